"""Registered queries of the operators (production parameters, whole tables) and their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.llm import (align, bwt, golay, language_id, lattice, lines, lookup, merkle, packing, ppm, toxicity, url_trees,
                        wumanber)

#: Tokenizer files are named here alone; operators take them as parameters.
TOKENIZER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
             public_tokenizers.PATTERN)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: text, declared language, and its source as the host."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.fit(docs), host_col="source", declared_col="lang")
    return out.select(F.col("id").alias("doc_id"), "language", "posterior", "text_language", "n_grams", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page: bare text, markup language, and host, domain and suffix of its address."""
    model = language_id.fit(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", *(c.alias(n) for n, c in language_id.address(F.col("url")).items()),
                        *(c.alias(n) for n, c in language_id.markup(F.col("html")).items()))
    out = language_id.identify(rows, model, id_col="page_id", host_col="host", domain_col="domain",
                               suffix_col="suffix", declared_col="declared")
    return out.select(F.col("id").alias("page_id"), "language", "posterior", "text_language", "n_grams", "accepted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.93 within a label."""
    return lattice.digests(table(spark, sf_dir, "embeddings"))


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and components of links at 4 or fewer bits."""
    return golay.digests(table(spark, sf_dir, "documents"))


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document under the byte-context model, and the word base beside it."""
    return ppm.digests(table(spark, sf_dir, "documents"))


def op7_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document by its id."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return lookup.place(docs, "doc_id", lookup.shard_names())


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address: rules, then boosted trees fitted on the addresses that rules decide."""
    pages = table(spark, sf_dir, "pages")
    return url_trees.verdicts(pages, url_trees.fit(url_trees.rule_labels(pages)))


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what is left without the bytes of repeated 200-byte strings."""
    return bwt.digests(table(spark, sf_dir, "documents"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words in benchmark windows, and whether it is contaminated."""
    return wumanber.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_two_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, those that other documents hold too, and a digest of the rest."""
    return lines.digests(table(spark, sf_dir, "documents"))


def op12_jump_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents by language, checked against tampered rows."""
    return merkle.digests(table(spark, sf_dir, "documents"))


def op13_identity_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the tokens of two tokenizers in every document, and how common they are in the corpus."""
    return align.digests(table(spark, sf_dir, "documents"), (*TOKENIZER, PIECES))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_lattice_dedup, op4_pattern_packing, op5_golay_simhash,
                                   op6_ppm_score, op7_lookup_shards, op8_url_trees, op9_bwt_dedup, op10_wu_manber,
                                   op11_two_bloom_lines, op12_jump_manifest, op13_identity_align, language_id_pages)}

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_N = lookup.SHARDS
_M = lookup.prime_from(lookup.PER_SHARD * _N)

ORACLE = {
    "op3_lattice_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
), u AS (
  SELECT r, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))
), l AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM u a JOIN u b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
   AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT r AS a, r AS b FROM u UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b
), comp AS (
  SELECT reach.a AS r, min(u.vec_id) AS component_id FROM reach JOIN u ON u.r = reach.b GROUP BY 1
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links,
       coalesce(comp.component_id, v.vec_id) AS component_id,
       v.vec_id = coalesce(comp.component_id, v.vec_id) AS kept
FROM v LEFT JOIN comp ON comp.r = v.r""",
    "op7_lookup_shards": f"""
WITH RECURSIVE prefs AS (
  SELECT i::INT AS i, (('0x' || substr(md5(printf('shard-%04d/offset', i::INT)), 1, 15))::BIGINT % {_M}) AS o,
         (('0x' || substr(md5(printf('shard-%04d/skip', i::INT)), 1, 15))::BIGINT % {_M - 1} + 1) AS k
  FROM range({_N}) t(i)
), p AS (SELECT list(o ORDER BY i) AS o, list(k ORDER BY i) AS k FROM prefs
), fill AS (
  SELECT 0 AS step, list_transform(range({_M}), lambda x: -1) AS owner FROM p
  UNION ALL
  SELECT step + 1, list_transform(owner, lambda x, s: CASE WHEN s - 1 = slot THEN (step % {_N})::INT ELSE x END)
  FROM (SELECT step, owner, list_filter(list_transform(range({_M}), lambda j: (p.o[step % {_N} + 1] + j * p.k[step % {_N} + 1]) % {_M}),
                                        lambda s: owner[s + 1] = -1)[1] AS slot
        FROM fill, p WHERE step < {_M})
), t AS (SELECT unnest(range({_M}))::INT AS slot, unnest(owner) AS i FROM fill WHERE step = {_M})
SELECT d.doc_id, t.slot, printf('shard-%04d', t.i) AS shard
FROM documents d JOIN t ON t.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {_M}""",
    "op10_wu_manber": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, w[s:s + 12] AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT r, s, n, w[s:s + n - 1] AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM d, (SELECT DISTINCT len(x) AS n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r, s, n, item FROM dw JOIN win USING (x)
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op11_two_bloom_lines": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_A_Z}) AS key FROM l
), often AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5
), g AS (
  SELECT k.*, often.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id""",
    "op12_jump_manifest": f"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source::VARCHAR) || ':' || source::VARCHAR, '-') || coalesce(strlen(lang::VARCHAR) || ':' || lang::VARCHAR, '-') AS a, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS n0, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS n1, coalesce(strlen(text::VARCHAR) || ':' || text::VARCHAR, '-') AS z
  FROM documents
), bits AS (
  SELECT r, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS b FROM f WHERE doc_id IS NOT NULL
), crc AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z:
      CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS c FROM bits
), leaf AS (
  SELECT f.r, doc_id, lang, sha256(a || n0 || z) AS leaf,
         sha256(a || CASE WHEN coalesce(c % 7 = 0, false) THEN n1 ELSE n0 END || z) AS shown FROM f LEFT JOIN crc USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf
), low AS (
  SELECT lang, 0 AS lv, list(leaf ORDER BY idx) AS a FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, lv + 1, list_transform(range((len(a) + 1) // 2), lambda i: sha256(a[2 * i + 1] || coalesce(a[2 * i + 2], '')))
  FROM low WHERE len(a) > 1
), subs AS (
  SELECT lang, a[1] AS subroot, row_number() OVER (ORDER BY lang COLLATE C NULLS FIRST) - 1 AS t FROM low WHERE len(a) = 1
), high AS (
  SELECT 0 AS lv, list(subroot ORDER BY t) AS a FROM subs
  UNION ALL
  SELECT lv + 1, list_transform(range((len(a) + 1) // 2), lambda i: sha256(a[2 * i + 1] || coalesce(a[2 * i + 2], '')))
  FROM high WHERE len(a) > 1
), steps AS (
  SELECT r, lv AS s, a[xor(idx >> lv, 1) + 1] AS sib, (idx >> lv) & 1 AS odd FROM placed JOIN low ON placed.lang IS NOT DISTINCT FROM low.lang AND len(a) > 1
  UNION ALL
  SELECT r, 100 + lv, a[xor(t >> lv, 1) + 1], (t >> lv) & 1 FROM placed JOIN subs ON placed.lang IS NOT DISTINCT FROM subs.lang JOIN high ON len(a) > 1
), proof AS (
  SELECT r, sha256(string_agg(coalesce(sib, ''), '' ORDER BY s)) AS p, list({{'sib': sib, 'odd': odd}} ORDER BY s) AS path FROM steps GROUP BY r
), fold AS (
  SELECT placed.r, shown AS h, 0 AS k, path FROM placed LEFT JOIN proof USING (r)
  UNION ALL
  SELECT r, CASE WHEN path[k + 1].sib IS NULL THEN sha256(h) WHEN path[k + 1].odd = 1 THEN sha256(path[k + 1].sib || h)
            ELSE sha256(h || path[k + 1].sib) END, k + 1, path FROM fold WHERE k < coalesce(len(path), 0)
)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN subs ON placed.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN (SELECT a[1] AS root FROM high WHERE len(a) = 1)
LEFT JOIN proof USING (r) JOIN fold ON fold.r = placed.r AND fold.k = coalesce(len(fold.path), 0)""",
}
