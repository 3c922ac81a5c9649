"""Cross-tokenizer alignment: which ids of one tokenizer stand where ids of another do.

Both tokenizers encode a document (A sees a space and the text, B adds that space itself). Byte offsets where
tokens of both end cut the document into groups; tokens of A and B in one group are linked, each with each. The
number of documents that hold a pair of ids linked is the pair's count.

Method: identity-map fast path. An array gives for each A id the B id of the same bytes. A group of one A
token and one B token that the array foretells is counted by its A id alone: tasks add documents into a vector
as long as the vocabulary, and only these vectors are merged. All other pairs (irregular groups) are made distinct
per document and pre-counted per batch before they shuffle; a pair that the array foretells is moved to the
vector wherever it turns up, so each pair is counted in one place. Documents are encoded once, into a
written table of their distinct links with multiplicities.

Per-document sums look counts up in vocabulary-length vectors, and those of irregular pairs in a broadcast table if
there are ``broadcast_pairs`` at most, else by a join (pairs that many documents hold by broadcast, see ``hot_join``).

Results: documents without tokens (null or empty text, or tokens whose bytes don't give back the text, such as one
that holds U+2581) have zeros and an empty digest; repeated rows are documents each; an empty table gives no
rows; columns other than id and text are not read. Text that names a special token is plain text. Large
irregular groups are multiplied out by distinct ids, in slices.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow, hot_join, written

BROADCAST_PAIRS = 2_000_000
_BLOCK, _SLICE = 1 << 20, 1 << 21


class Vocabulary:
    """Bytes of all ids, in one pool."""

    def __init__(self, entries: list[bytes]):
        self.size = len(entries)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[B.spans_to_indices(self.start[ids], self.length[ids])]


class Pair:
    """Both tokenizers, their vocabularies, and the identity map."""

    def __init__(self, json_file: str, ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.file, self.whole = json_file, None
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        spelled = [b""] * (max(table.values()) + 1)
        for k, v in table.items():
            spelled[v] = k
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        other, single = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            single.append(self.b.is_byte(i))
            other.append(bytes([int(piece[3:5], 16)]) if single[-1] else piece.replace("▁", " ").encode())
        self.va, self.vb = Vocabulary(spelled), Vocabulary(other)
        of = {}
        for i in sorted(range(len(other)), key=lambda i: (single[i], i)):  # whole pieces before single bytes
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of.setdefault(other[i], i)
        self.same = np.array([of.get(e, -1) if e else -1 for e in spelled], np.int64)

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # the pattern's stack overflows on very long runs of white space
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.file)
                self.whole.encode_special_tokens = True
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return [self.encode_a(" " + t) for t in texts], [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]


_pairs: dict = {}


def pair(files: tuple[str, str, str, str]) -> Pair:
    if files not in _pairs:
        _pairs[files] = Pair(*files)
    return _pairs[files]


_DIGITS = Vocabulary([str(i).encode() for i in range(1 << 16)])


def _joined(a, b, ga, gb, na, nb) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text, ids in decimal, each with the sign that follows it; and the end of each token's part."""
    n = len(a) + len(b)
    before_b, before_a = np.cumsum(nb) - nb, np.cumsum(na)
    pa_, pb_ = np.arange(len(a)) + before_b[ga], np.arange(len(b)) + before_a[gb]
    ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[pa_], ids[pb_] = a, b
    sign[np.cumsum(na) + before_b - 1] = ord("|")
    sign[np.cumsum(na + nb) - 1] = ord(";")
    size = _DIGITS.length[ids] + 1
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    digit = np.ones(len(out), bool)
    digit[ends - 1] = False
    out[ends - 1] = sign
    out[digit] = _DIGITS.spell(ids)
    return out, ends


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their times."""
    if not len(keys):
        return keys, times
    by = np.argsort(keys, kind="stable")
    keys, times = keys[by], times[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first)


def _irregular(a, b, na, nb, groups, doc) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the given groups as (document << 32 | A id << 16 | B id) and how often each is linked."""
    sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
    links = na[groups] * nb[groups]
    keys, times = [], []
    for g in groups[links > _SLICE]:
        xa, ta = np.unique(a[sa[g]:sa[g] + na[g]], return_counts=True)
        xb, tb = np.unique(b[sb[g]:sb[g] + nb[g]], return_counts=True)
        step = max(1, _SLICE // len(xb))
        for i in range(0, len(xa), step):
            keys.append(((doc[g] << 32) | (xa[i:i + step, None] << 16) | xb[None, :]).ravel())
            times.append((ta[i:i + step, None] * tb[None, :]).ravel())
    groups, links = groups[links <= _SLICE], links[links <= _SLICE]
    total = np.cumsum(links)
    lo = 0
    while lo < len(groups):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _SLICE, "right")))
        g = groups[lo:hi]
        i = B.spans_to_indices(sa[g], na[g])  # A tokens of these groups
        of = np.repeat(g, na[g])
        j = B.spans_to_indices(sb[of], nb[of])
        k, t = np.unique((np.repeat(doc[of], nb[of]) << 32) | (np.repeat(a[i], nb[of]) << 16) | b[j], return_counts=True)
        keys.append(k)
        times.append(t)
        lo = hi
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _counted(np.concatenate(keys), np.concatenate(times))


def _lists(doc: np.ndarray, values: np.ndarray, n: int, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


LINKS = ("id {0}, rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "same array<int>, same_times array<long>, pairs array<long>, times array<long>")


def _align(files: tuple):
    def block(batch, texts: list, p: Pair) -> pa.RecordBatch:
        n = len(texts)
        ea, eb = p.encode([t or "" for t in texts])
        good = np.zeros(n, bool)
        for i, t in enumerate(texts):
            if t:
                raw = np.frombuffer(b" " + t.encode(), np.uint8)
                good[i] = np.array_equal(p.va.spell(ea[i]), raw) and np.array_equal(p.vb.spell(eb[i]), raw)
        none = np.zeros(0, np.int64)
        ea, eb = [x if g else none for x, g in zip(ea, good)], [x if g else none for x, g in zip(eb, good)]
        n_a, n_b = np.array([len(x) for x in ea], np.int64), np.array([len(x) for x in eb], np.int64)
        a, b = np.concatenate([none, *ea]), np.concatenate([none, *eb])
        end_a, end_b = np.cumsum(p.va.length[a]), np.cumsum(p.vb.length[b])
        cut = end_a[np.isin(end_a, end_b, assume_unique=True)]
        ga, gb = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        na, nb = np.bincount(ga, minlength=len(cut)), np.bincount(gb, minlength=len(cut))
        sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
        doc_a = np.repeat(np.arange(n), n_a)
        doc = doc_a[sa] if len(cut) else none
        n_groups = np.bincount(doc, minlength=n)
        n_links = np.bincount(doc, na * nb, minlength=n).astype(np.int64) if len(cut) else np.zeros(n, np.int64)
        text, ends = _joined(a, b, ga, gb, na, nb)
        close = np.cumsum(n_a + n_b)
        shas, lo = [], 0
        for i in range(n):
            if not good[i]:
                shas.append("")
                continue
            hi = int(ends[close[i] - 1])
            shas.append(hashlib.sha256(text[lo:hi - 1]).hexdigest())  # without the last sign
            lo = hi
        regular = (na == 1) & (nb == 1)
        regular[regular] = p.same[a[sa[regular]]] == b[sb[regular]]
        keys, times = _irregular(a, b, na, nb, np.flatnonzero(~regular), doc)
        foretold = p.same[(keys >> 16) & 0xFFFF] == (keys & 0xFFFF)
        first = (doc[regular] << 16) | a[sa[regular]]
        same, same_times = _counted(np.concatenate([first, keys[foretold] >> 16]),
                                    np.concatenate([np.ones(len(first), np.int64), times[foretold]]))
        keys, times = keys[~foretold], times[~foretold]
        at = pa.array
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("rid"), at(n_a), at(n_b), at(n_groups), at(n_links), at(shas, pa.string()),
             _lists(same >> 16, same & 0xFFFF, n, pa.int32()), _lists(same >> 16, same_times, n, pa.int64()),
             _lists(keys >> 32, keys & 0xFFFFFFFF, n, pa.int64()), _lists(keys >> 32, times, n, pa.int64())],
            ["id", "rid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_times", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(files)
        for batch in batches:
            _, off = B.text_bytes(batch.column("text"))
            for lo, hi in B.blocks(off, _BLOCK):
                part = batch.slice(lo, hi - lo)
                yield block(part, part.column("text").to_pylist(), p)
    return run


def links(docs: DataFrame, files: tuple[str, str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: sizes, digest of its groups, and its distinct links with multiplicities. Written.

    ``files``: A's tokenizer file, the rank file of the same vocabulary and its split pattern, B's model file.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return written(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"),
                               F.col(text_col).cast("string").alias("text"))
                   .transform(arrow, _align(tuple(files)), LINKS.format(kind)), "links")


def _same_vector(batches):
    """Documents per A id of one task's identity links."""
    n = np.zeros(1 << 16, np.int64)
    for batch in batches:
        n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=1 << 16)
    a = np.flatnonzero(n)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(n[a])], ["a", "n"])


def _pair_counts(batches):
    for batch in batches:
        keys, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pair", "n"])


def same_counts(linked: DataFrame) -> DataFrame:
    """(a, n): documents that hold the A id linked with the B id of the same bytes."""
    return linked.select("same").transform(arrow, _same_vector, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n): documents that hold an irregular pair (A id << 16 | B id)."""
    return linked.select("pairs").transform(arrow, _pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def dictionary(linked: DataFrame, files: tuple[str, str, str, str]) -> DataFrame:
    """(a_id, b_id, n_docs, best): all linked pairs of the corpus with their counts; best: none of the A id's is higher."""
    spark = linked.sparkSession
    p = pair(tuple(files))
    same = spark.createDataFrame(pa.table({"a": pa.array(np.arange(p.va.size), pa.int32()), "b": pa.array(p.same, pa.int32())}))
    every = (same_counts(linked).join(F.broadcast(same), "a").select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), F.col("n").alias("n_docs"))
             .unionByName(pair_counts(linked).select(F.shiftright("pair", 16).cast("int").alias("a_id"),
                                                     F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b_id"), F.col("n").alias("n_docs"))))
    top = every.groupBy("a_id").agg(F.max("n_docs").alias("top"))  # a row per A id
    return every.join(F.broadcast(top), "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def _sums(vectors, pairs):
    """Sums over a document's links: of counts, and of links whose count is their A id's highest."""
    def run(batches):
        count, top = vectors.value
        known = pairs.value if pairs is not None else None
        for batch in batches:
            def per_doc(lists, values):
                o = lists.offsets.to_numpy()
                whole = np.concatenate([[0], np.cumsum(values)])
                return whole[o[1:] - o[0]] - whole[o[:-1] - o[0]]
            same = batch.column("same")
            a, times = same.flatten().to_numpy(), batch.column("same_times").flatten().to_numpy()
            total = per_doc(same, times * count[a])
            best = per_doc(same, times * (count[a] == top[a]))
            if known is not None:
                irregular = batch.column("pairs")
                key, times = irregular.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
                n = known[1][np.searchsorted(known[0], key)] if len(key) else key
                total = total + per_doc(irregular, times * n)
                best = best + per_doc(irregular, times * (n == top[key >> 16]))
            else:
                total = total + batch.column("more_sum").to_numpy()
                best = best + batch.column("more_best").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(best.astype(np.int64)),
                 pa.array(total.astype(np.int64)), batch.column("groups_sha256")],
                ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def digests(docs: DataFrame, files: tuple[str, str, str, str], id_col: str = "doc_id", text_col: str = "text",
            broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document its tokens, groups and links, and what the corpus-wide counts say about them."""
    sc = docs.sparkSession.sparkContext
    linked = links(docs, files, id_col, text_col)
    pairs = written(pair_counts(linked), "pairs")
    same = same_counts(linked).toArrow()  # a row per A id at most
    highest = pairs.groupBy(F.shiftright("pair", 16).cast("int").alias("a")).agg(F.max("n").alias("n")).toArrow()  # likewise
    count = np.zeros(1 << 16, np.int64)
    count[same.column("a").to_numpy()] = same.column("n").to_numpy()
    top = count.copy()
    np.maximum.at(top, highest.column("a").to_numpy(), highest.column("n").to_numpy())
    vectors = sc.broadcast((count, top))
    out = f"id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    if pairs.count() <= broadcast_pairs:
        t = pairs.orderBy("pair").toArrow()
        known = sc.broadcast((t.column("pair").to_numpy(), t.column("n").to_numpy()))
        done = linked.transform(arrow, _sums(vectors, known), out)
    else:
        tops = docs.sparkSession.createDataFrame(pa.table({"a": pa.array(np.arange(1 << 16), pa.int64()), "top": pa.array(top)}))
        judged = written(pairs.join(F.broadcast(tops), F.shiftright("pair", 16) == F.col("a"))
                         .select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "judged")
        each = written(linked.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
                       .select("rid", F.col("x.pairs").alias("pair"), "x.times"), "each")
        more = (hot_join(each, judged, "pair", "n", each.count()).groupBy("rid")
                .agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best")).alias("more_best")))
        done = (linked.drop("pairs", "times").join(more, "rid", "left").fillna(0, ["more_sum", "more_best"])
                .transform(arrow, _sums(vectors, None), out))
    return done.withColumnRenamed("id", id_col)
