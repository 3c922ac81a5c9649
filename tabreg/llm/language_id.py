"""Language ID by Bayesian evidence fusion.

Evidence for each known language: (1) the text's likelihood under byte-trigram models (hashed, smoothed; a
text counts as ``most_grams`` independent trigrams at most, since neighbours depend on each other); (2) the
declared markup language, by how often each language declares it; (3) a prior from the address: shares of
languages per host, smoothed towards its domain, that towards the address suffix, that towards all rows.
Shares and declarations are grouped aggregations of the texts' own posteriors over all rows; a row's own
share is taken out of its host prior. A background model (all buckets alike) stands for no known language.

Every labelled language has a trigram model, fitted on at most ``per_language`` of its rows (the least by a hash
of id and text), a documented bound; all else covers all rows. The driver and each task hold 128 KB per language.

A row is rejected if no known language gets ``min_posterior``. Null or empty texts, and texts under
one trigram, rest on the other evidence; without any, they are rejected. Null hosts, suffixes and
declarations give no evidence. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow, hot_join, least_rows, written

MOST_LABELS, SAID_BYTES = 1000, 16 << 20
BUCKETS, PER_LANGUAGE, MOST_GRAMS, MIN_POSTERIOR = 1 << 15, 2000, 200, 0.5
SMOOTH, PRIOR_WEIGHT, UNKNOWN = 0.05, 10.0, "und"


def _grams(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of rows lo..hi, and its row. Letters only count: other ASCII is a blank."""
    buf, first = B.spaced(data, off, lo, hi)
    buf = B.LOWER[buf]
    letter = (buf >= 0x80) | ((buf >= 0x61) & (buf <= 0x7A))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    keep[first - 1] = True
    new = np.cumsum(keep) - 1
    x = np.where(letter, buf, 32)[keep].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    real = (x[1:-1] != 32) | ((x[:-2] != 32) & (x[2:] != 32))
    row = np.searchsorted(new[first - 1], np.arange(len(g)), "right") - 1
    real &= row == np.searchsorted(new[first - 1], np.arange(len(g)) + 1, "right") - 1
    return ((g[real] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64), row[real]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, off = B.text_bytes(batch.column(1))
        for lo, hi in B.blocks(off):
            names = sorted(set(langs[lo:hi]))
            at = {x: i for i, x in enumerate(names)}
            code = np.array([at[x] for x in langs[lo:hi]])
            g, row = _grams(data, off, lo, hi)
            u, n = np.unique(code[row] * BUCKETS + g, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in u // BUCKETS], pa.string()),
                                              pa.array(u % BUCKETS, pa.int32()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def _log_row(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-likelihood of each bucket from the counts of those that occur."""
    row = np.full(BUCKETS, SMOOTH)
    row[gram] += n
    return np.log(row / row.sum()).astype(np.float32)


def _log_rows(counts: pa.Table) -> pa.Table:
    row = _log_row(counts.column("gram").to_numpy(), counts.column("n").to_numpy())
    return pa.table({"lang": counts.column("lang").slice(0, 1), "row": pa.array([row.tobytes()], pa.binary())})


class Model:
    """Log-likelihood table: languages by buckets, the last row for no known language."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """Fit the trigram models on a bounded sample of labelled rows (null labels are left out)."""
    src = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    n = src.select("lang").distinct().count()
    if n > MOST_LABELS:
        raise ValueError(f"{n} language labels; {MOST_LABELS} at most (a model of {BUCKETS * 4 >> 10} KB each)")
    ids = least_rows(src.select("lang", "h").distinct(), "lang", "h", per_language)
    # at most per_language rows of each language: of rows that repeat, one
    sample = src.join(F.broadcast(ids), ["lang", "h"]).dropDuplicates(["lang", "h"])
    counts = (sample.select("lang", "text").transform(arrow, _count, "lang string, gram int, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # a group holds a language's buckets, BUCKETS rows at most
    rows = sorted(counts.groupBy("lang").applyInArrow(_log_rows, "lang string, row binary").collect())
    none = np.zeros(0, np.int64)
    return Model([r["lang"] for r in rows],
                 np.stack([*(np.frombuffer(r["row"], np.float32) for r in rows), _log_row(none, none)]))


def _likelihood(model, most_grams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value.table
        for batch in batches:
            data, off = B.text_bytes(batch.column("__text"))
            ll = np.zeros((len(batch), len(table)))
            n = np.zeros(len(batch), np.int64)
            for lo, hi in B.blocks(off):
                g, row = _grams(data, off, lo, hi)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                for k in range(len(table)):
                    ll[lo:hi, k] = np.bincount(row, table[k][g], minlength=hi - lo)
            ll *= np.minimum(1.0, most_grams / np.maximum(n, 1))[:, None]
            keep = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel())),
                 pa.array(n)], [*keep, "__ll", "__grams"])
    return run


def _softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _shares(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Sums of the posteriors per group, as an array."""
    sums = rows.groupBy(*by).agg(*(F.sum(F.col("__post")[i]).alias(f"__s{i}") for i in range(k)))
    return sums.select(*by, F.array(*(F.col(f"__s{i}") for i in range(k))).alias("__n"))


def _smoothed(n: Column, parent: Column, weight: float) -> Column:
    total = F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(n, parent, lambda x, p: (x + weight * p) / (total + weight))


def _row_key(*cols: str | None) -> Column:
    """Identity of a row by all that its verdict rests on; a null counts apart from every value."""
    return F.xxhash64(*(x for c in cols for x in ((F.col(c).isNull(), F.col(c)) if c else (F.lit(True),)))).alias("row_key")


def identify(rows: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", host_col: str | None = None,
             domain_col: str | None = None, suffix_col: str | None = None, declared_col: str | None = None,
             most_grams: int = MOST_GRAMS, prior_weight: float = PRIOR_WEIGHT, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(row_key, id, language, posterior, text_language, n_grams, accepted) per row; row_key is that of id, text and evidence."""
    spark = rows.sparkSession
    k = len(model.langs) + 1
    names = F.array(*(F.lit(x) for x in [*model.langs, UNKNOWN]))
    kind = rows.schema[id_col].dataType.simpleString()
    opt = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    src = rows.select(F.col(id_col).alias("__id"), _row_key(id_col, text_col, host_col, domain_col, suffix_col, declared_col).alias("__key"),
                      opt(host_col).alias("__host"),
                      opt(domain_col).alias("__domain"), opt(suffix_col).alias("__suffix"),
                      F.lower(opt(declared_col)).alias("__declared"), F.col(text_col).alias("__text"))
    table = spark.sparkContext.broadcast(model)
    seen = src.transform(arrow, _likelihood(table, most_grams), f"__id {kind}, __key long, __host string, __domain string, "
                          "__suffix string, __declared string, __ll array<double>, __grams long")
    flat = F.array(*(F.lit(0.0 if i < k - 1 else float(np.log(1e-3))) for i in range(k)))
    seen = written(seen.withColumn("__post", _softmax(F.zip_with("__ll", flat, lambda a, b: a + b))), "lang")
    # grouped aggregations: all rows; suffix; domain; host; and declarations
    alike = F.array(*(F.lit(1.0 / k) for _ in range(k)))
    every = _shares(seen, [], k).select(
        _smoothed(F.coalesce(F.col("__n"), F.array(*(F.lit(0.0) for _ in range(k)))), alike, 1.0).alias("__all"))
    chain = _shares(seen, ["__suffix", "__domain", "__host"], k)
    add = lambda d, by: d.groupBy(*by).agg(F.array(*(F.sum(F.col("__n")[i]) for i in range(k))).alias("__n"))
    suffix = add(chain, ["__suffix"]).crossJoin(F.broadcast(every)).select(
        "__suffix", F.when(F.col("__suffix").isNull(), F.col("__all")).otherwise(_smoothed(F.col("__n"), F.col("__all"), prior_weight)).alias("__p1"))
    domain = add(chain, ["__suffix", "__domain"]).withColumnsRenamed({"__suffix": "__s"}).join(
        suffix, F.col("__s").eqNullSafe(F.col("__suffix"))).select(
        "__suffix", "__domain", F.when(F.col("__domain").isNull(), F.col("__p1")).otherwise(_smoothed(F.col("__n"), F.col("__p1"), prior_weight)).alias("__p2"))
    host = chain.withColumnsRenamed({"__suffix": "__s", "__domain": "__d"}).join(
        domain, F.col("__s").eqNullSafe(F.col("__suffix")) & F.col("__d").eqNullSafe(F.col("__domain"))).select(
        F.xxhash64("__s", "__d", "__host").alias("__place"), F.col("__n").alias("__host_n"), "__p2",
        F.round(F.aggregate("__n", F.lit(0.0), lambda a, b: a + b)).cast("long").alias("__rows"))  # posteriors of a row sum to 1
    said = _shares(seen.where("__declared is not null"), ["__declared"], k).crossJoin(F.broadcast(every)).crossJoin(
        F.broadcast(_shares(seen.where("__declared is not null"), [], k).select(F.col("__n").alias("__total")))).select(
        F.col("__declared").alias("__say"),
        F.transform(F.arrays_zip("__n", "__total"), lambda x: F.log((x["__n"] + 0.1) / (x["__total"] + 1.0))).alias("__log_said"))
    said = written(said, "said")
    if said.count() * k * 8 <= SAID_BYTES:
        said = F.broadcast(said)
    placed = seen.withColumn("__place", F.xxhash64("__suffix", "__domain", "__host"))
    fused = (hot_join(placed, written(host, "host"), "__place", "__rows", seen.count())
             .join(said, F.col("__declared") == F.col("__say"), "left"))
    own = F.zip_with("__host_n", "__post", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    prior = F.when(F.col("__host").isNull(), F.col("__p2")).otherwise(_smoothed(own, F.col("__p2"), prior_weight))
    zero = F.array(*(F.lit(0.0) for _ in range(k)))
    logp = F.zip_with(F.zip_with("__ll", F.transform(prior, lambda p: F.log(F.greatest(p, F.lit(1e-9)))), lambda a, b: a + b),
                      F.coalesce("__log_said", zero), lambda a, b: a + b)
    bare = (F.col("__grams") == 0) & F.col("__host").isNull() & F.col("__suffix").isNull() & F.col("__declared").isNull()
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    out = fused.withColumn("__final", _softmax(logp)).select(
        F.col("__key").alias("row_key"), F.col("__id").alias("id"), best(F.col("__final")).alias("language"),
        F.array_max("__final").alias("posterior"), F.when(F.col("__grams") > 0, best(F.col("__post"))).alias("text_language"),
        F.col("__grams").alias("n_grams"), bare.alias("__bare"))
    return out.withColumn("language", F.when(F.col("__bare"), UNKNOWN).otherwise(F.col("language"))).withColumn(
        "accepted", (F.col("language") != UNKNOWN) & (F.col("posterior") >= min_posterior)).drop("__bare")


def keep_known(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", **evidence) -> DataFrame:
    """``docs`` without the rows that are rejected, columns as they were."""
    judged = identify(docs, model, text_col, id_col, **evidence)
    gone = written(judged.where("not accepted").select("row_key").distinct(), "rejected")
    key = _row_key(id_col, text_col, *(evidence.get(f"{c}_col") for c in ("host", "domain", "suffix", "declared")))
    return (docs.withColumn("__row_key", key)
            .join(gone.select(F.col("row_key").alias("__row_key")), "__row_key", "left_anti").drop("__row_key"))


def address(url: Column) -> dict[str, Column]:
    """Host, registered domain (last two labels) and suffix (last label) of an address; null without ``://``."""
    host = F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1))
    host = F.when(host != "", host)
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def markup(html: Column) -> dict[str, Column]:
    """The declared language (primary subtag) and the bare text of a page."""
    said = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return {"declared": F.when(said != "", F.lower(said)), "text": F.regexp_replace(text, r"<[^>]*>", " ")}
