"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - weights . features): one weight per feature, shared across the ordered
thresholds. Features are the presence of words (lower-cased A-Z, letters and non-ASCII bytes), picked by the
z-score of their log-odds between toxic and other labelled texts. The result of a row is its expected grade,
its likeliest grade and P(grade >= 1).

Labels give 0 or 1; where no grades are given, a toxic training text's grade is 1, 2 or 3 by how many
distinct strongly toxic words (z of ``STRONG`` or more) it holds: up to one, two or three, more. The model is
fitted on at most ``per_class`` labelled rows of each class (the least by a hash of the id), weighted to the
classes' shares among all labels; the features of those rows are counted by Spark. Scoring covers whole
texts of all rows.

Null or empty text has no features. Labels with null ids or values are left out; of labels that disagree on
an id the highest grade counts. Without labels of both classes every row gets the classes' share. Repeated
rows score alike; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow, least_rows, written

PER_CLASS, FEATURES, LEAST_TEXTS, LEAST_Z, STRONG, PENALTY, STEPS = 6000, 4096, 4, 3.0, 5.0, 1e-5, 400
IS_WORD = np.zeros(256, bool)
IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _words(data, off, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word hash) of rows lo..hi."""
    buf, first = B.spaced(data, off, lo, hi)
    buf = B.LOWER[buf]
    s, e = B.words(buf, IS_WORD)
    return np.searchsorted(first, s, "right") - 1, B.span_hash(B.prefix_hash(buf), s, e).view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = B.text_bytes(batch.column(2))
        for lo, hi in B.blocks(off):
            row, h = _words(data, off, lo, hi)
            by = np.lexsort((h, row))
            row, h = row[by], h[by]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = row[new], h[new]
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(h))], ["sample", "grade", "words"])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Cumulative-link model: shared weights and ordered thresholds."""

    def __init__(self, n_features: int, grades: int):
        self.w = np.zeros(n_features)
        self.cuts = np.arange(grades - 1, dtype=float)

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        below = np.concatenate([sigmoid(self.cuts[None, :] - eta[:, None]), np.ones((len(eta), 1))], 1)
        return np.diff(below, axis=1, prepend=0.0)

    def fit(self, row: np.ndarray, col: np.ndarray, grade: np.ndarray, weight: np.ndarray, penalty: float = PENALTY,
            steps: int = STEPS) -> "Ordinal":
        """Maximum likelihood with an L2 penalty on the weights; full-batch Adam, first cut and log gaps."""
        n, k = len(grade), len(self.cuts)
        weight = weight / weight.sum()
        above = np.array([weight[grade > j].sum() for j in range(k)]).clip(1e-4, 1 - 1e-4)
        cuts = np.log((1 - above) / above)
        theta = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), .05)), self.w])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:k]))])
            w = theta[k:]
            eta = np.bincount(row, w[col], minlength=n)
            s = sigmoid(cuts[None, :] - eta[:, None])
            below = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], 1)
            d = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], 1)
            at = np.arange(n)
            p = np.maximum(below[at, grade + 1] - below[at, grade], 1e-12)
            up, down = d[at, grade + 1] / p, d[at, grade] / p
            g_cut = np.zeros(k + 2)
            np.add.at(g_cut, grade + 1, -weight * up)
            np.add.at(g_cut, grade, weight * down)
            g_cut = g_cut[1:-1]
            tail = np.cumsum(g_cut[::-1])[::-1]
            g_eta = weight * (up - down)
            grad = np.concatenate([[tail[0]], tail[1:] * np.exp(theta[1:k]),
                                   np.bincount(col, g_eta[row], minlength=len(w)) + penalty * w])
            m, v = .9 * m + .1 * grad, .999 * v + .001 * grad * grad
            theta = theta - .1 * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .999 ** step)) + 1e-9)
        self.cuts = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:k]))])
        self.w = theta[k:]
        return self


class Scorer:
    def __init__(self, words: np.ndarray, model: Ordinal):
        by = np.argsort(words)
        self.words, self.model = words[by], model
        model.w = model.w[by]

    def __call__(self, data, off, lo, hi) -> np.ndarray:
        row, h = _words(data, off, lo, hi)
        eta = np.zeros(hi - lo)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            pair = np.unique(row[hit] * len(self.words) + at[hit])
            eta = np.bincount(pair // len(self.words), self.model.w[pair % len(self.words)], minlength=hi - lo)
        return self.model.probabilities(eta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic",
        given: bool = False, per_class: int = PER_CLASS, features: int = FEATURES, least: int = LEAST_TEXTS,
        least_z: float = LEAST_Z, penalty: float = PENALTY) -> Scorer:
    """Fit on a bounded sample. ``given``: ``grade_col`` holds grades 0, 1, 2, ...; else it holds 0 or 1."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(grade_col)).cast("int").alias("grade")))
    known = known.withColumn("toxic", F.col("grade") > 0)
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = least_rows(known.withColumn("__h", F.xxhash64("__id")), "toxic", "__h", per_class).select("__id", "grade")
    rows = written(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
                   .join(F.broadcast(sample), "__id")  # at most 2 * per_class rows
                   .select(F.xxhash64("__id", "__text").alias("sample"), "grade", "__text", F.xxhash64("__id").alias("of"))
                   .groupBy("of").agg(F.min(F.struct("sample", "grade", "__text")).alias("one")).select("one.*")  # one row of an id
                   .transform(arrow, _features, "sample long, grade int, words array<long>"), "toxic")
    size = {r["t"]: r["n"] for r in rows.groupBy((F.col("grade") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(True, 0), size.get(False, 0)
    if not pos or not neg:
        one = Ordinal(0, 2)
        total = sum(share.values())
        p = (share.get(True, 0) + .5) / (total + 1)
        one.cuts = np.array([np.log((1 - p) / p)])
        return Scorer(np.zeros(0, np.int64), one)
    a, b = F.col("a") + .5, F.col("b") + .5
    z = F.log(a * (neg + 1 - b) / (b * (pos + 1 - a))) / F.sqrt(1 / a + 1 / b)
    counted = (rows.select((F.col("grade") > 0).alias("t"), F.explode("words").alias("word")).groupBy("word")
               .agg(F.count_if("t").alias("a"), F.count_if(~F.col("t")).alias("b")).where(F.col("a") + F.col("b") >= least)
               .withColumn("z", z).where(F.abs("z") >= least_z))
    picked = counted.orderBy(F.desc(F.abs("z")), "word").limit(features).select("word", "z").collect()
    words = np.array([r["word"] for r in picked], np.int64)
    strong = {r["word"] for r in picked if r["z"] >= STRONG}
    chosen = rows.select("sample", "grade", F.array_intersect("words", F.array(*(F.lit(int(w)) for w in words)))
                         .alias("words")) if len(words) <= 64 else rows.join(
        F.broadcast(counted.sparkSession.createDataFrame([([int(w) for w in words],)], "__w array<long>"))).select(
        "sample", "grade", F.array_intersect("words", "__w").alias("words"))
    taken = chosen.orderBy("sample").collect()  # at most 2 * per_class rows of picked words
    at = {w: i for i, w in enumerate(words.tolist())}
    grade = np.array([r["grade"] for r in taken])
    if not given:
        hits = np.array([sum(w in strong for w in r["words"]) for r in taken])
        grade = np.where(grade > 0, np.digitize(hits, [2, 4]) + 1, 0)
        ranks = np.unique(grade)
        grade = np.searchsorted(ranks, grade)  # no empty grade
    row = np.repeat(np.arange(len(taken)), [len(r["words"]) for r in taken])
    col = np.array([at[w] for r in taken for w in r["words"]], np.int64)
    weight = np.where(grade > 0, share[True] / pos, share[False] / neg)
    model = Ordinal(len(words), int(grade.max()) + 1).fit(row, col, grade, weight, penalty)
    return Scorer(words, model)


def _score(scorer, at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for batch in batches:
            data, off = B.text_bytes(batch.column("__text"))
            p = [s(data, off, lo, hi) for lo, hi in B.blocks(off)]
            p = np.concatenate(p) if p else np.zeros((0, len(s.model.cuts) + 1))
            keep = [c for c in batch.schema.names if c != "__text"]
            toxic = 1.0 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(p @ np.arange(p.shape[1])), pa.array(p.argmax(1), pa.int32()),
                 pa.array(toxic), pa.array(toxic >= at)], [*keep, "expected_severity", "grade", "p_toxic", "toxic"])
    return run


def severity(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", at: float = 0.5) -> DataFrame:
    """(id, expected_severity, grade, p_toxic, toxic) per row."""
    table = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
            .transform(arrow, _score(table, at), f"__id {kind}, expected_severity double, grade int, p_toxic double, toxic boolean")
            .withColumnRenamed("__id", id_col))
