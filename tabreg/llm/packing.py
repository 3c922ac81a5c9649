"""Best-fit packing by length patterns and non-negative least squares.

Every document becomes token ids and a closing id; one longer than a sequence is cut into full pieces (the
first piece takes the remainder). Only the histogram of piece lengths (one count per length, at most
``size`` numbers) reaches the driver. There all patterns of one to three lengths that fill a sequence are
enumerated (in steps of ``grain`` tokens: a piece counts as its length rounded up, so a pattern always fits),
their repeat counts are fitted to the histogram by non-negative least squares (accelerated projected gradient
over the patterns' few non-zeros), rounded down to what the histogram holds, and the residual pieces are
packed best-fit, longest first, as patterns of any number of pieces. The plan (a bounded table: pattern slots
per length) is sent back; the k-th piece of a length takes the k-th slot of its length.

Ranks within a length come from counts per (length, bucket of rows), so no task holds all pieces of a length.
Null text is empty (one closing id). Repeated rows are packed as often as they occur. An empty table gives no
rows. Ids are those of the tokenizer file; the rank file of the same vocabulary gives them faster and is used
where its result is the same (texts that name a special token, or that the rank file's pattern fails on, such as
a run of a million blanks, go through the tokenizer file itself).
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.shared import arrow, written

SIZE, END, GRAIN, PER_BUCKET = 2048, 0, 1, 20_000


class Encoder:
    """Ids of a text: by the rank file, or by the tokenizer file where a text may name a special token or that fails."""

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        self.file, self.whole, self.fast = tokenizer, None, None
        if ranks:
            import tiktoken
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def slow(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or "<|" in text:
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except ValueError:  # the pattern's stack overflows on very long runs of white space
            return self.slow(text)


_encoders: dict = {}


def encoder(tokenizer: str, ranks: str | None, pattern: str | None) -> Encoder:
    key = (tokenizer, ranks, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _cut(size: int, end: int, files: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*files)
        for batch in batches:
            src, cols = batch.column(1), ([], [], [], [], [])
            for i in range(len(batch)):
                ids = np.append(enc(src[i].as_py() or ""), np.uint32(end)).astype("<u4")
                n = len(ids)
                k = -(-n // size)
                head = n - (k - 1) * size
                for j in range(k):
                    a = 0 if j == 0 else head + (j - 1) * size
                    ln = head if j == 0 else size
                    for c, x in zip(cols, (i, j, a, ln, zlib.crc32(ids[a:a + ln]))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in cols[2:])], ["__id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, files: tuple, size: int = SIZE, end: int = END) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
            .transform(arrow, _cut(size, end, files), f"__id {kind}, piece int, start long, length long, ids_crc32 long"))


# ---- the plan (bounded: histogram in, pattern slots out) -----------------------------------------

def patterns(units: int) -> np.ndarray:
    """All ascending triples (a, b, c) with a + b + c = units; 0 stands for no piece."""
    a = np.arange(units // 3 + 1)
    out = [np.stack([np.full(len(b), x), b, units - x - b], 1)
           for x in a for b in [np.arange(x, (units - x) // 2 + 1)]]
    return np.concatenate(out)


def nnls(pats: np.ndarray, target: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that least miss the histogram; longer lengths weigh more."""
    flat, w = pats.ravel(), np.sqrt(np.arange(len(target)) + 1.0)
    w[0] = 0.0
    per = np.bincount(flat, minlength=len(target))
    scale = 1.0 / (3.0 * np.maximum((w ** 2 * per)[pats].max(1), 1.0))  # a step each, kept stable by the degrees
    x = np.zeros(len(pats))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        miss = np.bincount(flat, np.repeat(y, 3), minlength=len(target)) - target
        grad = (w ** 2 * miss)[pats].sum(1)
        new = np.maximum(y - scale * grad, 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray, size: int = SIZE, grain: int = GRAIN) -> list[tuple[tuple[int, ...], int]]:
    """[(piece lengths, repeats)] that use every piece of the histogram (hist[n]: pieces of n tokens) once."""
    hist = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if hist[size]:
        out.append(((size,), int(hist[size])))
        hist[size] = 0
    grain = max(g for g in range(1, grain + 1) if size % g == 0)
    units = size // grain
    unit = -(-np.arange(size + 1) // grain)
    coarse = np.bincount(unit, hist, minlength=units + 1).astype(np.int64)
    if coarse[1:].any():
        pats = patterns(units)
        have = coarse > 0
        have[0] = True
        pats = pats[have[pats].all(1)]
        if len(pats):
            x = nnls(pats, coarse.astype(float))
            left, classes = coarse.copy(), [[[n, int(hist[n])] for n in range(size, 0, -1) if unit[n] == u and hist[n]]
                                            for u in range(units + 1)]
            for i in np.argsort(-x, kind="stable"):
                want = int(np.floor(x[i] + .5))
                if want < 1:
                    break
                used = [int(u) for u in pats[i] if u]
                times = min([want, *(int(left[u]) // used.count(u) for u in used)])
                if times < 1:
                    continue
                for u in used:
                    left[u] -= times
                out += _concrete(classes, used, times)
            hist[:] = 0
            for c in classes:
                for n, k in c:
                    hist[n] += k
    out += best_fit(hist, size)
    return out


def _concrete(classes: list, used: list[int], times: int) -> list:
    """Exact lengths for ``times`` repeats of a coarse pattern, longest of each class first."""
    out = []
    while times:
        pick = [classes[u] for u in used]
        k = times
        for u in set(used):
            top = classes[u][0]
            k = min(k, top[1] // used.count(u)) if top[1] >= used.count(u) else 1
        lens = []
        if k >= 1 and all(classes[u][0][1] >= used.count(u) for u in used):
            for u in used:
                lens.append(classes[u][0][0])
            for u in used:
                classes[u][0][1] -= k
                if not classes[u][0][1]:
                    classes[u].pop(0)
        else:
            k = 1
            for c in pick:
                lens.append(c[0][0])
                c[0][1] -= 1
                if not c[0][1]:
                    c.pop(0)
        out.append((tuple(lens), k))
        times -= k
    return out


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each sequence filled with the longest piece that still fits, in repeats of whole patterns."""
    hist, out = hist.copy(), []
    lens = np.flatnonzero(hist)
    while len(lens):
        room, used, need = size, [], {}
        while True:
            fit = lens[:np.searchsorted(lens, room, "right")]
            fit = fit[::-1]
            n = next((int(f) for f in fit if hist[f] > need.get(int(f), 0)), None)
            if n is None:
                break
            used.append(n)
            need[n] = need.get(n, 0) + 1
            room -= n
        times = min(int(hist[n]) // k for n, k in need.items())
        for n, k in need.items():
            hist[n] -= k * times
        out.append((tuple(used), times))
        lens = lens[hist[lens] > 0]
    return out


def slots(plan_: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slot table sorted by (length, first rank): the sequence of the first rank and the offset there."""
    rows, seq = [], 0
    taken: dict[int, int] = {}
    for lens, times in plan_:
        at = 0
        for n in lens:
            rank = taken.get(n, 0)
            rows.append((n, rank, seq, at))
            taken[n] = rank + times
            at += n
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def _place(table):
    def run(batches):
        t = table.value
        key = t["length"] << 40 | t["rank"]
        for batch in batches:
            i = np.searchsorted(key, batch.column("length").to_numpy() << 40 | batch.column("rank").to_numpy(), "right") - 1
            seq = t["seq"][i] + batch.column("rank").to_numpy() - t["rank"][i]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(t["offset"][i])],
                                             [*keep, "sequence_id", "offset"])
    return run


def ranked(rows: DataFrame, by: str, order: list[str], per_bucket: int = PER_BUCKET) -> DataFrame:
    """``rows`` plus ``rank`` (long, from 0, gapless within each value of ``by``); no task holds a whole value."""
    total = rows.count()
    buckets = max(1, -(-total // per_bucket))
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(by, "__b").agg(F.count("*").alias("__n"))
    base = counts.selectExpr(by, "__b", f"sum(__n) over (partition by {by} order by __b) - __n as __base")
    local = dealt.selectExpr("*", f"row_number() over (partition by {by}, __b order by {', '.join(order)}) - 1 as __i")
    return local.join(base, [by, "__b"]).withColumn("rank", F.col("__base") + F.col("__i")).drop("__b", "__base", "__i")


def pack(docs: DataFrame, files: tuple, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         end: int = END, grain: int = GRAIN) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    ``files``: (tokenizer json, rank file of the same vocabulary or None, its split pattern or None).
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, files, size, end), "pieces")
    hist = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``size`` rows
        hist[r[0]] = r[1]
    table = spark.sparkContext.broadcast(slots(plan(hist, size, grain)))
    rows = ranked(cut, "length", ["__id", "piece", "start", "ids_crc32"])
    kind = cut.schema["__id"].dataType.simpleString()
    return (rows.select("__id", "piece", "start", "length", "ids_crc32", "rank")
            .transform(arrow, _place(table), f"__id {kind}, piece int, start long, length long, ids_crc32 long, "
                                       "sequence_id long, offset long")
            .withColumnRenamed("__id", id_col))
