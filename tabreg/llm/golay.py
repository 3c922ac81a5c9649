"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes of its word
shingles. Fingerprints link at ``max_bits`` = 4 or fewer differing bits. The three segments (22, 21, 21 bits)
are read as words of the perfect binary Golay code [23, 12]: a segment and its one-bit neighbours decode to at
most six codeword indices. By the pigeonhole principle four differing bits leave either a segment without
any, or two segments with one bit each. The first kind meets under the segment itself; the second under a
pair of indices, since each one's index is among the other's nearby ones: every fingerprint is filed under
(nearby index, own index) and (own index, nearby index) of each pair of segments. All that meet are compared.

Works on distinct fingerprints (copies cost one count), in bounded blocks, and emits only a spanning forest
of each block; components come from ``shared.components``. Null or empty text: fingerprint zero, linked like
any other. Repeated rows share a component. Null ids count for nothing when the smallest id is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm import buckets
from tabreg.llm.shared import arrow, components, written

SHINGLE, MAX_BITS, SEED = 4, 4, 42
CAP = 2048
_U = np.uint64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GEN = 0xC75  # generator polynomial of the [23, 12] Golay code (fixed value)


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each single bit, and the correctable error (up to 3 bits) of each of 2048 syndromes."""
    bits = []
    for i in range(23):
        x = 1 << i
        for d in range(22, 10, -1):
            if x >> d & 1:
                x ^= _GEN << (d - 11)
        bits.append(x)
    err = np.zeros(2048, np.int64)
    for i in range(23):
        err[bits[i]] = 1 << i
        for j in range(i):
            err[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                err[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return np.array(bits, np.int64), err


_BIT, _ERR = _syndromes()


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word: its bits above the check bits."""
    s = np.zeros(len(x), np.int64)
    for i in range(23):
        s ^= np.where(x >> i & 1, _BIT[i], 0)
    return (x ^ _ERR[s]) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) under which fingerprints with at most 4 differing bits meet."""
    rows, out, own, near = [], [], [], []
    n = len(fp)
    for t, (at, width) in enumerate(SEGMENTS):
        seg = (fp >> _U(at) & _U((1 << width) - 1)).astype(np.int64)
        rows.append(np.arange(n))
        out.append(seg | t << 32)
        own.append(decode(seg))
        near.append(np.stack([own[t], *(decode(seg ^ (1 << b)) for b in range(width))], 1))
    for t, (i, j) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        both = np.concatenate([near[i] << 12 | own[j][:, None], own[i][:, None] << 12 | near[j]], 1)
        both.sort(1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        out.append(both[r, c] | t << 32)
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    w = text.lower().split()  # ASCII letters and the six ASCII blanks, as bytes do
    if not w:
        return 0
    norm = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    k = min(shingle, len(w))
    starts = np.concatenate([[0], ends[:-1]])[:len(w) - k + 1].tolist()
    ends = (ends[k - 1:] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(norm[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    cols = h.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(cols[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(h)).tolist()))


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.text_bytes(batch.column("__text"))
            o = off.tolist()
            fp = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(o, o[1:])], np.uint64)
            rest = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp.view(np.int64))], [*rest, "__fp"])
    return run


def _marks(text_col: str) -> dict[str, Column]:
    """128 bits of a text, by which a row is known again beside its id."""
    return {f"__mark{i}": F.xxhash64(F.lit(i), F.col(text_col)) for i in (1, 2)}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 marks: bool = False) -> DataFrame:
    """(id, fp): the signed 64-bit value of each document's fingerprint; with ``marks``, those of its text too."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = _marks(text_col) if marks else {}
    return (docs.select(F.col(id_col).alias("__id"), *(c.alias(n) for n, c in more.items()), F.col(text_col).alias("__text"))
            .transform(arrow, _fingerprints(shingle), f"__id {kind}, {''.join(f'{n} long, ' for n in more)}__fp long")
            .select(F.col("__id").alias("id"), F.col("__fp").alias("fp"), *more))


def _file(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for a in range(0, len(fp), 20_000):
            r, k = keys(fp[a:a + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[a + r].view(np.int64))], ["key", "fp"])


def _compare(max_bits: int):
    def run(batches):
        for batch in buckets.groups(batches, 50_000):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            us, vs = [], []
            for i, j in buckets.pairs(batch):
                near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                us.append(i[near])
                vs.append(j[near])
            if us:
                lab = B.forest(np.concatenate(us), np.concatenate(vs), len(fp))
                i = np.flatnonzero(lab != np.arange(len(fp)))
                s = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s[i]), pa.array(s[lab[i]])], ["u", "v"])
    return run


def linked(fps: DataFrame, max_bits: int = MAX_BITS, cap: int = CAP) -> DataFrame:
    """(fp, root): component of every fingerprint that links with another. ``fps`` holds distinct ones."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the codes cover up to 4 differing bits")
    reg = fps.select("fp").transform(arrow, _file, "key long, fp long")
    dealt = buckets.split_hot(reg, cap, "fp").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    edges = dealt.transform(arrow, _compare(max_bits), "u long, v long").distinct()
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, cap: int = CAP, marks: bool = False) -> DataFrame:
    """(id, fp, root, component_id) per row, with ``marks`` also those of ``fingerprints``.

    root is a fingerprint that stands for the component; component_id is the smallest id reachable by links, null
    if there is none.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle, marks), "fp")
    each = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = linked(each, max_bits, cap)
    each = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = each.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(each.join(low, "root").select("fp", "root", "component_id"), "fp").select(
        "id", "fp", "root", "component_id", *(_marks(text_col) if marks else ()))


def digests(docs: DataFrame, **how) -> DataFrame:
    return near_duplicates(docs, **how).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (of repeated ids, one by content).

    Rows with a null id stay only if their component has no id at all; one such row stays then. Rows are known by
    id and text, so an id that several components share keeps a row in each of which it is the smallest.
    """
    near = near_duplicates(docs.select(id_col, text_col), id_col, text_col, marks=True, **how)
    marks = _marks(text_col)
    least = written(near.where(F.col("id").eqNullSafe(F.col("component_id"))).select("root", "id", *marks), "least")
    shared = written(least.groupBy("root").count().where("count > 1").select("root"), "shared")
    # plain exchanges on both sides of both joins: copies that share id and text can split
    pick = written(least.distinct().join(shared.withColumn("__several", F.lit(True)), "root", "left").select(
        F.col("root").alias("__root"), F.col("id").alias("__id"), *(F.col(m).alias(f"{m}_") for m in marks), "__several"), "pick")
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    for m in marks:
        same &= F.col(m) == F.col(f"{m}_")
    kept = docs.withColumns(marks).join(pick, same)
    single = kept.where("__several is null").select(*docs.columns)
    # a smallest id that several rows of a component share: one of them, the least by content
    several = kept.where("__several").groupBy("__root").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return single.unionByName(several.select("__row.*"))
