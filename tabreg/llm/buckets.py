"""Bucket joins with hot buckets split: pairs are looked at in bounded blocks and never emitted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B


def split_hot(reg: DataFrame, cap: int, member: str, keys: DataFrame | None = None) -> DataFrame:
    """Rows (key, member, ...) dealt to groups (key, bi, bj) so that every pair of a key meets in a group.

    A key of more than ``cap`` rows is cut into blocks by a hash of ``member``; each pair of blocks is a
    group of its own, so groups stay near 2 * cap rows and none is left out. ``keys``: the key column alone,
    if it comes cheaper than from ``reg``.
    """
    hot = ((reg if keys is None else keys).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cap)
           .select("key", F.ceil(F.col("n") / cap).cast("int").alias("nb")))
    nb = F.coalesce(F.col("nb"), F.lit(1))
    return (reg.join(hot, "key", "left")
            .withColumn("me", F.pmod(F.xxhash64(F.col(member), F.lit(11)), nb).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), nb - 1)))
            .select(*reg.columns, "me", F.least("me", "other").alias("bi"), F.greatest("me", "other").alias("bj")))


def groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rebatch a partition sorted by (key, bi, bj) at group borders, near ``rows`` rows each."""
    def borders(b):
        k = [b.column(c).to_numpy() for c in ("key", "bi", "bj")]
        new = np.ones(len(b), bool)
        new[1:] = (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])
        return np.flatnonzero(new)

    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            heads = borders(whole)
            a = 0
            while len(whole) - a >= rows:
                cut = heads[(heads > a) & (heads <= a + rows)]
                if not len(cut):  # one group is larger than a batch
                    cut = heads[heads > a][:1]
                    if not len(cut):
                        break
                yield whole.slice(a, int(cut[-1]) - a)
                a = int(cut[-1])
            held = [whole.slice(a)]
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def large(batch: pa.RecordBatch, over: int) -> list[tuple[int, int, bool]]:
    """(first row, end, across blocks) of the groups of more than ``over`` rows."""
    k = [batch.column(c).to_numpy() for c in ("key", "bi", "bj")]
    new = np.ones(len(batch), bool)
    new[1:] = (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])
    heads = np.append(np.flatnonzero(new), len(batch))
    return [(int(a), int(b), bool(k[1][a] != k[2][a])) for a, b in zip(heads, heads[1:]) if b - a > over]


def pairs(batch: pa.RecordBatch, most: int = 1 << 20, upto: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Local pairs i < j of each group: all of a group (b, b), those across the blocks of a group (a, b).
    Groups of more than ``upto`` rows (if given) are left to the caller."""
    k = [batch.column(c).to_numpy() for c in ("key", "bi", "bj")]
    me = batch.column("me").to_numpy()
    n = len(me)
    new = np.ones(n, bool)
    new[1:] = (k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])
    heads = np.flatnonzero(new)
    end = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))
    after = end - np.arange(n) - 1
    if upto is not None:
        size = np.repeat(np.diff(np.append(heads, n)), np.diff(np.append(heads, n)))
        after = np.where(size > upto, 0, after)
    cross = k[1] != k[2]
    total = np.cumsum(after)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        i = np.repeat(np.arange(a, b), after[a:b])
        j = B.spans_to_indices(np.arange(a, b) + 1, after[a:b])
        ok = ~cross[i] | (me[i] != me[j])
        yield i[ok], j[ok]
        a = b
