"""Embedding near-dedup by lattice hashing.

Each table projects the normalised vector onto 8 random directions, shifts it, and decodes the result to the
nearest point of the E8 lattice (D8 and its half-shifted copy). A vector is filed under its own cell and the
cells of the ``probes`` next best minimal vectors, per label and length. Vectors that share a cell are compared by
cosine in double precision, in bounded blocks. A pair is counted in the first table and the least cell they
share, so each link counts once; blocks emit sums of links and a spanning forest, never the pairs.

Not exact: links that share no cell are lost. Measured on 4000 pairs of 64 components with the production setting,
recall is 0.9993 at cosine 0.93 and 1.0 at 0.94 and 0.95 (8 tables: 0.9953, 0.9995, 1.0).

Equal vectors of a label are one class with a count. Null labels, and vectors that are null, empty, zero or
hold null or non-finite components, link with nothing. Repeated rows are vectors of their own. An empty
table gives no rows. Vectors of unlike lengths never link. Classes are told apart by 64 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm import buckets
from tabreg.llm.shared import arrow, components, written

THRESHOLD, TABLES, PROBES, SCALE, CAP, SEED, LARGE = 0.93, 12, 4, 1.1, 1024, 7, 32


def _minimal() -> np.ndarray:
    """The 240 minimal vectors of E8: (+-1, +-1, 0...) and (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        if bin(m).count("1") % 2 == 0:
            out.append(np.array([-.5 if m >> i & 1 else .5 for i in range(8)]))
    return np.array(out)


MINIMAL = _minimal()


def _d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1).astype(np.int64) & 1)
    d = x[odd] - f[odd]
    worst = np.abs(d).argmax(1)
    f[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row."""
    a, b = _d8(x), _d8(x - .5) + .5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _hash(p: np.ndarray) -> np.ndarray:
    """64-bit name of lattice points (their doubled coordinates are whole)."""
    q = np.rint(p * 2).astype(np.int64).view(np.uint64)
    h = np.zeros(q.shape[:-1], np.uint64)
    for i in range(8):
        h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + q[..., i] + np.uint64(i + 1))
    return h


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) cell names of normalised rows: own cell first."""
    rng = np.random.default_rng([seed, x.shape[1]])
    out = np.empty((len(x), tables, 1 + probes), np.uint64)
    for t in range(tables):
        y = x @ rng.standard_normal((x.shape[1], 8)) * scale + rng.uniform(0, 1, 8)
        p = nearest(y)
        gain = (y - p) @ MINIMAL.T
        best = np.argpartition(-gain, max(probes - 1, 0), 1)[:, :probes]
        all_ = np.concatenate([p[:, None, :], p[:, None, :] + MINIMAL[best]], 1)
        out[:, t] = B.mix(_hash(all_) + np.uint64(t * 1000 + x.shape[1]))
    return out


def _rows(col: pa.Array) -> np.ndarray:
    v = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    o = v.offsets.to_numpy()
    x = v.values.to_numpy(zero_copy_only=False)[o[0]:o[-1]].astype(np.float64).reshape(len(v), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _file(tables: int, probes: int, scale: float, seed: int, full: bool):
    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                same = np.flatnonzero(dim == d)
                for part in np.array_split(same, -(-len(same) // 4096)):
                    take = pa.array(part)
                    c = cells(_rows(batch.column("vec").take(take)), tables, probes, scale, seed)
                    lab = batch.column("label_key").take(take).to_numpy().view(np.uint64)
                    key = pa.array(B.mix(c + lab[:, None, None]).ravel().view(np.int64))
                    if not full:
                        yield pa.RecordBatch.from_arrays([key], ["key"])
                        continue
                    table = np.broadcast_to(np.arange(tables)[None, :, None], c.shape).ravel()
                    again = pa.array(np.repeat(part, tables * (1 + probes)))
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array(table, pa.int32()), pa.array(c.ravel().view(np.int64)),
                         *(batch.column(n).take(again) for n in ("node", "copies", "vec"))],
                        ["key", "t", "cell", "node", "copies", "vec"])
    return run


def _compare(threshold: float, tables: int, probes: int, scale: float, seed: int):
    def run(batches):
        for batch in buckets.groups(batches, 20_000):
            size = pc.list_value_length(batch.column("vec")).to_numpy()
            for d in np.unique(size):
                yield from solve(batch if (size == d).all() else batch.take(pa.array(np.flatnonzero(size == d))))

    def candidates(batch, x):
        """Pairs of small groups as they are, of large ones those that a matrix product finds near."""
        yield from buckets.pairs(batch, 1 << 17, LARGE)
        me = batch.column("me").to_numpy()
        for a, b, across in buckets.large(batch, LARGE):
            for top in range(a, b, 256):
                rows = np.arange(top, min(top + 256, b))
                i, j = np.nonzero(x[rows] @ x[a:b].T >= threshold - 1e-9)
                i, j = rows[i], j + a
                ok = (i < j) & ((me[i] != me[j]) | (not across))
                yield i[ok], j[ok]

    def solve(batch):
        x = _rows(batch.column("vec"))
        copies, node, t = (batch.column(c).to_numpy() for c in ("copies", "node", "t"))
        cell = batch.column("cell").to_numpy().view(np.uint64)
        gain, us, vs, reg = np.zeros(len(x), np.int64), [], [], None
        for i, j in candidates(batch, x):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            if not len(i):
                continue
            if reg is None:
                reg = np.sort(cells(x, tables, probes, scale, seed), 2)
            us.append(i)
            vs.append(j)
            first = np.ones(len(i), bool)
            for other in range(tables):
                open_ = np.flatnonzero(first & (other <= t[i]))
                a, b = reg[i[open_], other], reg[j[open_], other]
                same = (a[:, :, None] == b[:, None, :]).any(2)
                any_ = same.any(1)
                least = np.where(same, a, np.uint64(0xFFFFFFFFFFFFFFFF)).min(1)
                here = t[i[open_]] == other
                first[open_] = np.where(here, least == cell[i[open_]], ~any_)
            np.add.at(gain, i[first], copies[j[first]])
            np.add.at(gain, j[first], copies[i[first]])
        if us:
            lab = B.forest(np.concatenate(us), np.concatenate(vs), len(x))
            k = np.flatnonzero((gain > 0) | (lab != np.arange(len(x))))
            yield pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[lab[k]]), pa.array(gain[k])], ["u", "v", "links"])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
                    cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(id, n_links, component_id, kept) per row."""
    how = (tables, probes, scale, seed)
    v = F.col("vec")
    usable = (F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
              & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
            .withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("node", F.xxhash64("label", "vec")))
    classes = written(rows.where("ok").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("id").alias("low"), F.first("vec").alias("vec"),
        F.xxhash64(F.first("label")).alias("label_key")).withColumn("dim", F.size("vec")), "vec")
    kind = classes.schema["vec"].dataType.simpleString()
    src = classes.select("node", "copies", "label_key", "dim", "vec")
    reg = src.transform(arrow, _file(*how, True), f"key long, t int, cell long, node long, copies long, vec {kind}")
    dealt = (buckets.split_hot(reg, cap, "node", src.transform(arrow, _file(*how, False), "key long"))
             .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj"))
    found = written(dealt.transform(arrow, _compare(threshold, *how), "u long, v long, links long"), "links")
    sums = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v").where("u <> v").distinct())
    each = (classes.select("node", "copies", "low").join(sums, "node", "left").join(roots, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    low = each.groupBy("root").agg(F.min("low").alias("component_id"))
    each = each.join(low, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = (rows.where("ok").select("id", "node").join(each, "node").select("id", "n_links", "component_id")
           .unionByName(rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def digests(vectors: DataFrame, **how) -> DataFrame:
    return near_duplicates(vectors, **how).select(
        F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", "kept")
