"""Suffix-array dedup: bytes covered by a string of ``min_len`` bytes that starts anywhere else too.

Method: threshold-bounded interval expansion. A Burrows-Wheeler transform is built per block of text;
breadth-first backward extension visits the intervals of all strings of length 1, 2, 3, ... and marks the
boundary behind each interval when it is first met, so common prefixes come out in increasing value; it
stops at ``min_len``, and neighbours in suffix order whose boundary is still unmarked share a prefix of at
least ``min_len`` bytes.

Spark brings together what can match. Every window of ``min_len`` bytes elects its least hashed gram
(``gram`` bytes); equal windows elect the same gram at the same offset, so all windows that elect one place
form a context (under 2 * min_len bytes), and equal windows lie in contexts of the same key. Contexts are
counted by (key, content). One that occurs more than once is covered as a whole; keys of several
distinct contexts are read again, one copy of each. A key with more than ``hot`` of them is split exactly: its
windows are regrouped by the string that a band of neighbouring windows has in common, at last by the
window itself, which leaves one distinct context a key.

Results: null text is empty; texts under ``min_len`` bytes lose nothing; matches never cross documents;
repeated rows (same id and text) match each other; an empty table gives no rows; other columns are kept.
Context identity is 128 bits of hash (key and content) and the length; the comparison itself is on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow, row_key, written

U64 = np.uint64
MIN_LEN, GRAM, HOT, BLOCK = 200, 32, 512, 1 << 20
_SEGMENT = 1 << 22  # places must fit the low 24 bits of the elected value


# ---- contexts ------------------------------------------------------------------------------------

def _elected(buf: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``width`` grams the place of its least gram (leftmost of equals); gram hashes."""
    h = B.prefix_hash(buf)
    g = B.gram_hash(h, gram)
    m = (g & U64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=U64)
    step = 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[:len(m) - (width - step)], m[width - step:])
    return (m & U64(0xFFFFFF)).astype(np.int64), g, h


def _runs(data: np.ndarray, off: np.ndarray, min_len: int, gram: int):
    """Runs of windows that elect one place: (row, first window, windows, key, content hash), per block."""
    for lo, hi in B.blocks(off):
        base = int(off[lo])
        size = int(off[hi]) - base
        for a in range(0, max(size, 1), _SEGMENT):  # more than one segment only in a very long text
            b = min(size, a + _SEGMENT + min_len - 1)
            if b - a < min_len:
                continue
            buf = data[base + a:base + b]
            place, g, h = _elected(buf, min_len - gram + 1, gram)
            # windows must end inside the row they start in
            row_off = np.clip(off[lo:hi + 1] - base - a, 0, b - a)
            starts = B.spans_to_indices(row_off[:-1], np.maximum(np.diff(row_off) - min_len + 1, 0))
            starts = starts[starts < min(_SEGMENT, b - a)]
            if not len(starts):
                continue
            row = np.searchsorted(row_off, starts, "right") - 1
            p = place[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (p[1:] != p[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            n_win = np.diff(np.append(first, len(starts)))
            s0, r = starts[first], row[first]
            yield (r + lo, s0 - row_off[r] + np.where(row_off[r] == 0, np.maximum(a - (off[lo + r] - base), 0), 0),
                   n_win, g[p[first]], p[first] - s0, B.span_hash(h, s0, s0 + n_win + min_len - 1))


RUNS = "row_key long, s0 int, n_win int, off int, key long, ctx long"


def _emit_runs(min_len: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for r, s0, n_win, key, at, ctx in _runs(*B.text_bytes(batch.column(1)), min_len, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[r], pa.int64()), pa.array(s0, pa.int32()), pa.array(n_win, pa.int32()),
                     pa.array(at, pa.int32()), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))],
                    ["row_key", "s0", "n_win", "off", "key", "ctx"])
    return run


def _cut_contexts(min_len: int):
    """One row per wanted context with its bytes, from (text, wanted contexts of the text)."""
    def run(batches):
        for batch in batches:
            data, off = B.text_bytes(batch.column(0))
            lists = batch.column(1)
            o = lists.offsets.to_numpy()
            f = lists.values
            s0, n_win = f.field("s0").to_numpy(), f.field("n_win").to_numpy()
            s = np.repeat(off[:-1], np.diff(o)) + s0[o[0]:o[-1]]
            ln = (n_win[o[0]:o[-1]] + min_len - 1).astype(np.int64)
            step = 20_000
            for a in range(0, len(s), step):
                part = slice(a, a + step)
                bytes_ = data[B.spans_to_indices(s[part], ln[part])]
                ends = np.concatenate([[0], np.cumsum(ln[part])]).astype(np.int32)
                v = f.slice(int(o[0]) + a, len(ln[part]))
                yield pa.RecordBatch.from_arrays(
                    [v.field("key"), v.field("ctx"), v.field("off"), v.field("n"), v.field("hot"),
                     pa.Array.from_buffers(pa.binary(), len(ln[part]), [None, pa.py_buffer(ends), pa.py_buffer(bytes_)])],
                    ["key", "ctx", "off", "n", "hot", "body"])
    return run


def _banded(width: int, min_len: int):
    """Regroup the windows of each context by bands of ``width`` offsets; key: the band's common string."""
    def run(batches):
        for batch in batches:
            data, off = B.text_bytes(batch.column("body"))
            at = batch.column("off").to_numpy().astype(np.int64)
            win = np.diff(off) - min_len + 1
            # offset of the elected place in a window is at - start, so it falls along the context
            low, high = np.maximum(at - win + 1, 0) // width, at // width
            for lo, hi in B.blocks(off, 1 << 18):
                n = high[lo:hi] - low[lo:hi] + 1
                i = np.repeat(np.arange(lo, hi), n)
                band = B.spans_to_indices(low[lo:hi], n)
                first = np.maximum(at[i] - (band * width + width - 1), 0)
                last = np.minimum(at[i] - band * width, win[i] - 1)
                h = B.prefix_hash(data[off[lo]:off[hi]])
                o = off[i] - off[lo]
                common = o + at[i] - band * width
                key = B.mix(B.span_hash(h, common, common + min_len - width + 1) + (band * 2 + width).astype(U64))
                ln = last - first + min_len
                ctx = B.span_hash(h, o + first, o + first + ln)
                bytes_ = data[B.spans_to_indices(off[i] + first, ln)]
                ends = np.concatenate([[0], np.cumsum(ln)]).astype(np.int32)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(at[i] - first, pa.int32()),
                     batch.column("n").take(take), batch.column("key").take(take), batch.column("ctx").take(take),
                     batch.column("size").take(take), pa.array(first, pa.int32()),
                     pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(ends), pa.py_buffer(bytes_)])],
                    ["key", "ctx", "off", "n", "up_key", "up_ctx", "up_size", "shift", "body"])
    return run


# ---- the transform and its expansion -------------------------------------------------------------

def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``t`` (small non-negative symbols) by their next ``depth`` symbols: prefix doubling."""
    n = len(t)
    pad = np.zeros(n + 7, np.int64)
    pad[:n] = t
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | pad[j:n + j]
    sa = np.argsort(key)
    key = key[sa]
    slots, have, rank = np.arange(n), 7, np.zeros(n, np.int64)
    idx = sa
    while True:
        new = np.ones(len(idx), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(idx)))
        rank[idx] = np.repeat(slots[first], size)
        open_ = np.repeat(size > 1, size)
        slots, idx = slots[open_], idx[open_]
        if have >= depth or not len(idx):
            return sa
        ahead = idx + have
        key = (rank[idx] << 32) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        idx, key = idx[by], key[by]
        sa[slots] = idx
        have *= 2


def repeated_starts(parts: list[bytes] | tuple[np.ndarray, np.ndarray], min_len: int) -> np.ndarray:
    """Mark, over the parts laid end to end (each with one closing place), the starts of strings of
    ``min_len`` bytes that start elsewhere too. Matches never cross a part's end."""
    data, off = parts if isinstance(parts, tuple) else (
        np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
    lens = np.diff(off)
    n = int(lens.sum()) + len(lens)
    t = np.zeros(n, np.uint16)  # 0 closes a part, byte + 1 otherwise
    t[np.arange(int(lens.sum())) + np.repeat(np.arange(len(lens)), lens)] = data[off[0]:off[-1]].astype(np.uint16) + 1
    marked = np.zeros(n, bool)
    if n < 2:
        return marked
    sa = suffix_order(t, min_len)
    bwt = t[sa - 1]
    by = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    same = bwt[by[1:]] == bwt[by[:-1]]
    later, earlier = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    later[by[:-1][same]] = by[1:][same]
    earlier[by[1:][same]] = by[:-1][same]
    # strings of one symbol
    edges = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=257))])
    known = np.zeros(n + 1, bool)
    known[[0, edges[1], n]] = True
    lb, rb = edges[1:-1], edges[2:] - 1
    ok = rb >= lb
    lb, rb = lb[ok], rb[ok]
    for _ in range(min_len):
        fresh = ~known[rb + 1]
        lb, rb = lb[fresh], rb[fresh]
        if not len(lb):
            break
        known[rb + 1] = True
        size = rb - lb + 1
        at = B.spans_to_indices(lb, size)
        inside = bwt[at] != 0
        ends = at[inside & (later[at] > np.repeat(rb, size))]
        starts = at[inside & (earlier[at] < np.repeat(lb, size))]
        rb, lb = np.sort(lf[ends]), np.sort(lf[starts])
    close = np.flatnonzero(t == 0)
    room = close[np.searchsorted(close, sa)] - sa >= min_len
    pair = room[1:] & room[:-1] & ~known[1:n]
    hit = np.zeros(n, bool)
    hit[1:] |= pair
    hit[:-1] |= pair
    marked[sa[hit]] = True
    return marked


def _covered(starts: np.ndarray, part: np.ndarray, min_len: int):
    """Merge windows [start, start + min_len) of one part each: (part, from, to)."""
    if not len(starts):
        return part, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (part[1:] != part[:-1]) | (starts[1:] > starts[:-1] + min_len)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return part[first], starts[first], starts[last] + min_len


def _expand(min_len: int, block: int):
    """Blocks of whole keys from a partition sorted by key -> (key, ctx, size, covered ranges)."""
    def solve(keys, ctx, n, data, off):
        marks = np.flatnonzero(repeated_starts((data, off), min_len))
        at = off[:-1] - off[0] + np.arange(len(n))
        part = np.searchsorted(at, marks, "right") - 1
        open_ = n[part] == 1  # a context that occurs twice is covered as a whole already
        marks, part = marks[open_], part[open_]
        which, a, b = _covered(marks - at[part], part, min_len)
        if len(which):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[which]), pa.array(ctx[which]), pa.array(np.diff(off)[which], pa.int32()),
                 pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "ctx", "size", "a", "b"])

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(3).nbytes
            if size >= block:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = whole.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield from pieces(whole.slice(0, cut))
                    held = [whole.slice(cut)]
                    size = held[0].column(3).slice(0).nbytes if len(held[0]) else 0
        if held and sum(map(len, held)):
            yield from pieces(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def pieces(batch):
        keys, ctx, n = (batch.column(i).to_numpy() for i in range(3))
        data, off = B.text_bytes(batch.column(3))
        heads = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        lo = 0
        while lo < len(heads) - 1:
            hi = max(lo + 1, int(np.searchsorted(off[heads], off[heads[lo]] + block, "right")) - 1)
            a, b = heads[lo], heads[hi]
            yield from solve(keys[a:b], ctx[a:b], n[a:b], data, off[a:b + 1])
            lo = hi
    return run


FOUND = "key long, ctx long, size int, a int, b int"


def _solve(contexts: DataFrame, min_len: int, block: int) -> DataFrame:
    return (contexts.select("key", "ctx", "n", "body").repartition("key").sortWithinPartitions("key")
            .transform(arrow, _expand(min_len, block), FOUND))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                    gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(row_key, ranges): per document with repeated bytes, its covered ranges as an array of (a, b).

    ``row_key`` is ``shared.row_key(id_col, text_col)``. Ranges may touch or overlap; merge on use.
    """
    texts = docs.select(row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    runs = written(texts.transform(arrow, _emit_runs(min_len, gram), RUNS), "runs")
    # keys seen twice; written, so that the join below deals out plain shuffles and can split a hot key
    again = written(runs.groupBy("key").agg(F.count("*").alias("total")).where("total > 1").select("key"), "again")
    # grouped by the pair as one value: its partial counts are made before a shuffle of their own, whatever the join
    # made of a key that a large share of the rows holds
    distinct = (runs.join(again, "key").groupBy(F.struct("key", "ctx").alias("what"))
                .agg(F.count("*").alias("n"), F.min(F.struct("row_key", "s0", "n_win", "off")).alias("one")))
    distinct = written(distinct.select("what.*", "n", "one.*"), "distinct")
    # a context that occurs twice is covered as a whole; only keys of several contexts go through the transform
    twice = distinct.where("n > 1").select("key", "ctx", (F.col("n_win") + (min_len - 1)).alias("size"))
    several = written(distinct.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    wanted = (distinct.join(several, "key").groupBy("row_key")
              .agg(F.collect_list(F.struct("s0", "n_win", "off", "key", "ctx", F.least("n", F.lit(2)).cast("int").alias("n"),
                                           (F.col("kinds") > hot).alias("hot"))).alias("wanted")))
    cut = texts.join(wanted, "row_key").dropDuplicates(["row_key"]).select("text", "wanted")  # rows that repeat are cut once
    contexts = written(cut.transform(
        arrow, _cut_contexts(min_len), "key long, ctx long, off int, n int, hot boolean, body binary"), "ctx")
    contexts = contexts.withColumn("size", F.length("body"))
    whole = lambda df: df.select("key", "ctx", "size", F.lit(0).alias("a"), F.col("size").alias("b"))
    found = _solve(contexts.where("not hot"), min_len, block).unionByName(whole(twice))
    # hot keys: the same windows under finer keys, exactly; results carried back to the context they lie in
    heated, back = contexts.where("hot"), None
    for width in (min(16, min_len), 1):
        if heated.isEmpty():
            break
        fine = written(heated.select("key", "ctx", "off", "n", "size", "body").transform(
            arrow, _banded(width, min_len), "key long, ctx long, off int, n int, up_key long, up_ctx long, "
            "up_size int, shift int, body binary"), "band")
        fine = fine.withColumn("size", F.length("body"))
        kinds = fine.groupBy("key", "ctx", "size", "off").agg(F.sum("n").alias("n"), F.min("body").alias("body"))
        again = kinds.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
        kinds = written(kinds.join(again, "key").select(
            "key", "ctx", "off", F.least("n", F.lit(2)).cast("int").alias("n"), "size", "body",
            F.col("kinds"), (F.col("kinds") > hot).alias("hot")), "kinds")
        links = fine.select("key", "ctx", "size", "up_key", "up_ctx", "up_size", "shift")
        if back is not None:  # to the contexts of the first level
            up = back.select(F.col("key").alias("up_key"), F.col("ctx").alias("up_ctx"), F.col("size").alias("up_size"),
                             F.col("up_key").alias("k0"), F.col("up_ctx").alias("c0"), F.col("up_size").alias("z0"),
                             F.col("shift").alias("shift0"))
            links = links.join(up, ["up_key", "up_ctx", "up_size"]).select(
                "key", "ctx", "size", F.col("k0").alias("up_key"), F.col("c0").alias("up_ctx"),
                F.col("z0").alias("up_size"), (F.col("shift") + F.col("shift0")).alias("shift"))
        links = links.distinct()
        solved = (_solve(kinds.where("not hot and kinds > 1"), min_len, block).unionByName(whole(kinds.where("n > 1")))
                  .join(links, ["key", "ctx", "size"]))
        found = found.unionByName(solved.select(
            F.col("up_key").alias("key"), F.col("up_ctx").alias("ctx"), F.col("up_size").alias("size"),
            (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b")))
        heated, back = kinds.where("hot"), links
    per_ctx = written(found.groupBy("key", "ctx", "size").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "found")
    return (runs.withColumn("size", F.col("n_win") + (min_len - 1)).join(per_ctx, ["key", "ctx", "size"])
            .groupBy("row_key")
            .agg(F.flatten(F.collect_set(F.transform("spans", lambda x: F.struct(  # a set: rows that repeat add nothing
                (x["a"] + F.col("s0")).alias("a"), (x["b"] + F.col("s0")).alias("b"))))).alias("ranges")))


def with_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "ranges", **how) -> DataFrame:
    """``docs`` with all columns plus the array ``name`` of repeated ranges (null where there is none)."""
    key = "__row_key"
    ranges = repeated_ranges(docs, id_col, text_col, **how).select(F.col("row_key").alias(key), F.col("ranges").alias(name))
    return docs.withColumn(key, row_key(id_col, text_col)).join(ranges, key, "left").drop(key)


def merged(ranges: pa.ListArray, n: int) -> list[np.ndarray]:
    """Per row an (k, 2) array of maximal disjoint ranges."""
    out = []
    o = ranges.offsets.to_numpy()
    a, b = ranges.values.field("a").to_numpy(), ranges.values.field("b").to_numpy()
    for i in range(n):
        x, y = a[o[i]:o[i + 1]], b[o[i]:o[i + 1]]
        if not len(x) or not ranges[i].is_valid:
            out.append(np.zeros((0, 2), np.int64))
            continue
        by = np.argsort(x, kind="stable")
        x, y = x[by], np.maximum.accumulate(y[by])
        new = np.append(True, x[1:] > y[:-1])
        first = np.flatnonzero(new)
        out.append(np.stack([x[first], y[np.append(first[1:], len(x)) - 1]], 1).astype(np.int64))
    return out


def _digest(batches):
    for batch in batches:
        data, off = B.text_bytes(batch.column("text"))
        rows = []
        for i, spans in enumerate(merged(batch.column("ranges"), len(batch))):
            text = data[off[i]:off[i + 1]]
            sha, last = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(text[last:a])
                last = b
            sha.update(text[last:])
            rows.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha.hexdigest()))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, **how) -> DataFrame:
    """Per document the sizes of what is removed and a digest of what is kept (bytes)."""
    return (with_ranges(docs.select("doc_id", F.col("text").cast("binary").alias("text")), **how)
            .select("doc_id", "text", "ranges")
            .transform(arrow, _digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def _clean(batches):
    for batch in batches:
        data, off = B.text_bytes(batch.column("__text"))
        col, texts, counts = batch.column("__text"), [], []
        for i, spans in enumerate(merged(batch.column("__ranges"), len(batch))):
            if not len(spans):
                texts.append(col[i].as_py())
                counts.append(None)
                continue
            raw = data[off[i]:off[i + 1]]
            inner = (raw & 0xC0) == 0x80  # whole characters only: one cut in half stays
            keep, last = [], 0
            for a, b in spans:
                while a < b and inner[a]:
                    a += 1
                while b > a and b < len(raw) and inner[b]:
                    b -= 1
                keep.append(raw[last:a].tobytes())
                last = b
            keep.append(raw[last:].tobytes())
            texts.append(b"".join(keep).decode("utf-8", "replace"))
            counts.append(len(texts[-1]))
        names = [n for n in batch.schema.names if n not in ("__text", "__ranges")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
            [*names, "__text", "__n"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str | None = "n_chars",
                    **how) -> DataFrame:
    """``docs`` with the repeated ranges cut out of its texts; every row and column stays.

    A character that a range covers only in part stays. ``n_col`` (if there) is set to the new length of the
    texts that were cut.
    """
    cols = docs.columns
    rest = [c for c in cols if c != text_col]
    full = with_ranges(docs, id_col, text_col, "__ranges", **how).withColumnRenamed(text_col, "__text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col),
                        "__text string", "__n long"])
    out = full.select(*rest, "__text", "__ranges").transform(arrow, _clean, schema)
    if n_col in cols:
        out = out.withColumn(n_col, F.coalesce(F.col("__n").cast(docs.schema[n_col].dataType), F.col(n_col)))
    return out.withColumnRenamed("__text", text_col).select(*cols)
