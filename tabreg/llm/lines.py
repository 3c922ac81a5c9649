"""Line dedup: lines that many documents hold stay only in the one with the largest id.

Method: two Bloom filters. A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Tasks turn the keys (once per document) into filter places and send those that are set, by segments of 2**16
places: those met once and those met twice in the batch. A segment's filters merge in any order (``twice |= once
& new; once |= new``), streamed, so a task holds a bit pair per place and never a group of rows. Only the filter
of twice-seen places (``most_bits`` at most) is broadcast; documents are read again and lines whose places are all
in it are suspects. Suspects alone shuffle, as 32-byte digests of their keys: exact counts of documents and the
largest id per key. Keys with more than 1/2048 of all suspect rows (so 2048 keys at most) meet their rows by a
broadcast, the rest by a shuffled join. A filter that is too full lets more lines through to the exact count; results do
not change.

Results: a document is a row; rows that share an id and a text are several documents and get the same result; a
null or empty text is one empty line; null ids are the least; a key found in rows of the same largest id stays in
all of these (if all ids are null, everywhere). Keys that repeat within a document count once for it, and go or
stay together. Lines are cut at \\n alone. An empty table gives no rows. All other columns are kept (names that
begin with ``__line_`` are reserved and raise).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow, hot_join, written

U64 = np.uint64
MIN_DOCS, MIN_CHARS = 5, 40
MOST_BITS = 1 << 28
BITS_PER_KEY, SEGMENT, HOT_KEYS = 8, 1 << 16, 2048


def _row(id_col: str, text_col: str) -> Column:
    """Identity of a row by id and text (128 bits)."""
    return F.struct(F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(text_col, id_col, F.lit(7)).alias("b"))


def _lines(data: np.ndarray, off: np.ndarray, lo: int, hi: int, min_chars: int):
    """Lines of rows lo..hi with keys of ``min_chars``: (row, line number, key start, key end) and the lower-cased bytes."""
    size = np.diff(off[lo:hi + 1])
    raw = np.full(int(size.sum()) + hi - lo, 10, np.uint8)  # each row is closed by a line end
    raw[np.arange(int(size.sum())) + np.repeat(np.arange(hi - lo), size)] = data[off[lo]:off[hi]]
    ends = np.flatnonzero(raw == 10)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    row_end = off[lo + 1:hi + 1] - off[lo] + np.arange(hi - lo)
    row = np.searchsorted(row_end, ends)
    number = np.arange(len(ends)) - np.searchsorted(row, row)
    solid = np.flatnonzero(~B.WS[raw])
    if not len(solid):
        return row[:0], row[:0], row[:0], row[:0], raw
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    some = last >= first
    row, number, ks, ke = row[some], number[some], solid[first[some]], solid[last[some]] + 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    long_ = points[ke] - points[ks] >= min_chars
    return row[long_] + lo, number[long_], ks[long_], ke[long_], B.LOWER[raw]


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """Two filter places of each hash."""
    return np.stack([h & U64(bits - 1), B.mix(h ^ U64(0x9E3779B97F4A7C15)) & U64(bits - 1)]).astype(np.int64)


def _hashes(low: np.ndarray, ks: np.ndarray, ke: np.ndarray) -> np.ndarray:
    return B.span_hash(B.prefix_hash(low), ks, ke)


def _set_places(bits: int, min_chars: int):
    """Per Arrow batch and segment: the places set, and those set twice, as 16-bit offsets."""
    def offsets(places: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        seg = places >> 16
        heads = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(seg))
        small = (places & 0xFFFF).astype("<u2")
        return seg[heads], [small[a:b].tobytes() for a, b in zip(heads, ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.text_bytes(batch.column(0))
            found = []
            for lo, hi in B.blocks(off):
                row, _, ks, ke, low = _lines(data, off, lo, hi, min_chars)
                if not len(row):
                    continue
                h = _hashes(low, ks, ke)
                by = np.lexsort((h, row))  # a key counts once per document
                row, h = row[by], h[by]
                new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
                p = np.sort(_places(h[new], bits), 0)  # a key whose places coincide sets it once
                found.append(p[0])
                found.append(p[1][p[1] != p[0]])
            if not found:
                continue
            places, n = np.unique(np.concatenate(found), return_counts=True)
            seg, once = offsets(places)
            seg2, two = offsets(places[n > 1])
            twice = dict(zip(seg2.tolist(), two))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seg, pa.int32()), pa.array(once, pa.binary()), pa.array([twice.get(s, b"") for s in seg.tolist()], pa.binary())],
                ["segment", "once", "twice"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of one partition, streamed into bit pairs; gives the bits of twice-seen places."""
    def bits(raw: bytes) -> np.ndarray:
        mark = np.zeros(SEGMENT, bool)
        mark[np.frombuffer(raw, "<u2")] = True
        return np.packbits(mark)

    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            new = bits(a)
            old = once.get(s)
            if old is None:
                once[s], twice[s] = new, bits(b)
            else:
                twice[s] |= old & new
                old |= new
                if b:
                    twice[s] |= bits(b)
    for s, t in twice.items():
        if t.any():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([t.tobytes()], pa.binary())], ["segment", "bits"])


def _suspects(twice, bits: int, min_chars: int):
    """Per document and key in the filter: (row, id, digest of the key, its line numbers)."""
    def run(batches):
        seen = np.frombuffer(twice.value, np.uint8)

        def has(p):
            return (seen[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        for batch in batches:
            data, off = B.text_bytes(batch.column("text"))
            rows, keys, numbers = [], [], []
            for lo, hi in B.blocks(off):
                row, number, ks, ke, low = _lines(data, off, lo, hi, min_chars)
                if not len(row):
                    continue
                p = _places(_hashes(low, ks, ke), bits)
                hit = has(p[0]) & has(p[1])
                held: dict = {}
                for r, n, a, b in zip(row[hit].tolist(), number[hit].tolist(), ks[hit].tolist(), ke[hit].tolist()):
                    held.setdefault((r, hashlib.sha256(low[a:b].tobytes()).digest()), []).append(n)
                for (r, k), v in held.items():
                    rows.append(r)
                    keys.append(k)
                    numbers.append(v)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(take), batch.column("id").take(take), pa.array(keys, pa.binary()),
                 pa.array(numbers, pa.list_(pa.int32()))], ["row", "id", "key", "lines"])
    return run


def filter_bits(chars: int, min_chars: int = MIN_CHARS, most_bits: int = MOST_BITS) -> int:
    """Filter size (a power of two) for texts of ``chars`` characters in all: that many hold chars / min_chars keys at most."""
    want = max(SEGMENT, chars // max(min_chars, 1) * BITS_PER_KEY)
    return min(1 << (int(want) - 1).bit_length(), most_bits)


def twice_seen(texts: DataFrame, bits: int, min_chars: int) -> bytes:
    """The filter of places that two keys or more set, as bits (``bits`` / 8 bytes)."""
    sent = texts.select("text").transform(arrow, _set_places(bits, min_chars), "segment int, once binary, twice binary")
    merged = sent.repartition("segment").transform(arrow, _merge, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    table = merged.toArrow()  # at most ``bits`` / 8 bytes
    for s, b in zip(table.column("segment").to_pylist(), table.column("bits").to_pylist()):
        out[s * SEGMENT // 8:(s + 1) * SEGMENT // 8] = np.frombuffer(b, np.uint8)
    return out.tobytes()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                   min_chars: int = MIN_CHARS, most_bits: int = MOST_BITS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(row, lines): numbers of the lines that go, per (id, text) that loses some (arrays in an array, unsorted)."""
    spark = docs.sparkSession
    texts = docs.select(_row(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = filter_bits(chars, min_chars, most_bits)
    twice = spark.sparkContext.broadcast(twice_seen(texts, bits, min_chars))
    kind = docs.schema[id_col].dataType.simpleString()
    suspects = written(texts.transform(arrow, _suspects(twice, bits, min_chars),
                                       f"row struct<a:bigint,b:bigint>, id {kind}, key binary, lines array<int>"), "suspects")
    known = written(suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
                    .where(F.col("n") >= min_docs), "lines")
    met = hot_join(suspects, known, "key", "n", suspects.count(), hot_keys)
    return (met.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_set("lines").alias("lines")))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` plus ``__line_gone`` (array of arrays of line numbers; null where none)."""
    if taken := [c for c in docs.columns if c.startswith("__line_")]:
        raise ValueError(f"reserved column names: {', '.join(taken)}")
    gone = repeated_lines(docs, id_col, text_col, **how).select(F.col("row").alias("__line_row"), F.col("lines").alias("__line_gone"))
    return docs.withColumn("__line_row", _row(id_col, text_col)).join(gone, "__line_row", "left").drop("__line_row")


def _kept(text: bytes, gone: list | None) -> tuple[int, int, bytes]:
    """Number of lines, how many go, and the rest joined."""
    if not gone:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    out = {n for part in gone for n in part}
    return len(lines), len(out), b"\n".join([x for i, x in enumerate(lines) if i not in out])


def _digest(batches):
    for batch in batches:
        rows = []
        for t, gone in zip(batch.column("text"), batch.column("__line_gone")):
            n, dropped, left = _kept(t.as_py() or b"", gone.as_py())
            rows.append((n, dropped, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digests(docs: DataFrame, **how) -> DataFrame:
    """Per document its lines, how many go, and a digest of the text that stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return (with_repeats(slim, **how).select("doc_id", "text", "__line_gone")
            .transform(arrow, _digest, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string"))


def _clean(batches):
    for batch in batches:
        texts, counts = [], []
        for t, gone in zip(batch.column("__line_text"), batch.column("__line_gone")):
            text, gone = t.as_py(), gone.as_py()
            left = text if not gone else _kept(text.encode(), gone)[2].decode()
            texts.append(left)
            counts.append(len(left) if gone else None)
        names = [n for n in batch.schema.names if n not in ("__line_text", "__line_gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                                         [*names, "__line_text", "__line_n"])


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str | None = "n_chars",
                           **how) -> DataFrame:
    """``docs`` with the repeated lines cut out of its texts; every row and column stays. ``n_col`` (if there) is set
    to the new length of the texts that lost lines."""
    cols = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col),
                        "__line_text string", "__line_n long"])
    full = with_repeats(docs, id_col, text_col, **how).withColumnRenamed(text_col, "__line_text")
    out = full.select(*[f"`{c}`" for c in cols if c != text_col], "__line_text", "__line_gone").transform(arrow, _clean, schema)
    if n_col in cols:
        out = out.withColumn(n_col, F.coalesce(F.col("__line_n").cast(docs.schema[n_col].dataType), F.col(n_col)))
    return out.withColumnRenamed("__line_text", text_col).select(*[f"`{c}`" for c in cols])
