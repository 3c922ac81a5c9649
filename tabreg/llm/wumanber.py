"""Benchmark decontamination: occurrences of benchmark word windows in whole documents.

Method: Wu-Manber multi-pattern search. Patterns of similar length form a class. A class looks at the
blocks that end at a place: the shift table tells how far the search may skip, a shift of zero selects the
patterns of the block's suffix-hash bucket, and bytes are compared directly. Places are searched in many
short lanes at once (numpy over a block of documents), each lane with its own cursor.

Texts are read as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is
``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Windows are
broadcast in chunks of at most ``chunk_bytes``: a larger benchmark takes more passes over the documents, and
their hits are united, so results are the same at any size.

Results: null text has no words; an item without words has no window; repeated rows are judged alike; equal
windows of several items count for each of them; an empty benchmark or table gives no hits or no rows; all
other columns are kept. A null item id counts as the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow

WIDTH, CHUNK_BYTES = 13, 32 << 20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
_CLASSES = (1, 2, 4, 8, 16, 40, 1 << 40)  # pattern lengths that share a shift table
_LANE = 256
_BITS = 20


def _normal(data: np.ndarray, off: np.ndarray, lo: int, hi: int):
    """Rows lo..hi as lower-case words between single separators (1 before a row, else a blank)."""
    buf, first = B.spaced(data, off, lo, hi)
    buf = B.LOWER[buf]
    word = IS_WORD[buf]
    buf[~word] = 32
    buf[first - 1] = 1
    keep = word | (buf == 1)
    keep[1:] |= word[:-1]
    new = np.cumsum(keep) - 1
    out = np.append(buf[keep], np.uint8(1))
    starts, ends = B.words(out, IS_WORD)
    return out, starts, ends, new[first - 1]


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.text_bytes(batch.column(1))
            for lo, hi in B.blocks(off):
                out, s, e, row_at = _normal(data, off, lo, hi)
                row = np.searchsorted(row_at, s, "right") - 1
                n = np.bincount(row, minlength=hi - lo)
                base = np.cumsum(n) - n
                have = np.flatnonzero(n)
                count = np.maximum(n[have] - width + 1, 1)
                first = B.spans_to_indices(base[have], count)
                owner = np.repeat(have, count)
                last = np.minimum(first + width, base[owner] + n[owner]) - 1
                text = out.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + lo)),
                     pa.array([text[a:b] for a, b in zip(s[first], e[last])], pa.binary())], ["item", "pattern"])
    return run


def windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Distinct (item, pattern): the word windows of every item, as bytes with single blanks."""
    src = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return src.transform(arrow, _windows(width), "item string, pattern binary").distinct()


class Matcher:
    """Shift tables, suffix buckets and patterns of one bounded chunk."""

    def __init__(self, patterns: list[bytes], items: list[str]):
        self.patterns = sorted(set(patterns), key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(self.patterns)}
        names = sorted(set(items))
        code = {x: i for i, x in enumerate(names)}
        pair = np.array(sorted({(number[p], code[x]) for p, x in zip(patterns, items)}), np.int64).reshape(-1, 2)
        self.names, self.owner = names, pair[:, 1]
        self.owner_off = np.searchsorted(pair[:, 0], np.arange(len(self.patterns) + 1))
        self.lens = np.array([len(p) for p in self.patterns], np.int64)
        self.flat = np.frombuffer(b"".join(self.patterns), np.uint8)
        self.off = np.concatenate([[0], np.cumsum(self.lens)])
        self.classes = []
        for a, b in zip(_CLASSES[:-1], _CLASSES[1:]):
            ids = np.flatnonzero((self.lens >= a) & (self.lens < b))
            if len(ids):
                self.classes.append(self._tables(ids))

    def _tables(self, ids: np.ndarray) -> tuple:
        m = int(self.lens[ids].min())
        block = max(x for x in (1, 2, 4, 8, 16) if x <= m)
        shift = np.full(1 << _BITS, m - block + 1, np.int32)
        ends = self.off[ids]
        for j in range(block, m + 1):  # blocks end after j symbols of the first m
            np.minimum.at(shift, _block_hash(self.flat, ends + j - 1, block), m - j)
        suffix = _block_hash(self.flat, ends + m - 1, block)
        by = np.argsort(suffix, kind="stable")
        return m, block, shift, suffix[by], ids[by]

    def search(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence that starts and ends at word borders."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(buf)
        for m, block, shift, suffix, ids in self.classes:
            lane = np.arange(m - 1, n, _LANE)
            stop, at = np.minimum(lane + _LANE, n), lane
            while len(at):
                h = _block_hash(buf, at, block)
                skip = shift[h]
                zero = skip == 0
                if zero.any():
                    p, x = at[zero] - (m - 1), h[zero]
                    a, b = np.searchsorted(suffix, x), np.searchsorted(suffix, x, "right")
                    cand = ids[B.spans_to_indices(a, b - a)]
                    p = np.repeat(p, b - a)
                    ok = self._equal(buf, p, cand)
                    places.append(p[ok])
                    found.append(cand[ok])
                at = at + np.maximum(skip, 1)
                on = at < stop
                if not on.all():
                    at, stop = at[on], stop[on]
        return np.concatenate(places), np.concatenate(found)

    def _equal(self, buf: np.ndarray, p: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ln = self.lens[ids]
        ok = p + ln < len(buf)
        ok &= (buf[p] == self.flat[self.off[ids]]) & (buf[np.maximum(p - 1, 0)] <= 32)
        ok &= buf[np.minimum(p + ln, len(buf) - 1)] <= 32
        left = np.flatnonzero(ok)
        for part in np.array_split(left, max(1, int(ln[left].sum()) >> 22)):
            if len(part):
                same = buf[B.spans_to_indices(p[part], ln[part])] == self.flat[B.spans_to_indices(self.off[ids[part]], ln[part])]
                ok[part] = np.logical_and.reduceat(same, np.cumsum(ln[part]) - ln[part])
        return ok


def _block_hash(buf: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """Bucket of the block of 1, 2, 4, 8 or 16 bytes that ends at ``last``."""
    size = min(block, 8)
    view = np.ndarray((max(len(buf) - size + 1, 0),), f"<u{size}", buf, strides=(1,))
    x = view[last - size + 1].astype(np.uint64)
    if block == 16:
        x ^= (view[last - 15].astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


HIT = "struct<n_words: bigint, n_hit: bigint, items: array<string>, hits: array<int>>"
_HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                  ("hits", pa.list_(pa.int32()))])


def _pass(table, before: bool):
    """Judge rows of (other columns ..., __text[, __hit]); unite with an earlier pass's hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for batch in batches:
            data, off = B.text_bytes(batch.column("__text"))
            old = batch.column("__hit").to_pylist() if before else None
            res = []
            for lo, hi in B.blocks(off):
                buf, s, e, row_at = _normal(data, off, lo, hi)
                n = np.bincount(np.searchsorted(row_at, s, "right") - 1, minlength=hi - lo)
                base = np.concatenate([[0], np.cumsum(n)])
                place, pat = m.search(buf)
                row = np.searchsorted(row_at, place, "right") - 1
                cover = np.zeros(len(s) + 1, np.int64)
                np.add.at(cover, np.searchsorted(s, place), 1)
                np.add.at(cover, np.searchsorted(s, place + m.lens[pat]), -1)
                hit = np.cumsum(cover)[:-1] > 0
                pairs = np.unique(row * max(len(m.patterns), 1) + pat)
                prow, ppat = np.divmod(pairs, max(len(m.patterns), 1))
                edge = np.searchsorted(prow, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    items: set = set()
                    for q in ppat[edge[i]:edge[i + 1]]:
                        items.update(m.names[c] for c in m.owner[m.owner_off[q]:m.owner_off[q + 1]])
                    own = hit[base[i]:base[i + 1]]
                    if old:
                        own = own.copy()
                        items.update(old[lo + i]["items"])
                        h = old[lo + i]["hits"]
                        for a, b in zip(h[::2], h[1::2]):
                            own[a:b] = True
                    ranges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    res.append({"n_words": int(n[i]), "n_hit": int(own.sum()), "items": sorted(items),
                                "hits": ranges.tolist()})
            names = [c for c in batch.schema.names if c != "__hit"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(res, _HIT)], [*names, "__hit"])
    return run


def contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text", name: str = "contamination",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                  chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` plus a struct ``name``: words, hit words, ids of the items with occurring windows (sorted
    strings), and the hit word ranges as a flat array of starts and ends."""
    spark = docs.sparkSession
    pats = windows(bench, item_col, item_text_col, width)
    size = pats.agg(F.sum(F.length("pattern") + F.length("item") + 64)).first()[0] or 0
    chunks = -(-size // chunk_bytes) or 1
    rest = [f for f in docs.schema if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "__text string", f"__hit {HIT}"])
    out = docs.select(*(F.col(f"`{f.name}`") for f in rest), F.col(text_col).alias("__text"))
    for i in range(chunks):
        part = pats if chunks == 1 else pats.where(F.pmod(F.xxhash64("item", "pattern"), F.lit(chunks)) == i)
        rows = part.collect()  # at most chunk_bytes, give or take the unevenness of a hash
        table = spark.sparkContext.broadcast(Matcher([bytes(r.pattern) for r in rows], [r["item"] for r in rows]))
        out = out.transform(arrow, _pass(table, i > 0), schema)
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`")
                        for c in docs.columns), F.col("__hit").alias(name))


def is_contaminated(name: str = "contamination", share: int = 20):
    """At least one in ``share`` words of the document lies in an occurring window."""
    return (F.col(f"{name}.n_hit") > 0) & (share * F.col(f"{name}.n_hit") >= F.col(f"{name}.n_words"))


def clean(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they were."""
    return contamination(docs, bench, name="__c", **how).where(~is_contaminated("__c")).drop("__c")


def digests(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """Per document: counts of words, hit words and items, a digest of the item ids, and the verdict."""
    c = contamination(docs.select("doc_id", "text"), bench, **how)
    return c.select("doc_id", "contamination.n_words", "contamination.n_hit",
                    F.size("contamination.items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256"),
                    is_contaminated().alias("contaminated"))

