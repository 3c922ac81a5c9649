"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``order`` bytes with the counts of the symbols that followed
(a byte, or the text's end). Coding starts at the longest context the trie knows; a context that has not seen
the symbol pays an escape (method C: as many counts as it has kinds of symbols) and hands over to the next
shorter one, where the symbols it has seen itself are excluded. Below the empty context the symbols not seen
yet are equally likely. Each context keeps the totals of the next shorter one without its own symbols, so
symbol exclusion is a lookup. The base model beside it is a word unigram model with add-one counts.

The counts are Spark aggregations over all training texts, pre-aggregated within tasks. For scoring, trie and
vocabulary are sorted tables, sent in shards of at most ``shard_rows`` entries; each shard is one pass over
the texts that adds to the rows' sums, so larger models take more passes and no more memory. A pass sorts and looks up only the
places of its own shard, and hashes words only while shards of the vocabulary are left.

Null text is empty and scores as its end alone. Texts' contexts start empty (a start mark). Repeated rows
score alike. With no training text all symbols are equally likely and no token is known. Words are told
apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm import bytesops as B
from tabreg.llm.shared import arrow, written

ORDER, SHARD_ROWS, SYMBOLS = 5, 3_000_000, 257
_BITS = 9  # symbol 0 is a text's start or end, byte + 1 otherwise
_END_WORD = np.int64(0)
_FLUSH = 1_500_000


def _symbols(data, off, lo, hi, order):
    """Rows lo..hi as symbols, each row closed by 0; codes of (context, symbol) with contexts cut at the row."""
    o = off[lo:hi + 1] - off[lo]
    n = hi - lo
    ends = o[1:] + np.arange(n)  # place of each row's end symbol
    starts = o[:-1] + np.arange(n)
    inside = np.ones(int(o[-1]) + n, bool)
    inside[ends] = False
    t = np.zeros(len(inside), np.uint64)
    t[inside] = data[off[lo]:off[hi]]
    t += inside
    code = t.copy()
    for d in range(1, order + 1):
        # places within d of their row's start see no earlier symbols: the 0 that closes the row before is
        # in the window anyway, what lies before that is masked
        code[d:] |= t[:-d] << np.uint64(_BITS * d)
    for d in range(order):  # place d of a row: keep d symbols of context
        at = starts + d
        at = at[at <= ends]
        code[at] &= np.uint64((1 << _BITS * (d + 1)) - 1)
    return code, starts, ends


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << _BITS * k) - 1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.int64)


def _sum_by(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[by], first) if len(first) else n[:0]


def _word_hashes(data, off, lo, hi):
    """Hash of every word of rows lo..hi (lower-cased A-Z, split at ASCII blanks), and its row."""
    buf, first = B.spaced(data, off, lo, hi)
    buf = B.LOWER[buf]
    s, e = B.words(buf, ~B.WS)
    h = B.span_hash(B.prefix_hash(buf), s, e)
    h[h == 0] = np.uint64(1)  # 0 stands for the end token
    return h.view(np.int64), np.searchsorted(first, s, "right") - 1


def _count(order: int):
    """Rows (kind, code, n): grams of order + 1 symbols (kind 0) and words (kind 1) of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: [], 1: []}

        def flush(kind):
            k = np.concatenate([x for x, _ in held[kind]])
            n = np.concatenate([x for _, x in held[kind]])
            held[kind] = [_sum_by(k, n)]
            return len(held[kind][0][0])

        def out(kind):
            k, n = held[kind][0]
            held[kind] = []
            for a in range(0, len(k), 200_000):
                part = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[part]), kind, np.int32)),
                                                  pa.array(k[part].view(np.int64)), pa.array(n[part])], ["kind", "code", "n"])

        for batch in batches:
            data, off = B.text_bytes(batch.column(0))
            for lo, hi in B.blocks(off):
                code, _, _ = _symbols(data, off, lo, hi, order)
                u, n = np.unique(code, return_counts=True)
                held[0].append((u, n))
                h, _ = _word_hashes(data, off, lo, hi)
                u, n = np.unique(h, return_counts=True)
                held[1].append((np.append(u, _END_WORD), np.append(n, hi - lo)))
                for kind in held:
                    if sum(len(x) for x, _ in held[kind]) > _FLUSH and flush(kind) > _FLUSH // 2:
                        yield from out(kind)
        for kind in held:
            if held[kind]:
                flush(kind)
                yield from out(kind)
    return run


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(kind, code, n): counts of the longest grams (kind 0) and of words (kind 1) over all of ``texts``."""
    return written(texts.select(F.col(text_col).alias("__text")).transform(arrow, _count(order), "kind int, code long, n long")
                   .groupBy("kind", "code").agg(F.sum("n").alias("n")), "ppm")


# ---- model tables --------------------------------------------------------------------------------

class Trie:
    """Sorted tables per context length: entries (context, symbol) and contexts with totals, kinds and those
    of the next shorter context without this one's symbols."""

    def __init__(self, code: np.ndarray, n: np.ndarray, order: int):
        self.order, self.levels = order, []
        codes, counts = _sum_by(code.astype(np.uint64), n.astype(np.int64))
        for k in range(order, -1, -1):
            if k < order:  # drop the farthest symbol of the context
                codes, counts = _sum_by(codes & _mask(k + 1), counts)
            ctx = codes >> np.uint64(_BITS)
            first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1])) if len(ctx) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            kinds = np.diff(np.append(first, len(ctx)))
            self.levels.append({"entry": codes, "count": _narrow(counts), "ctx": ctx[first], "first": first,
                                "n": _narrow(total), "t": _narrow(kinds)})
        self.levels.reverse()
        for k in range(1, order + 1):
            self._left(k)

    def _left(self, k: int) -> None:
        """Totals and kinds of the next shorter contexts without the symbols that level k has seen."""
        up, down = self.levels[k], self.levels[k - 1]
        if len(up["entry"]):
            at = np.searchsorted(down["entry"], up["entry"] & _mask(k))
            seen = np.add.reduceat(down["count"][at].astype(np.int64), up["first"])
            node = np.searchsorted(down["ctx"], up["ctx"] & _mask(k - 1))
            up["n_left"] = _narrow(down["n"][node] - seen)
            up["t_left"] = _narrow(down["t"][node].astype(np.int64) - up["t"])

    def packed(self) -> "Trie":
        """Without what only the building needs."""
        for level in self.levels:
            level.pop("first", None)
        return self

    def replace_short(self, whole: "Trie") -> None:
        """Take the contexts of under two symbols from ``whole`` (counts of all shards)."""
        self.levels[:2] = whole.levels[:2]
        if self.order > 1:
            self._left(2)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each code after the symbols before it."""
        lp = np.zeros(len(codes))
        live = np.arange(len(codes))
        n_left, t_left = np.full(len(codes), -1.0), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            lv = self.levels[k]
            if not len(lv["ctx"]) or not len(live):
                continue
            c = codes[live] & _mask(k + 1)
            ctx = c >> np.uint64(_BITS)
            node = np.minimum(np.searchsorted(lv["ctx"], ctx), len(lv["ctx"]) - 1)
            known = lv["ctx"][node] == ctx
            i, node, c = live[known], node[known], c[known]
            whole = n_left[i] < 0
            n = np.where(whole, lv["n"][node], n_left[i])
            t = np.where(whole, lv["t"][node], t_left[i])
            e = np.minimum(np.searchsorted(lv["entry"], c), len(lv["entry"]) - 1)
            hit = lv["entry"][e] == c
            pays = hit | (t > 0)
            gain = np.where(hit, lv["count"][e], t).astype(np.float64)
            lp[i[pays]] += np.log10(gain[pays]) - np.log10((n + t)[pays])
            if k:
                n_left[i] = lv["n_left"][node]
                t_left[i] = lv["t_left"][node]
            done = np.zeros(len(live), bool)
            done[np.flatnonzero(known)[hit]] = True
            live = live[~done]
        if len(live):
            left = SYMBOLS - (int(self.levels[0]["t"][0]) if len(self.levels[0]["t"]) else 0)
            lp[live] -= np.log10(left)
        return lp


def _score(tables, train_tokens: int, distinct: int):
    """One pass: adds this shard's share to (__known, __seen, __score); counts tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = tables.value
        trie, words, counts = tab["trie"], tab["words"], tab["counts"]
        below = np.log10(train_tokens + distinct + 1.0)
        mine = None if tab["of"] == 1 else _shard(np.arange(1 << 2 * _BITS, dtype=np.uint64) << np.uint64(_BITS), tab["of"]) == tab["shard"]
        for batch in batches:
            data, off = B.text_bytes(batch.column("__text"))
            add = {c: [] for c in ((("__score",) if trie is not None else ()) + (("__tokens", "__known", "__base") if words is not None else ()))}
            for lo, hi in B.blocks(off, 1 << 20):
                rows = hi - lo
                if trie is not None:
                    code, starts, ends = _symbols(data, off, lo, hi, trie.order)
                    row = np.repeat(np.arange(rows), ends - starts + 1)
                    if mine is not None:
                        own = mine[(code >> np.uint64(_BITS)) & _mask(2)]
                        code, row = code[own], row[own]
                    u, back = np.unique(code, return_inverse=True)
                    add["__score"].append(np.bincount(row, trie.log10(u)[back], minlength=rows))
                if words is None:
                    continue
                h, row = _word_hashes(data, off, lo, hi)
                h = np.append(h, np.zeros(rows, np.int64))
                row = np.append(row, np.arange(rows))
                u, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(words, u), max(len(words) - 1, 0))
                c = np.where(words[at] == u, counts[at], 0).astype(np.int64) if len(words) else np.zeros(len(u), np.int64)
                c = c[back]
                add["__tokens"].append(np.bincount(row, minlength=rows))
                add["__known"].append(np.bincount(row[c > 0], minlength=rows))
                base = np.bincount(row, np.log10(c + 1.0), minlength=rows)
                if tab["shard"] == 0:
                    base = base - np.bincount(row, minlength=rows) * below
                add["__base"].append(base)
            new = {c: np.concatenate(x) if x else np.zeros(0) for c, x in add.items()}
            cols = []
            for name in batch.schema.names:
                col = batch.column(name)
                if name in new and name != "__tokens":
                    col = pa.array(col.to_numpy() + new[name].astype(np.int64 if name == "__known" else np.float64))
                elif name in new:
                    col = pa.array(new[name].astype(np.int64))
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)
    return run


def _last(code, bits_after: int = _BITS):
    return F.shiftrightunsigned(code, bits_after).bitwiseAND(F.lit((1 << 2 * _BITS) - 1))


def _shard(codes: np.ndarray, of: int) -> np.ndarray:
    """Shard of a gram: by its last two context symbols, so that of all contexts its coding visits only those
    of under two symbols, which every shard holds, lie elsewhere."""
    return (((codes >> np.uint64(_BITS)) & _mask(2)).astype(np.int64) * 40503 // 64) % of


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", order: int = ORDER, shard_rows: int = SHARD_ROWS,
          prefix: str = "lm_") -> DataFrame:
    """``docs`` plus n_tokens, n_known, train_tokens, base_score and score (names after ``prefix``)."""
    spark = docs.sparkSession
    size = {r["kind"]: r for r in model.groupBy("kind").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    grams, vocab = (size[k]["rows"] if k in size else 0 for k in (0, 1))
    tokens = size[1]["n"] if 1 in size else 0
    shards = max(1, -(-grams // shard_rows) if order > 1 else 1, -(-vocab // shard_rows))
    if shards > 1 and order > 1:  # contexts of under two symbols: 257 * 257 entries at most
        short = _columns(model.where("kind = 0").groupBy(F.col("code").bitwiseAND(F.lit((1 << 2 * _BITS) - 1)).alias("code"))
                         .agg(F.sum("n").alias("n")))
    rest = [c for c in docs.columns if c != text_col]
    out = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("__tokens"),
                      F.lit(0).cast("long").alias("__known"), F.lit(0.0).alias("__base"), F.lit(0.0).alias("__score"))
    word_shards = max(1, -(-vocab // shard_rows))
    for i in range(shards):
        part = model
        if shards > 1:
            of_gram = F.pmod(F.floor(_last(F.col("code")) * 40503 / 64), F.lit(shards)) if order > 1 else F.lit(0)
            part = model.where(F.when(F.col("kind") == 0, of_gram).otherwise(F.pmod(F.xxhash64("code"), F.lit(word_shards))) == i)
        words = counts = None
        if i < word_shards:
            words, counts = _columns(part.where("kind = 1"))
            by = np.argsort(words)
            words, counts = words[by], _narrow(counts[by])
            del by
        trie = Trie(*_columns(part.where("kind = 0")), order)
        if shards > 1 and order > 1:
            trie.replace_short(Trie(*short, 1))
        gram_shards = shards if order > 1 else 1
        table = spark.sparkContext.broadcast({"trie": trie.packed() if i < gram_shards else None, "words": words,
                                              "counts": counts, "shard": i, "of": gram_shards})
        del trie, words, counts
        out = out.transform(arrow, _score(table, tokens, vocab), out.schema)
        if i + 1 < shards:  # a pass of its own: tasks hold one shard's tables at a time
            out = written(out, "ppm-pass")
            table.unpersist()
    names = {"__tokens": "n_tokens", "__known": "n_known", "__base": "base_score", "__score": "score"}
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
                      *(F.col(c).alias(prefix + x) for c, x in names.items()),
                      F.lit(tokens).cast("long").alias(prefix + "train_tokens"))


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = df.select("code", "n").toArrow()
    return (t.column("code").to_numpy(zero_copy_only=False).astype(np.int64),
            t.column("n").to_numpy(zero_copy_only=False).astype(np.int64))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 7, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def digests(docs: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    src = docs.select("doc_id", "text").withColumn("held_out", held_out())
    model = train(src.where("not held_out"), order=order)
    s = score(src, model, order=order, shard_rows=shard_rows, prefix="")
    return s.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
