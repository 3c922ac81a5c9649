"""Merkle manifest of a table: a tree per group over its rows in id order, a tree over the groups, and for every
row the proof that leads from its leaf to the root.

Leaf: hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. Two nodes in a
row (one, where the last is alone) become the SHA-256 of their hex digests, until one is left: the group's
subroot. Subroots in the order of the groups (null first, then bytewise) give the root in the same way.

Method: pointer jumping. Building the tree shuffles nodes by their ancestor ``bits`` levels up, and each node gets
the segment of siblings towards that ancestor. Then self-joins double the distance: a node joins the node that
its segment ends at and takes over that one's segment, until every leaf reaches its root. A round keeps only nodes that a later round
starts from, so the far side of a join is 2 ** ``bits`` times smaller at least. That side is broadcast if its
size (rows x segment bytes, counted first) is under ``broadcast_bytes``; otherwise there are so many keys that
none is hot, and both sides shuffle. Rows are numbered by a range sort that is written once, with offsets per
(group, partition), so no task holds a group, whatever its share; many equal rows are dealt by a salt.

Results: rows with null ids come first in their group; rows with equal ids go by leaf digest; equal rows
get a leaf each; a group of one row has its leaf as subroot; an empty table gives no rows. Field names must be
columns; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabreg.llm.shared import arrow, hot_join, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS, BROADCAST_BYTES = 4, 16 << 20


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` (with a group ``g``) plus ``idx``, the place in the group by ``order`` from 0, and ``n``, its size."""
    by = ["g", *order, "__salt"]
    placed = written(leaves.withColumn("__salt", F.rand(12)).repartitionByRange(*by).sortWithinPartitions(*by)
                     .withColumn("__at", F.monotonically_increasing_id()).drop("__salt"), "leaves")
    part = F.shiftright("__at", 33)
    parts = placed.groupBy("g", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy("g").orderBy("__part")  # a row per partition of the sort at most
    parts = written(parts.select("g", "__part", "__first", F.sum("__rows").over(Window.partitionBy("g")).alias("n"),
                                 (F.sum("__rows").over(before) - F.col("__rows")).alias("__base")), "parts")
    return (placed.withColumn("__part", part).join(parts, ["g", "__part"])
            .withColumn("idx", F.col("__at") - F.col("__first") + F.col("__base")).drop("__at", "__part", "__first", "__base"))


def _h(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


NODES = "g string, n long, idx long, hash string, seg binary, above string"


def _climb(bits: int):
    """Runs of up to 2 ** bits nodes -> each node's siblings on the way up, and the ancestor's digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for g, n, top, members in zip(*(c.to_pylist() for c in batch.columns)):
                level = [m["hash"] for m in sorted(members, key=lambda m: m["idx"])]
                first, count, width = top << bits, len(level), n
                segs: list[list[bytes]] = [[] for _ in level]
                hashes = level
                for step in range(bits):
                    if width == 1:
                        break
                    raw = [bytes.fromhex(x) for x in level]
                    for i, seg in enumerate(segs):
                        other = (i >> step) ^ 1
                        if other < len(raw):
                            seg.append(raw[other])
                    level = [_h(*level[i:i + 2]) for i in range(0, len(level), 2)]
                    width = (width + 1) // 2
                for c, v in zip(out, ([g] * count, [n] * count, range(first, first + count), hashes,
                                      [b"".join(s) for s in segs], [level[0]] * count)):
                    c.extend(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             ["g", "n", "idx", "hash", "seg", "above"])
    return run


def _levels(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def paths(leaves: DataFrame, bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(g, n, idx, hash, seg, root) per leaf of (g, n, idx, hash): seg holds the siblings up to the group's root."""
    most = leaves.agg(F.max("n")).first()[0]
    height = max(1, -(-_levels(most or 0) // bits))  # in steps of ``bits`` levels
    nodes, layers = leaves.select("g", "n", "idx", "hash"), []
    for _ in range(height):  # nodes of a layer; those of finished groups stay behind
        runs = nodes.groupBy("g", "n", F.shiftright("idx", bits).alias("top")).agg(
            F.collect_list(F.struct("idx", "hash")).alias("members"))  # 2 ** bits members at most
        layer = written(runs.select("g", "n", "top", "members").transform(arrow, _climb(bits), NODES), "layer")
        layers.append(layer)
        size = F.ceil(F.col("n") / (1 << bits))
        nodes = (layer.where(F.col("n") > (1 << bits)).where(F.col("idx") % (1 << bits) == 0)
                 .select("g", size.cast("long").alias("n"), F.shiftright("idx", bits).alias("idx"), F.col("above").alias("hash")))
    # up: layers climbed so far; a group is done when its size there is 1
    hold = [(x.withColumn("size", F.ceil(F.col("n") / (1 << bits)).cast("long"))
             .withColumn("at", F.shiftright("idx", bits))) for x in layers]
    span = 1
    while span < height:
        wider = []
        for low in range(0, height, 2 * span):
            near = hold[low]
            if low + span < height:
                far = hold[low + span].select("g", F.col("idx").alias("at"), F.col("seg").alias("seg2"), F.col("above").alias("above2"),
                                              F.col("size").alias("size2"), F.col("at").alias("at2"))
                if far.count() * (32 * bits * span + 150) <= broadcast_bytes:
                    far = F.broadcast(far)
                going = near.where("size > 1").join(far, ["g", "at"])
                near = written(near.where("size = 1").unionByName(going.select(
                    "g", "n", "idx", "hash", F.concat("seg", "seg2").alias("seg"), F.col("above2").alias("above"),
                    F.col("size2").alias("size"), F.col("at2").alias("at"))), "jump")
            wider += [near] + [None] * (2 * span - 1)
        hold = wider
        span *= 2
    return hold[0].select("g", "n", "idx", "hash", "seg", F.col("above").alias("root"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             extra: dict[str, Column] | None = None, bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, leaf, subroot, root, proof, idx, n, top_idx, top_n, extra...) per row: proof holds the sibling digests (32 bytes each)
    from leaf to root; places and sizes in both trees tell where siblings stand. ``extra``: columns to carry along."""
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # sorts as the groups do
    extra = extra or {}
    rows = docs.select(g.alias("g"), F.col(id_col).alias("id"), leaf_hash([F.col(f) for f in fields]).alias("hash"),
                       *(c.alias(f"x_{k}") for k, c in extra.items()))
    leaves = written(numbered(rows, ["id", "hash"]), "numbered")
    low = paths(leaves, bits, broadcast_bytes)
    subroots = low.where("idx = 0").select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("n").alias("n_low"), F.col("root").alias("hash"))
    groups = written(numbered(subroots, ["of"]), "groups")
    high = paths(groups, bits, broadcast_bytes)
    tops = written(groups.select("of", "n_low", "idx").join(high, "idx").select(
        F.col("of").alias("g"), F.col("n_low").alias("rows"), F.col("hash").alias("subroot"), "root", F.col("seg").alias("seg_top"),
        F.col("idx").alias("top_idx"), F.col("n").alias("top_n")), "tops")
    full = leaves.drop("n", "hash").join(low.drop("root"), ["g", "idx"])
    return hot_join(full, tops, "g", "rows", leaves.count()).select(
        F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", F.concat("seg", "seg_top").alias("proof"), "idx", "n",
        "top_idx", "top_n", *(F.col(f"x_{k}").alias(k) for k in extra))


def fold(digest: str, proof: bytes, places: Sequence[tuple[int, int]]) -> str:
    """The root that a leaf digest and its proof lead to; ``places``: (place, size) in each tree on the way up."""
    at = 0
    for place, size in places:
        while size > 1:
            if place ^ 1 < size:
                other = proof[at:at + 32].hex()
                at += 32
                digest = _h(other, digest) if place & 1 else _h(digest, other)
            else:
                digest = _h(digest)
            place, size = place >> 1, (size + 1) // 2
    return digest


def _check(batches):
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("shown", "proof", "idx", "n", "top_idx", "top_n")}
        folded = [fold(d, p, ((i, n), (t, m))) for d, p, i, n, t, m in zip(*cols.values())]
        sha = [hashlib.sha256(p.hex().encode()).hexdigest() for p in cols["proof"]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(batch.column(c) for c in ("leaf", "subroot", "root")), pa.array(sha, pa.string()),
             pa.array(folded, pa.string()), pa.array([a == b for a, b in zip(folded, batch.column("root").to_pylist())], pa.bool_())],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verified(proofs: DataFrame, shown: str = "shown") -> DataFrame:
    """Fold each row's ``shown`` leaf digest (as held by someone else) with its proof, and compare with the root."""
    kind = proofs.schema["doc_id"].dataType.simpleString()
    return proofs.withColumnRenamed(shown, "shown").transform(
        arrow, _check, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def digests(docs: DataFrame, **how) -> DataFrame:
    """Proof digests of all rows; where 7 divides the CRC-32 of the decimal id, n_chars + 1 is shown instead of n_chars."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    true = leaf_hash([F.col(f) for f in FIELDS])
    false = leaf_hash([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    return verified(manifest(docs, extra={"shown": F.when(tampered, false).otherwise(true)}, **how))
