"""Sharding by a permutation-filled lookup table. DataFrame and SQL functions only.

Each shard prefers the slots of a table of prime size in the order (offset + j * skip) mod size, offset and
skip from hashes of its name. Shards take turns: each claims the next slot of its order that is still free,
until the table is full. A key goes to the shard of slot hash(key) mod size; the table is broadcast (its size
is a parameter, ``MOST`` rows at most), so placing a row is one hash lookup. When a shard is added or goes,
few keys move, and shards differ by one slot at most. The fill copies the table at each claim, in one task, so its
cost grows with the square of the size; ``MOST`` is a size that it was measured at (see README).

A null key is placed by the text 'null'; repeated keys share a shard; keys of a hot group differ and so
spread evenly. An empty table gives no rows. All columns are kept; slot and shard follow, and input columns of
these names are kept as ``<name>_input`` (with more underscores if that is taken too).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS, PER_SHARD, MOST = 16, 100, 10_007


def prime_from(n: int) -> int:
    """Smallest prime >= n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n ** .5) + 1)):
        n += 1
    return n


def hashed(text: str) -> str:
    """SQL text: 60 bits of md5 as a number."""
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) as bigint)"


def lookup_table(spark: SparkSession, names: list[str], size: int | None = None) -> DataFrame:
    """(slot, shard): the filled table. ``size`` must be a prime of at least the number of shards."""
    n = len(names)
    size = size or prime_from(PER_SHARD * n)
    if not n or len(set(names)) != n:
        raise ValueError("shard names must be given and differ")
    if not n <= size <= MOST or prime_from(size) != size:
        raise ValueError(f"size must be a prime from {n} to {MOST}")
    shards = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in names])).alias("i", "name"))
    prefs = shards.selectExpr(
        "i", f"{hashed('concat(name, \"/offset\")')} % {size} as o",
        f"{hashed('concat(name, \"/skip\")')} % {size - 1} + 1 as k").agg(
        F.array_sort(F.collect_list(F.struct("i", "o", "k"))).alias("prefs"))
    slot = lambda j: f"cast((prefs[i].o + {j} * prefs[i].k) % {size} as int)"
    free = f"j -> acc.owner[{slot('j')}] = -1"
    first = (f"coalesce(get(filter(sequence(acc.next[i], least(acc.next[i] + 63, {size - 1})), {free}), 0),"
             f" get(filter(sequence(acc.next[i], {size - 1}), {free}), 0))")
    claim = (f"named_struct('owner', concat(slice(acc.owner, 1, {slot('c')}), array(i), slice(acc.owner, {slot('c')} + 2, {size})),"
             f" 'next', concat(slice(acc.next, 1, i), array(c + 1), slice(acc.next, i + 2, {n})))")
    turn = f"transform(array(step % {n}), i -> transform(array({first}), c -> {claim})[0])[0]"
    fill = (f"aggregate(sequence(0, {size - 1}), named_struct('owner', array_repeat(-1, {size}), 'next', array_repeat(0, {n})),"
            f" (acc, step) -> {turn}).owner")
    filled = prefs.selectExpr(f"posexplode({fill}) as (slot, i)")
    return filled.join(F.broadcast(shards), "i").select("slot", F.col("name").alias("shard"))


def place(rows: DataFrame, key_col: str, names: list[str], size: int | None = None,
          slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``rows`` plus the slot and the shard of each row's key."""
    size = size or prime_from(PER_SHARD * len(names))
    table = lookup_table(rows.sparkSession, names, size).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    keyed = rows.withColumn("__slot", F.expr(f"cast({hashed(f'coalesce(cast(`{key_col}` as string), \"null\")')} % {size} as int)"))
    kept = {}
    for c in rows.columns:
        name = f"{c}_input" if c in (slot_col, shard_col) else c
        while name != c and (name in rows.columns or name in kept.values()):
            name += "_"
        kept[c] = name
    return keyed.join(F.broadcast(table), "__slot").select(
        *(F.col(f"`{c}`").alias(name) for c, name in kept.items()), F.col("__slot").alias(slot_col), F.col("__shard").alias(shard_col))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def write_shards(rows: DataFrame, key_col: str, path: str, names: list[str], salts: int = 8) -> None:
    """Write one folder per shard; ``salts`` tasks share the rows of a shard."""
    placed = place(rows, key_col, names)
    (placed.withColumn("__salt", F.pmod(F.xxhash64(key_col), F.lit(salts)))
     .repartition("shard", "__salt").drop("__salt", "slot").write.partitionBy("shard").parquet(path))
