"""Joins and ranks that stay bounded per task when one key holds a large part of all rows.

Everything here pre-aggregates first (map-side), so a hot key costs the shuffle one row per
map task, and spreads what is left over sub-keys. Nothing is dropped, capped or sampled.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows one key may bring to one task before it is spread. It also bounds what is
# broadcast: N input rows have at most N / HOT_ROWS keys above it.
HOT_ROWS = 1_000_000


def attach(facts: DataFrame, stats: DataFrame, keys: list[str], rows: str, spread: str,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join `facts` to `stats`, which has one row per `keys`.

    `rows` names the column of `stats` that says how many facts a key has (it is kept);
    `spread` names a column of `facts` that differs within a key. Keys above `hot_rows`
    are split into ceil(rows / hot_rows) sub-keys on both sides, so no task receives more
    than about `hot_rows` facts of one key. The sub-key is a hash of the row itself: a
    task that is run again gives every row the same place.
    """
    parts = F.ceil(F.col(rows) / F.lit(hot_rows)).cast("int")
    hot = stats.where(F.col(rows) > hot_rows).select(*keys, parts.alias("_parts"))
    place = F.when(F.col("_parts").isNotNull(),
                   F.pmod(F.xxhash64(F.col(spread)), F.col("_parts")).cast("int")).otherwise(F.lit(0))
    placed = facts.join(F.broadcast(hot), keys, "left").withColumn("_place", place).drop("_parts")
    copies = F.when(F.col(rows) > hot_rows, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    return placed.join(stats.withColumn("_place", F.explode(copies)), [*keys, "_place"], "left").drop("_place")


def count_per_key(facts: DataFrame, key: Column, name: str, spread: str, rows: str,
                  extra: list[Column] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """`facts` with the number of rows sharing `key` (column `rows`) and the `extra` aggregates."""
    keyed = facts.withColumn(name, key)
    stats = keyed.groupBy(name).agg(F.count(F.lit(1)).alias(rows), *extra)
    return attach(keyed, stats, [name], rows, spread, hot_rows)


def rank_in_chunks(rows: DataFrame, keys: list[str], order: str, rank: str,
                   chunk: int = HOT_ROWS) -> DataFrame:
    """1-based rank of each row within `keys` by `order`, a non-negative integer unique per key.

    A window over the key alone would sort a hot key in one task. Here rows are ranked
    within (key, order div chunk), which holds at most `chunk` rows because `order` is
    unique, and shifted by how many rows the key has in earlier chunks.
    """
    parted = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("bigint"))
    sizes = parted.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    within = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (parted.withColumn("_in_chunk", F.row_number().over(within))
            .join(offsets, [*keys, "_chunk"])
            .withColumn(rank, (F.col("_in_chunk") + F.col("_before")).cast("bigint"))
            .drop("_chunk", "_in_chunk", "_before"))
