"""Positions in a global order without bringing all rows to one task."""

from pyspark.sql import DataFrame, functions as F

from vellum.session import written


def sorted_positions(rows: DataFrame, by: str, position: str) -> DataFrame:
    """`rows` with their 1-based place in the order of the unique column `by`.

    Rows are range-partitioned and sorted once and written with their partition, so that
    the counts and the rows agree whatever is run again; a partition's first place is the
    sum of the counts before it, one number per partition.
    """
    from pyspark.sql import Window
    spread = rows.orderBy(by).withColumn("_id", F.monotonically_increasing_id())
    spread = written(spread.withColumn("_part", F.shiftright("_id", 33)), "sorted")
    low = (1 << 33) - 1
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return spread.join(F.broadcast(offsets), "_part").withColumn(
        position, (F.col("_id").bitwiseAND(F.lit(low)) + F.col("_before") + 1).cast("bigint")).drop(
        "_id", "_part", "_before")
