"""Running sums over a whole table, of which no task sees more than a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a column per entry of sums: the sum of its long values over all rows before this one (0 for the first).

    Rows are dealt out by ranges of the order and summed inside their range; the sums of the ranges before it are added.
    One task sees a row per range, and as many are broadcast: spark.sql.shuffle.partitions at most. The order should tell
    rows apart; rows alike in it are in one range, in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    start = Window.unboundedPreceding
    before_range, inside = Window.orderBy("__range").rowsBetween(start, -1), Window.partitionBy("__range").orderBy(*order).rowsBetween(start, -1)
    ranges = ranged.groupBy("__range").agg(*(F.sum(value).alias(f"__shift_{name}") for name, value in sums.items()))
    ranges = ranges.select("__range", *(F.coalesce(F.sum(f"__shift_{name}").over(before_range), F.lit(0)).alias(f"__shift_{name}") for name in sums))
    own = (F.coalesce(F.sum(value).over(inside), F.lit(0)) for value in sums.values())
    return ranged.join(F.broadcast(ranges), "__range").select(*rows.columns, *((F.col(f"__shift_{name}") + x).cast("long").alias(name) for name, x in zip(sums, own, strict=True)))
