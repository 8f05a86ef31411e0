"""Places in an explicit order, within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import storage


def placed(rows: DataFrame, kind: list[str], order: list[str | Column], settle=None) -> DataFrame:
    """Adds _place (from 0, within the rows of the same kind) and _size (how many those are).

    Rows are range-partitioned and sorted by kind and order, written once, and
    numbered within partitions; what stands before a partition comes from one
    count for each partition and kind.
    """
    settle = settle or storage.settle
    by = [*kind, *order]
    own = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    own = settle(own.select(*rows.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    stats = own.groupBy("_part", *kind).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*kind).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_part", *kind, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(*kind)).alias("_size"))
    a, b = own.alias("a"), stats.alias("b")
    same = F.col("a._part") == F.col("b._part")
    for k in kind:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in rows.columns], (F.col("a._at") - F.col("b._first") + F.col("b._before")).alias("_place"), F.col("b._size").alias("_size"))
