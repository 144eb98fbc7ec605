"""Window functions by name over partition and order keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quern.errors import build_error
from quern.operators.ordering import sort_column
from quern.sources.scratch import written
from quern.sources.tables import quote

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
VALUES = {"lag": F.lag, "lead": F.lead, "nth_value": F.nth_value}
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "first_value": F.first, "last_value": F.last}


def window(partition: Sequence[str] = (), order: Sequence[tuple[str, bool]] = (), rows: tuple[int, int] | None = None) -> WindowSpec:
    """rows is a frame of row offsets; without it, SQL's default: up to the current row's peers if ordered."""
    w = Window.partitionBy(*map(quote, partition)) if partition else Window.partitionBy()
    w = w.orderBy(*(sort_column(c, d) for c, d in order)) if order else w
    return w.rowsBetween(*rows) if rows else w


def over(name: str, w: WindowSpec, column: str | None = None, n: int | None = None) -> Column:
    if name in RANKS:
        return RANKS[name]().over(w)
    if name == "ntile" and n:
        return F.ntile(n).over(w)
    if name in VALUES and column:
        return VALUES[name](quote(column), n or 1).over(w)
    if name in AGGREGATES and (column or name == "count"):
        return AGGREGATES[name](quote(column) if column else F.lit(1)).over(w)
    raise build_error(f"no window function {name!r} with these arguments")


def with_window(df: DataFrame, alias: str, name: str, column: str | None = None, n: int | None = None, **spec) -> DataFrame:
    """df with one more column. A window without partition puts all rows in one task; for numbers over all rows use global_row_number()."""
    return df.withColumn(alias, over(name, window(**spec), column, n))


def global_row_number(df: DataFrame, order: Sequence[tuple[str, bool]], alias: str) -> DataFrame:
    """Row numbers over all rows by a total order, without bringing them to one task.

    Rows are sorted by range; the sizes of the ranges, one number a partition, give each its first number.
    """
    spark = df.sparkSession
    parts = df.repartitionByRange(*(sort_column(c, d) for c, d in order)).sortWithinPartitions(*(sort_column(c, d) for c, d in order))
    parts = parts.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    parts = written(parts)
    sizes = sorted((r["__part"], r["count"]) for r in parts.groupBy("__part").count().collect())
    first, rows = 0, []
    for part, n in sizes:
        rows.append((part, first))
        first += n
    starts = spark.createDataFrame(rows, "__part int, __first long")
    return parts.join(F.broadcast(starts), "__part").withColumn(alias, F.col("__first") + F.col("__at") + 1).drop("__part", "__at", "__first")
