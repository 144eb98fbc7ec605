"""Recursive queries beyond the engine's level limit: an iterative loop over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import ErrorCode, QueryError
from quern.sources.scratch import new_path


def iterate(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], max_levels: int = 100_000, distinct: bool = False) -> DataFrame:
    """anchor, then what step makes of each level, until a level is empty; UNION ALL, or UNION if distinct.

    Each level is written to the folder in spark.checkpoint.dir (or, unset, a local one), so that plans stay short and lost
    executors cost no earlier level. With distinct, rows seen before end their branch, so that cycles end too.
    """
    spark = anchor.sparkSession
    path = new_path(spark)
    level, now = 0, anchor.distinct() if distinct else anchor
    while True:
        now.write.parquet(f"{path}/level={level}")
        rows = spark.read.schema(anchor.schema).parquet(f"{path}/level={level}")
        if rows.isEmpty():
            break
        level += 1
        if level > max_levels:
            raise QueryError(ErrorCode.QUERY_FAILED, f"the recursion has more than {max_levels} levels")
        now = step(rows).select(*(F.col(f.name).cast(f.dataType) for f in anchor.schema.fields))
        if distinct:
            seen = spark.read.schema(anchor.schema).parquet(*(f"{path}/level={i}" for i in range(level)))
            now = now.distinct().exceptAll(seen.distinct())
    return spark.read.schema(anchor.schema).parquet(*(f"{path}/level={i}" for i in range(level + 1)))
