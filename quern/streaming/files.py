"""The dynamic operators on file streams. Only what has a streaming meaning: filters, projections and grouped aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.filters import FilterBy
from quern.operators.projection import ProjectBy
from quern.sources.tables import Table, quote


def read_stream(spark: SparkSession, table: Table, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files under path, with columns by their keys."""
    reader = spark.readStream.schema(table.struct_type())
    return table.renamed((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path))


def filtered(stream: DataFrame, table: Table, params: Mapping[str, Any]) -> DataFrame:
    return ProjectBy(table).apply(FilterBy(table).apply(stream, params), params)


def tumbling_counts(stream: DataFrame, time: str, every: str, late: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by time window and keys; rows later than late behind the newest are left out, so that state stays bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(quote(time), every), *map(quote, by)).agg(F.count(F.lit(1)).alias("n"))
