"""Results as text, and readers and writers of file formats."""

from __future__ import annotations

import csv
import io
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.errors import build_error

FILE_FORMATS = ("parquet", "json", "csv", "orc", "text")


def read(spark: SparkSession, kind: str, path: str, **options: Any) -> DataFrame:
    if kind not in FILE_FORMATS:
        raise build_error(f"no file format {kind!r}")
    return spark.read.format(kind).options(**options).load(path)


def write(df: DataFrame, kind: str, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: Any) -> None:
    if kind not in FILE_FORMATS:
        raise build_error(f"no file format {kind!r}")
    df.write.format(kind).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def as_text(rows: list[dict], columns: list[str], kind: str = "table") -> str:
    """rows as json, csv or an aligned table."""
    if kind == "json":
        return json.dumps(rows, indent=2, default=str)
    if kind == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(columns)
        w.writerows([["" if r[c] is None else r[c] for c in columns] for r in rows])
        return out.getvalue()
    if kind != "table":
        raise build_error(f"no result format {kind!r}")
    cells = [columns] + [["" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    width = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    lines = [" | ".join(v.ljust(n) for v, n in zip(row, width)).rstrip() for row in cells]
    return "\n".join([lines[0], "-+-".join("-" * n for n in width), *lines[1:]])


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **properties: str) -> DataFrame:
    """A table of another database. With a numeric column and its bounds, parts tasks read ranges of it side by side."""
    if parts > 1 and (column is None or bounds is None):
        raise build_error("reading in parts needs a column and its bounds")
    if parts > 1:
        return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)
