"""Tables written to the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.errors import build_error


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on a local master (tests), a local folder, kept for the session; elsewhere an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
            raise build_error("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
