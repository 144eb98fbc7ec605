"""What several of the operators share: scratch tables, text bytes, skew-safe joins, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import written as durable

#: A to Z to lower case, byte for byte: UTF-8 uses these bytes for these letters only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A group with at least one row in HOT_SHARE is hot; there are HOT_SHARE such groups at most.
HOT_SHARE = 1000


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def swept(spark: SparkSession) -> None:
    """Collects the garbage of the driver and of every executor, so that the heap that it takes goes back to the machine.

    The driver's is plans that have run, without whose references Spark frees their broadcasts and shuffle files too; many small queries
    one after the other leave more of it than a small driver's heap shrinks by itself. An executor's heap grows up to its limit in a
    step that makes much garbage and stays so large in all later ones, though they may need it for their Python workers.
    """
    spark._jvm.System.gc()
    # one task each, as Spark deals tasks out in turn; a local master is its own executor
    executors = max(1, spark._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows LEFT JOIN groups on key, where groups has one row for each key and its size among total rows.

    Hot groups number HOT_SHARE at most, whatever the data, so they are broadcast; the rest are
    joined by a shuffle in which no key has more than a HOT_SHARE-th of the rows.
    """
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    found = rows.join(F.broadcast(groups.where(is_hot)), key, "left")
    cold = found.where(F.col(size).isNull()).select(*rows.columns).join(groups.where(~is_hot), key, "left")
    return found.where(F.col(size).isNotNull()).unionByName(cold)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: long) as (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds until all that is left are stars; every round is written to the shared folder, and
    the driver sees two counts of it only. Edges that are stars around their least nodes need no round. Nodes without edges aren't listed.
    Each step reads its edges once for both of their ends, as plans are what fills the driver's memory here.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def twice(df: DataFrame, one: tuple[str, str], other: tuple[str, str], names: tuple[str, str]) -> DataFrame:
        """Each row as two: the columns one, then the columns other, both by names."""
        rows = [F.struct(*[F.col(c).alias(name) for c, name in zip(columns, names, strict=True)]) for columns in (one, other)]
        return df.select(F.explode(F.array(*rows)).alias("row")).select("row.*")

    def with_least(df: DataFrame, own: bool) -> DataFrame:
        least = df.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        least = least.withColumn("m", F.least("u", "m")) if own else least
        return join_groups(df, least, "u", "degree", F.lit(total))

    def state(df: DataFrame) -> tuple[int, int]:
        """Edges, and nodes with a smaller neighbour that have another one too: without such, all are stars."""
        ends = twice(df.withColumns({"up": F.lit(1), "down": F.lit(0)}), ("u", "up"), ("v", "down"), ("node", "up"))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
        return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 0 AND all > 1"))).first())

    now = durable(tidy(edges))
    count, left = state(now)
    while left:
        total = 2 * count
        large = with_least(twice(now, ("u", "v"), ("v", "u"), ("u", "v")), True)
        large = durable(tidy(large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        total = count
        now = durable(tidy(twice(with_least(large, False), ("u", "m"), ("v", "m"), ("u", "v"))))
        count, left = state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
