"""URL filters from dated lists: an as-of join of captures and the entries active when they were fetched; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Of entries for one pattern with the same date, the first of these counts; "none" ends an entry without a new one.
ACTIONS = ("block", "allow", "none")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and trailing dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1), r"\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): each dated entry holds until the next of its pattern; until is null for the last.

    entries has pattern, action and since. Rows with a null pattern or date, or an unknown action, are passed over; repeated rows count once.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.lower("action"))
    rows = entries.select(F.lower(F.col("pattern").cast("string")).alias("pattern"), F.col("since").cast("timestamp_ntz").alias("since"), rank.alias("rank"))
    rows = rows.where("pattern IS NOT NULL AND since IS NOT NULL AND rank > 0").groupBy("pattern", "since").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("pattern").orderBy("since")
    return rows.select("pattern", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int")).alias("action"), "since", F.lead("since").over(w).alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with three more columns: pattern and action of the entry that decides (null if none does), and kept.

    An entry's pattern is a host; it holds for that host and those under it. Of the entries active at a capture's time (since <= time <
    until), the one for the most labels decides; "block" drops the capture, all else keeps it. A null URL, one without a
    host or a null time meets no entry and is kept. Repeated rows are judged alike. The three names replace columns of theirs. An
    empty list keeps all; an empty table gives no rows.

    Entries that meet a host in a month are gathered once for each such pair; captures then join that by (host, month) and look up theirs by time.
    So a host with a third of all captures isn't multiplied by its parent domains, and its months are keys of
    their own; Spark splits what is still skewed.
    """
    added = ("pattern", "action", "kept")
    own = [c for c in captures.columns if c not in added]
    rows = captures.select(*own).withColumns({"__host": host_of(F.col(url_col).cast("string")), "__at": F.col(time_col).cast("timestamp_ntz")})
    rows = rows.withColumn("__month", F.date_trunc("month", "__at").cast("timestamp_ntz"))
    pairs = rows.where("__host <> '' AND __month IS NOT NULL").select(F.col("__host").alias("host"), F.col("__month").alias("month")).distinct()
    low, high = (F.lit(x).cast("timestamp_ntz") for x in pairs.agg(F.min("month"), F.max("month")).first())
    spans = intervals(entries).where("action <> 'none'")
    first = F.greatest(F.date_trunc("month", "since").cast("timestamp_ntz"), low)
    # the month in which until falls is met too; one too many does no harm
    last = F.least(F.coalesce(F.date_trunc("month", "until").cast("timestamp_ntz"), high), high)
    spans = spans.where(first <= last).select("pattern", "action", "since", "until", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i).alias("depth")))
    keys = pairs.select("host", "month", F.explode(above).alias("k")).select("host", "month", "k.pattern", "k.depth")
    # by depth, so that the first that is active is the most special
    active = keys.join(spans, ["pattern", "month"]).groupBy("host", "month").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("order"), "since", "until", "pattern", "action"))).alias("__entries"))
    active = durable(active).withColumnsRenamed({"host": "__host", "month": "__month"})
    out = rows.join(active, ["__host", "__month"], "left")
    at = F.col("__at")
    hit = F.get(F.filter("__entries", lambda e: (e["since"] <= at) & (e["until"].isNull() | (at < e["until"]))), F.lit(0))
    out = out.withColumn("__hit", hit)
    return out.select(*own, F.col("__hit.pattern").alias("pattern"), F.col("__hit.action").alias("action"), (~F.coalesce(F.col("__hit.action") == "block", F.lit(False))).alias("kept"))
