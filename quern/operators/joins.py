"""Joins by kind, with the null semantics of SQL's IN and NOT IN."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import build_error
from quern.sources.tables import quote

KINDS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def join(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Equi-join on left-to-right column pairs; both sides' columns stay, so their names should differ."""
    if how not in KINDS or not on:
        raise build_error(f"no join {how!r} on {dict(on)}")
    condition = None
    for l, r in on.items():
        same = left[quote(l)] == right[quote(r)]
        condition = same if condition is None else condition & same
    return left.join(right, condition, how)


def where_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column is in the one column of values; a semi join."""
    v = values.toDF("__v")
    return df.join(v, df[quote(column)] == v["__v"], "left_semi")


def where_not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows for which NOT IN is true: none if values has a null; all if values is empty; else those not null and not found."""
    v = values.toDF("__v")
    facts = v.agg(F.count(F.lit(1)).alias("__rows"), F.count("__v").alias("__known"))
    hit = df.join(v.where("__v IS NOT NULL"), df[quote(column)] == v["__v"], "left_anti")
    told = hit.join(F.broadcast(facts), F.lit(True))  # one row
    return told.where(f"__rows = 0 OR (__rows = __known AND {quote(column)} IS NOT NULL)").select(*df.columns)


def where_exists(df: DataFrame, other: DataFrame, on: Mapping[str, str], negate: bool = False) -> DataFrame:
    return join(df, other, on, "left_anti" if negate else "left_semi")
