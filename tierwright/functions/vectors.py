"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length 1."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)


def mean_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and the unit mean vector of its rows: one row for each key and place is summed before the shuffle."""
    places = rows.select(key, F.posexplode(vector).alias("place", "x"))
    means = places.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("v"))
    return ordered.select(key, unit(F.transform("v", lambda s: s["x"])).alias("centre"))


def nearest(v: Column, references: Column) -> Column:
    """The name of the reference (array of name, centre in order) with the largest product; the first of equals."""
    scored = F.transform(references, lambda r: F.struct((-dot(v, r["centre"])).alias("s"), r["name"].alias("name")))
    return F.array_min(scored)["name"]
