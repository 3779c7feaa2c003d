"""Fingerprints of tables by part, without order: what changed shows without comparing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["part", "n", "sum", "mixed"]


def row_hashes(df: DataFrame, seed: int) -> Column:
    """A hash of all the row's columns by name, null or not; maps as entries in order."""
    columns = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = df[f"`{f.name}`"]
        columns += [c.isNull(), F.array_sort(F.map_entries(c)) if f.dataType.typeName() == "map" else c]
    return F.xxhash64(F.lit(seed), *columns)


def manifest(df: DataFrame, part: Column) -> DataFrame:
    """part, n, sum and mixed: how many rows each part has, and two sums of hashes of them, in one aggregation.

    Parts with the same rows, as often each, have the same figures in whatever order. Different ones have the same with
    a chance of about 2**-128. A null part is a part.
    """
    given = df.select(part.alias("part"), row_hashes(df, 1).cast("decimal(38,0)").alias("a"), row_hashes(df, 2).cast("decimal(38,0)").alias("b"))
    return given.groupBy("part").agg(F.count("*").alias("n"), F.sum("a").cast("string").alias("sum"), F.sum("b").cast("string").alias("mixed"))


def stale_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """part and change (added, removed or changed) of two manifests' parts that do not agree."""
    a, b = (m.select("part", F.struct("n", "sum", "mixed").alias(c)) for m, c in ((old, "was"), (new, "is")))
    both = a.withColumnRenamed("part", "p").join(b, F.col("p").eqNullSafe(F.col("part")), "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(F.when(F.col("is").isNull(), F.col("p")).otherwise(F.col("part")).alias("part"), change.alias("change")).where("change IS NOT NULL")
