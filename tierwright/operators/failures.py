"""Failures of the machine tiers: collection, their shape, and a gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierwright.functions import text


def collect(answers: DataFrame) -> DataFrame:
    """The wrong answers with their mode and shown text.

    answers: tier_idx, tier, field_idx, field, id, text, expected, got. Their order is tier, field, id.
    """
    wrong = answers.where(~text.correct(F.col("got"), F.col("expected")))
    return wrong.select("tier_idx", "tier", "field_idx", "field", "id", text.displayed(F.col("text")).alias("text"), "expected", "got", text.failure_mode(F.col("got"), F.col("expected")).alias("mode"))


def shape(failures: DataFrame) -> DataFrame:
    """tier, field, mode, n and first of the groups; ``first`` is the place of the group's first failure, for ties."""
    place = F.struct("tier_idx", "field_idx", "id")
    return failures.groupBy("tier", "field", "mode").agg(F.count("*").alias("n"), F.min(place).alias("first"))


def top_shapes(failures: DataFrame, k: int) -> DataFrame:
    """The k most frequent groups; of equals, the one met first."""
    return shape(failures).orderBy(F.desc("n"), "first").limit(k).drop("first")


def gallery(failures: DataFrame, k: int) -> DataFrame:
    """The first failure of each tier and field, and of these the first k."""
    first = F.row_number().over(Window.partitionBy("tier", "field").orderBy("id"))
    one = failures.withColumn("rn", first).where("rn = 1").drop("rn")
    return one.orderBy("tier_idx", "field_idx", "id").limit(k)
