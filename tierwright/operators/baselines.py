"""Trivial baselines that a classifier has to beat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwright.functions import stats


def majority(rows: DataFrame, label: str, order: str) -> DataFrame:
    """label, n, total and accuracy of always answering the most common label; of equals, the one met first."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    total = F.sum("n").alias("total")
    top = F.max_by("label", F.struct("n", (-F.col("first")).alias("f"))).alias("label")
    return counts.agg(top, F.max("n").alias("n"), total).select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("total")), F.lit(0.0)).alias("accuracy"))


def uniform_guess(rows: DataFrame, label: str) -> DataFrame:
    """classes and the accuracy of guessing among them."""
    k = rows.agg(F.count_distinct(label).alias("classes"))
    return k.select("classes", F.coalesce(F.try_divide(F.lit(1.0), F.col("classes")), F.lit(0.0)).alias("accuracy"))


def constant(rows: DataFrame, label: str, decision) -> DataFrame:
    """The accuracy of one fixed answer; 0 without rows."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(label) == F.lit(decision)).cast("double")), F.lit(0.0)).alias("accuracy"))


def verdicts(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """``measured`` (accuracy, items and more) with the baseline's accuracy, the gap in points, and the verdict."""
    b = baseline.select(F.col("accuracy").alias("baseline")).scalar()
    rows = measured.withColumn("baseline", b)
    return rows.select("*", ((F.col("accuracy") - F.col("baseline")) * 100).alias("points"), stats.verdict(F.col("accuracy"), F.col("baseline"), F.col("items").cast("double")).alias("verdict"))
