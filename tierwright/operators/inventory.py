"""Where each number comes from: measured, assumed or chosen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierwright.functions.assumptions import KEYS

#: The kinds in the order of reports; the last has no member at present.
KINDS = ("measured", "assumed", "chosen", "cited")
MEASURED = (("profiles", "accuracy and latency of each tier on each field"), ("routing", "the best affordable assignment"), ("shadowPrice", "the least budget that buys a better one"), ("revisions", "the models that were measured"))
CHOSEN = (("corpus", "the generated items and their truth"), ("splits", "which phrasings rules may see"), ("fields", "what is extracted"), ("tiers", "where a field may go"))


def inventory(spark: SparkSession) -> DataFrame:
    """seq, name, provenance and what: the union of the three sections."""
    section = lambda kind, rows, at: spark.createDataFrame([(at + i, n, kind, w) for i, (n, w) in enumerate(rows)], "seq int, name string, provenance string, what string")
    assumed = [(k, "an assumption of the scenario") for k in KEYS]
    return section("measured", MEASURED, 0).unionByName(section("assumed", assumed, len(MEASURED))).unionByName(section("chosen", CHOSEN, len(MEASURED) + len(assumed)))


def union(sections: dict[str, DataFrame]) -> DataFrame:
    """seq, name, provenance and what of the sections' rows (name, what), by kind; seq numbers a section's names by code point."""
    by_name = Window.partitionBy("provenance").orderBy("name")
    rows = reduce(DataFrame.unionByName, (df.select("name", F.lit(kind).alias("provenance"), "what") for kind, df in sections.items()))
    return rows.select((F.row_number().over(by_name) - 1).alias("seq"), "name", "provenance", "what")


def counts(rows: DataFrame) -> DataFrame:
    """kind_idx, provenance and n of every kind, those without members too."""
    kinds = rows.sparkSession.createDataFrame([*enumerate(KINDS)], "kind_idx int, provenance string")
    return kinds.join(rows.groupBy("provenance").agg(F.count("*").alias("n")), "provenance", "left").select("kind_idx", "provenance", F.coalesce("n", F.lit(0)).alias("n"))


def listed(rows: DataFrame) -> DataFrame:
    """The inventory by kind, then in its own order."""
    kinds = rows.sparkSession.createDataFrame([*enumerate(KINDS)], "kind_idx int, provenance string")
    return rows.join(F.broadcast(kinds), "provenance").orderBy("kind_idx", "seq")


def missing(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """The wanted keys that nothing gives."""
    return wanted.select(key).distinct().join(given.select(key), key, "left_anti")


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that ``old`` does not have, with their repetitions."""
    return new.exceptAll(old)
