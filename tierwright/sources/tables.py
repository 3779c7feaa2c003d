"""Readers of the input tables and of profile documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ordered enumerations; their order decides ties.
TIERS = ("rules", "small", "large", "human")
FIELDS = ("name", "birth", "document", "country", "address")
LANGUAGES = ("en", "de", "fr", "es")

PROFILE_CELL = "struct<accuracy:double,latency:double,items:bigint>"
PROFILES = f"measuredAt string, extraction map<string,map<string,{PROFILE_CELL}>>, classification map<string,{PROFILE_CELL}>, loadTime map<string,double>"

#: The published profile of 120 held-out items; (accuracy, latency in ms) by tier and field.
FROZEN_EXTRACTION = {
    "rules": {"name": (0.0, 0.005700000000069849), "birth": (1.0, 0.014292708334202568), "document": (0.8333333333333334, 0.002732641667049999), "country": (1.0, 0.0013052083338455608), "address": (0.0, 0.0024180583335692064)},
    "small": {"name": (0.49166666666666664, 20.3606864583339), "birth": (1.0, 20.1110201416673), "document": (0.625, 19.7378357666661), "country": (1.0, 20.1210135416671), "address": (0.425, 19.468174299999372)},
    "large": {"name": (0.9666666666666667, 35.97289166666645), "birth": (1.0, 35.88262117500029), "document": (0.675, 35.93252881666704), "country": (1.0, 35.12660694999989), "address": (0.38333333333333336, 33.981761108333984)},
    "human": {"name": (1.0, 0.0014052083327745397), "birth": (1.0, 0.0009687499996895592), "document": (1.0, 0.0008569416667645176), "country": (1.0, 0.0006562499998835847), "address": (1.0, 0.0016072916672176991)},
}
FROZEN_CLASSIFICATION = {"rules": (0.24166666666666667, 0.008540625000023283), "small": (0.675, 3.101530558332646), "large": (0.44166666666666665, 6.86415243333322), "human": (1.0, 0.0002312500000698492)}
FROZEN_LOAD = {"rules": 0.0, "small": 648711.0420830001, "large": 648711.0420830001, "human": 0.0}
FROZEN_ITEMS = 120

PROFILE_ROW = "tier_idx int, tier string, field_idx int, field string, accuracy double, latency double, items bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dimension(spark: SparkSession, name: str, values: tuple[str, ...]) -> DataFrame:
    """(name_idx, name) rows of an ordered enumeration."""
    return spark.createDataFrame([*enumerate(values)], f"{name}_idx int, {name} string")


def read_profiles(spark: SparkSession, path: str) -> DataFrame | None:
    """The one-row profile document at a path, with its explicit schema; None if nothing is there."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    return spark.read.schema(PROFILES).option("multiLine", True).json(path)


def as_document(profile: DataFrame, single: DataFrame, load_times: DataFrame, measured_at: str) -> DataFrame:
    """One row with a profile document as JSON (document): the cells by tier and field, of one tier for all, and load times.

    profile: tier, field, accuracy, latency and items; single: the same without field; load_times: tier and ms. The
    cells of tiers and fields, which are few, become nested maps.
    """
    cell = F.struct("accuracy", "latency", "items")
    entries = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))))
    by_tier = profile.groupBy("tier").agg(F.array_sort(F.collect_list(F.struct(F.col("field").alias("key"), cell.alias("value")))).alias("cells"))
    extraction = by_tier.agg(F.map_from_entries(F.collect_list(F.struct("tier", F.map_from_entries("cells"))))).scalar()
    whole = profile.sparkSession.range(1).select(
        F.lit(measured_at).alias("measuredAt"), extraction.alias("extraction"), single.agg(entries("tier", cell)).scalar().alias("classification"), load_times.agg(entries("tier", F.col("ms"))).scalar().alias("loadTime")
    )
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("document"))


def parsed(documents: DataFrame) -> DataFrame:
    """The columns of profile documents in JSON (document), by their explicit schema; a document that is none gives nulls."""
    return documents.select(F.from_json("document", PROFILES).alias("p")).select("p.*")


def extraction_rows(profiles: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """A profile document's extraction cells as rows, with the enumerations' order."""
    spark = profiles.sparkSession
    by_tier = profiles.select(F.explode("extraction").alias("tier", "cells"))
    cells = by_tier.select("tier", F.explode("cells").alias("field", "cell")).select("tier", "field", "cell.*")
    named = cells.join(F.broadcast(dimension(spark, "tier", TIERS)), "tier").join(F.broadcast(dimension(spark, "field", fields)), "field")
    return named.select("tier_idx", "tier", "field_idx", "field", "accuracy", "latency", "items")


def frozen_extraction(spark: SparkSession) -> DataFrame:
    """The published extraction profile as rows."""
    rows = [(i, t, j, f, *FROZEN_EXTRACTION[t][f], FROZEN_ITEMS) for i, t in enumerate(TIERS) for j, f in enumerate(FIELDS)]
    return spark.createDataFrame(rows, PROFILE_ROW)


def frozen_classification(spark: SparkSession) -> DataFrame:
    rows = [(i, t, *FROZEN_CLASSIFICATION[t], FROZEN_ITEMS) for i, t in enumerate(TIERS)]
    return spark.createDataFrame(rows, "tier_idx int, tier string, accuracy double, latency double, items bigint")


def frozen_load_time(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*FROZEN_LOAD.items()], T.StructType([T.StructField("tier", T.StringType()), T.StructField("ms", T.DoubleType())]))
