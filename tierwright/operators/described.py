"""Vectors from text: every word has a vector of signs, and a text's vector is the sum over its words.

A word's signs are bits of a hash of it, so no table of vectors is needed, and equal words agree everywhere. Texts are
pooled by grouped aggregation: tasks add up what they have read, and one row of sums for each text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import words_of

#: Signs in a word's vector: bits of the first 15 hexadecimal digits of its md5.
SIGNS = 60


def bits_of(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, SIGNS // 4), 16, 10).cast("long")


def pooled(rows: DataFrame, keys: list[str], text: str, prefix: str = "") -> DataFrame:
    """The keys, n_words and v, the summed signs of all words of the rows with these keys; no words give zeros.

    ``prefix`` is put before every text, as some embeddings want it. Null keys are keys of their own.
    """
    given = rows.select(*keys, F.explode_outer(words_of(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    given = given.select(*keys, "word", bits_of(F.col("word")).alias("bits"))
    one = lambda i: F.coalesce(F.sum(F.shiftright("bits", i).bitwiseAND(F.lit(1))), F.lit(0))
    sums = given.groupBy(*keys).agg(F.count("word").alias("n_words"), *(one(i).alias(f"_{i}") for i in range(SIGNS)))
    return sums.select(*keys, "n_words", F.array(*(2 * F.col(f"_{i}") - F.col("n_words") for i in range(SIGNS))).alias("v"))


def references(labels: DataFrame, prefix: str = "") -> DataFrame:
    """name, centre and norm of each described label (name, description): reference vectors that need no examples."""
    found = pooled(labels, ["name"], "description", prefix).where("n_words > 0")
    return found.select("name", F.col("v").alias("centre"), F.sqrt(product(F.col("v"), F.col("v")).cast("double")).alias("norm"))


def product(a: Column, b: Column) -> Column:
    """The product of two vectors of whole numbers, exactly."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def nearest(rows: DataFrame, labels: DataFrame, keys: list[str], text: str, prefix: str = "", label_prefix: str = "") -> DataFrame:
    """The keys, n_words and got: the label whose description points most in the text's direction; the first of equals.

    Texts without words are answered by null. The labels are few, and reach the rows as one array.
    """
    centres = references(labels, label_prefix).agg(F.array_sort(F.collect_list(F.struct("name", "centre", "norm")))).scalar()
    scored = F.transform("refs", lambda r: F.struct((-product(F.col("v"), r["centre"]).cast("double") / r["norm"]).alias("s"), r["name"].alias("name")))
    found = pooled(rows, keys, text, prefix).withColumn("refs", centres)
    return found.select(*keys, "n_words", F.when(F.col("n_words") > 0, F.array_min(scored)["name"]).alias("got"))
