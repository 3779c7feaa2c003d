"""Measuring tiers: ladders of answers, and their aggregation to a profile."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwright.functions import text
from tierwright.session import in_small_batches
from tierwright.sources.tables import FIELDS, LANGUAGES, TIERS, dimension

#: Stop words by language, tried in the order of LANGUAGES: the rules tier looks for the first one only, the small tier
#: counts two of them, the large tier all.
STOP_WORDS = {"en": ("the", "and", "of", "that", "with"), "de": ("der", "und", "die", "das", "ist"), "fr": ("le", "les", "des", "est", "une"), "es": ("el", "los", "las", "que", "una")}
#: Marks of junk text, and shares of symbols above which the dearer tiers call a text bad.
JUNK, SMALL_SHARE, LARGE_SHARE = r"[*#%&$]{3}", 0.03, 0.01


def stop_words_of(c: Column) -> Column:
    """The text's words that are a stop word of any language, each time they occur, found in one pass."""
    any_of = [w for words in STOP_WORDS.values() for w in words]
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-zà-ÿ]+"), lambda w: w.isin(*any_of))


def most_hits(words: Column, number: int) -> Column:
    """The language with most hits among its first stop words; the first of equals, an empty text without a hit."""
    def among(stop_words: tuple[str, ...]) -> Callable[[Column], Column]:
        return lambda w: w.isin(*stop_words)

    hits = [F.size(F.filter(words, among(STOP_WORDS[lang][:number]))) for lang in LANGUAGES]
    top = F.greatest(*hits)
    return reduce(lambda c, x: c.when(x[1] == top, x[0]), zip(LANGUAGES, hits), F.when(top == 0, "")).otherwise("")


def language_ladder(documents: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, truth, what is carried, and each machine tier's answer to "which language", from whole texts."""
    rows = documents.select("doc_id", F.col("lang").alias("truth"), *carried, stop_words_of(F.col("text")).alias("w"))
    first = reduce(lambda c, lang: c.when(F.array_contains("w", STOP_WORDS[lang][0]), lang), LANGUAGES, F.when(F.lit(False), "")).otherwise("")
    return rows.select(*rows.columns[:-1], first.alias("rules"), most_hits(F.col("w"), 2).alias("small"), most_hits(F.col("w"), 5).alias("large"))


def quality_ladder(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, truth and each machine tier's answer to "is this text good", of the labelled documents."""
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    symbols, marks = F.regexp_count("text", F.lit("[*#%&$]")) / n, F.regexp_count("text", F.lit("[*#%&$|!]")) / n
    # of several labels of one document the highest holds, so that labels repeat no rows
    one = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    scored = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(one, "doc_id")
    good = lambda bad: F.when(bad, 0).otherwise(1)
    return scored.select("doc_id", F.col("quality").alias("truth"), good(F.rlike("text", F.lit(JUNK))).alias("rules"), good(symbols > SMALL_SHARE).alias("small"), good(marks > LARGE_SHARE).alias("large"))


def long_form(ladder: DataFrame) -> DataFrame:
    """The ladder's other columns, tier_idx, tier and got: one row for each tier, the human one (who is right here) included."""
    other = [c for c in ladder.columns if c not in TIERS]
    answers = F.posexplode(F.array(*(F.struct(F.lit(t).alias("tier"), (F.col("truth") if t == "human" else F.col(t)).alias("got")) for t in TIERS))).alias("tier_idx", "a")
    return ladder.select(*other, answers).select(*other, "tier_idx", "a.tier", "a.got")


def profile(long: DataFrame, by_field: bool = True) -> DataFrame:
    """tier_idx, tier (and field): accuracy and items. Latency is wall clock, so it belongs to ``timing``, not here."""
    keys = ["tier_idx", "tier"] + [F.col("truth").alias("field")] * by_field
    right = F.sum((F.col("got") == F.col("truth")).cast("bigint"))
    return long.groupBy(*keys).agg((right.cast("double") / F.count("*")).alias("accuracy"), F.count("*").alias("items"))


def language_profile(documents: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """The measured profile of the language ladder with the order of its fields.

    latencies (tier, latency) is what ``timing.latencies`` has observed; without it latencies are 0, so that a profile is repeatable.
    """
    fields = dimension(documents.sparkSession, "field", LANGUAGES)
    measured = profile(long_form(language_ladder(documents))).join(F.broadcast(fields), "field")
    if latencies is not None:
        measured = measured.join(F.broadcast(latencies), "tier", "left")
    latency = F.lit(0.0) if latencies is None else F.coalesce("latency", F.lit(0.0))
    return measured.select("tier_idx", "tier", "field_idx", "field", "accuracy", latency.alias("latency"), "items")


def quality_profile(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return profile(long_form(quality_ladder(documents, labels)), by_field=False)


def extraction(records: DataFrame) -> DataFrame:
    """id, split, text, field_idx, field, expected and got of the rules tier, a row for each field."""
    found = text.rules(F.col("text"))
    cells = F.posexplode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("expected"), found[f].alias("got")) for f in FIELDS))).alias("field_idx", "c")
    return records.select("id", "split", "text", cells).select("id", "split", "text", "field_idx", "c.*")


def scored(rows: DataFrame, scorer: Callable[[list[str]], list[str]], column: str, out: str = "got") -> DataFrame:
    """``rows`` with a model's answers; the scorer sees the values of ``column`` in batches, in a task.

    The plug for tiers whose models are not at hand here; a scorer is loaded once for each task.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = scorer(b[column].tolist())
            yield b

    return in_small_batches(rows).mapInPandas(run, schema)


def described(labels: DataFrame, embed: Callable[[list[str]], list[list[float]]], prefix: str = "") -> DataFrame:
    """name and centre (a unit vector) of each label (name, description): reference vectors that need no examples.

    The plug for embedding models, which are not at hand here; some models want a prefix before a description.
    """
    from tierwright.functions import vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "v": embed([prefix + x for x in b["description"]])})

    found = in_small_batches(labels).select("name", "description").mapInPandas(run, "name string, v array<double>")
    return found.select("name", vectors.unit(F.col("v")).alias("centre"))


def split_of(number: str) -> Column:
    """The fold of a numbered row: even numbers are for training."""
    return F.when(F.col(number) % 2 == 0, "training").otherwise("heldout")


def centroid_classes(embeddings: DataFrame) -> DataFrame:
    """vec_id, split, label and the label whose mean vector, over the even vec_ids, is nearest.

    The labels' means are few and small, and reach the rows as one scalar array.
    """
    from tierwright.functions import vectors

    rows = embeddings.select("vec_id", split_of("vec_id").alias("split"), "label", "embedding")
    centres = vectors.mean_pool(rows.where("split = 'training'"), "label", "embedding")
    references = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("name"), "centre"))).alias("r")).scalar()
    return rows.withColumn("references", references).select("vec_id", "split", "label", vectors.nearest(F.col("embedding"), F.col("references")).alias("got"))
