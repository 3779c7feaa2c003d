"""All tiers over a table in one pass, with what each took: answers go on, times are observed beside them."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tierwright.session import in_small_batches
from tierwright.sources.tables import LANGUAGES

from . import measure
from .models import LETTERS, Tier, loaded


@dataclass(frozen=True)
class StopWords:
    """The language ladder's cheaper tiers as models: the first stop word met in the languages' order, or most hits among
    the first ``number`` of each language."""

    number: int

    def __call__(self):
        word, lists = re.compile(f"[{LETTERS}]+"), {lang: measure.STOP_WORDS[lang][: self.number] for lang in LANGUAGES}

        def answer(text: str) -> str:
            words = word.findall(text)
            hits = {lang: sum(words.count(w) for w in lists[lang]) for lang in LANGUAGES}
            if self.number == 1:
                return next((lang for lang in LANGUAGES if hits[lang]), "")
            return max(LANGUAGES, key=hits.__getitem__) if any(hits.values()) else ""

        return lambda texts: [answer(t) for t in texts]


def ladder_tiers() -> list[Tier]:
    return [Tier(name, f"stop-words-{n}", StopWords(n)) for name, n in (("rules", 1), ("small", 2), ("large", 5))]


def timed(rows: DataFrame, tiers: list[Tier], text: Column, observed: Observation, kept: list[str] | None = None) -> DataFrame:
    """``rows`` (of their columns those ``kept``; all, if None) with each tier's answer; once they were read by an action,
    ``observed`` has items, and ns_ and load_ns_ of each tier: the wall-clock time in its calls, and in making its model,
    summed over all tasks."""
    carried = in_small_batches(rows).select(*(["*"] if kept is None else kept), F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    names, columns = [t.name for t in tiers], carried.columns[:-1]
    # a batch's times stand in its first row
    fields = "".join(f", `{n}` string" for n in names) + "".join(f", `_ns_{n}` long, `_load_{n}` long" for n in names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]) + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            answers, times = [], []
            for tier in tiers:
                began = time.perf_counter_ns()
                model, new = loaded(tier)
                ready = time.perf_counter_ns()
                answers.append(pa.array(model(texts), pa.string()))
                for ns in (time.perf_counter_ns() - ready, (ready - began) * new):
                    times.append(pa.array([ns if i == 0 else 0 for i in range(len(texts))], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *answers, *times], [*columns, *names, *(f"_{k}_{n}" for n in names for k in ("ns", "load"))])

    found = carried.mapInArrow(run, schema)
    sums = [F.sum(f"_{k}_{n}").alias(f"{k}_{n}") for n in names for k in ("ns", "load")]
    return found.observe(observed, F.count("*").alias("items"), *sums).drop(*(f"_{k}_{n}" for n in names for k in ("ns", "load")))


def measured_in_one_pass(documents: DataFrame, tiers: list[Tier]) -> tuple[DataFrame, DataFrame]:
    """tier, field, accuracy, latency (ms an item) and items of each tier by true language; and tier and ms, its load time.

    Documents are read once: the counts by tier and field, an enumeration, are gathered, and the times are observed on
    the way. Load time is summed over workers.
    """
    spark, observed, names = documents.sparkSession, Observation("tiers"), [t.name for t in tiers]
    answers = timed(documents.select(F.col("lang").alias("field"), "text"), tiers, F.col("text"), observed, kept=["field"])
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("tier_idx"), F.lit(n).alias("tier"), (F.col(n) == F.col("field")).alias("right")) for i, n in enumerate(names)))).alias("c")
    counted = answers.select("field", cells).groupBy("c.tier_idx", "c.tier", "field").agg(F.count_if("c.right").alias("k"), F.count("*").alias("items")).collect()
    seen = observed.get if counted else {}  # nothing is observed where nothing is read
    items = max(1, seen.get("items", 0))
    latency = {n: seen.get(f"ns_{n}", 0) / 1e6 / items for n in names}
    rows = [(r["tier_idx"], r["tier"], r["field"], r["k"] / r["items"], latency[r["tier"]], r["items"]) for r in counted]
    profile = spark.createDataFrame(rows, "tier_idx int, tier string, field string, accuracy double, latency double, items long")
    return profile, spark.createDataFrame([(n, seen.get(f"load_{n}", 0) / 1e6) for n in names], "tier string, ms double")


def latencies(documents: DataFrame, tiers: list[Tier]) -> DataFrame:
    """tier and latency: milliseconds an item of each tier, all of them timed in one pass. The human tier's is assumed, not measured."""
    profile, _ = measured_in_one_pass(documents, tiers)
    return profile.groupBy("tier").agg(F.max("latency").alias("latency"))
