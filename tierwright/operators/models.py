"""Model tiers: a linear model over words, fitted by grouped sums, that each worker loads once.

A tier is given to tasks as a ``Tier``: a factory with a pinned revision. The model itself is made in the worker, once for
each revision, and answers all batches of all tasks that the worker runs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwright.session import in_small_batches

#: Words that a model knows, the commonest of its training texts; what it weighs them in: thousandths of a natural logarithm.
WORDS, SCALE = 2_000, 1000.0
LETTERS = "a-zà-ÿ"
Model = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Tier:
    """A tier's name, the revision of its model, and what makes the model in a worker."""

    name: str
    revision: str
    factory: Callable[[], Model] = field(compare=False)


_LOADED: dict[tuple[str, str], Model] = {}


def loaded(tier: Tier) -> tuple[Model, bool]:
    """The tier's model in this worker, and whether it was made just now."""
    key = (tier.name, tier.revision)
    new = key not in _LOADED
    if new:
        _LOADED[key] = tier.factory()
    return _LOADED[key], new


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[^{LETTERS}]+"), "")


def fit(rows: DataFrame, text: str, label: str, words: int = WORDS) -> DataFrame:
    """word, label and weight of a naive Bayes model; the prior stands under the empty word.

    Weights are whole thousandths, so sums of them are the same in any order. Rows with a null label are left out.
    """
    given = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), words_of(F.col(text)).alias("w"))
    whole = lambda x: F.floor(F.log(x) * SCALE + 0.5).cast("long")
    counts = given.select("label", F.explode("w").alias("word")).groupBy("word", "label").agg(F.count("*").alias("c"))
    known = counts.groupBy("word").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("by_label")).orderBy(F.desc("n"), "word").limit(words)
    labels = given.groupBy("label").agg(F.count("*").alias("docs"))
    prior = labels.select(F.lit("").alias("word"), "label", whole(F.col("docs") / labels.agg(F.sum("docs")).scalar()).alias("weight"))
    each = known.withColumn("all", labels.agg(F.array_sort(F.collect_set("label"))).scalar()).select("word", "by_label", F.explode("all").alias("label"))
    each = each.select("word", "label", F.coalesce(F.try_element_at("by_label", F.col("label")), F.lit(0)).alias("c"))
    size = each.groupBy("label").agg(F.sum("c").alias("total"), F.count("*").alias("known"))
    weighed = each.join(F.broadcast(size), "label").select("word", "label", whole((F.col("c") + 1) / (F.col("total") + F.col("known"))).alias("weight"))
    return weighed.unionByName(prior)


class WordModel:
    """The label of the highest summed weights; the first of equals."""

    def __init__(self, labels: list[str], words: list[str], weights: np.ndarray, prior: np.ndarray):
        self.labels, self.number, self.weights, self.prior = labels, {w: i for i, w in enumerate(words)}, weights, prior
        self.word = re.compile(f"[{LETTERS}]+")

    def __call__(self, texts: list[str]) -> list[str]:
        """The texts' answers; texts are in lower case already."""
        out = []
        for text in texts:
            at = [i for w in self.word.findall(text) if (i := self.number.get(w)) is not None]
            out.append(self.labels[int((self.prior + self.weights[at].sum(0)).argmax())] if self.labels else "")
        return out


@dataclass(frozen=True)
class FromBroadcast:
    """Makes a ``WordModel`` of what the driver has sent to the worker's host once."""

    sent: Broadcast

    def __call__(self) -> WordModel:
        return WordModel(*self.sent.value)


def word_tier(weights: DataFrame, name: str = "model") -> Tier:
    """The tier of a fitted model (``fit``), which has at most ``WORDS`` words for each label."""
    rows = weights.collect()
    labels, words = sorted({r["label"] for r in rows}), sorted({r["word"] for r in rows} - {""})
    table, prior, place = np.zeros((len(words), len(labels)), np.int64), np.zeros(len(labels), np.int64), {w: i for i, w in enumerate(words)}
    for r in rows:
        if r["word"]:
            table[place[r["word"]], labels.index(r["label"])] = r["weight"]
        else:
            prior[labels.index(r["label"])] = r["weight"]
    revision = hashlib.sha256(repr((labels, words)).encode() + table.tobytes() + prior.tobytes()).hexdigest()
    return Tier(name, revision, FromBroadcast(weights.sparkSession.sparkContext.broadcast((labels, words, table, prior))))


def answered(rows: DataFrame, tier: Tier, text: Column) -> DataFrame:
    """``rows`` with a column of the tier's name: its answer to the text in lower case. A null text is empty."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, _ = loaded(tier)
        for batch in batches:
            yield pd.Series(model(batch.tolist()), batch.index, object)

    return in_small_batches(rows).withColumn(tier.name, answer(F.lower(F.coalesce(text, F.lit("")))))
