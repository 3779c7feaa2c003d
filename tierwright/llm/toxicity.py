"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Only documents carry labels. A logistic sentence score over words and word beginnings is combined to the document's
probability by noisy-or, 1 - prod(1 - p_sentence), and the weights are fitted through that combination; the fitted
sentence scores then show which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the fit uses at most (about: they are chosen by a hash of the id).
FIT_ROWS = 20_000
#: Characters of their texts that the fit uses at most (about): beyond, fewer documents are chosen.
FIT_CHARS = 200_000_000
#: Features met in the sentences of these documents that the driver fits on, about; fewer documents are taken beyond.
FIT_MET = 8_000_000
#: Features kept, by chi-square; each is in at least LEAST_DF labelled documents.
FEATURES, LEAST_DF = 4_000, 8
BEGINNINGS = (4, 5)
STEPS, RATE, L2 = 300, 0.1, 2e-4
THRESHOLD = 0.7
FOLDS = 3
SENTENCE = 0.5
PIECE = re.compile(r"[^\W\d_]+|[.!?\n]")
BREAKS = frozenset(".!?\n")
#: Words whose weights a task remembers; beyond that it starts anew (speed only).
REMEMBERED = 200_000


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    """Weights of the sentence score."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)


class Scorer:
    """Scores texts under a model, with the weights of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def weight(self, piece: str) -> float:
        w = self.words.get(piece)
        if w is None:
            if len(self.words) > REMEMBERED:
                self.words = {}
            w = self.words[piece] = np.nan if piece in BREAKS else sum(self.model.weights.get(f, 0.0) for f in features_of(piece))
        return w

    def sentences(self, text: str) -> np.ndarray:
        """The logit of each sentence; a text without words is one empty sentence."""
        w = np.fromiter(map(self.weight, PIECE.findall(text.lower())), float)
        at = np.isnan(w)
        w[at] = 0
        starts = np.concatenate([[0], np.flatnonzero(at[:-1]) + 1]) if len(w) else np.empty(0, int)
        z = np.add.reduceat(w, starts) if len(w) else np.zeros(1)
        sizes = np.diff(np.append(starts, len(w))) - np.add.reduceat(at, starts) if len(w) else np.ones(1)
        return self.model.bias + (z[sizes > 0] if (sizes > 0).any() else np.zeros(1))


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)), without loss of small terms."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Begin and end of the sentences that ``Scorer.sentences`` scores, in the same order."""
    out, begin = [], None
    for m in PIECE.finditer(text):
        if m[0] in BREAKS:
            if begin is not None:
                out.append((begin, m.end()))
            begin = None
        elif begin is None:
            begin = m.start()
    return [*out, (begin, len(text))] if begin is not None else out


def fit_noisy_or(labels: np.ndarray, counts: np.ndarray, met: np.ndarray, at: np.ndarray, feature: np.ndarray, features: list[str]) -> Model:
    """Adam over whole batches. Of each text its label, the number of its sentences and of the features that it has, and
    of each of these, text by text, the sentence (from 0 in its text) and the feature's number."""
    y = labels.astype(float)
    first = np.concatenate([[0], np.cumsum(counts)])
    sentence = np.repeat(first[:-1], met) + at
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    theta, m, v = np.zeros(len(features) + 1), 0.0, 0.0
    theta[-1] = -4.0
    for step in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], first[-1])
        s = np.minimum(np.add.reduceat(np.logaddexp(0, z), first[:-1]), 500)
        p = -np.expm1(-s)
        # d loss / d s of -y log(1 - exp(-s)) + (1 - y) s
        down = weight * np.where(y > 0, -np.exp(-s) / np.maximum(p, 1e-12), 1.0)
        by_sentence = np.repeat(down, counts) / (1 + np.exp(-np.maximum(z, -500)))
        g = np.append(np.bincount(feature, by_sentence[sentence], len(features)), by_sentence.sum())
        g[:-1] += L2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[-1]), {f: float(w) for f, w in zip(features, theta) if w})


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from about ``rows`` of the labelled documents outside the held-out fold (all, if there are fewer).

    Fewer are taken where their texts have more than ``FIT_CHARS`` characters or ``FIT_MET`` features. Null labels, ids
    and texts are left out; of several labels of one id the highest holds. Without rows, or with one class only, the model
    gives every sentence the same small score.
    """
    docs = common.in_small_batches(docs)
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    given = given.where(~common.held_out(F.col("doc_id"), FOLDS))
    n = given.count()
    share = min(1.0, rows / max(1, n))
    given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(common.sized(given, rows * 2), "doc_id")
    sample = common.stored(sample.withColumn("by", F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000))).select("text", "label", "by"), "toxic-sample")
    chars = sample.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if chars > FIT_CHARS:
        sample = sample.where(F.col("by") < int(FIT_CHARS / chars * 1_000_000))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, toxic = Counter(), Counter()
        for b in batches:
            for text, label in zip(b["text"], b["label"]):
                met = {f for w in set(PIECE.findall(text.lower())) - BREAKS for f in features_of(w)}
                total.update(met)
                if label:
                    toxic.update(met)
        if total:
            yield pd.DataFrame([(f, k, toxic[f]) for f, k in total.items()], columns=["feature", "n", "n1"])

    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    if not size["n1"] or size["n1"] == size["n"]:
        return Model(-4.0)
    p = size["n1"] / size["n"]
    counts = sample.mapInPandas(counted, "feature string, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    chi = (F.col("n1") - F.col("n") * p) ** 2 / (F.col("n") * p * (1 - p))
    best = counts.where(F.col("n") >= min(LEAST_DF, max(1, size["n1"] // 2))).orderBy(chi.desc(), "feature").limit(FEATURES)
    features = sorted(r["feature"] for r in best.select("feature").collect())
    number = {f: i for i, f in enumerate(features)}

    def instances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, label in zip(b["text"], b["label"]):
                at, ids, sentence, open_ = [], [], 0, False
                for w in PIECE.findall(text.lower()):
                    if w in BREAKS:
                        sentence, open_ = sentence + open_, False
                        continue
                    open_ = True
                    for f in features_of(w):
                        if (i := number.get(f)) is not None:
                            at.append(sentence)
                            ids.append(i)
                out.append((label, max(1, sentence + open_), len(at), np.array(at, np.int32).tobytes(), np.array(ids, np.int16).tobytes()))
            yield pd.DataFrame(out, columns=["label", "n", "met", "at", "ids"])

    # numbers of features fit two bytes; they come to the driver as they are, and not as objects
    found = common.stored(sample.mapInPandas(instances, "label int, n int, met long, at binary, ids binary"), "toxic-instances")
    total = found.agg(F.sum("met").alias("n")).first()["n"]
    if total > FIT_MET:
        found = found.where(F.pmod(F.xxhash64("at", "ids"), F.lit(1_000_000)) < int(FIT_MET / total * 1_000_000))
    rows = found.toArrow()
    joined = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
    return fit_noisy_or(rows["label"].to_numpy(), rows["n"].to_numpy().astype(np.int64), rows["met"].to_numpy(), joined("at", np.int32), joined("ids", np.int16).astype(np.int64), features)


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of every row, score, n_sentences, n_offending and offending.

    ``offending`` has begin:end (code points) of each sentence whose own score is at least ``SENTENCE``. A null or
    empty text is one sentence without words. Rows may repeat; each is scored by itself, whole. The given columns are
    passed on as they are, whatever their types and nulls.
    """
    kept = [docs[c] for c in columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    cut = float(np.log(SENTENCE / (1 - SENTENCE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            out = []
            for text in b.column(b.num_columns - 1).to_pylist():
                z = scorer.sentences(text)
                bad = np.flatnonzero(z >= cut)
                spans = sentence_spans(text) if len(bad) else []
                out.append((float(noisy_or(z)), len(z), len(bad), ",".join(f"{spans[i][0]}:{spans[i][1]}" for i in bad if i < len(spans))))
            found = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.float64(), pa.int64(), pa.int64(), pa.string()))]
            # the other columns stay as they came
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], [*b.schema.names[:-1], "score", "n_sentences", "n_offending", "offending"])

    return common.in_small_batches(docs).select(*kept, common.text_of(docs).alias("_text")).mapInArrow(run, f"{schema}, score double, n_sentences long, n_offending long, offending string")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the located sentences of every row of ``docs``.

    A null or empty text is one sentence without words, with the score of the bias. Rows may repeat and ids be null (never
    held out); each row is scored by itself. Other columns are not looked at.
    """
    found = score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return found.select("doc_id", common.held_out(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "n_offending", "offending")


def harmless_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    # positional names, so that no column of the documents can clash with those of the score
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    found = score(plain, fit(docs, labels), tuple(names))
    return found.where(F.col("score") < THRESHOLD).select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
