"""Quality by co-training: a text view and a metadata view teach each other.

Both views are naive Bayes classifiers: the text view over hashed words and word pairs and over bins of what the text
looks like, the metadata view over source and declared language. In each round, each view labels the unlabelled
documents it is surest of for the other's training set; then the views' scores are calibrated and combined on labelled
documents that neither was trained on. Features are computed in one pass over whole texts; every round is a grouped
aggregation over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard_join import STEP, mixed, word_hashes

ROUNDS = 3
#: Labelled documents up to which their labels go to every task.
SMALL = 500_000
#: Share of the unlabelled documents that a view labels anew in each round, and their weight against true labels.
SHARE, WEIGHT = 0.1, 0.5
#: Evidence, in log odds against the prior, without which a view does not label however sure it is beside others.
CONFIDENT = 2.0
BINS = 16
#: Sources are told apart by a hash of so many values, which bounds the metadata model.
SOURCES = 1_024
#: Values that words and word pairs are hashed to, and words of a text that count at most, in the whole text's proportions:
#: words depend on each other.
SLOTS, TRUST = 1 << 15, 40.0
#: Folds of the labelled documents by crc32 of the id: 1 is held out, 0 calibrates, the others train.
FOLDS, CALIBRATE = 5, 0
THRESHOLD = 0.5


def by_share(part: Column, whole: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.sqrt(part / F.greatest(whole, F.lit(1))) * (BINS - 1))).cast("int")


def by_size(x: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor(F.log2(x + 1))).cast("int")


def text_bins(text: Column) -> dict[str, Column]:
    n = F.length(text)
    words, lines = F.split(text, r"\s+"), F.split(text, "\n")
    return {
        "symbols": by_share(F.regexp_count(text, F.lit(r"[*#%&$]")), n),
        "capitals": by_share(F.regexp_count(text, F.lit("[A-Z]")), n),
        "digits": by_share(F.regexp_count(text, F.lit("[0-9]")), n),
        "bars": by_share(F.regexp_count(text, F.lit(r"[|!<>{}=]")), n),
        "stops": by_share(F.regexp_count(text, F.lit(r"[.?]")), n),
        "words": by_size(F.size(words)),
        "word_length": F.least(F.lit(BINS - 1), F.floor(n / F.greatest(F.size(words), F.lit(1)))).cast("int"),
        "different_words": by_share(F.size(F.array_distinct(words)), F.size(words)),
        "different_lines": by_share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": by_size(n / F.size(lines)),
    }


def metadata_bins(docs: DataFrame) -> dict[str, Column]:
    """Bins of the page's metadata, as far as the columns are there; null is a value of its own."""
    has = set(docs.columns)
    out: dict[str, Column] = {}
    if "source" in has:
        out["source"] = F.when(F.col("source").isNull(), F.lit(SOURCES)).otherwise(F.pmod(F.xxhash64(F.col("source").cast("string")), F.lit(SOURCES)).cast("int"))
    if "lang" in has:
        out["lang"] = F.when(F.col("lang").isNull(), F.lit(64)).otherwise(F.pmod(F.xxhash64(F.col("lang").cast("string")), F.lit(64)).cast("int"))
    return out


#: Bins a feature can have, for smoothing and for the models' layout.
WIDTH = {"source": SOURCES + 1, "lang": 65}


def word_slots(texts: pd.Series) -> list[bytes]:
    """The different slots of each text's words and word pairs, two bytes each."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    h, begins = word_hashes(b" ".join(raw))
    ends = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in raw])).tolist()
    half = np.uint64(SLOTS // 2 - 1)
    words, pairs = h & half, (mixed(h[:-1] + STEP) + h[1:] >> np.uint64(40) & half) + half + np.uint64(1)
    return [np.unique(np.append(words[i:j], pairs[i : max(i, j - 1)])).astype("<u2").tobytes() for i, j in zip([0, *ends], ends)]


def features(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """The stored table of doc, label, fold, bins and word slots, and the names of the two views' bins."""
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).select(F.col("doc_id").alias("labelled"), "label")
    text = text_bins(F.col("_text"))
    meta = metadata_bins(docs)
    names = ["doc", *(f"t_{k}" for k in text), *(f"m_{k}" for k in meta)]
    bins = docs.withColumn("_text", common.text_of(docs)).select(common.key_of(docs).alias("doc"), *(c.alias(f"t_{k}") for k, c in text.items()), *(c.alias(f"m_{k}") for k, c in meta.items()), "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[names].assign(words=word_slots(b["_text"]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bins.select(*names).schema.fields)
    bins = common.in_small_batches(bins).mapInPandas(run, f"{schema}, words binary")
    fold = F.pmod(F.crc32(F.col("doc").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    joined = bins.join(common.sized(given, SMALL), bins["doc"] == given["labelled"], "left").drop("labelled").withColumn("fold", fold)
    return common.stored(joined, "quality-features"), [f"t_{k}" for k in text], [f"m_{k}" for k in meta]


class WordView:
    """Naive Bayes over word slots."""

    def __init__(self):
        self.weights = np.zeros(SLOTS)

    def fit(self, rows: DataFrame) -> None:
        """From rows with words, y and weight: tasks sum what they read by slot, and the sums are grouped."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, SLOTS))
            for b in batches:
                for y in (0, 1):
                    part = b[b["y"] == y]
                    slots = [np.frombuffer(x, "<u2") for x in part["words"]]
                    if slots:
                        total[y] += np.bincount(np.concatenate(slots), np.repeat(part["weight"].to_numpy(float), [len(x) for x in slots]), SLOTS)
            at = np.flatnonzero(total.any(0))
            yield pd.DataFrame({"slot": at.astype(np.int32), "n0": total[0, at], "n1": total[1, at]})

        found = rows.select("words", "y", "weight").mapInPandas(run, "slot int, n0 double, n1 double").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()
        n = np.full((2, SLOTS), 0.5)
        for r in found:  # at most SLOTS
            n[:, r["slot"]] += r["n0"], r["n1"]
        self.weights = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())

    def scored(self, rows: DataFrame, turn: int) -> DataFrame:
        """The stored rows with word_odds, the words' log odds, in place of the words."""
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)
        names = [c for c in rows.columns if c != "words"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                slots = [np.frombuffer(x, "<u2") for x in b.pop("words")]
                sums = np.array([shared.value[x].sum() * min(1.0, TRUST / max(1, len(x))) for x in slots])
                b["label"] = b["label"].astype("Int64")
                yield b.assign(word_odds=sums)[[*names, "word_odds"]]

        return common.stored(rows.select(*names, "words").mapInPandas(run, f"{schema}, word_odds double"), f"quality-scores-{turn}")


class View:
    """Naive Bayes over the bins of some features: a row of weights for each feature, and a prior."""

    def __init__(self, names: list[str]):
        self.names = names
        self.weights = [np.zeros(WIDTH.get(n[2:], BINS)) for n in names]
        self.prior = 0.0

    def score(self) -> Column:
        """The log odds as a column expression; the weights are literals, as many as there are bins."""
        terms = [F.element_at(F.lit(np.asarray(w)), F.col(n) + 1) for n, w in zip(self.names, self.weights)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.prior))

    def fit(self, rows: DataFrame) -> None:
        """From rows with y (0 or 1) and weight: one aggregation over (feature, bin, y)."""
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(n).alias("b")) for i, n in enumerate(self.names)))).alias("cell") if self.names else F.lit(None).alias("cell")
        counts = rows.select("y", "weight", cells).groupBy("cell.f", "cell.b", "y").agg(F.sum("weight").alias("n")).collect() if self.names else []
        found = [np.zeros((2, len(w))) for w in self.weights]
        for r in counts:  # at most as many as bins, twice
            found[r["f"]][r["y"], r["b"]] += r["n"]
        for i, n in enumerate(found):
            smooth = n + 1
            p = smooth / smooth.sum(1, keepdims=True)
            self.weights[i] = np.log(p[1]) - np.log(p[0])
        if found:
            total = found[0].sum(1) + 1
            self.prior = float(np.log(total[1] / total[0]))


def pseudo_labels(rows: DataFrame, score: Column, share: float, prior: float, odds: float) -> Column:
    """1, 0 or null: the unlabelled rows among the surest ``share``, by the classes' proportion (``prior``), whose score
    has moved by ``CONFIDENT`` from ``odds``, the view's prior log odds."""
    s = rows.where("label IS NULL").select(score.alias("s"))
    cuts = s.agg(F.percentile_approx("s", F.lit([share * (1 - prior), 1 - share * prior]).cast("array<double>"), 10_000).alias("cuts")).first()["cuts"]
    if not cuts:
        return F.lit(None).cast("int")
    return F.when((score >= cuts[1]) & (score >= odds + CONFIDENT), 1).when((score <= cuts[0]) & (score <= odds - CONFIDENT), 0)


def calibrated(cells: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """Logistic weights of the two views' scores and a bias, by Newton steps on cells (text, metadata, y, rows)."""
    if len({y for *_, y, _ in cells}) < 2:
        return 1.0, 1.0, 0.0
    t = np.array(cells, float)
    x, y, n = np.column_stack([t[:, 0], t[:, 1], np.ones(len(t))]), t[:, 2], t[:, 3]
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1.0, 1e-3])
        w = w + np.linalg.solve(h, x.T @ (n * (y - p)) - np.diag([1.0, 1.0, 1e-3]) @ w)
    return tuple(float(a) for a in w)


def classify(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, text_score, metadata_score, score (probability of quality 1) and predicted, one row a row.

    The label of a document in the held-out fold is never used. A null or empty text has its own bins, as have null
    metadata; columns that are missing are left out of the metadata view. Of several labels of an id the highest
    holds. Without labels of both classes all scores are those of the smoothed prior. Rows may repeat.
    """
    rows, text_names, meta_names = features(docs, labels)
    text, meta, words = View(text_names), View(meta_names), WordView()
    trained = F.col("label").isNotNull() & ~F.col("fold").isin(1, CALIBRATE)
    gold = rows.where(trained).select("*", F.col("label").alias("y"), F.lit(1.0).alias("weight"))
    text.fit(gold)
    words.fit(gold)
    meta.fit(gold)
    prior = 1 / (1 + float(np.exp(-text.prior)))
    open_rows = lambda t: t.where("label IS NULL")
    taught = lambda t, label: open_rows(t).select("*", label.alias("y"), F.lit(WEIGHT).alias("weight")).where("y IS NOT NULL")
    of_text = lambda: text.score() + F.col("word_odds")
    narrow = words.scored(rows, 0)
    for turn in range(1, rounds + 1):
        by_text = pseudo_labels(narrow, of_text(), SHARE * turn, prior, text.prior)
        by_meta = pseudo_labels(narrow, meta.score(), SHARE * turn, prior, meta.prior)
        for_text, for_meta = gold.unionByName(taught(rows, by_meta)), gold.unionByName(taught(narrow, by_text), allowMissingColumns=True)
        meta.fit(for_meta)
        text.fit(for_text)
        words.fit(for_text)
        narrow = words.scored(rows, turn)
    rows = narrow
    step = 0.25
    near = lambda score: (F.round(score / step) * step).alias
    cells = rows.where(F.col("label").isNotNull() & (F.col("fold") == CALIBRATE)).select(near(of_text())("t"), near(meta.score())("m"), "label").groupBy("t", "m", "label").agg(F.count("*").alias("n"))
    # the scores' range is bounded by the bins' weights, and so are the cells
    a, b, c = calibrated([(r["t"], r["m"], r["label"], r["n"]) for r in cells.collect()])
    logit = F.lit(a) * F.col("text_score") + F.lit(b) * F.col("metadata_score") + F.lit(c)
    scored = rows.select("doc", "fold", of_text().alias("text_score"), meta.score().alias("metadata_score")).withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(
        F.when(F.col("doc") != common.NO_ID, F.col("doc")).alias("doc_id"), (F.col("fold") == 1).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
