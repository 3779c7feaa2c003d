"""Whole results against plain ones: near matches, toxicity from its weights, the text view's labels; stages without rows."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, LOREM, SF, odd_rows

from tierwright.llm import common, decontaminate, exact_dedup, jaccard_join, pii, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_near(docs, items, length, slop):
    """Every window of every item with every document, word by word."""
    texts = [words_of(t) for _, t in docs]
    windows = {}
    for item, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - length + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + length]), set()).add(item)
    vocabulary = {t for w in windows for t in w}
    df = {t: sum(x.count(t) for x in texts) for t in vocabulary}
    out = []
    for (doc, _), x in zip(docs, texts):
        n, ids = 0, set()
        for w, of in windows.items():
            if not all(df[t] for t in w):
                continue
            off = min(range(len(w)), key=lambda i: (df[w[i]], i))
            starts = [p - off for p, t in enumerate(x) if t == w[off]]
            if any(all(i == off or any(abs(p - s - i) <= slop for p, t in enumerate(x) if t == w[i]) for i in range(len(w))) for s in starts):
                n += 1
                ids |= {str(i) for i in of if i is not None}
        out.append((doc, n, ",".join(sorted(ids))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, slop, seed", [(4, 2, 1), (6, 1, 2), (3, 3, 3)])
def test_near_matches_equal_brute_force(spark, length, slop, seed):
    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(14)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 9))))) for i in range(12)] + [(20, None), (21, "--"), (22, "T1, t2; T3!")]
    docs = [(i if i % 9 else None, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(60)] + [(100, None), (101, "T1 x T2 y t3")]
    found = decontaminate.near_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), length, slop)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_near(docs, items, length, slop)


def test_near_matches_on_odd_rows_and_without_rows(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    items = spark.createDataFrame([(1, LOREM), (2, None), (None, "tau upsilon")], "item_id long, text string")
    wide = odd.select("*", *(F.lit(1).alias(c) for c in ("doc", "pos", "block", "win_id", "n", "start", "term_id", "want")))
    plain = sorted(map(repr, decontaminate.near_matches(odd, items).collect()))
    assert len(plain) == len(odd_rows()) and sorted(map(repr, decontaminate.near_matches(wide, items).collect())) == plain
    assert decontaminate.near_matches(odd.limit(0), items).collect() == []
    assert {r["n_near"] for r in decontaminate.near_matches(odd, items.limit(0)).collect()} == {0}


def test_toxicity_equals_plain_noisy_or_of_the_fitted_weights(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    assert model.weights

    def plain(text):
        clean = 1.0
        sentences = [s for s in re.split(r"[.!?\n]", (text or "").lower()) if re.search(r"[^\W\d_]", s)] or [""]
        for s in sentences:
            z = model.bias
            for w in re.findall(r"[^\W\d_]+", s):
                z += model.weights.get(w, 0.0) + sum(model.weights.get(f"{w[:n]}*", 0.0) for n in toxicity.BEGINNINGS if len(w) > n)
            clean *= 1 / (1 + math.exp(min(z, 700)))
        return 1 - clean

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-9)


def test_a_fit_of_fewer_features_still_learns(spark, monkeypatch):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    whole = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "FIT_MET", 3_000)
    part = toxicity.fit(docs, labels)
    assert part.weights and part.weights != whole.weights


def test_stages_without_rows_and_with_repeated_ones(spark):
    labels = common.table(spark, SF, "labels")
    items = spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")
    rows = spark.createDataFrame([(1, LOREM, "en", "s", 5), (1, LOREM, "en", "s", 5), (None, LOREM, None, None, None)], DOCS)
    stages = (lambda d: toxicity.harmless_documents(d, labels), exact_dedup.unique_documents, jaccard_join.distinct_documents, lambda d: decontaminate.clean_documents(d, items))
    for stage, left in zip(stages, (3, 1, None, 3)):
        assert stage(rows.limit(0)).collect() == []
        if left:
            assert stage(rows).count() == left


def test_no_short_number_is_called_a_card():
    found = pii.Decoder(pii.train(pii.labelled_table()))
    texts = ["tel: 020 7946 0958 today", "fax 0049 30 1234567", "call 0161 496 0000 now", "number 12345 of 67890", "card 4111 1111 1111 1111 end"]
    for text, spans in zip(texts, found.spans(texts)):
        for kind, a, b in spans:
            assert pii.KINDS[kind] != "card" or sum(c.isdigit() for c in text[a:b]) >= 12, (text, text[a:b])
