"""Fusion of language evidence against a plain one, with few and with many languages, and hot and missing values."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwright.llm import language

SCHEMA = "doc_id string, page_id string, ll array<double>, p array<double>, declared string, host string, domain string, suffix string"


def found_rows(seed, n, k):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ll = [-r.expovariate(0.3) for _ in range(k)]
        top = max(ll)
        ll = [x - top for x in ll]
        powers = [math.exp(x) for x in ll]
        host = r.choice(["", "h.a.org", "h.a.org", "i.a.org", "j.b.fr", "k.de"])
        out.append((None if i % 7 == 0 else str(i), str(i) if i % 7 == 0 else None, ll, [x / sum(powers) for x in powers], r.choice(["", "de", "xx"]), host, ".".join(host.split(".")[-2:]) if host != "k.de" else "", host.split(".")[-1]))
    return out


def plain_fusion(rows, names):
    k = range(len(names))
    total = lambda of: [sum(r[3][i] for r in rows if of(r)) for i in k]
    base = [x + 1 for x in total(lambda r: True)]
    base = [x / sum(base) for x in base]
    out = {}
    for row in rows:
        scores = list(row[2])
        for c in (4, 7):
            if row[c]:
                mine, all_ = total(lambda r: r[c] == row[c]), total(lambda r: r[c] != "")
                scores = [s + math.log((mine[i] + 0.1) / (all_[i] + 1)) for i, s in enumerate(scores)]
        prior = base
        for of in (lambda r: row[5] and row[6] and r[6] == row[6] and r[5], lambda r: row[5] and r[5] == row[5]):
            others = [max(x - row[3][i], 0.0) for i, x in enumerate(total(of))] if row[5] else [0.0] * len(names)
            prior = [(others[i] + language.ABOVE * prior[i]) / (sum(others) + language.ABOVE) for i in k]
        scores = [s + math.log(prior[i]) for i, s in enumerate(scores)]
        powers = [math.exp(s - max(scores)) for s in scores]
        best = max(k, key=lambda i: powers[i])
        out[row[0], row[1]] = (names[best], powers[best] / sum(powers), names[max(k, key=lambda i: row[3][i])])
    return out


@pytest.mark.parametrize("k, n", [(1, 20), (4, 120), (9, 60)])
def test_fusion_equals_plain_fusion(spark, k, n):
    names = [f"l{i}" for i in range(k)]
    rows = found_rows(k, n, k)
    got = {(r["doc_id"], r["page_id"]): r for r in language.fuse(spark.createDataFrame(rows, SCHEMA), names).collect()}
    want = plain_fusion(rows, names)
    assert set(got) == set(want)
    for key, (lang, confidence, text_lang) in want.items():
        assert got[key]["confidence"] == pytest.approx(confidence, abs=1e-9)
        assert (got[key]["lang"], got[key]["text_lang"]) == (lang, text_lang)


def test_a_hundred_languages_are_planned_and_told_apart(spark):
    """All by name, in seconds, where a plan that grew with the languages took hours."""
    r = random.Random(1)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1_000)]
    words = {f"l{i:03d}": ["".join(letters[(i * 10 + r.randrange(10)) % 1_000] for _ in range(4)) for _ in range(12)] for i in range(100)}
    rows = [(j * 100 + i, " ".join(r.choice(words[f"l{i:03d}"]) for _ in range(30)), f"l{i:03d}", f"s{i % 7}") for i in range(100) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    began = time.time()
    found = {x["doc_id"]: x["lang"] for x in language.identify(docs, pages).collect()}
    assert time.time() - began < 90
    assert len(found) == 1_000 and np.mean([found[i] == lang for i, _, lang, _ in rows]) > 0.99


def test_sparse_evidence_equals_dense_counts():
    r = np.random.default_rng(3)
    lang, slot = np.divmod(r.choice(3 * language.SLOTS, 4_000, replace=False), language.SLOTS)
    n = r.integers(1, 50, 4_000).astype(float)
    model = language.Trigrams(["a", "b", "c"], lang, slot, n)
    dense = np.full((language.SLOTS, 3), 0.5)
    dense[slot, lang] += n
    dense = np.log(dense / dense.sum(0))
    for text in ("", "x", "Some words, and more of them; " * 9):
        slots = language.trigrams(text)
        ll = dense[slots].sum(0) * min(1.0, language.TRUST / max(1, len(slots)))
        assert model.evidence(text) == pytest.approx(ll - ll.max(), abs=1e-4)


def test_missing_values_say_nothing(spark):
    rows = [(str(i), None, [0.0, -1.0], [0.7310585786300049, 0.2689414213699951], "", "", "", "") for i in range(50)]
    got = language.fuse(spark.createDataFrame(rows, SCHEMA), ["a", "b"]).agg(F.min("confidence"), F.max("confidence")).first()
    assert got[0] == pytest.approx(got[1]) and 0.5 < got[0] < 1
