"""Links in groups of near copies: equal to brute force, and found without meeting all pairs of a group."""

import itertools
import random

import pytest

from tierwright.llm import jaccard_join

WORDS = 120


def variant_group(n, variants, seed):
    """Near copies in variants: one word is the variant's, one is each document's own."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(WORDS)]
    out = []
    for i in range(n):
        w = list(base)
        w[60] = f"variant{i % variants}"
        w[r.choice([*range(0, 55), *range(66, WORDS)])] = f"own{i}"
        out.append((i, " ".join(w)))
    return out


def footers(n, seed):
    """Three words that have two forms each, independently: eight kinds of documents with a word of their own."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"b{k}" for k in range(WORDS)]
        for k in (20, 50, 80):
            w[k] = f"form{k}{r.randrange(2)}"
        w[r.choice([*range(16), *range(100, 118)])] = f"own{i}"
        out.append((i, " ".join(w)))
    return out


def links_of(rows, variants=1):
    """Each document's links, and how many links there are between variants."""
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    kinds = {s: i % variants for i, s in sets.items()}
    near, between = {s: 0 for s in kinds}, 0
    for a, b in itertools.combinations(kinds, 2):
        k = len(a & b)
        if 100 * k >= 90 * (len(a) + len(b) - k):
            near[a] += 1
            near[b] += 1
            between += kinds[a] != kinds[b]
    return {i: near[s] for i, s in sets.items()}, between


def joined(spark, rows, monkeypatch):
    met = []
    pairs = jaccard_join.met_apart
    monkeypatch.setattr(jaccard_join, "met_apart", lambda *a: met.append((p := pairs(*a)).count()) or p)
    found = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 90).collect()
    return {r["doc_id"]: r["links"] for r in found}, sum(met)


@pytest.mark.parametrize("rows", [variant_group(240, 5, 2), footers(200, 4)], ids=["five", "footers"])
def test_links_in_variants_equal_brute_force(spark, monkeypatch, rows):
    got, _ = joined(spark, rows, monkeypatch)
    want, _ = links_of(rows)
    assert max(want.values()) > 10 and got == want


@pytest.mark.parametrize("n, variants", [(300, 2), (3_000, 2), (300, 10)])
def test_pairs_that_meet_grow_with_the_group_and_not_with_its_square(spark, monkeypatch, n, variants):
    """Of documents in one variant none meet; between variants those meet that changed the same words, most of which are links."""
    rows = variant_group(n, variants, n)
    got, pairs = joined(spark, rows, monkeypatch)
    if n > 1_000:
        assert pairs <= 20 * n
        return
    want, between = links_of(rows, variants)
    assert got == want and pairs <= 3 * between + 20 * n
