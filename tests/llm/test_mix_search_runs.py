"""Mixing, ranked search and periodic runs, against brute force and on odd tables."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tierwright.llm import common, periodic_runs, ranked_search, source_mix

from test_operators import DOCS, LOREM, odd_rows

SF = "/root/testdata/sf0.001"
BIG = 2**53 + 1


@pytest.fixture(scope="module")
def clashing(spark):
    extra = ("of", "row", "draw", "size", "target", "copies", "place", "term", "item", "score", "block", "rank", "runs", "n", "low", "collapsed")
    return spark.createDataFrame(odd_rows(), DOCS).select("*", *(F.lit(1).alias(c) for c in extra))


def texts(seed, n, words=6):
    r = random.Random(seed)
    return [" ".join(r.choice(LOREM.split()[:words]) for _ in range(int(r.expovariate(1 / 8)))) for _ in range(n)]


# mixing


def plain_mix(rows, weights=(5, 2, 1), share=1.5, most=2):
    """rows (doc_id, source, text) mixed by the definition: targets by resharing the excess, then one order per source."""
    size = lambda t: len((t or "").encode().split())
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, q, t in rows if q == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), share * sum(total.values())
    while left > 1e-9 and free:
        unit = left / sum(weight[s] for s in free)
        left = 0.0
        for s in [*free]:
            target[s] += unit * weight[s]
            if target[s] > most * total[s]:
                left += target[s] - most * total[s]
                target[s] = most * total[s]
                free.discard(s)
    out = []
    for s in names:
        mine = [(d, t, size(t)) for d, q, t in rows if q == s]
        copies = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - copies * total[s]
        fraction = rest / total[s] if total[s] else 0
        order = []
        for d, t, n in mine:
            if n and fraction > 1e-12:
                h = int(hashlib.sha256(f"mix:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:13], 16)
                u = (h + 0.5) / 2**52
                mean = total[s] / sum(1 for x in mine if x[2])
                odds = fraction / (1 - fraction) * math.sqrt(mean / n)
                order.append((u / (1 - u) / odds, d is None, d or 0, n))
            else:
                out.append((d, n, round(target[s], 4), copies * n))
        words = 0
        for _, no, d, n in sorted(order):
            first = words + n / 2 <= rest
            words += n
            out.append((None if no else d, n, round(target[s], 4), (copies + first) * n))
    return sorted(out, key=repr)


def mixed(rows, spark, **settings):
    found = source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), **settings).collect()
    return sorted(((r["doc_id"], r["size"], round(r["target"], 4), r["taken"]) for r in found), key=repr)


def test_mix_equals_plain_sampling(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "FEW", 3)  # so that the cut is searched over several digits
    r = random.Random(5)
    rows = [(BIG + i if i % 9 else None, r.choice(["a", "b", "b", "b", "é", "z", None, ""]), t) for i, t in enumerate(texts(5, 300))]
    assert mixed(rows, spark) == plain_mix(rows)


def test_some_of_many_equal_rows_are_taken(spark):
    rows = [(7, "a", "one two three")] * 50 + [(8, "b", "x " * 60)] * 3 + [(None, None, "y")] * 40
    found = mixed(rows, spark, weights=(1,), share=0.5)
    assert found == plain_mix(rows, weights=(1,), share=0.5)
    assert 0 < sum(t for d, _, _, t in found if d == 7) < 150


def test_targets_stop_at_twice_the_size_and_rows_are_near_them(spark):
    docs = common.table(spark, SF, "documents")
    rows = source_mix.mix(docs).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and docs.count() == len(rows)
    sums = source_mix.mix(docs.withColumn("x", F.lit(1))).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(r["target"] <= 2 * r["source_size"] and abs(r["t"] - r["target"]) <= r["m"] / 2 for r in sums)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, source_mix.mix(docs.repartition(7)).collect()), key=repr)


def test_preference_decides_who_is_taken(spark):
    rows = [(i, "ab"[i % 2], "w w w w") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = source_mix.mix(docs, weights=(1,), share=0.5, preference=F.when(F.col("doc_id") < 200, 1000.0).otherwise(1.0)).collect()
    assert sum(r["taken"] for r in found if r["doc_id"] < 200) > 0.95 * sum(r["taken"] for r in found)


# ranked search


def plain_search(docs, items, k=10):
    """docs and items (id, text), scored in full."""
    keep = lambda t: "".join(c if c >= "\x80" or c.isascii() and c.isalnum() else " " for c in (t or "")).encode()
    words = lambda t: [w.decode() for w in keep(t).lower().split()]
    found = [(d, words(t)) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n_docs, n_words = len(found), sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for x in {*w}:
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in asked.items():
        ranked = []
        for d, w in found:
            m = 10 + 90 * len(w) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in terms if x in df)
            if s > 0:
                ranked.append((-s, d is None, d or 0))
        out += [(i, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_docs, n, at_once", [(4096, 300, 500_000), (40, 700, 500_000), (600, 1_300, 9)])
def test_search_equals_full_scoring(spark, block_docs, n, at_once):
    """With many ties, repeated ids, texts without words, and blocks and nodes of all levels."""
    docs = [(None if i % 50 == 7 else BIG + i // 2, t) for i, t in enumerate(texts(n, n, 19))] + [(3, None), (4, "\n"), (5, "Éa ÉA ALPHA beta")]
    items = [(1, "Alpha, beta; GAMMA!"), (2, "tau"), (2, "upsilon"), (3, None), (4, "nowhere"), (None, "mu nu xi"), (5, " ".join(LOREM.split() * 3)), (6, "éa Éa")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("x"))
    found = ranked_search.search(table, spark.createDataFrame(items, "item_id int, text string"), block_docs=block_docs, item_terms_at_once=at_once).collect()
    assert sorted(map(tuple, found), key=repr) == plain_search(docs, items)


def test_search_without_documents_or_items(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for d, i in ((docs, items), (some, items.limit(0)), (some, items.withColumn("text", F.lit("!")))):
        found = ranked_search.search(d, i)
        assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")] and found.collect() == []


# periodic runs


def plain_runs(words):
    """Every maximal stretch of its smallest period, by the definition."""
    n, found = len(words), set()
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            part = words[i : i + length]
            if length >= max(6, 4 * p) and not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, p)):
                found.add((i, length, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite=True):
    words = (text or "").encode().split()
    if rewrite and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(lines), sha(b" ".join(kept)))


def periodic_texts():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(60)))) for i in range(150)]
    for i in range(60):
        once = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
        rows.append((BIG + i, " ".join([*"xy"[: i % 3], *(once * 12)[: r.randrange(3, 60)], "tail"])))
    return rows + [(700, None), (701, ""), (702, " \t"), (None, "a a a a a a a"), (None, "b"), (703, "　".join("aaaaaaaa")), (3, "z z z z z z")]


def found_runs(found):
    return sorted((tuple(r) for r in periodic_runs.digests(found).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)


@pytest.mark.parametrize("long, cells", [(1 << 16, 1 << 30), (0, 40)])
def test_runs_equal_the_definition(spark, long, cells):
    """In one task each, and by ranges of shifts that meet again."""
    rows = periodic_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1))
    found = periodic_runs.periodic_runs(docs, rewrite=periodic_runs.repeated_tail, long=long, cells=cells)
    assert found_runs(found) == sorted((plain_row(*r) for r in rows), key=repr)


def test_runs_query_equals_the_definition_on_documents(spark):
    short = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").collect() if len(r["text"] or "") < 4_000}
    found = {r["doc_id"]: r for r in periodic_runs.query(spark, SF).collect()}
    assert len(found) == common.table(spark, SF, "documents").count()
    assert any(found[d]["n_runs"] for d in short)
    for d, text in short.items():
        assert tuple(found[d][c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) == plain_row(d, text)


def test_runs_are_real_outputs(spark):
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, "x a b a b a b a b a  y")], "doc_id long, text string")).first()
    assert r["n_words"] == 11 and [tuple(x) for x in r["runs"]] == [(1, 9, 2)] and r["collapsed"] == "x a b y"


def test_odd_rows_and_empty_tables(spark, clashing):
    none = clashing.limit(0)
    items = spark.createDataFrame([(1, LOREM)], "item_id long, text string")
    assert source_mix.mix(clashing).count() == periodic_runs.periodic_runs(clashing).count() == len(odd_rows())
    found = ranked_search.search(clashing, items).collect()
    assert sorted(map(tuple, found), key=repr) == plain_search([(r[0], r[1]) for r in odd_rows()], [(1, LOREM)])
    assert source_mix.mix(none).collect() == [] and periodic_runs.periodic_runs(none).collect() == [] and ranked_search.search(none, items).collect() == []
