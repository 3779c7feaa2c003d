"""Models, vectors, exact frontiers, one-pass measures, patterns, update logs, totals, leaks and manifests."""

import hashlib
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tierwright.functions.assumptions import as_row, prices
from tierwright.operators import described, leaks, measure, models, patterns, reports, routing, skyline, timing, updates
from tierwright.sinks import files, manifest
from tierwright.sources import tables

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "fr"), (5, "LE chat — les chiens", "fr"), (6, "zzz 123", None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string, lang string")


# models


def test_weights_are_those_of_plain_counts(texts):
    got = {(r["word"], r["label"]): r["weight"] for r in models.fit(texts, "text", "lang", words=4).collect()}
    words = {"en": "the cat and the dog".split(), "de": "der hund und die katze".split(), "fr": "le chat les chiens".split()}
    counts = {w: sum(x.count(w) for x in words.values()) for x in words.values() for w in x}
    known = sorted(counts, key=lambda w: (-counts[w], w))[:4]
    for label, mine in words.items():
        total = sum(mine.count(w) for w in known)
        for w in known:
            assert got[w, label] == math.floor(1000 * math.log((mine.count(w) + 1) / (total + 4)) + 0.5)
        assert got["", label] == math.floor(1000 * math.log({"en": 2, "de": 1, "fr": 2}[label] / 5) + 0.5)
    assert len(got) == 15


def test_a_tier_is_made_once_for_each_revision_and_worker(spark, texts, tmp_path):
    made = tmp_path / "made"

    class Counting:
        def __call__(self):
            with made.open("a") as f:
                f.write("x")
            return lambda batch: [str(len(t)) for t in batch]

    import os

    rows = texts.repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        tier = models.Tier("length", f"r-{os.getpid()}", Counting())
        got = {r["id"]: r["length"] for r in models.answered(rows, tier, F.col("text")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: str(len(t or "")) for i, t, _ in TEXTS}
    # the test's workers are four at the most; six batches were answered
    assert 1 <= len(made.read_text()) <= 4


def test_word_model_answers(texts):
    tier = models.word_tier(models.fit(texts, "text", "lang"))
    model, _ = models.loaded(tier)
    assert model(["the cat", "der hund", "le chat les", "", "unknown"]) == ["en", "de", "fr", "en", "en"]
    again = models.word_tier(models.fit(texts, "text", "lang"))
    assert again.revision == tier.revision and not models.loaded(again)[1]
    nothing = models.word_tier(models.fit(texts.where("false"), "text", "lang"))
    assert nothing.revision != tier.revision and models.loaded(nothing)[0](["a"]) == [""]


# vectors


def plain_vector(text):
    words = [w for w in "".join(c if "a" <= c <= "z" or "à" <= c <= "ÿ" else " " for c in text.lower()).split()]
    bits = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
    return len(words), [sum(2 * (b >> i & 1) - 1 for b in bits) for i in range(described.SIGNS)]


def test_vectors_equal_plain_sums_and_rows_of_a_key_are_pooled(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b ç"), (2, None), (None, "x")], "id long, text string")
    got = {r["id"]: (r["n_words"], r["v"]) for r in described.pooled(rows, ["id"], "text", prefix="q ").collect()}
    assert got == {1: plain_vector("q a b q b ç"), 2: plain_vector("q"), None: plain_vector("q x")}
    assert described.pooled(rows, ["id"], "text").where("id = 2").first()["v"] == [0] * described.SIGNS


def test_nearest_description_and_prefixes(spark, texts):
    labels = spark.createDataFrame([("de", "der die und"), ("en", "the and"), ("fr", "le les"), ("none", None)], "name string, description string")
    got = {r["id"]: r["got"] for r in described.nearest(texts, labels, ["id"], "text").collect()}
    assert (got[1], got[2], got[3], got[4]) == ("en", "de", None, None)
    with_prefix = {r["id"]: r["n_words"] for r in described.nearest(texts, labels, ["id"], "text", prefix="query: ").collect()}
    assert with_prefix[3] == 1 and with_prefix[1] == 6


# frontiers


def random_profile(spark, n, seed):
    r = random.Random(seed)
    a = [[round(r.random(), 3) for _ in tables.TIERS] for _ in range(n)]
    return a, spark.createDataFrame([(t, tables.TIERS[t], i, f"f{i}", a[i][t], 0.0, 1) for i in range(n) for t in range(4)], tables.PROFILE_ROW)


def plain_frontier(a, human, prices, volume):
    best = {}
    for tiers in itertools.product(range(4), repeat=len(a)):
        accuracy = sum((human if t == 3 else a[i][t]) for i, t in enumerate(tiers)) / len(a)
        cost = round(sum(volume / 1000 * prices[t] for t in tiers), 6)
        if cost not in best or accuracy > best[cost] + 1e-12:
            best[cost] = accuracy
    out = []
    for cost in sorted(best):
        if not out or best[cost] > out[-1][1] + 1e-12:
            out.append((cost, best[cost]))
    return out


@pytest.mark.parametrize("n, seed", [(1, 1), (4, 2), (6, 3)])
def test_frontier_equals_enumeration(spark, n, seed):
    a, profile = random_profile(spark, n, seed)
    given = as_row(spark)
    cost = given.select(prices().alias("p")).first()["p"]
    rows = skyline.frontier(profile, given, n).orderBy("step").collect()
    want = plain_frontier(a, 0.85, cost, 100_000.0)
    assert [(round(r["cost"], 6), round(r["accuracy"], 9)) for r in rows] == [(c, round(x, 9)) for c, x in want]
    assert [r["step"] for r in rows] == [*range(len(rows))]
    for r in rows:
        assert r["accuracy"] == pytest.approx(sum(0.85 if t == 3 else a[i][t] for i, t in enumerate(r["tiers"])) / n)


def test_frontier_agrees_with_the_search_at_every_budget_and_scenario(spark):
    _, profile = random_profile(spark, 4, 7)
    budgets = [0.0, 19.0, 20.0, 200.0, 1_000.0, 60_000.0, 1e6]
    steps = skyline.frontier(profile, as_row(spark).withColumn("one", F.lit(1)), 4, "one")
    got = {r["budget"]: r["tiers"] for r in skyline.at_budget(steps, spark.createDataFrame([(1, b) for b in [-1.0, *budgets]], "one int, budget double"), "one").collect()}
    want = {r["budget"]: r["tiers"] for r in routing.frontier(profile, as_row(spark), budgets, 4).collect()}
    assert got.pop(-1.0) is None and got == want


def test_twenty_fields(spark):
    """Against a search over how many fields go to each tier."""
    a, profile = random_profile(spark, 20, 11)
    given = as_row(spark)
    states = {(0, 0, 0): 0.0}
    for i in range(20):
        new = {}
        for (s, l, h), x in states.items():
            for key, gain in (((s, l, h), a[i][0]), ((s + 1, l, h), a[i][1]), ((s, l + 1, h), a[i][2]), ((s, l, h + 1), 0.85)):
                new[key] = max(new.get(key, -1), x + gain)
        states = new
    p = given.select(prices().alias("p")).first()["p"]
    by_cost = {}
    for (s, l, h), x in states.items():
        c = round(100 * (s * p[1] + l * p[2] + h * p[3]), 4)
        by_cost[c] = max(by_cost.get(c, 0), x / 20)
    want = []
    for c in sorted(by_cost):
        if not want or by_cost[c] > want[-1][1] + 1e-12:
            want.append((c, by_cost[c]))
    rows = skyline.frontier(profile, given, 20).orderBy("step").collect()
    assert len(rows) == len(want) > 20
    for r, (c, x) in zip(rows, want):
        assert r["cost"] == pytest.approx(c) and r["accuracy"] == pytest.approx(x)


def test_verdict_map_traces_the_first_flip(spark):
    _, profile = random_profile(spark, 3, 4)
    rows = skyline.verdict_map(profile, as_row(spark), 3, (0.0, 460.0), (0.0, 1.0), lambda: F.col("volume") * 0 + F.col("budget") < F.col("volume") / 1000).orderBy("i").collect()
    assert len(rows) == 47 and rows[0]["volume"] == 5 and rows[45]["volume"] == 455 and rows[46]["volume"] == 460
    for r in rows:
        held = [(j + 0.5) / 74 < r["volume"] / 1000 for j in range(74)]
        assert r["j"] == (held.index(False) if False in held else 74)
    never = skyline.verdict_map(profile, as_row(spark), 3, (0.0, 1.0), (0.0, 1.0), lambda: F.col("accuracy") < -1, 4)
    always = skyline.verdict_map(profile, as_row(spark), 3, (0.0, 1.0), (0.0, 1.0), lambda: F.col("accuracy") >= 0, 4)
    assert {r["j"] for r in never.collect()} == {0} and {r["j"] for r in always.collect()} == {6}


# one pass


def test_answers_and_times_come_from_one_pass(spark, texts):
    from pyspark.sql import Observation

    seen = Observation("t")
    rows = timing.timed(texts, timing.ladder_tiers(), F.col("text"), seen)
    got = {r["id"]: (r["rules"], r["small"], r["large"]) for r in rows.collect()}
    ladder = measure.language_ladder(texts.withColumnRenamed("id", "doc_id"))
    assert got == {r["doc_id"]: (r["rules"], r["small"], r["large"]) for r in ladder.collect()}
    assert rows.columns == ["id", "text", "lang", "rules", "small", "large"]
    assert seen.get["items"] == len(TEXTS) and all(seen.get[f"ns_{t}"] > 0 for t in ("rules", "small", "large"))


def test_one_pass_of_nothing(spark, texts):
    profile, loads = timing.measured_in_one_pass(texts.where("false"), timing.ladder_tiers())
    assert profile.collect() == [] and {r["ms"] for r in loads.collect()} == {0.0}


# documents


def test_profile_document_round_trip(spark, tmp_path):
    profile, single = tables.frozen_extraction(spark), tables.frozen_classification(spark)
    document = tables.as_document(profile, single, tables.frozen_load_time(spark), "2026-08-17")
    read = tables.parsed(document)
    key = lambda r: (r["tier_idx"], r["field_idx"])
    assert sorted(tables.extraction_rows(read).collect(), key=key) == sorted(profile.select(*tables.extraction_rows(read).columns).collect(), key=key)
    plain = json.loads(document.first()["document"])
    assert plain["measuredAt"] == "2026-08-17" and plain["classification"]["small"]["accuracy"] == 0.675 and plain["loadTime"]["human"] == 0.0
    # a written document is what the reader of files takes
    (tmp_path / "p.json").write_text(document.first()["document"])
    assert tables.extraction_rows(tables.read_profiles(spark, f"file://{tmp_path}/p.json")).count() == 20
    odd = tables.parsed(spark.createDataFrame([("no json",), (None,), ('{"extraction": {}}',)], "document string"))
    assert tables.extraction_rows(odd).collect() == []


# patterns


@pytest.mark.parametrize("at_once", [1_000, 7])
def test_patterns_equal_contains(spark, at_once):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abc ") for _ in range(r.randrange(40)))) for i in range(120)] + [(120, None), (121, ""), (122, "日本 ab")]
    listed = [["abc", "b", "", None, "aa"], ["c a", "abc", "日", "cc c"], ["".join(p) for p in itertools.product("ab", repeat=4)]]
    frames = [(spark.createDataFrame([(x,) for x in values], "v string"), "v", f"k{i}") for i, values in enumerate(listed)]
    order = [(i, v) for i, values in enumerate(listed) for v in sorted({x for x in values if x})]
    found = patterns.contained(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), patterns.numbered(frames), at_once)
    got = {r["id"]: (r["n"], r["first"], r["last"]) for r in found.collect()}
    for i, t in rows:
        hits = [v for _, v in order if v in (t or "")]
        distinct = {(j, v) for j, v in order if v in (t or "")}
        assert got[i][1:] == ((hits[0], hits[-1]) if hits else (None, None)), i
        assert got[i][0] == len(distinct)


def test_no_patterns(spark, texts):
    none = patterns.numbered([(texts.where("false"), "text", "k")])
    assert {tuple(r)[1:] for r in patterns.contained(texts, "id", F.col("text"), none).collect()} == {(0, None, None)}


# update logs

BOUNDS = {"a": (0.0, 10.0), "b": (-5.0, 5.0)}


def plain_fold(log):
    out = {}
    for entity, seq, key, value in sorted(log, key=lambda x: (x[1], x[3] if x[3] is not None and x[3] == x[3] else 0)):
        state = out.setdefault((entity, key), [None, None, 0, 0])
        if key not in BOUNDS or value is None or not math.isfinite(value):
            state[3] += 1
            continue
        new = min(BOUNDS[key][1], max(BOUNDS[key][0], value))
        if state[1] is None or (seq, new) > (state[1], state[0]):
            state[0], state[1] = new, seq
        state[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def update_log():
    r = random.Random(9)
    rows = [(r.randrange(6), i, r.choice(["a", "b", "c", None]), r.choice([r.uniform(-20, 20), r.uniform(-20, 20), None, float("nan"), float("inf")])) for i in range(200)]
    r.shuffle(rows)
    return rows


def states(rows):
    return {(r["entity"], r["key"]): (r["value"], r["seq"], r["applied"], r["refused"]) for r in rows}


def test_batch_fold_equals_plain_fold(spark):
    log = update_log()
    bounds = spark.createDataFrame([(k, *b) for k, b in BOUNDS.items()], "key string, lo double, hi double")
    assert states(updates.folded(spark.createDataFrame(log, updates.LOG), bounds).collect()) == plain_fold(log)
    assert updates.folded(spark.createDataFrame([], updates.LOG), bounds).collect() == []


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    log = update_log()
    for k in range(3):  # out of order, over three batches
        spark.createDataFrame(log[k::3], updates.LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changed = []
    try:
        stream = spark.readStream.schema(updates.LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
        run = updates.folded_stream(stream, BOUNDS).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").foreachBatch(lambda df, i: changed.append(df.collect())).trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert run.exception() is None
    finally:
        spark.conf.set(provider, before)
    assert len(changed) >= 3
    got = {}
    for rows in changed:
        got |= states(rows)
    assert got == plain_fold(log)


# totals


def test_totals_show_empty_kinds_and_unknown_values_count_above(spark):
    rows = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("x", None, 4), ("?", "p", 8), (None, "p", 16), ("y", "odd", 32)], "a string, b string, v int")
    got = {(r["a"], r["b"]): (r["a_idx"], r["b_idx"], r["n"], r["v"]) for r in reports.rolled_up(rows, {"a": ["x", "y"], "b": ["p", "q"]}, n=F.count("*"), v=F.sum("v")).collect()}
    assert got == {
        ("x", "p"): (0, 0, 1, 1), ("x", "q"): (0, 1, 1, 2), ("x", "total"): (0, 2, 3, 7), ("y", "p"): (1, 0, 0, 0), ("y", "q"): (1, 1, 0, 0), ("y", "total"): (1, 2, 1, 32), ("total", "total"): (2, 2, 6, 63),
    }
    empty = reports.rolled_up(rows.where("false"), {"a": ["x"]}, n=F.count("*")).collect()
    assert {(r["a"], r["n"]) for r in empty} == {("x", 0), ("total", 0)}


# leaks


@pytest.mark.parametrize("most", [leaks.MOST, 1 << 10])
def test_leaks_are_exact_whatever_the_filter(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "MOST", most)
    a = [(i, f"text {i}") for i in range(600)] + [(600, None), (601, "")]
    b = [(i, f"text {i}") for i in range(590, 1_200)] + [(7, None), (8, "")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = sorted(r["id"] for r in leaks.leaked(frame(a), frame(b), "id", F.col("text")).collect())
    assert got == [*range(590, 600), 601]
    assert leaks.leaked(frame(a), frame(b).where("false"), "id", F.col("text")).collect() == []


def test_the_filter_never_denies_and_mostly_refuses(spark):
    keys = spark.range(2_000).select(F.col("id").cast("string").alias("k"))
    filter_, bits = leaks.bloom(keys, "k")
    seen = spark.range(20_000).select("id", leaks.may_hold(filter_, F.col("id").cast("string"), bits).alias("m"))
    assert seen.where("id < 2000 AND NOT m").count() == 0 and seen.where("id >= 2000 AND m").count() < 900


# manifests


def test_manifest_knows_rows_and_their_number_but_no_order(spark):
    rows = [(1, "a", 1.0), (1, None, 2.0), (1, "", 2.0), (2, "b", None), (None, "c", 0.0), (1, "a", 1.0)]
    frame = lambda x: spark.createDataFrame(x, "p int, s string, v double").withColumn("m", F.create_map(F.lit("x"), "s", F.lit("y"), "s"))
    of = lambda df: manifest.manifest(df, F.col("p"))
    old = of(frame(rows))
    assert manifest.stale_parts(old, of(frame(rows[::-1]).repartition(3).select("m", "v", "s", "p"))).collect() == []
    once = of(frame(rows[:-1]))
    assert [tuple(r) for r in manifest.stale_parts(old, once).collect()] == [(1, "changed")]
    other = of(frame([(1, "a", 1.0), (1, "", 2.0), (1, "", 2.0), (1, "a", 1.0), (2, "b", None), (3, "c", 0.0)]))
    assert {tuple(r) for r in manifest.stale_parts(old, other).collect()} == {(1, "changed"), (None, "removed"), (3, "added")}


def test_unchanged_tables_are_told_by_their_manifest(spark, tmp_path):
    path, rows = f"file://{tmp_path}/t", spark.range(50).withColumn("x", F.col("id") % 7)
    assert files.freeze_if_changed(rows, path) and not files.freeze_if_changed(rows.repartition(5), path)
    assert files.freeze_if_changed(rows.withColumn("x", F.lit(1).cast("long")), path)
    assert spark.read.parquet(path).columns == ["id", "x"] and spark.read.parquet(path).count() == 50
    assert files.freeze_if_changed(rows.withColumn("y", F.lit(1)), path)
