"""Unit cases, golden numbers and invariants of the tiered-processing engine."""

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierwright.functions import assumptions as given
from tierwright.functions import charts, stats, text
from tierwright.operators import failures, inventory, measure, routing, sensitivity, timing
from tierwright.plans import state
from tierwright.sinks import files
from tierwright.sources import corpus
from tierwright.sources import tables as t
from tierwright.streaming import rates


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def with_values(spark, **changes):
    return given.as_row(spark, given.Assumptions(**changes))


@pytest.mark.parametrize(
    "got, expected, ok",
    [
        ("10 / 07 / 1987", "10/07/1987", True),
        ("IT - 5560 - K", "IT-5560-K", True),
        ("Amina Haddad.", "Amina Haddad", True),
        ("Leila", "Leila Haddad", False),
        ("", "Leila Haddad", False),
        ("Leila Haddad Birth 10/07/1987", "Leila Haddad", False),
        ("Marcus Ferreira", "Leila Haddad", False),
    ],
)
def test_scorer_forgives_format_only(spark, got, expected, ok):
    df = spark.createDataFrame([(got, expected)], "got string, expected string")
    assert one(df.select(text.correct(F.col("got"), F.col("expected")).alias("ok"))).ok is ok


@pytest.mark.parametrize("got, mode", [("", "empty"), ("Leila", "fragment"), ("Leila Haddad Birth 1987", "over-long"), ("Marcus Ferreira", "wrong span"), ("x y", "other")])
def test_failure_modes(spark, got, mode):
    df = spark.createDataFrame([(got, "Leila Haddad")], "got string, expected string")
    assert one(df.select(text.failure_mode(F.col("got"), F.col("expected")).alias("m"))).m == mode


def test_intervals(spark):
    df = spark.createDataFrame([(3, 4), (15, 20), (4, 4), (0, 0)], "k long, n long")
    a, b, c, d = df.select(*stats.rate(F.col("k"), F.col("n"))).collect()
    assert not a.reportable and b.reportable
    assert c.low == pytest.approx(0.5101, abs=1e-4) and c.high == 1
    assert (d.rate, d.low, d.high) == (0, 0, 1)
    shown = [r.s for r in df.select(*stats.rate(F.col("k"), F.col("n"))).select(stats.written_rate().alias("s")).collect()]
    assert "too few" in shown[0] and shown[1].startswith("75.0 %")


@pytest.mark.parametrize("gains, losses, p", [(3, 2, 1.0), (0, 0, None), (10, 0, 2 / 1024), (1, 9, 22 / 1024)])
def test_paired_test(spark, gains, losses, p):
    got = one(spark.range(1).select(stats.paired_p(F.lit(gains), F.lit(losses)).alias("p"))).p
    assert got == (None if p is None else pytest.approx(p))


def test_verdict(spark):
    df = spark.createDataFrame([(0.5, 0.5, 100.0), (0.9, 0.5, 100.0), (0.1, 0.5, 100.0), (0.0, 0.0, 10.0)], "m double, b double, n double")
    assert [r.v for r in df.select(stats.verdict(F.col("m"), F.col("b"), F.col("n")).alias("v")).collect()] == ["indistinguishable", "beats", "loses", "loses"]


def test_published_optimum(spark):
    profile, scenario = t.frozen_extraction(spark), given.as_row(spark)
    best = one(routing.optimum(profile, scenario, 5))
    assert [t.TIERS[i] for i in best.tiers] == ["large", "rules", "rules", "rules", "small"]
    assert best.accuracy == pytest.approx(0.845) and best.cost == pytest.approx(180)
    step = one(routing.shadow_price(profile, scenario, 5))
    assert step.gain_points == pytest.approx(8.5) and step.extra == pytest.approx(58_692.12, abs=0.01) and not step.constraint_binds
    assert [(r.field, r.after) for r in routing.changed(routing.shadow_price(profile, scenario, 5), t.FIELDS).collect()] == [("address", "human")]


def test_published_uniform_and_single(spark):
    rows = {r.tier: r for r in routing.uniform(routing.evaluated(t.frozen_extraction(spark), given.as_row(spark), 5)).collect()}
    assert rows["human"].cost == pytest.approx(293_560.61, abs=0.01) and rows["large"].accuracy == pytest.approx(0.805)
    chosen = one(routing.single_choice(t.frozen_classification(spark), given.as_row(spark)).where("chosen"))
    assert chosen.tier == "small" and chosen.accuracy == pytest.approx(0.675)


def test_cost_stays_in_budget_and_accuracy_rises(spark):
    rows = routing.frontier(t.frozen_extraction(spark), given.as_row(spark), [50.0, 200.0, 1_000.0, 4_000.0, 10_000.0, 100_000.0, 1_000_000.0], 5).collect()
    assert all(r.cost <= r.budget and r.monotone for r in rows)


def test_no_budget(spark):
    assert one(routing.optimum(t.frozen_extraction(spark), with_values(spark, budget=0.0), 5)).budget_share == math.inf
    assert routing.optimum(t.frozen_extraction(spark), with_values(spark, budget=-1.0), 5).count() == 0
    assert routing.shadow_price(t.frozen_extraction(spark), with_values(spark, budget=-1.0), 5).count() == 0


def test_published_sensitivity(spark):
    bands = {r.assumption: r for r in sensitivity.bands(t.frozen_extraction(spark), t.frozen_classification(spark), 5).withColumn("advice", sensitivity.advice()).collect()}
    assert {k for k, r in bands.items() if r.reason == "tier priced out"} == {"humanSeconds", "analystAnnualCost"}
    assert not any(r.decides for r in bands.values())
    assert "out of the budget" in bands["humanSeconds"].advice


def test_human_is_assumed(spark):
    assert given.Assumptions().humanAccuracy < 1
    p = one(given.as_row(spark).select(given.prices().alias("p"))).p
    assert p[0] == 0 and p[3] > p[2] and p[3] == pytest.approx(587.1212, abs=1e-4)


def test_corpus_is_the_sequential_one(spark):
    s, states = corpus.seed_of(corpus.RECORD_SEED, "heldout"), []
    for _ in range(150 * corpus.DRAWS + 1):
        states.append(s)
        s = (s * corpus.MULTIPLIER + corpus.INCREMENT) % corpus.MODULUS
    rows = spark.range(150).select(corpus.jumped(states[0], F.col("id"), corpus.DRAWS, 8).alias("s")).collect()
    assert [r.s for r in rows] == states[:: corpus.DRAWS][:150]
    assert corpus.records(spark, 20).collect() == corpus.records(spark, 20).collect()


def test_splits_share_no_text_and_no_shape(spark):
    a, b = corpus.records(spark, 40, "training"), corpus.records(spark, 40, "heldout")
    assert not corpus.shared_texts(a, b).count() and not corpus.shared_texts(a, b, text.text_shape(F.col("text"))).count()


def test_alert_labels_are_known(spark):
    assert {r.truth for r in corpus.alerts(spark, 30).collect()} <= set(text.TYPOLOGIES)


def test_rules_profile_is_the_published_one(spark):
    rows = measure.extraction(corpus.records(spark, 120, "heldout"))
    got = {r.field: r.a for r in rows.groupBy("field").agg(F.avg(text.correct(F.col("got"), F.col("expected")).cast("double")).alias("a")).collect()}
    assert got == {f: pytest.approx(t.FROZEN_EXTRACTION["rules"][f][0]) for f in t.FIELDS}
    wrong = failures.collect(rows.withColumn("tier_idx", F.lit(0)).withColumn("tier", F.lit("rules")))
    assert wrong.count() == 260
    assert failures.gallery(wrong, 2).count() == 2


def test_published_failures_add_up():
    assert round(sum((1 - a) * t.FROZEN_ITEMS for tier in ("rules", "small", "large") for a, _ in t.FROZEN_EXTRACTION[tier].values())) == 552


def test_profiles_round_trip(spark, tmp_path):
    path = str(tmp_path / "profiles.json")
    assert t.read_profiles(spark, path) is None
    cell = lambda x: {"accuracy": x[0], "latency": x[1], "items": 120}
    doc = {"measuredAt": "2026-08-17", "extraction": {k: {f: cell(c) for f, c in v.items()} for k, v in t.FROZEN_EXTRACTION.items()}, "classification": {k: cell(c) for k, c in t.FROZEN_CLASSIFICATION.items()}, "loadTime": t.FROZEN_LOAD}
    import json

    (tmp_path / "profiles.json").write_text(json.dumps(doc, indent=1))
    got = t.extraction_rows(t.read_profiles(spark, path))
    assert not got.exceptAll(t.frozen_extraction(spark)).count() and got.count() == 20


def test_state_bundle(spark):
    own = spark.createDataFrame([(i, "large") for i in range(5)], "field_idx int, tier string")
    s = state.state(t.frozen_extraction(spark), given.as_row(spark), own, t.FIELDS)
    assert one(s["mine"]).accuracy == pytest.approx(0.805)
    assert one(s["compared"]).factor == pytest.approx(800 / 180)
    assert s["accuracy"].count() == 5 and s["bounds"].count() == 9


def test_inventory(spark):
    counts = {r.provenance: r.n for r in inventory.counts(inventory.inventory(spark)).collect()}
    assert counts == {"measured": 4, "assumed": 9, "chosen": 4, "cited": 0}


def test_writer_leaves_equal_tables_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    assert files.freeze_if_changed(df, path) and not files.freeze_if_changed(df, path)
    assert files.freeze_if_changed(spark.range(4), path)
    assert spark.read.parquet(path).count() == 4


def test_blocks(spark):
    table = files.markdown(spark.range(2))
    page = files.rendered("<!-- a -->\nold\n<!-- /a -->", {"a": table})
    assert "| 1 |" in page and files.stale_blocks(page, {"a": table}) == [] and files.stale_blocks(page, {"a": "x"}) == ["a"]
    with pytest.raises(ValueError):
        files.rendered("no markers", {"a": "x"})


def test_chart_edges(spark):
    assert charts.extent(spark.createDataFrame([], "x double"), "x").collect() == [(0.0, 1.0)]
    assert one(charts.extent(spark.createDataFrame([(-10.0,), (10.0,)], "x double"), "x")) == (-11.6, 11.6)
    shares = spark.createDataFrame([(0, 0), (5, 5), (0, 5), (1, 1000), (999, 1000)], "p long, w long").select(stats.share_written(F.col("p"), F.col("w")).alias("s"))
    assert [r.s for r in shares.collect()] == ["—", "100 %", "0 %", "1 %", "99 %"]


def test_scorer_plug(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id int, text string")
    got = measure.scored(df, lambda xs: [x.upper() for x in xs], "text").collect()
    assert [r.got for r in got] == ["A B", ""]


def test_streamed_rates_equal_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = rates.windowed_rates(stream, 50.0).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert not spark.table("streamed").exceptAll(rates.windowed_rates(events, 50.0)).count()


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert measure.language_profile(empty).count() == 0
    assert one(failures.top_shapes(failures.collect(measure.extraction(corpus.records(spark, 0)).withColumn("tier_idx", F.lit(0)).withColumn("tier", F.lit("rules"))), 3).agg(F.count("*").alias("n"))).n == 0


def test_mean_pool_all_pools_every_row(spark, tmp_path):
    from tierwright import queries

    rows = [(0, [1.0, 0.0], 3), (1, [0.0, 1.0], 3), (3, [0.0, 1.0], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.label, r.place): r.x for r in queries.queries()["mean_pool_all"](spark, str(tmp_path)).collect()}
    assert got == {(3, 0): 0.707107, (3, 1): 0.707107, (4, 0): 0.0, (4, 1): 1.0}


def test_freeze_replaces_a_table_that_reads_its_own_path(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert files.freeze_if_changed(spark.range(3), path)
    assert not files.freeze_if_changed(spark.range(3), path)
    assert files.freeze_if_changed(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2]
    files.freeze(spark.range(1), f"file://{tmp_path}/rows", "json")
    assert spark.read.json(f"file://{tmp_path}/rows").count() == 1


@pytest.mark.parametrize("gains,regressions", [(0, 0), (3, 0), (5, 9), (40, 60), (700, 640), (30_000, 31_000), (5_000_000, 4_998_000)])
def test_paired_p_equals_the_binomial_tail(spark, gains, regressions):
    d, least = gains + regressions, min(gains, regressions)
    got = spark.range(1).select(stats.paired_p(F.lit(gains), F.lit(regressions)).alias("p")).first()["p"]
    if not d:
        assert got is None
    else:
        i = np.arange(max(0, least - 200_000), least + 1)
        logs = math.lgamma(d + 1) - np.array([math.lgamma(x + 1) + math.lgamma(d - x + 1) for x in i.tolist()]) - d * math.log(2)
        assert got == pytest.approx(min(1.0, 2 * float(np.exp(logs).sum())), rel=1e-5)


def test_a_staircase_without_series_refuses_many_rows(spark, monkeypatch):
    monkeypatch.setattr(charts, "ONE_LINE", 5)
    with pytest.raises(ValueError):
        charts.staircase(spark.range(6).selectExpr("id", "id AS y"), "id", "y")
    rows = spark.range(6).selectExpr("id", "id % 2 AS s", "id div 4 AS y")
    assert charts.staircase(rows, "id", "y", "s").count() == 4


def test_the_entry_keeps_its_queries_when_a_module_cannot_be_imported(tmp_path):
    code = "import sys\nsys.modules['public_tokenizers'] = None\nimport __spark_entry__ as e\nassert 'optimal_routing' in e.queries() and 'pipeline' not in e.queries()\nassert set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parent.parent
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0


def test_timed_latencies_reach_the_profile(spark):
    documents = t.table(spark, "/root/testdata/sf0.001", "documents")
    latencies = timing.latencies(documents, timing.ladder_tiers())
    assert {r["tier"] for r in latencies.collect()} == {"rules", "small", "large"} and latencies.where("latency <= 0").count() == 0
    rows = measure.language_profile(documents, latencies).collect()
    assert {r["tier"] for r in rows if r["latency"] > 0} == {"rules", "small", "large"} and all(r["latency"] == 0 for r in rows if r["tier"] == "human")


def test_described_labels_are_references(spark):
    labels = spark.createDataFrame([("a", "xx"), ("b", "xyyy")], "name string, description string")
    embed = lambda texts: [[float(x.count("x")), float(x.count("y"))] for x in texts]
    got = {r["name"]: r["centre"] for r in measure.described(labels, embed, "x").collect()}
    assert got["a"] == [1.0, 0.0] and got["b"] == pytest.approx([2 / 13**0.5, 3 / 13**0.5])
