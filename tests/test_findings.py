"""What reviewers found: each test failed before the finding was mended."""

import functools
import operator
import random

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tierwright import queries as own
from tierwright.functions import charts
from tierwright.operators import measure, models, patterns, timing

#: Their mean is 50; doubles added up come to 900 or a little beside it, by their order.
EVEN = [30.26, 66.61, 198.9, 28.54, 14.24, 91.98, 54.85, 2.98, 0.56, 25.35, 17.03, 70.25, 10.61, 17.52, 4.68, 69.64, 39.2, 156.8]


def order_with(sign):
    """``EVEN`` in an order in which its doubles add up to more (1) or not (0) than 900."""
    orders = (random.Random(i).sample(EVEN, len(EVEN)) for i in range(1_000))
    return next(x for x in orders if (functools.reduce(operator.add, x) > 900) == bool(sign))  # sum() rounds only once


@pytest.mark.parametrize("sign", [0, 1])
def test_a_mean_at_the_bound_is_not_above_it(spark, sign):
    rows = spark.createDataFrame([("even", x) for x in order_with(sign)] + [("odd", 49.0), ("odd", 51.01), ("huge", 1e300), ("huge", 2.0), ("nan", float("nan")), ("low", -1e14), ("null", None)], "k string, x double")
    got = dict(map(tuple, rows.coalesce(1).groupBy("k").agg(charts.mean_above("x", 50)).collect()))
    assert got == {"even": False, "odd": True, "huge": True, "nan": True, "low": False, "null": None}


def test_unstable_cases_on_odd_events(spark, tmp_path):
    """Means at the bound, no values, no dates: as the SQL has them."""
    even = ", ".join(f"({i}, TIMESTAMP '2024-01-02', 9, {x})" for i, x in enumerate(order_with(1), 100))
    duckdb.sql(f"""COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, 'a' AS event_type, value::DOUBLE AS value, '' AS props FROM (VALUES (0, TIMESTAMP '2024-01-02', 1, NULL), (1, '2024-01-10', 1, 60), (2, NULL, 1, 10), (3, '2024-01-17', 1, NULL),
      (4, '2024-01-02', 2, 'nan'::DOUBLE), (5, '2024-01-10', 2, 10), (7, NULL, 2, 70), (8, '2024-01-02', NULL, 70), (9, '2024-01-10', NULL, 7), (10, '2024-01-10', NULL, NULL), (11, '2024-01-10', 9, 60), {even}) t(event_id, ts, user_id, value)) TO '{tmp_path}/events.parquet'""")
    got = {(r["user_id"], r["week"]): r["state"] for r in own.queries()["unstable_cases"](spark, str(tmp_path)).collect()}
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {(u, w): s for u, w, s in duckdb.sql(own.oracle_sql()["unstable_cases"]).fetchall()}
    even_week = min(w for u, w in want if u == 9)
    assert got.pop((9, even_week)) == "ko" and got.pop((9, max(w for u, w in want if u == 9))) == "repaired"  # by the exact mean; the SQL's doubles go by their order
    assert got == {k: s for k, s in want.items() if k[0] != 9}


@pytest.fixture
def large_batches(spark):
    """Batches as Spark has them by default, whatever other tests have left."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    for key in keys:
        spark.conf.unset(key)


def shown(way, rows):
    """The sizes of the batches of texts that Python gets."""

    def sizes(texts):
        return [str(len(texts))] * len(texts)

    if way == "scored":
        return measure.scored(rows, sizes, "text")
    tier = models.Tier("got", f"sizes-{way}", lambda: sizes)
    return timing.timed(rows, [tier], F.col("text"), Observation("sizes")) if way == "timed" else models.answered(rows, tier, F.col("text"))


@pytest.mark.parametrize("way", ["timed", "answered", "scored"])
def test_python_gets_few_texts_at_a_time(spark, large_batches, way):
    short, long = spark.range(0, 3_000, 1, 1).select("id", F.lit("ab").alias("text")), spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    assert {int(r["got"]) for r in shown(way, short).select("got").collect()} == {500}
    assert max(int(r["got"]) for r in shown(way, long).select("got").collect()) <= 9


def test_one_pass_carries_what_is_kept(spark):
    rows = spark.createDataFrame([(1, "the cat", "en"), (2, None, None)], "id long, text string, lang string")
    answers = timing.timed(rows, timing.ladder_tiers(), F.col("text"), Observation("kept"), kept=["id"])
    assert answers.columns == ["id", "rules", "small", "large"]
    assert sorted(map(tuple, answers.collect())) == [(1, "en", "en", "en"), (2, "", "", "")]


def test_long_patterns_go_by_slices(spark, large_batches, monkeypatch):
    """An automaton takes ten times the bytes of its patterns and more, in each worker."""
    given, found = [], patterns._found
    monkeypatch.setattr(patterns, "_found", lambda rows, listed, text, key: given.append(sum(map(len, listed))) or found(rows, listed, text, key))
    listed = spark.range(0, 30_000, 1, 1).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.col("id").cast("string"), 384)).alias("v"))
    documents = listed.limit(3).select(F.monotonically_increasing_id().alias("id"), F.concat(F.lit("a "), "v", F.lit(" z")).alias("text")).unionByName(spark.createDataFrame([(9, None)], "id long, text string"))
    got = {r["id"]: (r["n"], r["first"], r["last"], r["text"]) for r in patterns.contained(documents, "id", F.col("text"), patterns.numbered([(listed, "v", "k")])).join(documents, "id").collect()}
    assert sum(given) == 30_000 * 224 and max(given) < 1.1 * (4 << 20)
    assert len(got) == 4 and all((n, f"a {first} z", last) == (1, text, first) for n, first, last, text in got.values() if text) and got[9] == (0, None, None, None)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
