"""Which assumptions decide the routing: all scenarios of all assumptions as one job."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwright.functions import assumptions as given
from tierwright.functions import stats

from . import routing

STEPS = 60


def beyond(key: str, current: float) -> float:
    """Where an assumption is pushed to see whether it only seems not to matter."""
    return {"humanAccuracy": 0.05, "humanSeconds": 1.0}.get(key, current / 100)


def scenarios(spark: SparkSession, base: given.Assumptions = given.Assumptions(), steps: int = STEPS) -> DataFrame:
    """key, direction (-1, 1; 0: pushed; key '' : as given), step, value, and the assumptions as columns."""
    now = asdict(base)
    ranges = spark.createDataFrame([(k, lo, hi, now[k], beyond(k, now[k])) for k, (lo, hi) in given.PLAUSIBLE.items()], "key string, lo double, hi double, now double, push double")
    walks = ranges.select("*", F.explode(F.array(F.lit(-1), F.lit(1))).alias("direction")).select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    limit = F.when(F.col("direction") == 1, F.col("hi")).otherwise(F.col("lo"))
    walked = walks.select("key", "direction", "step", (F.col("now") + (limit - F.col("now")) * F.col("step") / steps).alias("value"))
    pushed = ranges.select("key", F.lit(0).alias("direction"), F.lit(0).alias("step"), F.col("push").alias("value"))
    reference = spark.createDataFrame([("", 0, 0, 0.0)], "key string, direction int, step int, value double")
    rows = walked.unionByName(pushed).unionByName(reference)
    return rows.select("*", *(F.when(F.col("key") == k, F.col("value")).otherwise(F.lit(v)).alias(k) for k, v in now.items()))


def signatures(profile: DataFrame, single: DataFrame, rows: DataFrame, n_fields: int) -> DataFrame:
    """key, direction, step, value and signature: both chains' choices, or none."""
    keys = ["key", "direction", "step", "value"]
    fields = routing.best(routing.evaluated(profile, rows, n_fields), *keys).select(*keys, F.concat_ws(",", routing.names(F.col("tiers"))).alias("fields"))
    cells = single.agg(F.transform(F.array_sort(F.collect_list(F.struct("tier_idx", "accuracy"))), lambda s: s["accuracy"])).scalar()
    tiers = rows.withColumn("_a", cells).withColumn("_p", given.prices()).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3))))
    accuracy = F.when(F.col("t") == 3, F.col("humanAccuracy")).otherwise(F.col("_a")[F.col("t")])
    options = tiers.select(*keys, "t", accuracy.alias("a"), (F.col("volume") / 1000.0 * F.col("_p")[F.col("t")]).alias("c"), "budget").where("c <= budget")
    one = options.groupBy(*keys).agg(F.min_by("t", F.struct((-F.col("a")).alias("a"), "c", "t")).alias("t")).select(*keys, routing.names(F.array("t"))[0].alias("one"))
    whole = rows.select(*keys).join(fields, keys, "left").join(one, keys, "left")
    signature = F.when(F.col("fields").isNull(), "none").otherwise(F.concat_ws("|", "fields", F.coalesce("one", F.lit("none"))))
    return whole.select(*keys, signature.alias("signature"))


def bands(profile: DataFrame, single: DataFrame, n_fields: int, base: given.Assumptions = given.Assumptions(), steps: int = STEPS) -> DataFrame:
    """assumption, current, stable_from, stable_to, current_inside, decides and reason of each swept assumption."""
    spark, now = profile.sparkSession, asdict(base)
    signed = signatures(profile, single, scenarios(spark, base, steps), n_fields)
    reference = signed.where("key = ''").select("signature").scalar()
    moved = signed.where("key <> ''").withColumn("moved", F.col("signature") != reference)
    first = moved.groupBy("key").agg(
        F.min(F.when((F.col("direction") == -1) & F.col("moved"), F.col("step"))).alias("down"),
        F.min(F.when((F.col("direction") == 1) & F.col("moved"), F.col("step"))).alias("up"),
        F.bool_or(F.when(F.col("direction") == 0, F.col("moved"))).alias("pushed"),
    )
    ranges = spark.createDataFrame([(k, lo, hi, now[k]) for k, (lo, hi) in given.PLAUSIBLE.items()], "key string, lo double, hi double, current double")
    edge = lambda step, limit: F.when(F.col(step).isNull(), F.col(limit)).otherwise(F.col("current") + (F.col(limit) - F.col("current")) * (F.col(step) - 1) / steps)
    rows = ranges.join(first, "key").withColumn("stable_from", edge("down", "lo")).withColumn("stable_to", edge("up", "hi"))
    rows = rows.withColumn("decides", (F.col("stable_from") > F.col("lo") + 1e-9) | (F.col("stable_to") < F.col("hi") - 1e-9))
    reason = F.when(F.col("decides"), "affects the answer").when(F.col("pushed"), "tier priced out").otherwise("genuinely insensitive")
    return rows.select(F.col("key").alias("assumption"), "lo", "hi", "current", "stable_from", "stable_to", F.lit(True).alias("current_inside"), "decides", reason.alias("reason"))


def advice() -> Column:
    """What a band tells its reader to do."""
    number = lambda c: F.format_string("%.2f", stats.fixed(F.col(c), 2))
    return (
        F.when(F.col("reason") == "tier priced out", "no effect while the tier it governs is out of the budget; measure it before the budget rises or the volume falls")
        .when(F.col("reason") == "genuinely insensitive", F.concat(F.lit("decides nothing from "), number("lo"), F.lit(" to "), number("hi"), F.lit("; not worth measuring here")))
        .otherwise(F.concat(F.lit("decides the routing outside "), number("stable_from"), F.lit(" to "), number("stable_to"), F.lit("; worth measuring")))
    )
