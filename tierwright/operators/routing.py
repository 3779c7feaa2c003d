"""Routing fields to tiers under a budget: exhaustive search, the next step's price, and comparisons.

An assignment is a number whose base-4 digits are the tiers of the fields, the first field first. Its cells come from
the profile as one small array, so nothing is joined: each assignment, in each scenario, is a row with expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwright.functions import assumptions as given
from tierwright.sources.tables import TIERS

#: Accuracy gained that counts as an improvement.
EPSILON = 1e-9
#: Share of the budget used above which it binds.
BINDS = 0.98


def cells(profile: DataFrame, column: str) -> Column:
    """A profile column as array<array<double>>, by field and tier, as a scalar subquery."""
    by_field = profile.groupBy("field_idx").agg(F.array_sort(F.collect_list(F.struct("tier_idx", F.col(column).alias("x")))).alias("t"))
    ordered = by_field.agg(F.array_sort(F.collect_list(F.struct("field_idx", F.transform("t", lambda s: s["x"]).alias("x")))).alias("f"))
    return ordered.select(F.transform("f", lambda s: s["x"])).scalar()


def evaluated(profile: DataFrame, scenarios: DataFrame, n_fields: int) -> DataFrame:
    """The scenarios' columns with ord, tiers, accuracy, cost, seconds and budget_share of every assignment.

    scenarios has the assumptions as columns. Sums run over the fields in order, so equal assignments tie exactly.
    """
    k = len(TIERS)
    digits = [F.floor(F.col("ord") / k ** (n_fields - 1 - i)) % k for i in range(n_fields)]
    rows = scenarios.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(k**n_fields - 1))))
    rows = rows.withColumn("tiers", F.array(*(d.cast("int") for d in digits)))
    accuracy, latency, human = cells(profile, "accuracy"), cells(profile, "latency"), k - 1
    rows = rows.withColumn("_accuracy", accuracy).withColumn("_latency", latency).withColumn("_prices", given.prices())
    total_accuracy, cost, seconds = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(n_fields):
        t = F.col("tiers")[i]
        total_accuracy = total_accuracy + F.when(t == human, F.col("humanAccuracy")).otherwise(F.col("_accuracy")[i][t])
        cost = cost + F.col("volume") / 1000.0 * F.col("_prices")[t]
        seconds = seconds + F.col("volume") * F.when(t == human, F.col("humanSeconds") * 1000.0).otherwise(F.col("_latency")[i][t]) / 1000.0
    rows = rows.withColumn("accuracy", total_accuracy / n_fields).withColumn("cost", cost).withColumn("seconds", seconds)
    share = F.when(F.col("budget") == 0, F.lit(float("inf"))).otherwise(F.try_divide("cost", "budget"))
    return rows.withColumn("budget_share", share).drop("_accuracy", "_latency", "_prices")


def best(rows: DataFrame, *by: str) -> DataFrame:
    """The best affordable assignment by key: most accurate, then cheapest, then first. Keys without one are absent."""
    rank = F.struct((-F.col("accuracy")).alias("a"), F.col("cost").alias("c"), F.col("ord").alias("o"))
    solution = F.struct("ord", "tiers", "accuracy", "cost", "seconds", "budget_share")
    found = rows.where(F.col("cost") <= F.col("budget")).groupBy(*by).agg(F.min_by(solution, rank).alias("s"))
    return found.where("s IS NOT NULL").select(*by, "s.*")


def names(tiers: Column) -> Column:
    return F.transform(tiers, lambda t: F.element_at(F.array(*map(F.lit, TIERS)), t + 1))


def optimum(profile: DataFrame, scenario: DataFrame, n_fields: int) -> DataFrame:
    """The optimal assignment under one row of assumptions; no row if nothing fits the budget."""
    return best(evaluated(profile, scenario, n_fields).withColumn("one", F.lit(1)), "one").drop("one")


def by_field(solution: DataFrame, profile: DataFrame, scenario: DataFrame) -> DataFrame:
    """A solution's fields: field_idx, field, tier, accuracy and cost."""
    chosen = solution.select(F.posexplode("tiers").alias("field_idx", "tier_idx"))
    priced = scenario.select("humanAccuracy", "volume", given.prices().alias("prices"))
    rows = chosen.join(F.broadcast(profile), ["field_idx", "tier_idx"]).withColumn("s", F.lit(1)).join(F.broadcast(priced.withColumn("s", F.lit(1))), "s")
    return rows.select("field_idx", "field", "tier", given.accuracy_of(F.col("tier"), F.col("accuracy")).alias("accuracy"), (F.col("volume") / 1000.0 * F.col("prices")[F.col("tier_idx")]).alias("cost"))


def frontier(profile: DataFrame, scenario: DataFrame, budgets: list[float], n_fields: int) -> DataFrame:
    """The optimum at each budget, and whether accuracy did not fall from the budget below."""
    spark = profile.sparkSession
    each = scenario.drop("budget").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    found = best(evaluated(profile, each, n_fields), "budget")
    all_ = spark.createDataFrame([(b,) for b in budgets], "budget double").join(found, "budget", "left")
    before = F.lag("accuracy").over(Window.orderBy("budget"))  # a row for each budget asked for
    return all_.withColumn("monotone", F.coalesce(F.col("accuracy") >= before, F.lit(True)))


def single_choice(profile: DataFrame, scenario: DataFrame) -> DataFrame:
    """One tier for everything: tier_idx, tier, accuracy, cost, affordable and chosen of the four options."""
    priced = scenario.select("humanAccuracy", "volume", "budget", given.prices().alias("prices")).withColumn("s", F.lit(1))
    rows = profile.withColumn("s", F.lit(1)).join(F.broadcast(priced), "s")
    options = rows.select("tier_idx", "tier", given.accuracy_of(F.col("tier"), F.col("accuracy")).alias("accuracy"), (F.col("volume") / 1000.0 * F.col("prices")[F.col("tier_idx")]).alias("cost"), "budget")
    options = options.withColumn("affordable", F.col("cost") <= F.col("budget")).drop("budget")
    first = F.row_number().over(Window.orderBy(F.desc("affordable"), F.desc("accuracy"), "cost", "tier_idx"))  # four rows
    return options.withColumn("chosen", (first == 1) & F.col("affordable"))


def uniform(rows: DataFrame) -> DataFrame:
    """The assignments that send every field to one tier."""
    return rows.where(F.size(F.array_distinct("tiers")) == 1).withColumn("tier", names(F.col("tiers"))[0])


def shadow_price(profile: DataFrame, scenario: DataFrame, n_fields: int) -> DataFrame:
    """One row: what the optimum costs, whether the budget binds, and the next step that improves on it, if any.

    The least budget that buys more is the least cost among the better assignments, and what it buys is the optimum
    at that budget. No row if nothing fits the budget.
    """
    rows = evaluated(profile, scenario, n_fields).withColumn("one", F.lit(1))
    base = best(rows, "one").select("one", F.col("accuracy").alias("base_accuracy"), F.col("cost").alias("base_cost"), F.col("budget_share").alias("base_share"), F.col("tiers").alias("base_tiers"))
    better = rows.join(F.broadcast(base), "one").where(F.col("accuracy") > F.col("base_accuracy") + EPSILON)
    needed = better.groupBy("one").agg(F.min("cost").alias("needed"))
    at = rows.drop("budget").join(F.broadcast(needed), "one").withColumn("budget", F.col("needed"))
    reachable = base.select("one", (F.greatest(F.col("base_cost") * 2, F.lit(1.0)) * 2.0**40).alias("most"))
    step = best(at, "one").join(reachable, "one").where(F.col("cost") <= F.col("most"))
    step = step.select("one", F.col("tiers").alias("step_tiers"), F.col("accuracy").alias("step_accuracy"), F.col("cost").alias("step_cost"))
    budget = scenario.select("budget", F.lit(1).alias("one"))
    gain = (F.col("step_accuracy") - F.col("base_accuracy")) * 100
    extra = F.col("step_cost") - F.col("base_cost")
    return base.join(budget, "one").join(step, "one", "left").select(
        F.col("budget").alias("current_budget"), F.col("base_accuracy").alias("current_accuracy"), F.col("base_cost").alias("current_cost"), (F.col("base_share") > BINDS).alias("constraint_binds"),
        F.col("step_cost").alias("budget_needed"), extra.alias("extra"), gain.alias("gain_points"), F.try_divide(gain, extra / 1000).alias("points_per_thousand"),
        names(F.col("base_tiers")).alias("routing"), names(F.col("step_tiers")).alias("step_routing"),
    )


def changed(step: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, before and after where a shadow price's two routings differ."""
    pairs = F.posexplode(F.arrays_zip(F.col("routing").alias("before"), F.col("step_routing").alias("after"))).alias("field_idx", "p")
    named = step.where("step_routing IS NOT NULL").select(pairs).select(F.element_at(F.array(*map(F.lit, fields)), F.col("field_idx") + 1).alias("field"), "p.before", "p.after")
    return named.where("before <> after")


def cheaper(own: DataFrame, better: DataFrame) -> DataFrame:
    """How a solution compares with the optimum (one row each): points apart, and how many times cheaper it is."""
    x = own.select(F.lit(1).alias("s"), F.col("accuracy").alias("own_accuracy"), F.col("cost").alias("own_cost"))
    y = better.select(F.lit(1).alias("s"), F.col("accuracy").alias("best_accuracy"), F.col("cost").alias("best_cost"))
    factor = F.when(F.col("best_cost") > 0, F.try_divide("own_cost", "best_cost")).when(F.col("own_cost") > 0, F.lit(float("inf"))).otherwise(1.0)
    return x.join(y, "s").select("own_accuracy", "own_cost", "best_accuracy", "best_cost", ((F.col("best_accuracy") - F.col("own_accuracy")) * 100).alias("points"), factor.alias("factor"))


def updated(routing: DataFrame, changes: DataFrame, fields: DataFrame, tiers: DataFrame) -> DataFrame:
    """The routing (field, tier) after changes (seq, field, tier); unknown fields and tiers change nothing."""
    valid = changes.join(F.broadcast(fields), "field", "left_semi").join(F.broadcast(tiers), "tier", "left_semi")
    last = valid.groupBy("field").agg(F.max_by("tier", "seq").alias("new"))
    return routing.join(last, "field", "left").select("field", F.coalesce("new", "tier").alias("tier"))
