"""The exact frontier of routings: every budget step at once, without enumerating the assignments.

Fields are merged one by one. What is kept of the fields so far are the assignments that no other beats, being at most as
dear and at least as accurate; only they can begin a best assignment of all fields. A price hangs on the tier alone, so
of n fields there are at most as many different costs as ways to share n among the tiers (1,771 for 20 fields and four
tiers), and at most so many rows for each scenario, where enumeration has 4**n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierwright.functions import assumptions as given
from tierwright.sources.tables import TIERS

from . import routing

#: Costs that differ by less are one cost.
CENT = 6


def unbeaten(rows: DataFrame, *by: str) -> DataFrame:
    """Of each key's rows (accuracy, cost, tiers) those that no cheaper or equally dear one equals in accuracy.

    Of rows equal in both, the first assignment stays.
    """
    before = Window.partitionBy(*by).orderBy("_cost", F.desc("accuracy"), "tiers").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_cost", F.round("cost", CENT))
    rows = rows.withColumn("_before", F.max("accuracy").over(before))
    return rows.where(F.col("_before").isNull() | (F.col("accuracy") > F.col("_before"))).drop("_before", "_cost")


def frontier(profile: DataFrame, scenarios: DataFrame, n_fields: int, *by: str) -> DataFrame:
    """The keys with step (from 0), tiers, accuracy and cost: all breakpoints of the best accuracy over the budget.

    ``scenarios`` has the assumptions as columns and the keys ``by``; its budget is not looked at.
    """
    k = len(TIERS)
    rows = scenarios.select(*by, "volume", "humanAccuracy", given.prices().alias("prices"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("cost"), F.array().cast("array<int>").alias("tiers"))
    cells = routing.cells(profile, "accuracy")
    for i in range(n_fields):
        each = rows.withColumn("cells", cells).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        accuracy = F.when(F.col("t") == k - 1, F.col("humanAccuracy")).otherwise(F.col("cells")[i][F.col("t")])
        merged = each.select(
            *by, "volume", "humanAccuracy", "prices", (F.col("accuracy") + accuracy).alias("accuracy"), (F.col("cost") + F.col("volume") / 1000.0 * F.col("prices")[F.col("t")]).alias("cost"),
            F.concat("tiers", F.array("t")).alias("tiers"),
        )
        rows = unbeaten(merged, *by)
    rows = unbeaten(rows.withColumn("accuracy", F.col("accuracy") / n_fields), *by)
    return rows.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("cost")) - 1).alias("step"), "tiers", "accuracy", "cost")


def at_budget(steps: DataFrame, budgets: DataFrame, *by: str) -> DataFrame:
    """The budgets (the keys, budget and more) with tiers, accuracy and cost of the best step within; null if none is."""
    within = F.filter("steps", lambda s: s["cost"] <= F.col("budget"))
    listed = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "tiers", "accuracy", "cost"))).alias("steps"))
    found = budgets.join(listed, [*by], "left").withColumn("best", F.try_element_at(within, F.lit(-1)))
    return found.drop("steps").select("*", "best.tiers", "best.accuracy", "best.cost").drop("best")


def middle(i: Column, n: int, low: float, high: float, last: float | None = None) -> Column:
    """The value in the middle of the i-th of n equal steps from low to high, i going no further than ``last``."""
    step = (high - low) / n
    at = i.cast("double") if last is None else F.least(i.cast("double"), F.lit(last))
    return F.lit(low) + at * F.lit(step) + F.lit(step / 2)


def verdict_map(profile: DataFrame, scenario: DataFrame, n_fields: int, volumes: tuple[float, float], budgets: tuple[float, float], verdict: Callable[[], Column], resolution: int = 46) -> DataFrame:
    """i, volume and j: for each column of a map of volume by budget the number of rows from below in which the verdict
    on the best routing there holds, up to the first in which it does not.

    ``verdict`` is a condition on tiers, accuracy and cost, which are null where nothing fits the budget, and on volume
    and budget. The map has resolution + 1 columns and 1.6 times resolution rows, looked at in their middles.
    """
    n = round(resolution * 1.6)
    columns = scenario.drop("volume", "budget").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(resolution))))
    columns = columns.withColumn("volume", middle(F.col("i"), resolution, *volumes, last=resolution - 0.5))
    steps = frontier(profile, columns.withColumn("budget", F.lit(0.0)), n_fields, "i")
    grid = columns.select("i", "volume", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).withColumn("budget", middle(F.col("j"), n, *budgets))
    flipped = F.min(F.when(~F.coalesce(verdict(), F.lit(False)), F.col("j")))
    return at_budget(steps, grid, "i").groupBy("i", "volume").agg(F.coalesce(flipped, F.lit(n)).alias("j"))
