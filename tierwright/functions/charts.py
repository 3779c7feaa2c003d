"""The numeric kernels of the charts; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a step function without a series may have.
ONE_LINE = 1_000_000


def extent(rows: DataFrame, value: str) -> DataFrame:
    """low and high of an axis: the values and 0, with 8 % room above, and below only if some are negative."""
    x = F.col(value).cast("double")
    finite = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    lo, hi = F.least(F.min(x), F.lit(0.0)), F.greatest(F.max(x), F.lit(0.0))
    ends = finite.agg(F.coalesce(lo, F.lit(0.0)).alias("lo"), F.coalesce(hi, F.lit(0.0)).alias("hi"))
    room = (F.col("hi") - F.col("lo")) * 0.08
    wide = ends.select(F.when(F.col("lo") < 0, F.col("lo") - room).otherwise(F.lit(0.0)).alias("low"), (F.col("hi") + room).alias("high"))
    return wide.select("low", F.when(F.col("high") == F.col("low"), F.col("low") + 1).otherwise(F.col("high")).alias("high"))


def ticks(extents: DataFrame, wanted: int = 5) -> DataFrame:
    """tick: round values inside (low, high), about ``wanted`` of them.

    Steps are 1, 2, 5 or 10 times a power of ten, or 2.5 at the cost of one tick off; the count nearest to the wanted
    wins, then the larger step.
    """
    steps = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(p).alias("p")) for m, p in ((1.0, 0.0), (2.0, 0.0), (5.0, 0.0), (10.0, 0.0), (2.5, 1.0))))).alias("s")
    scale = F.pow(F.lit(10.0), F.floor(F.log10((F.col("high") - F.col("low")) / wanted)))
    tried = extents.select("low", "high", scale.alias("scale"), steps).select("low", "high", (F.col("s.m") * F.col("scale")).alias("step"), F.col("s.p").alias("p"))
    counted = tried.withColumn("n", F.floor(F.col("high") / F.col("step") + 1e-9) - F.ceil(F.col("low") / F.col("step") - 1e-9) + 1)
    chosen = counted.groupBy("low", "high").agg(F.min_by("step", F.struct((F.abs(F.col("n") - wanted) + F.col("p")).alias("off"), (-F.col("step")).alias("s"))).alias("step"))
    at = F.sequence(F.ceil(F.col("low") / F.col("step") - 1e-9), F.floor(F.col("high") / F.col("step") + 1e-9))
    return chosen.select(F.explode(at).alias("i"), "step").select((F.col("i") * F.col("step")).alias("tick"))


def scaled(value: Column, low: Column, high: Column, root: bool = False) -> Column:
    """A value's place in 0 .. 1, linear or by square root."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    return F.sqrt(share) if root else share


def islands(rows: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """``rows`` without nulls of value, with the number of the unbroken stretch that each belongs to."""
    w = Window.partitionBy(series).orderBy(order)
    gap = F.sum(F.col(value).isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("gap", gap).where(F.col(value).isNotNull())
    return marked.withColumn("stretch", F.dense_rank().over(Window.partitionBy(series).orderBy("gap"))).drop("gap")


def bar(value: Column, cap: Column) -> Column:
    """A bar's length in percent of the cap, 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_divide(value * 100.0, cap), F.lit(0.0))))


def stacked(rows: DataFrame, row: str, part: str, value: str) -> DataFrame:
    """row, part, value, and its share of the largest row's total."""
    sums = rows.groupBy(row, part).agg(F.sum(value).alias("value"))
    totals = sums.withColumn("total", F.sum("value").over(Window.partitionBy(row)))
    most = sums.groupBy(row).agg(F.sum("value").alias("total")).agg(F.max("total")).scalar()
    return totals.withColumn("most", most).select(row, part, "value", "total", F.try_divide(F.col("value"), F.col("most")).alias("share"))


def mean_above(value: str, bound: int) -> Column:
    """Whether a group's mean of doubles is above ``bound``, whatever the order its rows come in.

    Doubles are added up as the decimals they are written as, so a mean of exactly ``bound`` is never above it. Groups with
    values that 12 digits before the point and 16 after do not hold, or that are not finite, have the mean of doubles.
    """
    exact = F.col(value).try_cast("decimal(28,16)")
    above = F.sum(exact) > F.count(value).cast("decimal(20,0)") * bound
    return F.when(F.count(exact) == F.count(value), above).otherwise(F.avg(value) > bound)


def case_grid(rows: DataFrame, case: str, version: str | Column, value: str, unstable: str | None = None) -> DataFrame:
    """``rows`` with state: what each case's result (true, false or null) is beside the version before.

    A cell that ``unstable`` marks is so whatever its result.
    """
    before = F.lag(value).over(Window.partitionBy(case).orderBy(version))
    known = F.row_number().over(Window.partitionBy(case).orderBy(version)) > 1
    v = F.col(value)
    state = (
        F.when(F.coalesce(F.col(unstable), F.lit(False)) if unstable else F.lit(False), "unstable")
        .when(v.isNull(), "empty")
        .when(known & before.isNotNull() & v & ~before, "repaired")
        .when(known & before.isNotNull() & ~v & before, "broken")
        .when(v, "ok").otherwise("ko")
    )
    return rows.withColumn("state", state)


def populations(rows: DataFrame, group: str, value: str, bins: int = 16) -> DataFrame:
    """group, bin and n over bins that all groups share: the values' range with 8 % room on both sides."""
    ends = rows.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    r = rows.withColumn("e", ends)
    room = (F.col("e.hi") - F.col("e.lo")) * 0.08
    share = F.try_divide(F.col(value) - (F.col("e.lo") - room), F.col("e.hi") - F.col("e.lo") + 2 * room)
    placed = r.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(F.floor(share * bins), F.lit(0)))))
    return placed.groupBy(group, "bin").agg(F.count("*").alias("n"))


def overlap(rows: DataFrame, group: str, value: str) -> DataFrame:
    """low and high of what two groups share; no row if they share nothing, or are not two."""
    ends = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    both = ends.agg(F.max("lo").alias("low"), F.min("hi").alias("high"), F.count("*").alias("groups"))
    return both.where("groups = 2 AND low <= high").select("low", "high")


def opposed(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with place: the value on an axis that reaches as far to both sides, at least to 1."""
    most = rows.agg(F.greatest(F.lit(1.0), F.max(F.abs(F.col(value))))).scalar()
    return rows.withColumn("place", F.col(value) / most)


def clipped(low: Column, high: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """A band's ends inside the axis."""
    return F.greatest(lo, F.least(hi, low)), F.greatest(lo, F.least(hi, high))


def frontier(scenario: DataFrame, verdict, columns: int = 47, rows: int = 74) -> DataFrame:
    """i and j: for each of the columns, the first row at which ``verdict`` of (x, y) in 0 .. 1 is false."""
    grid = scenario.select("*", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("j"))
    x, y = F.col("i") / F.lit(float(columns - 1)), F.col("j") / F.lit(float(rows - 1))
    return grid.groupBy("i").agg(F.min(F.when(~verdict(x, y), F.col("j"))).alias("j"))


def strata(rows: DataFrame, stratum: str, value: str, threshold: float, low: float, high: float, bins: int = 116) -> DataFrame:
    """stratum, bin, n and within: how many of the bin's values do not pass the threshold."""
    place = F.floor((F.col(value) - low) / (high - low) * bins)
    placed = rows.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)))
    return placed.groupBy(stratum, "bin").agg(F.count("*").alias("n"), F.count_if(F.col(value) <= threshold).alias("within"))


def rank_moves(ranked: DataFrame, series: str, rank: str) -> DataFrame:
    """series, best, worst and moved (worst less best)."""
    return ranked.groupBy(series).agg(F.min(rank).alias("best"), F.max(rank).alias("worst")).withColumn("moved", F.col("worst") - F.col("best"))


def largest_move(moves: DataFrame) -> DataFrame:
    """The series that moved most; of equals, the one that was best once."""
    return moves.orderBy(F.desc("moved"), "best", moves.columns[0]).limit(1)


def ribbon(rows: DataFrame, key: str, value: str, log: bool = False) -> DataFrame:
    """key, x, low, high and mid of the values by key, and the axis end; x is the key, or its logarithm."""
    ends = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mid"))
    top = rows.agg(F.max(value) * 1.05).scalar()
    x = F.log10(F.col(key)) if log else F.col(key).cast("double")
    return ends.select(key, x.alias("x"), "low", "high", "mid", top.alias("end"))


def overdue(start: Column, end: Column, due: Column) -> Column:
    """The part of a bar of work that lies after its due time."""
    return F.when(end > due, end - F.greatest(start, due)).otherwise(F.lit(0.0))


def staircase(rows: DataFrame, x: str, y: str, *series: str) -> DataFrame:
    """The rows where y changes along x: the corners of the step function of each series.

    Without a series all rows are one line in one task; more than ``ONE_LINE`` of them are refused.
    """
    if not series and rows.count() > ONE_LINE:
        raise ValueError(f"name the series of more than {ONE_LINE} rows")
    before = F.lag(y).over(Window.partitionBy(*series).orderBy(x))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(y))).drop("before")


def histogram(rows: DataFrame, value: str, width: float, threshold: float, fixed: Column) -> DataFrame:
    """bin, low, n, fixed and beyond: equal bins from 0, how many rows of each have the fixed part, and whether the bin
    begins at or beyond the threshold."""
    binned = rows.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"), F.count_if(fixed).alias("fixed"))
    return binned.select("bin", (F.col("bin") * width).alias("low"), "n", "fixed", (F.col("bin") * width >= threshold).alias("beyond"))


def curves(rows: DataFrame, x: str, first: str, second: str) -> DataFrame:
    """x, series, value and place of one or two series on the axis that they share: ``extent`` of all their values."""
    long = rows.select(x, F.stack(F.lit(2), F.lit(first), F.col(first).cast("double"), F.lit(second), F.col(second).cast("double")).alias("series", "value")).where("value IS NOT NULL")
    ends = extent(long, "value").agg(F.struct(F.max("low").alias("low"), F.max("high").alias("high"))).scalar()
    placed = long.withColumn("e", ends)
    return placed.select(x, "series", "value", scaled(F.col("value"), F.col("e.low"), F.col("e.high")).alias("place"))
