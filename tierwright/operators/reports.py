"""Counts over all combinations of ordered kinds, the empty ones too, with subtotals and a total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "total"


def rolled_up(rows: DataFrame, dimensions: dict[str, list[str]], **measures: Column) -> DataFrame:
    """The dimensions' places (``<name>_idx``) and names with the measures, for every combination of kinds, for every kind
    of the leading dimensions, and for all.

    ``dimensions`` lists the kinds of each column in the order of reports. Combinations without rows show 0. Subtotals
    have the name "total", one place behind the last kind. Values that are no kind count in the subtotals above
    them only. Rows are summed once, by grouping sets.
    """
    names = [*dimensions]
    known = rows
    for n in names:
        known = known.withColumn(n, F.when(F.col(n).cast("string").isin(dimensions[n]), F.col(n).cast("string")))
    level = F.grouping_id().alias("_level")
    counted = known.rollup(*names).agg(level, *(c.alias(m) for m, c in measures.items()))
    # a null that the data has is no kind; a null of a subtotal shows in the level's bits
    shown = counted
    for i, n in enumerate(names):
        summed_up = F.col("_level").bitwiseAND(F.lit(1 << (len(names) - 1 - i))) != 0
        shown = shown.withColumn(n, F.when(summed_up, TOTAL).otherwise(F.col(n)))
    shown = shown.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))).drop("_level")
    frame = reduce(lambda df, n: df.withColumn(n, F.explode(F.array(*map(F.lit, [*dimensions[n], TOTAL])))), names, rows.sparkSession.range(1).drop("id"))
    for a, b in zip(names, names[1:]):
        frame = frame.where((F.col(a) != TOTAL) | (F.col(b) == TOTAL))
    place = [(F.array_position(F.array(*map(F.lit, [*dimensions[n], TOTAL])), F.col(n)) - 1).cast("int").alias(f"{n}_idx") for n in names]
    whole = frame.join(F.broadcast(shown), names, "left")
    return whole.select(*place, *names, *(F.coalesce(m, F.lit(0)).alias(m) for m in measures))
