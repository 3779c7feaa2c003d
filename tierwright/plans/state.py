"""The state that a routing screen shows, and the blocks of a report, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierwright.functions import assumptions as given
from tierwright.functions import stats, text
from tierwright.operators import baselines, routing
from tierwright.sources.tables import FIELDS, TIERS


def pivoted(profile: DataFrame, scenario: DataFrame) -> DataFrame:
    """field_idx, field and each tier's accuracy; the human one as assumed."""
    human = scenario.select("humanAccuracy").scalar()
    shown = profile.withColumn("humanAccuracy", human).withColumn("shown", given.accuracy_of(F.col("tier"), F.col("accuracy")))
    return shown.groupBy("field_idx", "field").pivot("tier", list(TIERS)).agg(F.max("shown"))


def matrix(profile: DataFrame, scenario: DataFrame, own: DataFrame, n_fields: int) -> DataFrame:
    """field_idx, field, tier_idx, tier, accuracy, seconds, chosen and optimum of every cell.

    seconds is what a thousand items take; chosen marks the tiers of ``own`` (field_idx, tier), optimum the best ones.
    """
    best = routing.optimum(profile, scenario, n_fields).select(F.posexplode("tiers").alias("field_idx", "best_idx"))
    mine = own.select("field_idx", F.col("tier").alias("own_tier"))
    human = scenario.select(F.struct("humanAccuracy", "humanSeconds")).scalar()
    cells = profile.withColumn("h", human).withColumns({c: F.col(f"h.{c}") for c in ("humanAccuracy", "humanSeconds")})
    joined = cells.join(F.broadcast(best), "field_idx", "left").join(F.broadcast(mine), "field_idx", "left")
    return joined.select(
        "field_idx", "field", "tier_idx", "tier", given.accuracy_of(F.col("tier"), F.col("accuracy")).alias("accuracy"), given.latency_of(F.col("tier"), F.col("latency")).alias("seconds"),
        F.coalesce(F.col("tier") == F.col("own_tier"), F.lit(False)).alias("chosen"), F.coalesce(F.col("tier_idx") == F.col("best_idx"), F.lit(False)).alias("optimum"),
    )


def state(profile: DataFrame, scenario: DataFrame, own: DataFrame, fields: tuple[str, ...]) -> dict[str, DataFrame]:
    """Everything that a screen recomputes when a cell or an assumption changes.

    own: field_idx and tier of the user's routing.
    """
    n = len(fields)
    rows = routing.evaluated(profile, scenario, n)
    tiers = F.array(*map(F.lit, TIERS))
    digits = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("field_idx", (F.array_position(tiers, F.col("tier")) - 1).cast("int").alias("t")))), lambda s: s["t"])).scalar()
    best = routing.optimum(profile, scenario, n)
    mine = rows.where(F.col("tiers") == digits)
    return {
        "accuracy": pivoted(profile, scenario),
        "prices": scenario.select(F.posexplode(given.prices()).alias("tier_idx", "price")),
        "mine": mine,
        "optimum": best,
        "uniform": routing.uniform(rows),
        "next_gain": routing.shadow_price(profile, scenario, n),
        "compared": routing.cheaper(mine, best),
        "assumptions": scenario,
        "bounds": scenario.sparkSession.createDataFrame([(k, *b) for k, b in given.BOUNDS.items()], "key string, lo double, hi double"),
    }


def extraction_block(profile: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """tier, each field's accuracy and the mean latency of the machine tiers; ``fields`` are the enumeration's."""
    machine = profile.where("tier <> 'human'")
    latency = machine.groupBy("tier").agg(F.avg("latency").alias("mean_latency"))
    return machine.groupBy("tier_idx", "tier").pivot("field", [*fields]).agg(F.max("accuracy")).join(latency, "tier").orderBy("tier_idx")


def console_lines(profile: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """line_no and line of the extraction report in columns of fixed width: a head, a rule, and a line for each machine tier."""
    block = extraction_block(profile, fields)
    cell = lambda c: F.lpad(F.lpad(text.percent(F.col(c)), 7, " "), 10, " ")
    latency = F.lpad(F.format_string("%.2f", stats.fixed(F.col("mean_latency"), 2)), 7, " ")
    rows = block.select((F.col("tier_idx") + 2).alias("line_no"), F.concat(F.rpad("tier", 10, " "), *map(cell, fields), F.lit("   "), latency, F.lit(" ms")).alias("line"))
    head = "tier      " + "".join(f.rjust(10) for f in fields) + "     latency"
    top = profile.sparkSession.range(2).select(F.col("id").cast("int").alias("line_no"), F.when(F.col("id") == 0, head).otherwise("─" * 76).alias("line"))
    return top.unionByName(rows)


def classification_block(profile: DataFrame) -> DataFrame:
    """tier, accuracy and its interval of the machine tiers."""
    k = F.floor(F.col("accuracy") * F.col("items") + 0.5).cast("bigint")
    return profile.where("tier <> 'human'").select("tier_idx", "tier", "latency", *stats.rate(k, F.col("items")))


def routing_block(profile: DataFrame, scenario: DataFrame, n_fields: int) -> DataFrame:
    """The optimum by field, and a total row: mean accuracy and summed cost."""
    fields = routing.by_field(routing.optimum(profile, scenario, n_fields), profile, scenario)
    whole = fields.agg(F.lit(n_fields).alias("field_idx"), F.lit("total").alias("field"), F.lit("").alias("tier"), F.avg("accuracy").alias("accuracy"), F.sum("cost").alias("cost"))
    return fields.unionByName(whole)


def shadow_block(profile: DataFrame, scenario: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    step = routing.shadow_price(profile, scenario, len(fields))
    return step, routing.changed(step, fields)


def baselines_block(measured: DataFrame, truths: DataFrame, label: str, order: str) -> DataFrame:
    return baselines.verdicts(measured, baselines.majority(truths, label, order))


def finding_block(profile: DataFrame, scenario: DataFrame, n_fields: int) -> DataFrame:
    """One row: accuracy, cost, fields carried free by rules, and how many tiers the optimum uses."""
    best = routing.optimum(profile, scenario, n_fields)
    return best.select("accuracy", "cost", F.size(F.filter("tiers", lambda t: t == 0)).alias("free_fields"), F.size(F.array_distinct("tiers")).alias("tiers_used"), "budget_share")


def as_json(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """part and body: each part of a state (its rows, and the columns that order them) as a JSON array, in one row each.

    What a screen asks for at once; the parts are of report size.
    """
    def one(name: str, rows: DataFrame, order: list[str]) -> DataFrame:
        cells = F.struct(F.struct(*order).alias("o"), F.struct(*rows.columns).alias("r"))
        listed = F.transform(F.array_sort(F.collect_list(cells)), lambda c: c["r"])
        return rows.agg(F.to_json(listed).alias("body")).select(F.lit(name).alias("part"), "body")

    return reduce(DataFrame.unionByName, (one(name, *rows) for name, rows in parts.items()))
