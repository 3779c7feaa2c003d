"""Assumed numbers: prices, bounds and the human tier; and the column expressions made of them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Assumptions:
    """The published defaults."""

    humanAccuracy: float = 0.85
    humanSeconds: float = 45.0
    analystAnnualCost: float = 62_000.0
    productiveHoursPerDay: float = 6.0
    workingDaysPerYear: float = 220.0
    pricePerThousandSmall: float = 0.20
    pricePerThousandLarge: float = 1.60
    volume: float = 100_000.0
    budget: float = 4_000.0


KEYS = tuple(asdict(Assumptions()))

#: What a screen accepts, and what is plausible for the numbers without a source.
BOUNDS = {
    "humanAccuracy": (0.5, 0.99), "humanSeconds": (5.0, 1800.0), "analystAnnualCost": (20_000.0, 200_000.0), "productiveHoursPerDay": (1.0, 8.0), "workingDaysPerYear": (180.0, 260.0),
    "pricePerThousandSmall": (0.0, 50.0), "pricePerThousandLarge": (0.0, 200.0), "volume": (1_000.0, 10_000_000.0), "budget": (0.0, 10_000_000.0),
}
PLAUSIBLE = {
    "humanAccuracy": (0.70, 0.98), "humanSeconds": (15.0, 300.0), "analystAnnualCost": (40_000.0, 160_000.0), "productiveHoursPerDay": (4.0, 7.0), "pricePerThousandSmall": (0.02, 2.0), "pricePerThousandLarge": (0.20, 20.0),
}


def as_row(spark: SparkSession, given: Assumptions = Assumptions()) -> DataFrame:
    """One row with a column for each assumption."""
    return spark.createDataFrame([tuple(map(float, asdict(given).values()))], ", ".join(f"{k} double" for k in KEYS))


def prices() -> Column:
    """The price of a thousand items at each tier, in the tiers' order, from a row of assumptions."""
    hour = F.col("analystAnnualCost") / (F.col("productiveHoursPerDay") * F.col("workingDaysPerYear"))
    return F.array(F.lit(0.0), F.col("pricePerThousandSmall"), F.col("pricePerThousandLarge"), (F.col("humanSeconds") / F.lit(3600.0)) * hour * F.lit(1000.0))


def accuracy_of(tier: Column, measured: Column) -> Column:
    return F.when(tier == "human", F.col("humanAccuracy")).otherwise(measured)


def latency_of(tier: Column, measured: Column) -> Column:
    """Milliseconds an item, or seconds a thousand; the human tier's are assumed."""
    return F.when(tier == "human", F.col("humanSeconds") * 1000.0).otherwise(measured)


def clamped(updates: DataFrame) -> DataFrame:
    """key and value of the updates (key, value) that name an assumption and are finite, inside the bounds."""
    bounds = updates.sparkSession.createDataFrame([(k, *b) for k, b in BOUNDS.items()], "key string, lo double, hi double")
    finite = updates.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return finite.join(F.broadcast(bounds), "key").select("key", F.least("hi", F.greatest("lo", "value")).alias("value"))
