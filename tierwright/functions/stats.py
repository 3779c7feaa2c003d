"""Intervals, paired tests and baseline verdicts as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENOUGH = 20
Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The score interval of k of n, inside [0, 1]; all of it when there is nothing to count."""
    n_, k_, zz = F.nullif(n.cast("double"), F.lit(0.0)), k.cast("double"), z * z
    p = k_ / n_
    scale = 1 + zz / n_
    centre = (p + zz / (2 * n_)) / scale
    spread = (z * F.sqrt((p * (1 - p)) / n_ + zz / (4 * n_ * n_))) / scale
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), centre + spread)).otherwise(1.0)


def precision(low: Column, high: Column) -> Column:
    """Half the interval's width in points."""
    return (high - low) / 2 * 100


def rate(k: Column, n: Column) -> list[Column]:
    """successes, n, rate, low, high, precision and reportable."""
    low, high = wilson(k, n)
    share = F.when(n == 0, 0.0).otherwise(k.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)))
    return [k.alias("successes"), n.alias("n"), share.alias("rate"), low.alias("low"), high.alias("high"), precision(low, high).alias("precision"), (n >= ENOUGH).alias("reportable")]


def fixed(c: Column, digits: int) -> Column:
    """The number rounded to so many digits, the larger of two equally near, as a double."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def written_rate() -> Column:
    """A rate (columns of ``rate``) for readers; small samples are not quoted."""
    few = F.format_string("— (n=%d, too few to quote)", F.col("n"))
    full = F.format_string("%.1f %% [%.0f–%.0f], n=%d", fixed(F.col("rate") * 100, 1), fixed(F.col("low") * 100, 0), fixed(F.col("high") * 100, 0), F.col("n"))
    return F.when(F.col("reportable"), full).otherwise(few)


def distinguishable(a: str, b: str) -> Column:
    """Whether the intervals of two rows, aliased a and b, are apart."""
    return (F.col(f"{a}.high") < F.col(f"{b}.low")) | (F.col(f"{b}.high") < F.col(f"{a}.low"))


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps further up, for x of 1 or more."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return reduce(lambda s, k: s - F.log(x + k), range(8), series)


def paired_p(gains: Column, regressions: Column) -> Column:
    """The two-sided binomial p of discordant pairs; null without any.

    Terms that lie more than ten times sqrt(d) before the last one, of d pairs, are below 1e-80 of it and left out, so
    the row's sequence grows with the root of the pairs only.
    """
    d, least = (gains + regressions).cast("double"), F.least(gains, regressions).cast("bigint")
    begin = F.greatest(F.lit(0).cast("bigint"), least - 50 - F.ceil(10 * F.sqrt(d)))
    b = begin.cast("double")
    first = F.when(begin > 0, log_gamma(d + 1) - log_gamma(b + 1) - log_gamma(d - b + 1)).otherwise(0.0) - d * math.log(2)
    # C(d, i) / 2**d, each from the one before, in logarithms so that many pairs do not overflow
    logs = F.aggregate(
        F.when(least > begin, F.sequence(begin + 1, least)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("at"), F.exp(first).alias("sum")),
        lambda s, i: F.struct((s["at"] + F.log((d - i + 1) / i)).alias("at"), (s["sum"] + F.exp(s["at"] + F.log((d - i + 1) / i))).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(d > 0, F.least(F.lit(1.0), 2 * logs))


def verdict(measured: Column, baseline: Column, n: Column) -> Column:
    """indistinguishable, beats or loses, by a z test in which both sides have n cases."""
    se = F.sqrt(measured * (1 - measured) / n + baseline * (1 - baseline) / n)
    gap = measured - baseline
    return F.when(F.abs(gap) < Z * se, "indistinguishable").when(gap > 0, "beats").otherwise("loses")


def share_written(part: Column, whole: Column) -> Column:
    """A share in whole percent; 100 only if full, 0 only if empty, a dash of nothing."""
    return (
        F.when(whole == 0, "—").when(part == whole, "100 %").when(part == 0, "0 %")
        .otherwise(F.concat(F.greatest(F.lit(1), F.least(F.lit(99), F.floor(F.lit(100.0) * part / F.nullif(whole, F.lit(0)) + 0.5))).cast("string"), F.lit(" %")))
    )
