"""Mixing sources to target weights by Pareto order sampling.

A source's target gives each of its documents target / size copies. The whole part of that is certain: every document is
taken so often. What is left of the target is filled by a sample: documents stand in the order of random odds divided by
inclusion odds, and the first of them are taken until the words that are left are reached, the last one if that comes
nearer. Inclusion odds are those of the copies' fraction, times a preference: by default the root of the source's mean
size over the document's own, so that one very long document seldom is the one that overshoots.

No source is ever sorted or gathered. The place where its order is cut is found digit by digit: words are summed by
the leading bits of the order's number, and only the documents of the digit in which the cut lies are looked at further.
Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in the order of their names, again and again; the mix's share of all words; copies at most.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SEED = "mix"
#: Bits of a document's place in the order, and bits looked at in one step.
BITS, DIGIT = 52, 8
#: Documents of a source up to which the cut is searched among themselves.
FEW = 256
#: What rows stand in order by.
ORDER = ("place", "no_id", "id", "size")
#: Sources up to which their table is broadcast, after a count.
SOURCES = 100_000


def size_of(text: Column) -> Column:
    """The number of words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def drawn(doc_id: Column, text: Column, seed: str) -> Column:
    """52 random bits that hang on the seed, the id and the text only."""
    of = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.sha2(of, 256), 1, 13), 16, 10).cast("long")


def placed(sources: DataFrame) -> DataFrame:
    """``sources`` with place: 0 for the first by code point, a null source last. Only counts by partition meet."""
    by_name = F.col("source").asc_nulls_last()
    rows = sources.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("row", F.monotonically_increasing_id())
    rows = common.stored(rows, "sources").withColumn("part", F.shiftright("row", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.count("*").alias("n_rows")).select("part", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("earlier"))
    return rows.join(F.broadcast(parts), "part").select(*sources.columns, (F.col("earlier") + F.col("row") - F.shiftleft("part", 33)).alias("place"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size and more) with weight and target, stored.

    The mix has ``share`` of all words, divided by weight; a target stops at ``most`` times its source's size, and what
    is above goes to the others by weight, until none is above.
    """
    weight = F.array(*map(F.lit, map(float, weights)))[F.pmod("place", F.lit(len(weights))).cast("int")]
    rows = common.stored(placed(sources).withColumn("weight", weight).drop("place"), "weights")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # the sources that stop only ever grow in number
        stops = F.col("weight") * level > F.col("source_size") * float(most)
        r = rows.agg(F.count_if(stops).alias("n"), F.sum(F.when(stops, F.col("source_size"))).alias("words"), F.sum(F.when(~stops, F.col("weight"))).alias("weight")).first()
        if r["n"] <= stopped or not r["weight"]:
            break
        stopped, level = r["n"], (total - float(most) * (r["words"] or 0)) / r["weight"]
    return rows.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * level))


def _cuts(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """of, cut (place, no_id, id and size of the first rows that are not all taken) and take (how many of them are taken);
    a source all of whose documents are taken has none. rows: of, place, no_id, id, size; rest: of, rest."""
    left, shift, prefix = rest.select("of", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base")), BITS, F.lit(0).cast("long")
    inside = lambda: rows.join(common.sized(left, SOURCES), "of").where(F.shiftright("place", shift) == F.col("prefix"))
    while shift > 0:
        here, shift = inside(), max(0, shift - DIGIT)
        prefix = F.shiftright("place", shift)
        sums = here.groupBy("of", "rest", "base", prefix.alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = Window.partitionBy("of").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0))).where(F.col("base") + F.col("words") > F.col("rest"))
        # the first digit at which the words exceed the rest
        left = common.stored(sums.groupBy("of").agg(F.min_by(F.struct("rest", "prefix", "base", "n"), "prefix").alias("x")).select("of", "x.*"), "cuts")
        if (left.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    alike = inside().groupBy("of", "rest", "base", "prefix", F.struct(*ORDER).alias("cut")).agg(F.count("*").alias("alike"))
    before = Window.partitionBy("of").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("cut.size")
    alike = alike.withColumn("base", F.col("base") + F.coalesce(F.sum(size * F.col("alike")).over(before), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("alike"), F.floor((F.col("rest") - F.col("base")) / size + 0.5)))
    # the last one before the rest is exceeded may be taken as the nearer end, and all of its digit with it
    beyond = F.struct(F.shiftleft(F.col("prefix") + 1, shift).alias("place"), F.lit(False).alias("no_id"), F.lit(-(2**63)).alias("id"), F.lit(0).cast("long").alias("size"))
    alike, short = alike.withColumn("take", take), F.col("take") < F.col("alike")
    found = alike.groupBy("of", "prefix").agg(F.min_by(F.struct("cut", "take"), F.when(short, F.col("cut"))).alias("x"))
    return common.stored(found.select("of", F.coalesce("x.cut", beyond).alias("cut"), F.coalesce("x.take", F.lit(0)).alias("take")), "cuts")


def _some_alike(rows: DataFrame) -> DataFrame:
    """row of those that are taken among rows that are alike, where not all of them are: the first ``take`` in the order
    of the stored table. They are told apart by their place in it only, so which of them are taken shows nowhere."""
    alike = rows.where((F.struct(*ORDER) == F.col("cut")) & (F.col("take") > 0)).select("of", "row", "take", F.shiftright("row", 33).alias("part"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy("of", "part").agg(F.count("*").alias("n")).select("of", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = alike.withColumn("nth", F.row_number().over(Window.partitionBy("of", "part").orderBy("row"))).join(parts, ["of", "part"])
    return ranked.where(F.col("earlier") + F.col("nth") <= F.col("take")).select("row", F.lit(True).alias("some"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, preference: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target (of the row's source, in words), copies and taken (words), one row for each of ``docs``.

    Sources are weighed by ``weights`` in the order of their names by code point, a null source last. ``preference`` is
    a positive factor on a document's inclusion odds, of the columns doc_id, source, size, source_size and mean_size. A
    null or empty text has size 0 and is taken 0 times its size. The outcome hangs on the seed, ids and texts only; rows
    that repeat both are exchangeable, and as many of them are taken as the order asks for. Other columns are not
    looked at. An empty table gives an empty one.
    """
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    rows = docs.select(doc_id.alias("doc_id"), docs["source"].cast("string").alias("source"), size_of(text).alias("size"), drawn(doc_id, text, seed).alias("draw"))
    rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
    of = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.withColumn("of", of)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    plan = targets(sums, weights, share, most).withColumn("copies", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = plan.select(of.alias("of"), "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.try_divide("source_size", "n").alias("mean_size"))
    plan = common.stored(plan, "targets")

    planned = rows.join(common.sized(plan, SOURCES), "of")
    fraction = F.col("rest") / F.col("source_size")
    preference = F.sqrt(F.col("mean_size") / F.col("size")) if preference is None else preference
    u = (F.col("draw").cast("double") + 0.5) / float(1 << BITS)
    # without a fraction nobody is in the sample, and no odds are divided by
    q = (u / (1.0 - u)) / (fraction / (1.0 - fraction) * preference)
    place, in_sample = F.least(F.floor(q / (1.0 + q) * float(1 << BITS)), F.lit((1 << BITS) - 1)), (F.col("size") > 0) & (F.col("rest") > 0)
    planned = planned.withColumns({"place": F.when(in_sample, place), "no_id": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
    cuts = _cuts(planned.where(in_sample).select("of", *ORDER), plan.where("rest > 0").select("of", "rest"))
    cut = planned.join(common.sized(cuts, SOURCES), "of", "left")
    first = in_sample & (F.col("cut").isNull() | (F.struct(*ORDER) < F.col("cut")))
    if cuts.where("take > 0").limit(1).count():
        cut = cut.join(_some_alike(cut), "row", "left")
        first = first | F.coalesce("some", F.lit(False))
    copies = F.col("copies") + first.cast("long")
    return cut.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH m AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ((('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496 AS u FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n,
    ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM m GROUP BY source),
filled AS (  -- the sources that stop first come first
  SELECT *, row_number() OVER by_stop AS k, coalesce(sum(source_size) OVER earlier, 0)::DOUBLE AS stopped, sum(weight) OVER later AS open_weight, sum(source_size) OVER ()::DOUBLE AS total
  FROM s WINDOW by_stop AS (ORDER BY source_size / weight, source NULLS LAST),
    earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    later AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT (1.5::DOUBLE * total - 2 * stopped) / open_weight AS level FROM filled WHERE (1.5::DOUBLE * total - 2 * stopped) / open_weight * weight <= 2 * source_size ORDER BY k LIMIT 1),
target AS (SELECT source, source_size, n, least(2::DOUBLE * source_size, weight * level) AS target FROM s, level),
rest AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS copies, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS rest FROM target),
odds AS (
  SELECT m.doc_id, m.size, m.u, r.*, (u / (1 - u)) / ((rest / source_size) / (1 - rest / source_size) * sqrt(source_size::DOUBLE / n / size)) AS q
  FROM m JOIN rest r ON m.source IS NOT DISTINCT FROM r.source WHERE size > 0 AND rest > 0),
cut AS (
  SELECT doc_id, size, source_size, target, copies,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY floor(q / (1 + q) * 4503599627370496), doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2::DOUBLE <= rest AS first FROM odds)
SELECT doc_id, size, source_size, target, copies + first::BIGINT AS copies, ((copies + first::BIGINT) * size)::BIGINT AS taken FROM cut
UNION ALL SELECT m.doc_id, m.size, source_size, target, copies, copies * m.size FROM m JOIN rest r ON m.source IS NOT DISTINCT FROM r.source WHERE NOT (m.size > 0 AND rest > 0)
"""
