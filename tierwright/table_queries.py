"""Further registered queries: models, vectors, exact frontiers, one-pass measures and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwright import oracle as o
from tierwright import queries as q
from tierwright.functions import assumptions as given
from tierwright.functions import charts
from tierwright.functions import text as rules
from tierwright.operators import described, failures, inventory, leaks, measure, models, patterns, reports, routing, sensitivity, skyline, timing, updates
from tierwright.plans import state
from tierwright.registry import registered
from tierwright.sinks import manifest
from tierwright.sources.tables import FIELDS, LANGUAGES, TIERS, as_document, dimension, extraction_rows, parsed, table

N = len(LANGUAGES)
MACHINE = ("rules", "small", "large", "model")

# a model tier

WORDS_OF = "list_filter(string_split_regex(lower({}), '[^a-zà-ÿ]+'), lambda x: x <> '')"


def model_sql(label: str) -> str:
    """``chosen`` (doc_id, model): the answers of the word model that learns ``label`` from the labelled documents."""
    return f"""
tw AS (SELECT doc_id, lang, {WORDS_OF.format("coalesce(text, '')")} AS w FROM documents),
train AS (SELECT ({label})::VARCHAR AS label, w FROM tw JOIN labels USING (doc_id) WHERE {label} IS NOT NULL),
wc AS (SELECT word, label, count(*) AS c FROM (SELECT label, unnest(w) AS word FROM train) GROUP BY ALL),
known AS (SELECT word FROM wc GROUP BY word ORDER BY sum(c) DESC, word LIMIT {models.WORDS}),
lab AS (SELECT label, count(*) AS docs FROM train GROUP BY 1),
every_cell AS (SELECT k.word, l.label, coalesce(c, 0) AS c FROM known k CROSS JOIN lab l LEFT JOIN wc ON wc.word = k.word AND wc.label = l.label),
size AS (SELECT label, sum(c) AS total, count(*) AS n FROM every_cell GROUP BY 1),
weight AS (SELECT word, label, floor(ln((c + 1)::DOUBLE / (total + n)::DOUBLE) * 1000::DOUBLE + 0.5::DOUBLE)::BIGINT AS weight FROM every_cell JOIN size USING (label)),
prior AS (SELECT label, floor(ln(docs::DOUBLE / (SELECT sum(docs) FROM lab)::DOUBLE) * 1000::DOUBLE + 0.5::DOUBLE)::BIGINT AS prior FROM lab),
met AS (SELECT doc_id, label, sum(n * weight) AS s FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM tw) GROUP BY ALL) JOIN weight USING (word) GROUP BY ALL),
chosen AS (SELECT doc_id, label AS model FROM (SELECT tw.doc_id, p.label, row_number() OVER (PARTITION BY tw.doc_id ORDER BY prior + coalesce(s, 0) DESC, p.label) AS rn
  FROM tw CROSS JOIN prior p LEFT JOIN met ON met.doc_id = tw.doc_id AND met.label = p.label) WHERE rn = 1)"""


def with_model(spark: SparkSession, d: str) -> DataFrame:
    """The language ladder with a fourth machine tier, fitted from the labelled documents."""
    documents = table(spark, d, "documents")
    labelled = documents.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    tier = models.word_tier(models.fit(labelled, "text", "lang"))
    return models.answered(measure.language_ladder(documents, F.col("text")), tier, F.col("text")).drop("text")


@registered(f"WITH {o.LADDER}, {model_sql('lang')} SELECT doc_id, truth, rules, small, large, model FROM ladder JOIN chosen USING (doc_id)")
def model_answers(spark, d):
    return with_model(spark, d)


@registered(f"WITH {o.LADDER}, {model_sql('lang')}, answers AS ({' UNION ALL '.join(f'SELECT truth AS field, {i} AS tier_idx, {o.quoted(t)} AS tier, {t} = truth AS ok FROM ladder JOIN chosen USING (doc_id)' for i, t in enumerate(MACHINE))}) SELECT tier_idx, tier, field, round(sum(ok::INT)::DOUBLE / count(*), 6) AS accuracy, count(*) AS items FROM answers GROUP BY ALL")
def model_profile(spark, d):
    answers = F.explode(F.array(*(F.struct(F.lit(i).alias("tier_idx"), F.lit(t).alias("tier"), F.col(t).alias("got")) for i, t in enumerate(MACHINE)))).alias("a")
    return q.rounded(measure.profile(with_model(spark, d).select("truth", answers).select("truth", "a.*")), "accuracy")


@registered(f"WITH {model_sql('quality')}, t AS (SELECT model, quality FROM chosen LEFT JOIN labels USING (doc_id)) SELECT model, quality, count(*) AS n FROM t GROUP BY ALL")
def quality_model(spark, d):
    """How the quality model answers over all documents, beside the labels where there are any."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    tier = models.word_tier(models.fit(documents.join(labels, "doc_id"), "text", "quality"))
    answers = models.answered(documents.select("doc_id", "text"), tier, F.col("text")).drop("text")
    return answers.join(labels, "doc_id", "left").groupBy("model", "quality").agg(F.count("*").alias("n"))


# vectors from text

DESCRIPTIONS = [(lang, " ".join(words)) for lang, words in measure.STOP_WORDS.items()]


def described_sql(rows: str, keys: str) -> str:
    """``near`` (the keys, n_words, got): the nearest description of each of ``rows`` (the keys, text)."""
    bits = "('0x' || substr(md5(word), 1, 15))::BIGINT"
    sums = "[" + ", ".join(f"2 * coalesce(sum((b >> {i}) & 1), 0) - count(word)" for i in range(described.SIGNS)) + "]"
    exploded = lambda t, k: f"SELECT {k}, word, {bits} AS b FROM (SELECT {k}, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE w END) AS word FROM (SELECT {k}, {WORDS_OF.format('text')} AS w FROM {t}))"
    return f"""given_texts AS ({rows}), said AS {o.values(DESCRIPTIONS, "name, text")},
refs AS (SELECT name, r, sqrt(list_sum(list_transform(r, lambda x: x * x))::DOUBLE) AS norm FROM (SELECT name, {sums} AS r FROM ({exploded("said", "name")}) GROUP BY name)),
vectors AS (SELECT {keys}, count(word) AS n_words, {sums} AS v FROM ({exploded("given_texts", keys)}) GROUP BY {keys}),
near AS (SELECT {keys}, n_words, CASE WHEN n_words > 0 THEN name END AS got FROM (
  SELECT {keys}, n_words, name, row_number() OVER (PARTITION BY {keys} ORDER BY list_sum(list_transform(range(1, {described.SIGNS} + 1), lambda i: v[i] * r[i]))::DOUBLE / norm DESC, name) AS rn FROM vectors, refs) WHERE rn = 1)"""


TURNS = described_sql("SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations", "conv_id, turn")
PREFIXED = described_sql("SELECT doc_id, lang, 'die ' || coalesce(text, '') AS text FROM documents", "doc_id, lang")


def descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DESCRIPTIONS, "name string, description string")


@registered(f"WITH {TURNS} SELECT conv_id, turn, n_words, got FROM near")
def described_turns(spark, d):
    return described.nearest(table(spark, d, "conversations"), descriptions(spark), ["conv_id", "turn"], "text")


@registered(f"WITH {PREFIXED} SELECT lang, got, count(*) AS n, sum(n_words)::BIGINT AS n_words FROM near GROUP BY ALL")
def described_documents(spark, d):
    """The nearest descriptions of all documents, each with a prefix, by true language."""
    near = described.nearest(table(spark, d, "documents"), descriptions(spark), ["doc_id", "lang"], "text", prefix="die ")
    return near.groupBy("lang", "got").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))


# exact frontiers


def steps_sql(rows: str, names: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""steps AS (SELECT * FROM (SELECT *, max(accuracy) OVER ({part}ORDER BY round(cost, 6), accuracy DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {rows}) WHERE before IS NULL OR accuracy > before)
SELECT {f"{keys}, " if keys else ""}row_number() OVER ({part}ORDER BY cost) - 1 AS step, {names} AS routing, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost FROM steps"""


def shown_steps(steps: DataFrame) -> DataFrame:
    return q.rounded(steps.withColumn("routing", F.array_join(routing.names(F.col("tiers")), ",")).drop("tiers"), "accuracy", "cost")


@registered(f"WITH {o.MEASURED}, {o.GIVEN}, {o.assigned(N)}, {steps_sql('rows_', o.tier_names(N))}")
def exact_frontier(spark, d):
    """All breakpoints of the measured profile; the SQL enumerates."""
    return shown_steps(skyline.frontier(q.measured(spark, d), given.as_row(spark), N))


def by_source(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """The measured profile with the documents' sources as fields, and how many there are."""
    documents = table(spark, d, "documents")
    sources = [r["source"] for r in documents.where("source IS NOT NULL").select("source").distinct().orderBy("source").collect()]  # an enumeration
    long = measure.long_form(measure.language_ladder(documents, F.col("source").alias("field")))
    right = F.sum((F.col("got") == F.col("truth")).cast("bigint"))
    cells = long.groupBy("tier_idx", "tier", "field").agg((right.cast("double") / F.count("*")).alias("accuracy"), F.count("*").alias("items"))
    named = cells.join(F.broadcast(dimension(spark, "field", tuple(sources))), "field")
    return named.select("tier_idx", "tier", "field_idx", "field", "accuracy", F.lit(0.0).alias("latency"), "items"), len(sources)


def merged_sql(n: int) -> str:
    """The frontier over n sources by merging them in turn, as DuckDB can be told: ``f{n}``."""
    parts = ["f0 AS MATERIALIZED (SELECT 0::DOUBLE AS a, 0::DOUBLE AS c, []::INT[] AS tiers)"]
    for i in range(n):
        parts.append(f"""f{i + 1} AS MATERIALIZED (SELECT a, c, tiers FROM (SELECT *, max(a) OVER (ORDER BY round(c, 6), a DESC, tiers ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT f.a + CASE WHEN t = 3 THEN humanAccuracy ELSE accuracy END AS a, f.c + volume / 1000::DOUBLE * prices[t + 1] AS c, list_append(f.tiers, t::INT) AS tiers FROM f{i} f, (SELECT unnest(range(4)) AS t) x, priced, cell_of WHERE field_idx = {i} AND tier_idx = t)) WHERE before IS NULL OR a > before)""")
    return ",\n".join(parts)


SOURCES = 20


@registered(f"""WITH {o.LADDER}, by_source AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS field_idx, ladder.* FROM ladder JOIN (SELECT doc_id, source FROM documents WHERE source IS NOT NULL) USING (doc_id)),
cell_of AS ({' UNION ALL '.join(f"SELECT field_idx, {i} AS tier_idx, sum(({'truth' if t == 'human' else t} = truth)::INT)::DOUBLE / count(*) AS accuracy FROM by_source GROUP BY field_idx" for i, t in enumerate(TIERS))}), {o.GIVEN},
priced AS (SELECT *, {o.PRICES} AS prices FROM given), {merged_sql(SOURCES)},
ready AS (SELECT a / {SOURCES} AS accuracy, c AS cost, tiers AS ord FROM f{SOURCES}), {steps_sql('ready', f"array_to_string(list_transform(ord, lambda t: ({o.listed(TIERS)})[t + 1]), ',')")}""")
def source_frontier(spark, d):
    """Routing by source: 20 fields, whose 4**20 assignments nobody enumerates."""
    profile, n = by_source(spark, d)
    return shown_steps(skyline.frontier(profile, given.as_row(spark), n))


VOLUMES, BUDGETS, COLUMNS, ROWS = (1_000.0, 10_000_000.0), (0.0, 40_000.0), 46, 74
_STEP_X, _STEP_Y = (VOLUMES[1] - VOLUMES[0]) / COLUMNS, (BUDGETS[1] - BUDGETS[0]) / ROWS


@registered(f"""WITH {o.MEASURED}, {o.GIVEN},
scenarios AS (SELECT given.* EXCLUDE (volume, budget), i, j, {o.double(VOLUMES[0])} + least(i::DOUBLE, {COLUMNS - 0.5}::DOUBLE) * {o.double(_STEP_X)} + {o.double(_STEP_X / 2)} AS volume,
  {o.double(BUDGETS[0])} + j::DOUBLE * {o.double(_STEP_Y)} + {o.double(_STEP_Y / 2)} AS budget FROM given, (SELECT unnest(range({COLUMNS + 1})) AS i), (SELECT unnest(range({ROWS})) AS j)), {o.assigned(N, 'scenarios', 'i, j')}
SELECT s.i, round(s.volume, 6) AS volume, coalesce(min(s.j) FILTER (NOT coalesce(b.accuracy < (SELECT max(accuracy) FROM rows_) - 1e-9, false)), {ROWS}) AS j FROM scenarios s LEFT JOIN best b ON b.i = s.i AND b.j = s.j GROUP BY s.i, s.volume""")
def verdict_map(spark, d):
    """Up to which budget, at each volume, the best routing still falls short of what any budget buys."""
    profile, scenario = q.measured(spark, d), given.as_row(spark)
    most = skyline.frontier(profile, scenario, N).agg(F.max("accuracy")).scalar()
    return q.rounded(skyline.verdict_map(profile, scenario, N, VOLUMES, BUDGETS, lambda: F.col("accuracy") < most - 1e-9, COLUMNS), "volume")


# measured in one pass


@registered(f"WITH {o.MEASURED} SELECT tier_idx, tier, field, round(accuracy, 6) AS accuracy, items FROM profile WHERE tier <> 'human'")
def one_pass_profile(spark, d):
    profile, _ = timing.measured_in_one_pass(table(spark, d, "documents"), timing.ladder_tiers())
    return q.rounded(profile.drop("latency"), "accuracy")


@registered("SELECT tier, n AS items, true AS timed, true AS loaded, true AS in_seconds FROM (SELECT count(*) AS n FROM documents), (SELECT unnest(['rules', 'small', 'large']) AS tier)")
def observed_latency(spark, d):
    """What the clock said, as far as it is the same in every run: that each tier took time on all documents, and that
    the seconds of a routing follow from it."""
    profile, loads = timing.measured_in_one_pass(table(spark, d, "documents"), timing.ladder_tiers())
    by_tier = profile.groupBy("tier").agg(F.sum("items").alias("items"), F.first("latency").alias("latency")).join(loads, "tier", "left")
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("tier_idx"), F.lit(t).alias("t")) for i, t in enumerate(TIERS)))).alias("c")
    whole = by_tier.select("tier", "latency").unionByName(spark.createDataFrame([("human", 0.0)], "tier string, latency double"))
    one_field = whole.select("tier", "latency", cells).where("c.t = tier").select("c.tier_idx", "tier", F.lit(0).alias("field_idx"), F.lit("lang").alias("field"), F.lit(1.0).alias("accuracy"), "latency", F.lit(1).alias("items"))
    seconds = routing.uniform(routing.evaluated(one_field, given.as_row(spark), 1)).select("tier", "seconds")
    rows = by_tier.join(seconds, "tier")
    follows = F.abs(F.col("seconds") - F.col("latency") * given.Assumptions().volume / 1000) < 1e-6 * F.col("seconds")
    return rows.select("tier", "items", (F.col("latency") > 0).alias("timed"), (F.col("ms") >= 0).alias("loaded"), (follows & (F.col("seconds") > 0)).alias("in_seconds"))


# the profile as a document


@registered(f"WITH {o.MEASURED} SELECT tier_idx, tier, field_idx, field, round(accuracy, 6) AS accuracy, items FROM profile WHERE field_idx IS NOT NULL")
def profile_document(spark, d):
    """The measured profile out of the JSON document that was made of it."""
    profile, single = q.measured(spark, d), q.judged(spark, d).withColumn("latency", F.lit(0.0))
    loads = single.select("tier", F.lit(0.0).alias("ms"))
    rows = extraction_rows(parsed(as_document(profile, single, loads, "2026-01-01")), LANGUAGES)
    return q.rounded(rows.drop("latency"), "accuracy")


# reports over the measured profile


@registered(o.advice_sql(o.bands_sql(o.MEASURED, f"judged_ladder AS (SELECT * FROM (WITH {o.JUDGED} SELECT * FROM single)), single AS (SELECT * FROM judged_ladder)", N)))
def measured_advice(spark, d):
    return sensitivity.bands(q.measured(spark, d), q.judged(spark, d), N).select("assumption", sensitivity.advice().alias("advice"))


@registered(f"""WITH {o.MEASURED}, {o.GIVEN}, {o.assigned(N)}, b AS ({' UNION ALL '.join(f'SELECT {i} AS field_idx, t{i} AS best_idx FROM best' for i in range(N))})
SELECT field_idx, field, tier_idx, tier, round(CASE tier WHEN 'human' THEN humanAccuracy ELSE accuracy END, 6) AS accuracy, tier = 'large' AS chosen, tier_idx = best_idx AS optimum FROM profile JOIN b USING (field_idx), given""")
def measured_matrix(spark, d):
    own = spark.createDataFrame([(i, "large") for i in range(N)], "field_idx int, tier string")
    return q.rounded(state.matrix(q.measured(spark, d), given.as_row(spark), own, N).drop("seconds"), "accuracy")


# rules over a table

#: Records that are derived from orders: what each says, and how it is said.
STREETS = ("Elm Street", "High Road", "Mill Lane")


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """id, text and the five fields' truth of a record for each order, written in one of four ways."""
    orders, customers, parts = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "part")
    items = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(items, "o_orderkey").join(parts, "p_partkey")
    k = F.col("o_orderkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    long_date = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), pick(rules.MONTHS, F.month("o_orderdate") - 1), F.year("o_orderdate").cast("string"))
    truth = rows.select(
        k.alias("id"), F.initcap("p_name").alias("name"), F.when(k % 2 == 0, long_date).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("birth"),
        F.concat(F.upper(F.substring("p_name", 1, 2)), F.lit("-"), F.lpad((F.col("o_custkey") % 10_000).cast("string"), 4, "0"), F.lit("-"), F.upper(F.substring("c_mktsegment", 1, 1))).alias("document"),
        pick(rules.COUNTRIES, F.col("c_nationkey")).alias("country"), F.concat((1 + k % 90).cast("string"), F.lit(" "), pick(STREETS, k)).alias("address"),
    )
    said = {
        0: F.format_string("Client: %s, born %s, holds %s of %s, residing at %s.", "name", "birth", "document", "country", "address"),
        1: F.format_string("%s (%s) of %s. Address: %s. Paper %s.", "name", "birth", "country", "address", "document"),
        2: F.format_string("The applicant, %s, came with %s\nfrom %s on %s; they live at %s.", "name", "document", "country", "birth", "address"),
        3: F.format_string("To whom it concerns: %s, number x%sx, %s, of no fixed abode in %s", "name", "document", "birth", "country"),
    }
    return truth.select("id", F.when(F.col("id") % 4 == 0, said[0]).when(F.col("id") % 4 == 1, said[1]).when(F.col("id") % 4 == 2, said[2]).otherwise(said[3]).alias("text"), *FIELDS)


_PICK = lambda values, at: f"{o.listed(values)}[({at}) % {len(values)} + 1]"
ORDER_RECORDS = f"""truths AS (SELECT o_orderkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
  CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) || ' ' || {_PICK(rules.MONTHS, "month(o_orderdate) - 1")} || ' ' || year(o_orderdate) ELSE strftime(o_orderdate, '%d/%m/%Y') END AS birth,
  upper(p_name[1:2]) || '-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || '-' || upper(c_mktsegment[1]) AS document, {_PICK(rules.COUNTRIES, "c_nationkey")} AS country, (1 + o_orderkey % 90) || ' ' || {_PICK(STREETS, "o_orderkey")} AS address
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
records AS (SELECT *, 'all' AS split, CASE id % 4 WHEN 0 THEN 'Client: ' || name || ', born ' || birth || ', holds ' || document || ' of ' || country || ', residing at ' || address || '.'
  WHEN 1 THEN name || ' (' || birth || ') of ' || country || '. Address: ' || address || '. Paper ' || document || '.'
  WHEN 2 THEN 'The applicant, ' || name || ', came with ' || document || chr(10) || 'from ' || country || ' on ' || birth || '; they live at ' || address || '.'
  ELSE 'To whom it concerns: ' || name || ', number x' || document || 'x, ' || birth || ', of no fixed abode in ' || country END AS text FROM truths), {o.EXTRACTED}"""


@registered(f"WITH {ORDER_RECORDS} SELECT id, field_idx, field, expected, got FROM extracted")
def rules_on_orders(spark, d):
    return measure.extraction(order_records(spark, d).withColumn("split", F.lit("all"))).select("id", "field_idx", "field", "expected", "got")


def order_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = measure.extraction(order_records(spark, d).withColumn("split", F.lit("all")))
    return failures.collect(rows.withColumns({"tier_idx": F.lit(0), "tier": F.lit("rules")}))


@registered(f"WITH {ORDER_RECORDS} SELECT field, round(avg({o.CORRECT}::INT), 6) AS accuracy, count(*) AS items FROM extracted GROUP BY ALL")
def rules_accuracy(spark, d):
    rows = measure.extraction(order_records(spark, d).withColumn("split", F.lit("all")))
    right = rules.correct(F.col("got"), F.col("expected")).cast("double")
    return q.rounded(rows.groupBy("field").agg(F.avg(right).alias("accuracy"), F.count("*").alias("items")), "accuracy")


ORDER_FAILED = f"{ORDER_RECORDS}, failed AS (SELECT 'rules' AS tier, field_idx, field, id, expected, got, {o.MODE} AS mode FROM extracted WHERE NOT {o.CORRECT})"


@registered(f"WITH {ORDER_FAILED} SELECT tier, field, mode, count(*) AS n FROM failed GROUP BY ALL ORDER BY n DESC, min(field_idx), min(id) LIMIT 12")
def rules_failures(spark, d):
    return failures.top_shapes(order_failures(spark, d), 12)


# many patterns

LONG_WORD = 9
PATTERNS_SQL = f"""patterns AS (SELECT DISTINCT list, value FROM (SELECT 0 AS list, n_name AS value FROM nation UNION ALL SELECT 1, r_name FROM region UNION ALL SELECT 2, s_name FROM supplier UNION ALL SELECT 3, text FROM benchmark
  UNION ALL SELECT 4, unnest(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: len(w) >= {LONG_WORD})) FROM benchmark) WHERE value <> '')"""


def listed_names(spark: SparkSession, d: str) -> DataFrame:
    benchmark = table(spark, d, "benchmark")
    words = benchmark.select(F.explode(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) >= LONG_WORD)).alias("word"))
    of = lambda name: table(spark, d, name)
    return patterns.numbered([(of("nation"), "n_name", "nation"), (of("region"), "r_name", "region"), (of("supplier"), "s_name", "supplier"), (benchmark, "text", "passage"), (words, "word", "word")])


@registered(f"WITH {PATTERNS_SQL} SELECT doc_id, count(value) AS n, arg_min(value, (list, value)) AS first, arg_max(value, (list, value)) AS last FROM documents LEFT JOIN patterns ON contains(text, value) GROUP BY doc_id")
def names_in_documents(spark, d):
    """Names, passages and long words that whole documents hold: the first and last in the list's order."""
    return patterns.contained(table(spark, d, "documents"), "doc_id", F.col("text"), listed_names(spark, d))


# an update log

KEPT = {"click": (10.0, 90.0), "purchase": (25.0, 75.0), "signup": (0.0, 40.0), "view": (0.0, 100.0)}


@registered(f"""WITH bounds AS {o.values([(k, *b) for k, b in KEPT.items()], 'key, lo, hi')},
l AS (SELECT user_id AS entity, event_id AS seq, event_type AS key, value, lo, hi, lo IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AS ok FROM events LEFT JOIN bounds ON event_type = key),
last AS (SELECT entity, key, seq, least(hi, greatest(lo, value)) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity, key ORDER BY seq DESC, value DESC) AS rn FROM l WHERE ok) WHERE rn = 1)
SELECT entity, key, round(any_value(last.value), 6) AS value, any_value(last.seq) AS seq, count(*) FILTER (ok) AS applied, count(*) FILTER (NOT ok) AS refused FROM l LEFT JOIN last USING (entity, key) GROUP BY entity, key""")
def folded_updates(spark, d):
    """Each user's state after all events, taken as updates of the value named by their type."""
    log = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "value")
    return q.rounded(updates.folded(log, spark.createDataFrame([(k, *b) for k, b in KEPT.items()], "key string, lo double, hi double")), "value")


# totals

STATUSES, PRIORITIES = ["F", "O", "P", "X"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@registered(f"""WITH s AS {o.values([*enumerate([*STATUSES, reports.TOTAL])], 'o_orderstatus_idx, o_orderstatus')}, p AS {o.values([*enumerate([*PRIORITIES, reports.TOTAL])], 'o_orderpriority_idx, o_orderpriority')},
c AS (SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'total' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'total' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS dear
  FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority))
SELECT s.*, p.*, coalesce(n, 0) AS n, coalesce(dear, 0) AS dear FROM s CROSS JOIN p LEFT JOIN c ON c.o_orderstatus = s.o_orderstatus AND c.o_orderpriority = p.o_orderpriority WHERE s.o_orderstatus <> 'total' OR p.o_orderpriority = 'total'""")
def order_totals(spark, d):
    return reports.rolled_up(table(spark, d, "orders"), {"o_orderstatus": STATUSES, "o_orderpriority": PRIORITIES}, n=F.count("*"), dear=F.count_if(F.col("o_totalprice") > 200_000))


# leaks between splits

SHAPE = r"regexp_replace(text, '[A-Z][a-zà-ÿ]+|\d+', '·', 'g')"


@registered(f"""SELECT 'text' AS kind, doc_id FROM documents WHERE doc_id % 2 = 1 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)
UNION ALL SELECT 'shape', doc_id FROM documents WHERE doc_id % 2 = 1 AND {SHAPE} IN (SELECT {SHAPE} FROM documents WHERE doc_id % 2 = 0)""")
def leaked_documents(spark, d):
    """The held-out documents whose text, or shape, training documents have too."""
    rows = table(spark, d, "documents").withColumn("split", measure.split_of("doc_id"))
    heldout, training = rows.where("split = 'heldout'"), rows.where("split = 'training'")
    of = lambda kind, c: leaks.leaked(heldout, training, "doc_id", c).select(F.lit(kind).alias("kind"), "doc_id")
    return of("text", F.col("text")).unionByName(of("shape", rules.text_shape(F.col("text"))))


# stale parts

NEXT = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN month(o_orderdate) = 6 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE date_trunc('month', o_orderdate) < (SELECT max(date_trunc('month', o_orderdate)) FROM orders)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate - INTERVAL 30 YEAR, o_orderpriority FROM orders WHERE month(o_orderdate) = 2"""


@registered(f"""WITH next AS ({NEXT}), parts AS (SELECT v, date_trunc('month', o_orderdate)::TIMESTAMP AS part, md5(string_agg((o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)::VARCHAR, ',' ORDER BY o_orderkey, o_custkey)) AS h
  FROM (SELECT 'was' AS v, * FROM orders UNION ALL SELECT 'is', * FROM next) GROUP BY ALL)
SELECT coalesce(a.part, b.part) AS part, CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM parts WHERE v = 'was') a FULL JOIN (SELECT * FROM parts WHERE v = 'is') b ON a.part = b.part WHERE a.h IS DISTINCT FROM b.h""")
def stale_months(spark, d):
    """The months of orders that a later version of the table has changed, added or removed."""
    orders = table(spark, d, "orders")
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")
    last = orders.agg(F.max(F.date_trunc("month", "o_orderdate"))).scalar()
    june = F.when(F.month("o_orderdate") == 6, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    later = orders.where(F.date_trunc("month", "o_orderdate") < last).withColumn("o_totalprice", june)
    earlier = orders.where(F.month("o_orderdate") == 2).withColumn("o_orderdate", F.col("o_orderdate") - F.expr("INTERVAL 30 YEAR"))
    return manifest.stale_parts(manifest.manifest(orders, month), manifest.manifest(later.unionByName(earlier), month))


# a scale by roots, and the extraction block over the measured profile


@registered(f"WITH {q.EXTENT} SELECT o_orderkey, round(sqrt(greatest(0, least(1, (o_totalprice - low) / (high - low)))), 6) AS place FROM orders, extent")
def root_places(spark, d):
    orders = table(spark, d, "orders")
    ends = charts.extent(orders, "o_totalprice").select(F.struct("low", "high")).scalar()
    rows = orders.withColumn("ends", ends)
    return q.rounded(rows.select("o_orderkey", charts.scaled(F.col("o_totalprice"), F.col("ends.low"), F.col("ends.high"), root=True).alias("place")), "place")


@registered(f"WITH {o.MEASURED} SELECT tier_idx, tier, {', '.join(f'round(max(accuracy) FILTER (field = {o.quoted(x)}), 6) AS {x}' for x in LANGUAGES)}, 0::DOUBLE AS mean_latency FROM profile WHERE tier <> 'human' GROUP BY ALL")
def measured_block(spark, d):
    return q.rounded(state.extraction_block(q.measured(spark, d), LANGUAGES), *LANGUAGES)


# classes by keyword, and an inventory of tables


@registered(f"SELECT got, count(*) AS n, sum(len(narrative))::BIGINT AS chars FROM (SELECT narrative, {o.KEYWORD} AS got FROM (SELECT replace(coalesce(text, ''), 'The ', 'Notes of the ') AS narrative FROM conversations)) GROUP BY 1")
def keyword_turns(spark, d):
    """The keyword classes of all turns, after a change of words that brings one of the keywords in."""
    turns = table(spark, d, "conversations").select(F.replace(F.coalesce("text", F.lit("")), F.lit("The "), F.lit("Notes of the ")).alias("narrative"))
    return turns.select("narrative", rules.keyword_class(F.col("narrative")).alias("got")).groupBy("got").agg(F.count("*").alias("n"), F.sum(F.length("narrative")).alias("chars"))


def table_sections(spark: SparkSession, d: str) -> DataFrame:
    """Three sections of names: suppliers are measured, segments assumed, types of parts chosen."""
    of = lambda name, column, what: table(spark, d, name).groupBy(F.col(column).alias("name")).agg(F.concat(F.lit(f"{what}: "), F.count("*").cast("string")).alias("what"))
    return inventory.union({"measured": of("supplier", "s_name", "rows"), "assumed": of("customer", "c_mktsegment", "customers"), "chosen": of("part", "p_type", "parts")})


SECTIONS = """sections AS (SELECT 'measured' AS provenance, s_name AS name, 'rows: ' || count(*) AS what FROM supplier GROUP BY ALL UNION ALL SELECT 'assumed', c_mktsegment, 'customers: ' || count(*) FROM customer GROUP BY ALL
UNION ALL SELECT 'chosen', p_type, 'parts: ' || count(*) FROM part GROUP BY ALL)"""


@registered(f"WITH {SECTIONS}, {o.KINDS} SELECT kind_idx, provenance, coalesce(n, 0) AS n FROM kinds LEFT JOIN (SELECT provenance, count(*) AS n FROM sections GROUP BY 1) USING (provenance)")
def section_counts(spark, d):
    return inventory.counts(table_sections(spark, d))


@registered(f"WITH {SECTIONS}, {o.KINDS} SELECT kind_idx, row_number() OVER (PARTITION BY provenance ORDER BY name) - 1 AS seq, provenance, name, what FROM sections JOIN kinds USING (provenance)")
def section_list(spark, d):
    return inventory.listed(table_sections(spark, d))


# numbers and reports as they are written

_GROUPED = "format('{:,}', floor(c_acctbal + 0.5::DOUBLE)::BIGINT)"


@registered(f"""SELECT c_custkey, {_GROUPED} AS grouped, '$' || {_GROUPED} AS dollars, printf('%.1f %%', floor(c_acctbal / 10000 * 100 * 10 + 0.5::DOUBLE) / 10) AS percent, printf('%.0f %%', floor(c_acctbal / 10000 * 100 + 0.5::DOUBLE)) AS short,
  replace(replace(replace(replace('<' || c_name || ' & "' || c_mktsegment || '">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM customer""")
def written_customers(spark, d):
    x, share = F.col("c_acctbal"), F.col("c_acctbal") / 10_000
    name = F.concat(F.lit("<"), "c_name", F.lit(' & "'), "c_mktsegment", F.lit('">'))
    return table(spark, d, "customer").select("c_custkey", rules.grouped(x).alias("grouped"), rules.dollars(x).alias("dollars"), rules.percent(share).alias("percent"), rules.percent(share, 0).alias("short"), rules.escaped(name).alias("escaped"))


_CELL = lambda x: f"lpad(lpad(printf('%.1f', floor(max(accuracy) FILTER (field = {o.quoted(x)}) * 100 * 10 + 0.5::DOUBLE) / 10) || ' %', 7, ' '), 10, ' ')"


@registered(f"""WITH {o.MEASURED} SELECT 0 AS line_no, {o.quoted('tier      ' + ''.join(x.rjust(10) for x in LANGUAGES) + '     latency')} AS line UNION ALL SELECT 1, {o.quoted('─' * 76)}
UNION ALL SELECT tier_idx + 2, rpad(tier, 10, ' ') || {' || '.join(map(_CELL, LANGUAGES))} || '   ' || lpad('0.00', 7, ' ') || ' ms' FROM profile WHERE tier <> 'human' GROUP BY tier_idx, tier""")
def console_report(spark, d):
    return state.console_lines(q.measured(spark, d), LANGUAGES)


@registered(f"""WITH {o.MEASURED}, {o.GIVEN}, {o.assigned(N)},
uniform_rows AS (SELECT {o.listed(TIERS)}[t0 + 1] AS tier, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost, t0 FROM rows_ WHERE {' AND '.join(f't0 = t{i}' for i in range(1, N))}),
price_rows AS (SELECT generate_subscripts({o.PRICES}, 1) - 1 AS tier_idx, round(unnest({o.PRICES}), 6) AS price FROM given)
SELECT 'uniform' AS part, to_json(list({{'tier': tier, 'accuracy': accuracy, 'cost': cost}} ORDER BY cost, tier))::VARCHAR AS body FROM uniform_rows
UNION ALL SELECT 'optimum', to_json(list({{'routing': {o.tier_names(N)}, 'accuracy': round(accuracy, 6), 'cost': round(cost, 6)}}))::VARCHAR FROM best
UNION ALL SELECT 'prices', to_json(list({{'tier_idx': tier_idx, 'price': price}} ORDER BY tier_idx))::VARCHAR FROM price_rows""")
def state_json(spark, d):
    """The state over the measured profile as a screen gets it."""
    own = spark.createDataFrame([(i, "large") for i in range(N)], "field_idx int, tier string")
    found = state.state(q.measured(spark, d), given.as_row(spark), own, LANGUAGES)
    best = found["optimum"].select(F.array_join(routing.names(F.col("tiers")), ",").alias("routing"), "accuracy", "cost")
    uniform = q.rounded(found["uniform"].select("tier", "accuracy", "cost"), "accuracy", "cost")
    return state.as_json({"uniform": (uniform, ["cost", "tier"]), "optimum": (q.rounded(best, "accuracy", "cost"), ["routing"]), "prices": (q.rounded(found["prices"], "price"), ["tier_idx"])})
