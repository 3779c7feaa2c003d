"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from dataclasses import asdict

from tierwright.functions import text
from tierwright.functions.assumptions import BOUNDS, PLAUSIBLE, Assumptions
from tierwright.operators import inventory, measure, sensitivity
from tierwright.sources import corpus
from tierwright.sources.tables import FIELDS, FROZEN_CLASSIFICATION, FROZEN_EXTRACTION, FROZEN_ITEMS, LANGUAGES, TIERS


def quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def double(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def values(rows, columns: str) -> str:
    cell = lambda v: double(v) if isinstance(v, float) else str(v) if isinstance(v, int) else quoted(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns}))"


def listed(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def language_hits(number: int) -> list[str]:
    return [f"len(list_filter(w, lambda x: x IN ({', '.join(map(quoted, measure.STOP_WORDS[lang][:number]))})))" for lang in LANGUAGES]


def most_hits(number: int) -> str:
    hits = language_hits(number)
    top = f"greatest({', '.join(hits)})"
    return f"CASE WHEN {top} = 0 THEN '' " + " ".join(f"WHEN {h} = {top} THEN {quoted(lang)}" for lang, h in zip(LANGUAGES, hits)) + " ELSE '' END"


LADDER = f"""
words AS (SELECT doc_id, lang AS truth, string_split_regex(lower(coalesce(text, '')), '[^a-zà-ÿ]+') AS w FROM documents),
ladder AS (SELECT doc_id, truth,
  CASE {" ".join(f"WHEN list_contains(w, {quoted(measure.STOP_WORDS[x][0])}) THEN {quoted(x)}" for x in LANGUAGES)} ELSE '' END AS rules,
  {most_hits(2)} AS small, {most_hits(5)} AS large FROM words)"""

QUALITY = f"""
ladder AS (SELECT d.doc_id, quality AS truth, (NOT regexp_matches(t, '{measure.JUNK}'))::INT AS rules,
  (NOT (len(t) - len(regexp_replace(t, '[*#%&$]', '', 'g'))) / greatest(len(t), 1)::DOUBLE > {measure.SMALL_SHARE})::INT AS small,
  (NOT (len(t) - len(regexp_replace(t, '[*#%&$|!]', '', 'g'))) / greatest(len(t), 1)::DOUBLE > {measure.LARGE_SHARE})::INT AS large
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d JOIN labels USING (doc_id))"""

LONG = "long AS (" + " UNION ALL ".join(f"SELECT doc_id, truth, {i} AS tier_idx, '{t}' AS tier, {'truth' if t == 'human' else t} AS got FROM ladder" for i, t in enumerate(TIERS)) + ")"
FIELD_IDX = "CASE truth " + " ".join(f"WHEN {quoted(x)} THEN {i}" for i, x in enumerate(LANGUAGES)) + " END"
PROFILE = f"profile AS (SELECT tier_idx, tier, {FIELD_IDX} AS field_idx, truth AS field, sum((got = truth)::INT)::DOUBLE / count(*) AS accuracy, count(*) AS items FROM long GROUP BY ALL)"
SINGLE = "single AS (SELECT tier_idx, tier, sum((got = truth)::INT)::DOUBLE / count(*) AS accuracy, count(*) AS items FROM long GROUP BY ALL)"
MEASURED = f"{LADDER}, {LONG}, {PROFILE}"
JUDGED = f"{QUALITY}, {LONG}, {SINGLE}"

FROZEN = "profile AS " + values([(i, t, j, f, FROZEN_EXTRACTION[t][f][0], FROZEN_EXTRACTION[t][f][1], FROZEN_ITEMS) for i, t in enumerate(TIERS) for j, f in enumerate(FIELDS)], "tier_idx, tier, field_idx, field, accuracy, latency, items")
FROZEN_SINGLE = "single AS " + values([(i, t, *FROZEN_CLASSIFICATION[t], FROZEN_ITEMS) for i, t in enumerate(TIERS)], "tier_idx, tier, accuracy, latency, items")

DEFAULT = asdict(Assumptions())
GIVEN = "given AS (SELECT " + ", ".join(f"{double(v)} AS {k}" for k, v in DEFAULT.items()) + ")"
PRICES = "[0::DOUBLE, pricePerThousandSmall, pricePerThousandLarge, (humanSeconds / 3600::DOUBLE) * (analystAnnualCost / (productiveHoursPerDay * workingDaysPerYear)) * 1000::DOUBLE]"


def assigned(n: int, scenarios: str = "given", keys: str = "") -> str:
    """``rows``: every assignment under every scenario; ``best``: the best affordable one of each."""
    t = [f"((ord // {4 ** (n - 1 - i)}) % 4)" for i in range(n)]
    acc = "0::DOUBLE"
    cost = "0::DOUBLE"
    for i in range(n):
        acc = f"({acc} + CASE WHEN {t[i]} = 3 THEN humanAccuracy ELSE cells[{i * 4} + {t[i]} + 1] END)"
        cost = f"({cost} + volume / 1000::DOUBLE * prices[{t[i]} + 1])"
    key = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
cell AS (SELECT list(accuracy ORDER BY field_idx, tier_idx) AS cells FROM profile),
priced AS (SELECT *, {PRICES} AS prices FROM {scenarios}),
rows_ AS (SELECT {key}budget, ord, {acc} / {n} AS accuracy, {cost} AS cost, {", ".join(f"{x} AS t{i}" for i, x in enumerate(t))}
  FROM priced, cell, (SELECT unnest(range({4**n})) AS ord)),
best AS (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY accuracy DESC, cost, ord) AS rn FROM rows_ WHERE cost <= budget) WHERE rn = 1)"""


def tier_names(n: int, prefix: str = "t") -> str:
    return " || ',' || ".join(f"{listed(TIERS)}[{prefix}{i} + 1]" for i in range(n))


def routing_sql(profile: str, n: int) -> str:
    cells = " UNION ALL ".join(f"SELECT {i} AS field_idx, t{i} AS tier_idx FROM best" for i in range(n))
    return f"""WITH {profile}, {GIVEN}, {assigned(n)},
chosen AS ({cells}),
fields AS (SELECT field_idx, field, tier, CASE tier_idx WHEN 3 THEN humanAccuracy ELSE p.accuracy END AS accuracy, volume / 1000::DOUBLE * prices[tier_idx + 1] AS cost
  FROM chosen JOIN profile p USING (field_idx, tier_idx), priced)
SELECT field_idx, field, tier, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost FROM fields
UNION ALL SELECT {n}, 'total', '', round(avg(accuracy), 6), round(sum(cost), 6) FROM fields"""


def shadow_sql(profile: str, n: int) -> str:
    return f"""WITH {profile}, {GIVEN}, {assigned(n)},
needed AS (SELECT min(r.cost) AS c FROM rows_ r, best b WHERE r.accuracy > b.accuracy + 1e-9),
step AS (SELECT * FROM rows_ WHERE cost <= (SELECT c FROM needed) ORDER BY accuracy DESC, cost, ord LIMIT 1)
SELECT b.budget AS current_budget, round(b.accuracy, 6) AS current_accuracy, round(b.cost, 6) AS current_cost, b.cost / b.budget > 0.98 AS constraint_binds,
  round(s.cost, 6) AS budget_needed, round(s.cost - b.cost, 6) AS extra, round((s.accuracy - b.accuracy) * 100, 6) AS gain_points,
  round((s.accuracy - b.accuracy) * 100 / ((s.cost - b.cost) / 1000), 6) AS points_per_thousand,
  {tier_names(n, "b.t")} AS routing, {tier_names(n, "s.t")} AS step_routing
FROM best b LEFT JOIN step s ON true"""


def changed_sql(profile: str, fields) -> str:
    n = len(fields)
    each = " UNION ALL ".join(f"SELECT {quoted(f)} AS field, {listed(TIERS)}[b.t{i} + 1] AS before, {listed(TIERS)}[s.t{i} + 1] AS after FROM best b, step s" for i, f in enumerate(fields))
    return f"""WITH {profile}, {GIVEN}, {assigned(n)},
needed AS (SELECT min(r.cost) AS c FROM rows_ r, best b WHERE r.accuracy > b.accuracy + 1e-9),
step AS (SELECT * FROM rows_ WHERE cost <= (SELECT c FROM needed) ORDER BY accuracy DESC, cost, ord LIMIT 1)
SELECT * FROM ({each}) WHERE before <> after"""


def frontier_sql(profile: str, n: int, budgets) -> str:
    return f"""WITH {profile}, {GIVEN},
asked AS {values([(float(b),) for b in budgets], "b")},
scenarios AS (SELECT given.* EXCLUDE (budget), b AS budget FROM given, asked), {assigned(n, "scenarios", "budget").replace("SELECT budget, budget, ord", "SELECT budget, ord")}
SELECT a.b AS budget, {tier_names(n)} AS routing, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost,
  coalesce(accuracy >= lag(accuracy) OVER (ORDER BY a.b), true) AS monotone
FROM asked a LEFT JOIN best ON best.budget = a.b"""


def uniform_sql(profile: str, n: int, tail: str = "") -> str:
    same = " AND ".join(f"t0 = t{i}" for i in range(1, n))
    return f"""WITH {profile}, {GIVEN}, {assigned(n)}
SELECT {listed(TIERS)}[t0 + 1] AS tier, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost FROM rows_ WHERE {same} {tail}"""


SINGLE_CHOICE = f"""{GIVEN}, priced AS (SELECT *, {PRICES} AS prices FROM given),
options AS (SELECT tier_idx, tier, CASE tier_idx WHEN 3 THEN humanAccuracy ELSE accuracy END AS accuracy, volume / 1000::DOUBLE * prices[tier_idx + 1] AS cost, budget FROM single, priced)
SELECT tier_idx, tier, round(accuracy, 6) AS accuracy, round(cost, 6) AS cost, cost <= budget AS affordable,
  cost <= budget AND row_number() OVER (ORDER BY cost <= budget DESC, accuracy DESC, cost, tier_idx) = 1 AS chosen FROM options"""


def bands_sql(profile: str, single: str, n: int) -> str:
    steps = sensitivity.STEPS
    ranges = values([(k, lo, hi, DEFAULT[k], sensitivity.beyond(k, DEFAULT[k])) for k, (lo, hi) in PLAUSIBLE.items()], "key, lo, hi, now_, push")
    columns = ", ".join(f"CASE WHEN key = {quoted(k)} THEN value ELSE {double(v)} END AS {k}" for k, v in DEFAULT.items())
    return f"""WITH {profile}, {single},
ranges AS {ranges},
walk AS (SELECT key, d AS direction, s AS step, now_ + (CASE d WHEN 1 THEN hi ELSE lo END - now_) * s / {steps} AS value
  FROM ranges, (SELECT unnest([-1, 1]) AS d), (SELECT unnest(range(1, {steps + 1})) AS s)
  UNION ALL SELECT key, 0, 0, push FROM ranges UNION ALL SELECT '', 0, 0, 0),
scenarios AS (SELECT key, direction, step, {columns} FROM walk), {assigned(n, "scenarios", "key, direction, step")},
options AS (SELECT key, direction, step, tier_idx, tier, CASE tier_idx WHEN 3 THEN humanAccuracy ELSE accuracy END AS a, volume / 1000::DOUBLE * prices[tier_idx + 1] AS c, budget FROM priced, single),
one AS (SELECT key, direction, step, tier FROM (SELECT *, row_number() OVER (PARTITION BY key, direction, step ORDER BY a DESC, c, tier_idx) AS rn FROM options WHERE c <= budget) WHERE rn = 1),
signed AS (SELECT s.key, s.direction, s.step, CASE WHEN b.ord IS NULL THEN 'none' ELSE {tier_names(n)} || '|' || coalesce(one.tier, 'none') END AS signature
  FROM scenarios s LEFT JOIN best b USING (key, direction, step) LEFT JOIN one USING (key, direction, step)),
moved AS (SELECT key, min(step) FILTER (direction = -1 AND m) AS down, min(step) FILTER (direction = 1 AND m) AS up, bool_or(m) FILTER (direction = 0) AS pushed
  FROM (SELECT *, signature <> (SELECT signature FROM signed WHERE key = '') AS m FROM signed WHERE key <> '') GROUP BY key),
edges AS (SELECT key, lo, hi, now_, pushed, CASE WHEN down IS NULL THEN lo ELSE now_ + (lo - now_) * (down - 1) / {steps} END AS a, CASE WHEN up IS NULL THEN hi ELSE now_ + (hi - now_) * (up - 1) / {steps} END AS b
  FROM ranges JOIN moved USING (key))
SELECT key AS assumption, lo, hi, now_ AS current, round(a, 6) AS stable_from, round(b, 6) AS stable_to, true AS current_inside, a > lo + 1e-9 OR b < hi - 1e-9 AS decides,
  CASE WHEN a > lo + 1e-9 OR b < hi - 1e-9 THEN 'affects the answer' WHEN pushed THEN 'tier priced out' ELSE 'genuinely insensitive' END AS reason FROM edges"""


def advice_sql(bands: str) -> str:
    shown = lambda c: f"floor({c} * 100 + 0.5::DOUBLE) / 100"
    return f"""SELECT assumption, CASE reason WHEN 'tier priced out' THEN 'no effect while the tier it governs is out of the budget; measure it before the budget rises or the volume falls'
WHEN 'genuinely insensitive' THEN printf('decides nothing from %.2f to %.2f; not worth measuring here', {shown("lo")}, {shown("hi")})
ELSE printf('decides the routing outside %.2f to %.2f; worth measuring', {shown("stable_from")}, {shown("stable_to")}) END AS advice FROM ({bands})"""


def wilson(k: str, n: str) -> tuple[str, str]:
    k, n, z = f"({k})::DOUBLE", f"({n})::DOUBLE", "1.96::DOUBLE"
    p, scale = f"({k} / {n})", f"(1 + {z} * {z} / {n})"
    centre, spread = f"(({p} + {z} * {z} / (2 * {n})) / {scale})", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / {scale})"
    return f"CASE WHEN {n} > 0 THEN greatest(0, {centre} - {spread}) ELSE 0 END", f"CASE WHEN {n} > 0 THEN least(1, {centre} + {spread}) ELSE 1 END"


def rate(k: str, n: str) -> str:
    low, high = wilson(k, n)
    return f"""{k} AS successes, {n} AS n, round(CASE WHEN {n} = 0 THEN 0 ELSE ({k})::DOUBLE / {n} END, 6) AS rate, round({low}, 6) AS low, round({high}, 6) AS high,
  round((({high}) - ({low})) / 2 * 100, 6) AS precision, {n} >= 20 AS reportable"""


VERDICT = """CASE WHEN abs(m - b) < 1.96 * sqrt(m * (1 - m) / n + b * (1 - b) / n) THEN 'indistinguishable' WHEN m > b THEN 'beats' ELSE 'loses' END"""


def draws(seed: int, n: int) -> str:
    return f"""lcg(n, s) AS (SELECT 0::BIGINT, {seed}::BIGINT UNION ALL SELECT n + 1, (s * {corpus.MULTIPLIER} + {corpus.INCREMENT}) % {corpus.MODULUS} FROM lcg WHERE n < {n})"""


def records_cte(split: str, n: int = 120) -> str:
    seed = corpus.seed_of(corpus.RECORD_SEED, split)
    d = ", ".join(f"max(s) FILTER ((n - 1) % {corpus.DRAWS} = {k - 1}) AS d{k}" for k in range(1, corpus.DRAWS + 1))
    at = lambda k, n: f"floor(d{k}::DOUBLE / {corpus.MODULUS}::DOUBLE * {n})::INT"
    pick = lambda k, items: f"{listed(items)}[{at(k, len(items))} + 1]"
    shapes = corpus.HELDOUT if split == "heldout" else corpus.TRAINING
    text_ = pick(15, shapes)
    for hole in (*FIELDS, "birthCity"):
        text_ = f"replace({text_}, '{{{hole}}}', {hole})"
    return f"""{draws(seed, n * corpus.DRAWS).replace("lcg", f"lcg_{split}")},
draws_{split} AS (SELECT (n - 1) // {corpus.DRAWS} AS i, {d} FROM lcg_{split} WHERE n > 0 GROUP BY 1),
truth_{split} AS (SELECT *, {pick(1, corpus.FIRST_NAMES)} || ' ' || {pick(2, corpus.SURNAMES)} AS name,
  CASE WHEN d5 < {corpus.MODULUS // 2} THEN (1 + {at(3, 28)}) || ' ' || {pick(6, corpus.MONTHS)} || ' ' || (1955 + {at(4, 50)})
       ELSE lpad((1 + {at(3, 28)})::VARCHAR, 2, '0') || '/' || lpad((1 + {at(6, 12)})::VARCHAR, 2, '0') || '/' || (1955 + {at(4, 50)}) END AS birth,
  {pick(7, corpus.PREFIXES)} || '-' || (1000 + {at(8, 9000)}) || '-' || {pick(9, corpus.SUFFIXES)} AS document, {pick(10, corpus.COUNTRIES)} AS country,
  (1 + {at(11, 200)}) || ' ' || {pick(12, corpus.STREETS)} || ', ' || {pick(13, corpus.CITIES)} AS address, {pick(14, corpus.CITIES)} AS birthCity FROM draws_{split}),
records_{split} AS (SELECT 'D-' || lpad((i + 1)::VARCHAR, 4, '0') AS id, '{split}' AS split, {text_} AS text, name, birth, document, country, address FROM truth_{split})"""


BOTH = f"{records_cte('training')}, {records_cte('heldout')}, records AS (SELECT * FROM records_training UNION ALL SELECT * FROM records_heldout)"

_OR = lambda *xs: "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"
RULES = {
    "name": _OR(f"regexp_extract(text, {quoted(text.NAME_AFTER)}, 1)", f"regexp_extract(text, {quoted(text.NAME_FIRST)}, 1)"),
    "birth": _OR(rf"regexp_extract(text, {quoted(rf'\b{text.LONG_DATE}\b')}, 0)", rf"regexp_extract(text, {quoted(rf'\b{text.SHORT_DATE}\b')}, 0)"),
    "document": f"regexp_extract(text, {quoted(rf'\b{text.DOCUMENT}\b')}, 0)",
    "country": f"coalesce(list_filter({listed(text.COUNTRIES)}, lambda c: contains(text, c))[-1], '')",
    "address": f"trim(regexp_extract(text, {quoted(text.ADDRESS)}, 1))",
}
EXTRACTED = "extracted AS (" + " UNION ALL ".join(f"SELECT id, split, text, {i} AS field_idx, '{f}' AS field, {f} AS expected, {RULES[f]} AS got FROM records" for i, f in enumerate(FIELDS)) + ")"
NORMAL = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s*([/\-.,;:])\s*', '\1', 'g'), '[.,;:]+$', ''), '\s+', ' ', 'g'))"
CORRECT = f"({NORMAL('got')} = {NORMAL('expected')} AND len({NORMAL('got')}) > 0)"
MODE = r"""CASE WHEN trim(got) = '' THEN 'empty' WHEN contains(lower(trim(expected)), lower(trim(got))) THEN 'fragment' WHEN contains(lower(trim(got)), lower(trim(expected))) THEN 'over-long'
  WHEN len(list_filter(string_split_regex(lower(trim(got)), '\s+'), lambda w: len(w) > 3 AND NOT contains(lower(trim(expected)), w))) > 0 THEN 'wrong span' ELSE 'other' END"""
FAILED = f"""failed AS (SELECT 0 AS tier_idx, 'rules' AS tier, field_idx, field, id, substr(replace(text, chr(10), ' ⏎ '), 1, 120) AS text, expected, got, {MODE} AS mode FROM extracted WHERE split = 'heldout' AND NOT {CORRECT})"""


def alerts_sql(split: str, n: int = 120) -> str:
    pool = corpus.NARRATIVES_HELDOUT if split == "heldout" else corpus.NARRATIVES
    step = lambda s: f"(({s} * {corpus.MULTIPLIER} + {corpus.INCREMENT}) % {corpus.MODULUS})"
    u = lambda s, k: f"floor({s}::DOUBLE / {corpus.MODULUS}::DOUBLE * {k})::INT"
    spans, lows = "[" + ", ".join(str(x[3]) for x in pool) + "]", "[" + ", ".join(str(x[2]) for x in pool) + "]"
    s1, s2, s3 = step("s"), step(step("s")), step(step(step("s")))
    t = f"({u(s1, 5)} * 3 + {u(s2, 3)})"
    return f"""WITH RECURSIVE a(i, s) AS (SELECT 0, {corpus.seed_of(corpus.ALERT_SEED, split)}::BIGINT
  UNION ALL SELECT i + 1, CASE WHEN {spans}[{t} + 1] > 0 THEN {s3} ELSE {s2} END FROM a WHERE i < {n - 1}),
alerts AS (SELECT 'A-' || lpad((i + 1)::VARCHAR, 4, '0') AS id, replace({listed(x[1] for x in pool)}[{t} + 1], '{{}}', ({lows}[{t} + 1] + floor({s3}::DOUBLE / {corpus.MODULUS}::DOUBLE * {spans}[{t} + 1])::INT)::VARCHAR) AS narrative,
  {listed(text.TYPOLOGIES)}[{u(s1, 5)} + 1] AS truth FROM a)"""


KEYWORD = "CASE " + " ".join(f"WHEN regexp_matches(narrative, {quoted(rf'(?i)\b(?:{text.KEYWORDS[k]})\b')}) THEN {quoted(k)}" for k in text.TYPOLOGIES) + " ELSE '' END"

CENTRES = """
places AS (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings WHERE vec_id % 2 = 0) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM places GROUP BY label),
centres AS (SELECT label AS name, list(x / norm ORDER BY place) AS centre FROM places JOIN norms USING (label) GROUP BY label)"""
ALL_CENTRES = """
places AS (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM places GROUP BY label),
centres AS (SELECT label AS name, list(x / norm ORDER BY place) AS centre FROM places JOIN norms USING (label) GROUP BY label)"""
SPLIT_CENTRES = """
places AS (SELECT split, label, place, avg(x) AS x FROM (SELECT CASE vec_id % 2 WHEN 0 THEN 'training' ELSE 'heldout' END AS split, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL),
norms AS (SELECT split, label, sqrt(sum(x * x)) AS norm FROM places GROUP BY ALL),
centres AS (SELECT split, label AS name, list(x / norm ORDER BY place) AS centre FROM places JOIN norms USING (split, label) GROUP BY ALL)"""
CLASSED = f"""{CENTRES},
scores AS (SELECT vec_id, CASE vec_id % 2 WHEN 0 THEN 'training' ELSE 'heldout' END AS split, label, name, list_dot_product(embedding::DOUBLE[], centre) AS s FROM embeddings, centres),
classed AS (SELECT vec_id, split, label, name AS got FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS rn FROM scores) WHERE rn = 1)"""

BY_TYPE = f"by_type AS (SELECT event_type, {rate('k', 'm')} FROM (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS m FROM events GROUP BY 1))"
INVENTORY = "inventory AS " + values(
    [(i, n, k, w) for i, (n, k, w) in enumerate([*((n, "measured", w) for n, w in inventory.MEASURED), *((k, "assumed", "an assumption of the scenario") for k in DEFAULT), *((n, "chosen", w) for n, w in inventory.CHOSEN)])], "seq, name, provenance, what"
)
KINDS = "kinds AS " + values([*enumerate(inventory.KINDS)], "kind_idx, provenance")
BOUNDS_SQL = "bounds AS " + values([(k, *b) for k, b in BOUNDS.items()], "key, lo, hi")
