"""The labelled corpora, generated in parallel from a linear congruential generator.

A record takes a fixed number of draws, so each row jumps to its own place in the sequence: n steps of s -> a s + c are
one affine map, made of the maps for powers of two. Alerts take one draw more or less by template, so their states
are folded in order; only the states, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwright.functions.text import COUNTRIES, MONTHS

# Generator, seeds, pools and templates of the corpora.
MULTIPLIER, INCREMENT, MODULUS = 1_664_525, 1_013_904_223, 4_294_967_296
RECORD_SEED, ALERT_SEED, HELDOUT_SHIFT = 20260817, 20260818, 7717
DRAWS = 15
FIRST_NAMES = ("Amina", "Viktor", "Sofia", "Marcus", "Leila", "Tomas", "Nadia", "Piotr", "Ines", "Karim")
SURNAMES = ("Haddad", "Morozov", "Vasquez", "Lindqvist", "Okonkwo", "Novak", "Ferreira", "Mbeki", "Rossi", "Chen")
CITIES = ("Paris", "Lyon", "Athens", "Lisbon", "Warsaw", "Milan", "Rotterdam", "Valencia")
STREETS = ("rue Victor Hugo", "avenue des Fleurs", "Odos Ermou", "Rua da Prata", "ulica Nowy Świat", "via Garibaldi")
PREFIXES, SUFFIXES = ("FR", "GR", "PT", "PL", "IT"), ("K", "M", "T", "X")
TRAINING = (
    "Client: {name}, born {birth} in {birthCity}, residing at {address}. Identity document {document}, issued in {country}.",
    "Onboarding file — name {name} / DOB {birth} / ID {document} / nationality {country}. Correspondence address: {address}.",
    "The applicant, {name}, was born on {birth}. They hold document number {document} delivered by the authorities of {country} and live at {address}.",
    "{name} ({country}), d.o.b. {birth}. Address on file: {address}. Document reference {document}.",
    "Received today: an application from {name}. Date of birth is {birth} and the identity document presented carries the number {document}. Nationality: {country}. The declared address is {address}.",
)
HELDOUT = (
    "{name} — dob {birth} — doc no {document} — {country} — lives {address} (updated by branch staff, no further checks)",
    "Further to our call: the person concerned is {name}. We hold {document} on file. Born {birth}. Their postal address reads {address} and they present themselves as a national of {country}.",
    "KYC REVIEW\nSubject ......... {name}\nBirth ........... {birth}\nDocument ........ {document}\nCitizenship ..... {country}\nPostal .......... {address}",
    "Application received from {name} of {address}; the identity reference supplied was {document} and the stated country {country}. Birth date given as {birth}.",
    "re {name} / {country} — address {address} — id{document} — born {birth} — file opened pending review",
)
#: (typology, template with at most one hole, least value of the hole, number of values; 0 without a hole).
NARRATIVES = (
    ("fractionnement", "Eleven cash deposits of between 8,400 and 9,600 booked over {} days across three branches, each below the declaration ceiling.", 4, 6),
    ("fractionnement", "A sequence of transfers just under the reporting limit, repeated on consecutive mornings from the same terminal.", 0, 0),
    ("fractionnement", "Account received {} payments in one week, none individually notable, together exceeding the annual declared income.", 6, 8),
    ("mouvement rapide", "Funds credited in the morning and fully transferred out to a third party before close of business, leaving a nil balance.", 0, 0),
    ("mouvement rapide", "{} incoming wires cleared and forwarded within two hours, with no economic purpose stated.", 3, 5),
    ("mouvement rapide", "Balance rose and returned to zero on the same day, three times this month.", 0, 0),
    ("lien sanctions", "The beneficiary name returned a partial match against a designated persons list, with a differing middle name.", 0, 0),
    ("lien sanctions", "Counterparty bank is domiciled in a jurisdiction subject to sectoral restrictions, and the stated purpose is generic.", 0, 0),
    ("lien sanctions", "A shareholder identified in the ownership chain shares a date of birth with a listed individual.", 0, 0),
    ("contrepartie inhabituelle", "Payments to {} newly incorporated entities with no trading history and a shared registered address.", 2, 4),
    ("contrepartie inhabituelle", "Regular remittances to a counterparty whose declared sector bears no relation to the client's stated activity.", 0, 0),
    ("contrepartie inhabituelle", "A first-time counterparty received an amount larger than the client's entire prior twelve-month turnover.", 0, 0),
    ("intensite especes", "Cash represents {} % of turnover for a business whose sector averages under twenty.", 72, 22),
    ("intensite especes", "Notes deposited are consistently high denomination and show no pattern of retail takings.", 0, 0),
    ("intensite especes", "Weekly cash lodgements continued unchanged through a period the premises were closed.", 0, 0),
)
NARRATIVES_HELDOUT = (
    ("fractionnement", "Client paid in {} separate lodgements this fortnight, every one a shade under the level that would have triggered paperwork.", 9, 5),
    ("fractionnement", "Money arrived in slices rather than in one movement, spread over several counters, with no explanation offered for the pattern.", 0, 0),
    ("fractionnement", "Amounts were kept small enough individually to pass unnoticed, though together they exceed anything this account has seen.", 0, 0),
    ("mouvement rapide", "Whatever came in was gone again within the working day, to a party the client had never dealt with before.", 0, 0),
    ("mouvement rapide", "The account held a positive balance for roughly {} hours on each of the dates reviewed, then emptied.", 2, 4),
    ("mouvement rapide", "Money did not rest here. It passed through, repeatedly, and the account ends every period flat.", 0, 0),
    ("lien sanctions", "A name in the ownership structure resembles one on a restricted register closely enough that we cannot rule it out.", 0, 0),
    ("lien sanctions", "The receiving institution sits in a territory currently subject to measures, and the stated reason for payment is vague.", 0, 0),
    ("lien sanctions", "Screening flagged a near-identity between a director and a person the authorities have designated.", 0, 0),
    ("contrepartie inhabituelle", "Payments went to {} companies registered within weeks of each other at one address, none of which appear to trade.", 2, 4),
    ("contrepartie inhabituelle", "The recipient does business in a field entirely unconnected to what this client told us they do.", 0, 0),
    ("contrepartie inhabituelle", "A party never seen before on this account received more in a single instruction than the client turned over all last year.", 0, 0),
    ("intensite especes", "Notes account for roughly {} % of what comes through, far above what this line of business normally shows.", 70, 25),
    ("intensite especes", "The physical money banked does not look like shop takings — too uniform, too large, too clean.", 0, 0),
    ("intensite especes", "Banking of notes carried on at the usual rate during weeks the premises were shut.", 0, 0),
)


def affine(steps: int) -> tuple[int, int]:
    """The map of so many steps of the generator."""
    a, c, times, add = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            a, c = a * times % MODULUS, (c * times + add) % MODULUS
        times, add, steps = times * times % MODULUS, (add * times + add) % MODULUS, steps >> 1
    return a, c


def stepped(state: Column, a: Column, c: Column) -> Column:
    """a * state + c; the product is taken in halves, which stay within a long."""
    high = (F.floor(a / 65536) * state) % MODULUS * 65536
    return (high + (a % 65536) * state + c) % MODULUS


def advanced(state: Column, steps: int) -> Column:
    """The state after so many steps."""
    a, c = affine(steps)
    return ((F.lit(a // 65536) * state) % MODULUS * 65536 + F.lit(a % 65536) * state + F.lit(c)) % MODULUS


def jumped(seed: int, times: Column, stride: int, bits: int = 32) -> Column:
    """The state after ``times`` strides from the seed: the maps of the number's bits, one after the other."""
    maps = F.array(*(F.struct(F.lit(1 << b).cast("bigint").alias("bit"), *(F.lit(x).cast("bigint").alias(n) for n, x in zip("ac", affine(stride << b)))) for b in range(bits)))
    return F.aggregate(F.filter(maps, lambda m: m["bit"].bitwiseAND(times) != 0), F.lit(seed).cast("bigint"), lambda s, m: stepped(s, m["a"], m["c"]))


def share(state: Column, n: int) -> Column:
    """A draw's state as one of 0 .. n - 1."""
    return F.floor(state.cast("double") / float(MODULUS) * n).cast("int")


def picked(state: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), share(state, len(values)) + 1)


def filled(template: str) -> Column:
    """A template's text with the columns of its holes."""
    parts = [p for piece in template.split("{") for p in piece.split("}")]
    return F.concat(*(F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def seed_of(seed: int, split: str) -> int:
    return seed + (HELDOUT_SHIFT if split == "heldout" else 0)


def records(spark: SparkSession, n: int = 120, split: str = "heldout", seed: int = RECORD_SEED) -> DataFrame:
    """id, split, text and the true name, birth, document, country and address of n generated client files."""
    rows = spark.range(n).select("id", jumped(seed_of(seed, split), F.col("id"), DRAWS, max(1, n.bit_length())).alias("s"))
    d = {k: advanced(F.col("s"), k) for k in range(1, DRAWS + 1)}
    day, year = share(d[3], 28) + 1, share(d[4], 50) + 1955
    written = F.concat_ws(" ", day.cast("string"), picked(d[6], MONTHS), year.cast("string"))
    numeric = F.format_string("%02d/%02d/%d", day, share(d[6], 12) + 1, year)
    shapes = HELDOUT if split == "heldout" else TRAINING
    truth = rows.select(
        "id",
        F.concat_ws(" ", picked(d[1], FIRST_NAMES), picked(d[2], SURNAMES)).alias("name"),
        F.when(d[5] < MODULUS // 2, written).otherwise(numeric).alias("birth"),
        F.concat_ws("-", picked(d[7], PREFIXES), (share(d[8], 9000) + 1000).cast("string"), picked(d[9], SUFFIXES)).alias("document"),
        picked(d[10], COUNTRIES).alias("country"),
        F.concat((share(d[11], 200) + 1).cast("string"), F.lit(" "), picked(d[12], STREETS), F.lit(", "), picked(d[13], CITIES)).alias("address"),
        picked(d[14], CITIES).alias("birthCity"),
        share(d[15], len(shapes)).alias("shape"),
    )
    text = F.element_at(F.array(*map(filled, shapes)), F.col("shape") + 1)
    return truth.select(F.format_string("D-%04d", F.col("id") + 1).alias("id"), F.lit(split).alias("split"), text.alias("text"), "name", "birth", "document", "country", "address")


def alerts(spark: SparkSession, n: int = 120, split: str = "heldout", seed: int = ALERT_SEED) -> DataFrame:
    """id, narrative and truth of n generated alerts."""
    from tierwright.functions.text import TYPOLOGIES

    pool = NARRATIVES_HELDOUT if split == "heldout" else NARRATIVES
    of_label = len(pool) // len(TYPOLOGIES)
    spans = F.array(*(F.lit(span) for *_, span in pool))
    at = lambda s: share(advanced(s, 1), len(TYPOLOGIES)) * of_label + share(advanced(s, 2), of_label)
    starts = F.aggregate(
        F.sequence(F.lit(1), F.lit(n)),
        F.struct(F.lit(seed_of(seed, split)).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("all")),
        lambda a, _: F.struct(F.when(F.element_at(spans, at(a["s"]) + 1) > 0, advanced(a["s"], 3)).otherwise(advanced(a["s"], 2)).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")),
        lambda a: a["all"],
    )
    rows = spark.range(1).select(F.posexplode(starts).alias("i", "s")).withColumn("t", at(F.col("s")))
    low, span = F.array(*(F.lit(x) for _, _, x, _ in pool)), F.element_at(spans, F.col("t") + 1)
    hole = F.floor(advanced(F.col("s"), 3).cast("double") / float(MODULUS) * span).cast("int") + F.element_at(low, F.col("t") + 1)
    text = F.replace(F.element_at(F.array(*(F.lit(x) for _, x, _, _ in pool)), F.col("t") + 1), F.lit("{}"), hole.cast("string"))
    label = F.element_at(F.array(*map(F.lit, TYPOLOGIES)), F.floor(F.col("t") / of_label).cast("int") + 1)
    return rows.select(F.format_string("A-%04d", F.col("i") + 1).alias("id"), text.alias("narrative"), label.alias("truth"))


def shared_texts(a: DataFrame, b: DataFrame, key: Column | None = None) -> DataFrame:
    """The distinct texts (or keys made of text) that both splits have."""
    key = F.col("text") if key is None else key
    return a.select(key.alias("text")).intersect(b.select(key.alias("text")))
