"""Benchmark decontamination over a distributed positional inverted index.

The index stores one posting (term, document, position) for each training token that some test text holds, in
segments that are sorted by term, and one end mark for each document. Searches start with the postings of a
pattern's rarest term, move every posting back by the term's offset in the pattern, and intersect with the list of the
next rarest term; when only few documents are left, all other lists are intersected at once. Everything is
DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words by which a term may stand off its place in a proximity match.
SLOP = 2
#: The lists of this many rarest terms are intersected one after the other, the others together.
RAREST = 3
#: Rows up to which a side is broadcast, after a count.
SMALL = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for a document's end in the index; no word can hold it.
END = "\x00"


def words_of(text: F.Column) -> F.Column:
    """The words, letters as written: ASCII signs other than digits and letters divide them."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """win_id, terms and item_ids (as text) of each different window of the test items, with all items that hold it.

    A window is ``length`` consecutive words; an item of fewer words is one window, one without words has none.
    """
    words = items.select("item_id", words_of(common.ascii_lower(items["text"])).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1))))
    each = words.select("item_id", "words", starts.alias("start")).select("item_id", F.slice("words", F.col("start"), length).alias("terms"))
    return each.select(F.xxhash64(F.concat_ws(" ", "terms"), F.size("terms")).alias("win_id"), "terms", F.col("item_id").cast("string").alias("item_id"))


def row_key(docs: DataFrame) -> F.Column:
    """What tells texts apart that share an id, null or not; rows that repeat both the id and the text are one."""
    return F.xxhash64(common.key_of(docs), docs["text"].cast("string"))


def build_index(docs: DataFrame, vocabulary: DataFrame, key: F.Column | None = None) -> DataFrame:
    """The stored postings (term_id, doc, pos) of the vocabulary's terms in whole texts, and each document's end mark.

    ``vocabulary`` has term. ``doc`` is the key, the id by default; end marks have the id as doc_id. A null text holds
    the end mark only; a null id becomes ``common.NO_ID``.
    """
    vocabulary = vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(END).alias("term")))
    vocabulary = vocabulary.select("term", F.lower("term").alias("folded"), term_id("term").alias("term_id"))
    key = common.key_of(docs) if key is None else key
    tokens = docs.select(key.alias("doc"), common.key_of(docs).alias("doc_id"), F.posexplode(F.concat(words_of(docs["text"].cast("string")), F.array(F.lit(END)))).alias("pos", "word"))
    # lower() also folds letters outside ASCII, so equality under it only proposes; the term itself decides
    same = (F.lower("word") == F.col("folded")) & ((F.col("word") == F.col("term")) | (common.ascii_lower(F.col("word")) == F.col("term")))
    postings = tokens.join(common.sized(vocabulary, SMALL), same).select("term_id", "doc", "pos", F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id"))
    return common.stored(postings.sortWithinPartitions("term_id", "doc", "pos"), "postings")


def term_id(column: str) -> F.Column:
    return F.xxhash64(F.col(column))


def ranked_terms(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """win_id, n, off, term_id and rank (1: the rarest in the index) for patterns all of whose terms the index holds."""
    seen = index.groupBy("term_id").agg(F.count("*").alias("df"))
    terms = patterns.select("win_id", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term")).select("win_id", "n", "off", term_id("term").alias("term_id"))
    by_rarity = Window.partitionBy("win_id").orderBy("df", "off")
    ranked = terms.join(common.sized(seen, SMALL), "term_id").select("win_id", "n", "off", "term_id", F.row_number().over(by_rarity).alias("rank"), F.count("*").over(Window.partitionBy("win_id")).alias("present"))
    return common.stored(ranked.where("present = n").drop("present"), "patterns")


def occurrences(index: DataFrame, patterns: DataFrame) -> DataFrame:
    """win_id, n, doc and start of every exact occurrence of a pattern (win_id, terms) in the indexed documents."""
    ranked = ranked_terms(index, patterns)
    first = common.sized(ranked.where("rank = 1"), SMALL)
    found = index.join(first, "term_id").select("doc", "win_id", "n", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    for k in range(2, RAREST + 1):
        level = ranked.where(F.col("rank") == k)
        lists = index.join(common.sized(level.select("term_id").distinct(), SMALL), "term_id", "left_semi")
        expected = found.where(F.col("n") >= k).join(common.sized(level.select("win_id", "off", "term_id"), SMALL), "win_id")
        expected = expected.withColumn("pos", F.col("start") + F.col("off")).drop("off")
        kept = expected.join(lists.distinct(), ["doc", "term_id", "pos"]).select("doc", "win_id", "n", "start")
        found = kept.unionByName(found.where(F.col("n") < k))
        found = common.stored(found, f"candidates-{k}")
    rest = ranked.where(F.col("rank") > RAREST)
    of_these = common.sized(found.select("doc").distinct(), SMALL)
    lists = index.join(common.sized(rest.select("term_id").distinct(), SMALL), "term_id", "left_semi").join(of_these, "doc", "left_semi")
    expected = found.where(F.col("n") > RAREST).join(common.sized(rest.select("win_id", "off", "term_id"), SMALL), "win_id")
    expected = expected.withColumn("pos", F.col("start") + F.col("off")).drop("off")
    whole = expected.join(lists.distinct(), ["doc", "term_id", "pos"]).groupBy("doc", "win_id", "start").agg(F.first("n").alias("n"), F.count("*").alias("met"))
    return whole.where(F.col("met") == F.col("n") - RAREST).select("doc", "win_id", "n", "start").unionByName(found.where(F.col("n") <= RAREST).select("doc", "win_id", "n", "start")).distinct()


def near_occurrences(index: DataFrame, patterns: DataFrame, slop: int) -> DataFrame:
    """win_id, doc and start where every term of a pattern stands within ``slop`` words of its place.

    The start is where the rarest term's posting puts the pattern. Postings meet by blocks of ``slop`` positions, so
    that a list is never compared with another as a whole.
    """
    ranked = ranked_terms(index, patterns)
    wide = max(1, slop)
    found = index.join(common.sized(ranked.where("rank = 1"), SMALL), "term_id").select("doc", "win_id", "n", (F.col("pos") - F.col("off")).alias("start"))
    rest = common.sized(ranked.where("rank > 1").select("win_id", "off", "term_id"), SMALL)
    expected = found.join(rest, "win_id").withColumn("want", F.col("start") + F.col("off"))
    expected = expected.withColumn("block", F.explode(F.sequence(F.floor((F.col("want") - slop) / wide), F.floor((F.col("want") + slop) / wide))))
    lists = index.join(common.sized(ranked.select("term_id").distinct(), SMALL), "term_id", "left_semi").withColumn("block", F.floor(F.col("pos") / wide))
    met = expected.join(lists, ["doc", "term_id", "block"]).where(F.abs(F.col("pos") - F.col("want")) <= slop)
    all_met = met.groupBy("doc", "win_id", "start", "n").agg(F.countDistinct("off").alias("met")).where(F.col("met") == F.col("n") - 1)
    alone = found.where("n = 1").select("doc", "win_id", "start")
    return all_met.select("doc", "win_id", "start").unionByName(alone)


def covered_words(found: DataFrame) -> DataFrame:
    """doc and n_hit: the words inside any occurrence, each counted once."""
    spans = found.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    earlier = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    return spans.select("doc", F.greatest(F.col("end") - begin, F.lit(0)).alias("new")).groupBy("doc").agg(F.sum("new").cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row for each row of ``docs``.

    A null or empty text, or one without words, has no hits; so has every document if there are no items. Rows that
    share a doc_id, or have none, are documents of their own. Items with a null id count as items without a name in
    the list of ids. Other columns are not looked at.
    """
    return judged(docs, items, length).drop("doc")


def judged(docs: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """``decontaminate`` with the key of each row as doc."""
    patterns = windows(items, length)
    different = common.stored(patterns.groupBy("win_id").agg(F.first("terms").alias("terms")), "windows")
    index = build_index(docs, different.select(F.explode("terms").alias("term")).distinct(), row_key(docs))
    found = common.stored(occurrences(index, different), "occurrences")
    named = found.select("doc", "win_id").distinct().join(patterns.select("win_id", "item_id").distinct(), "win_id").groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    ends = index.where(F.col("term_id") == F.xxhash64(F.lit(END))).select("doc", "doc_id", F.col("pos").cast("long").alias("n_words"))
    whole = reduce(lambda a, b: a.join(b, "doc", "left"), [ends, covered_words(found), named])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return whole.select(
        "doc",
        F.when(F.col("doc_id") != common.NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def near_matches(docs: DataFrame, items: DataFrame, length: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_near and near_items, one row for each row of ``docs``: proximity matches, exact ones among them.

    n_near is the number of different windows of items all of whose terms stand within ``slop`` words of their places;
    near_items are those items' ids as text, sorted and divided by commas. Rows and ids are taken as in ``decontaminate``.
    """
    patterns = windows(items, length)
    different = common.stored(patterns.groupBy("win_id").agg(F.first("terms").alias("terms")), "windows")
    index = build_index(docs, different.select(F.explode("terms").alias("term")).distinct(), row_key(docs))
    found = common.stored(near_occurrences(index, different, slop).select("doc", "win_id").distinct(), "near-occurrences")
    named = found.join(patterns.select("win_id", "item_id").distinct(), "win_id").groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    ends = index.where(F.col("term_id") == F.xxhash64(F.lit(END))).select("doc", "doc_id")
    whole = ends.join(found.groupBy("doc").agg(F.count("*").alias("n_near")), "doc", "left").join(named, "doc", "left")
    return whole.select(
        F.when(F.col("doc_id") != common.NO_ID, F.col("doc_id")).alias("doc_id"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.concat_ws(",", F.coalesce("item_ids", F.array().cast("array<string>"))).alias("near_items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns."""
    hit = judged(docs, items, WINDOW).where("contaminated").select(F.col("doc").alias("hit_key")).distinct()
    return docs.join(hit, row_key(docs) == hit["hit_key"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
