"""Ids beyond 2**53 beside nulls in one batch, and columns that the operators only carry: values, not counts."""

import datetime
import decimal

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import LOREM, SF

from tierwright.llm import bpe, common, cotraining, decontaminate, exact_dedup, jaccard_join, language, periodic_runs, pii, pitman_yor, ranked_search, source_mix, toxicity, warc

BIG = 2**53 + 1
IDS = [BIG, None, BIG + 2, -BIG, 5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{LOREM} {k} {LOREM[: 7 * k]}", "en", "s", BIG + k if k % 2 else None) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def found_ids(spark, docs, name):
    labels = common.table(spark, SF, "labels")
    items = spark.createDataFrame([(BIG, LOREM)], "item_id long, text string")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.org/x").alias("url"), F.col("text").alias("html"))
    return {
        "cotraining": lambda: cotraining.classify(docs, labels).select("doc_id"),
        "exact": lambda: exact_dedup.deduplicate(docs).select("doc_id"),
        "pii": lambda: pii.find(docs).select("doc_id"),
        "jaccard": lambda: jaccard_join.join(docs, 3, 90).select("doc_id"),
        "warc": lambda: warc.archived_pages(pages).select("page_id"),
        "pitman_yor": lambda: pitman_yor.score(docs).select("doc_id"),
        "toxicity": lambda: toxicity.detect(docs, labels).select("doc_id"),
        "bpe": lambda: bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id"),
        "language": lambda: language.identify(docs, pages.limit(0)).select("doc_id"),
        "decontaminate": lambda: decontaminate.decontaminate(docs, items).select("doc_id"),
        "near": lambda: decontaminate.near_matches(docs, items).select("doc_id"),
        "mix": lambda: source_mix.mix(docs).select("doc_id"),
        "search": lambda: ranked_search.search(docs, items).select("doc_id"),
        "runs": lambda: periodic_runs.periodic_runs(docs).select("doc_id"),
    }[name]()


@pytest.mark.parametrize("name", ["cotraining", "exact", "pii", "jaccard", "warc", "pitman_yor", "toxicity", "bpe", "language", "decontaminate", "near", "mix", "search", "runs"])
def test_ids_come_back_as_they_are(spark, docs, name):
    assert sorted((r[0] for r in found_ids(spark, docs, name).collect()), key=repr) == sorted(IDS, key=repr)


def test_held_out_goes_by_the_id_itself(spark, docs):
    for df in (pitman_yor.score(docs), toxicity.detect(docs, common.table(spark, SF, "labels"))):
        folds = pitman_yor.FOLDS if "n_tokens" in df.columns else toxicity.FOLDS
        assert df.where(F.col("held_out") != common.held_out(F.col("doc_id"), folds)).count() == 0


def test_stages_carry_all_columns_unchanged(spark, docs):
    """The pipeline's stages drop rows and change none: longs beside nulls, decimals, dates, arrays and maps."""
    labels = common.table(spark, SF, "labels")
    items = spark.createDataFrame([(1, "no such words at all")], "item_id long, text string")
    rare = F.when(F.col("doc_id") > 5, F.col("doc_id"))
    wide = docs.withColumns({
        "a": rare, "b": F.when(rare.isNotNull(), F.lit(7)), "c": F.when(rare.isNotNull(), F.lit(decimal.Decimal("12345678901234567.89"))), "d": F.when(rare.isNotNull(), F.lit(datetime.date(1500, 2, 3))),
        "e": F.array(rare, F.lit(1)), "f": F.when(rare.isNotNull(), F.lit(datetime.datetime(2024, 3, 31, 2, 30))), "g": F.create_map(F.lit("k"), rare), "h": rare.isNotNull(), "score": rare,
    })
    rows = sorted(map(repr, wide.collect()))
    for stage in (lambda d: toxicity.harmless_documents(d, labels), exact_dedup.unique_documents, lambda d: decontaminate.clean_documents(d, items)):
        assert sorted(map(repr, stage(wide).collect())) == rows
    assert {*map(repr, jaccard_join.distinct_documents(wide, 5, 80).collect())} <= {*rows}
