"""The queries of this subpackage's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, cotraining, decontaminate, exact_dedup, jaccard_join, language, periodic_runs, pii, pitman_yor, ranked_search, source_mix, toxicity, warc

VOCABULARY = "word_bpe_49k.json"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cotraining": cotraining.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_pii": pii.query,
        "op4_jaccard_join": jaccard_join.query,
        "op5_warc": warc.query,
        "op6_pitman_yor": pitman_yor.query,
        "op7_toxicity": toxicity.query,
        "op8_bpe": op8_bpe,
        "op9_language": language.query,
        "op10_decontaminate": decontaminate.query,
        "op10_near_matches": decontaminate.near_query,
        "op11_source_mix": source_mix.query,
        "op12_ranked_search": ranked_search.query,
        "op13_periodic_runs": periodic_runs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.SQL,
        "op4_jaccard_join": jaccard_join.SQL,
        "op5_warc": warc.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_source_mix": source_mix.SQL,
        "op12_ranked_search": ranked_search.SQL,
    }
