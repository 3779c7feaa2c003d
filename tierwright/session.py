"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Rows of texts that tasks' Python workers get at a time, and bytes of them.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def session(name: str = "tierwright", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` are further Spark settings, with _ for the dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to send Python workers small batches, if it does not so already.

    Texts are long: ten thousand of them, the usual batch, and what is made of them fill a worker's memory.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub(r"\D", "", conf.get(key)) or 0) <= most:
            conf.set(key, str(most))
    return df
