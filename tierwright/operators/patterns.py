"""Many patterns in one pass over the texts: an automaton over a list that grows with data.

Every text is read once, whatever the number of patterns. Lists are given to tasks in slices of bounded size; a list
of more slices is looked for slice by slice, and the first and last finds of the slices are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierwright.session import in_small_batches

#: Patterns, and bytes of them, that a task is given at a time: an automaton takes some 46 bytes for each byte of patterns
#: that share no beginnings, so about 190 MB.
PATTERNS, BYTES = 200_000, 4 << 20


def numbered(lists: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """seq (a struct that orders), kind and pattern of the values of several tables: (table, column, kind), in the order given.

    Values of a table go by code point, each once; null and empty ones are left out.
    """
    each = [rows.select(F.col(column).cast("string").alias("pattern")).where("pattern <> ''").distinct().select(F.struct(F.lit(i).alias("list"), F.col("pattern").alias("value")).alias("seq"), F.lit(kind).alias("kind"), "pattern") for i, (rows, column, kind) in enumerate(lists)]
    return reduce(DataFrame.unionByName, each)


def _found(rows: DataFrame, patterns: list[str], text: Column, key: str) -> DataFrame:
    """key, n, first and last: how many patterns each text holds, and the first and last place in the list among them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, list[int]] = {}  # several lists may have a value
        for i, p in enumerate(patterns):
            places.setdefault(p, []).append(i)
        automaton = ahocorasick.Automaton()
        for p, at in places.items():
            automaton.add_word(p, at)
        automaton.make_automaton()
        for b in batches:
            at = [{i for _, found in automaton.iter(t) for i in found} for t in b.column(1).to_pylist()]
            ends = [pa.array([of(x) if x else None for x in at], pa.int32()) for of in (min, max)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in at], pa.int64()), *ends], [key, "n", "first", "last"])

    kind = rows.schema[key].dataType.simpleString()
    return in_small_batches(rows).select(key, F.coalesce(text, F.lit("")).alias("_text")).mapInArrow(search, f"`{key}` {kind}, n long, first int, last int")


def contained(rows: DataFrame, key: str, text: Column, patterns: DataFrame, at_once: int = PATTERNS) -> DataFrame:
    """key, n, first and last for each row: how many of the patterns (seq, pattern) its text holds, and which is first and
    last in the order of seq; null where there is none.

    Texts hold a pattern where it stands in them exactly, inside a word too. A null text holds none. ``key`` names the
    row; rows that share it are put together only if the list has several slices.
    """
    size = patterns.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)).alias("bytes")).first()
    slices = max(1, -(-size["n"] // at_once), -(-size["bytes"] // BYTES))
    parts = []
    for s in range(slices):
        mine = patterns if slices == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == s)
        listed = [r["pattern"] for r in mine.orderBy("seq").select("pattern").collect()]
        if not listed:
            continue
        # finds are places in the slice's list; the list itself goes with the plan, once
        names = mine.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pattern"))), lambda x: F.struct(x["seq"].alias("seq"), x["pattern"].alias("pattern")))).scalar()
        found = _found(rows, listed, text, key).withColumn("names", names)
        parts.append(found.select(key, "n", *(F.col("names")[F.col(end)].alias(end) for end in ("first", "last"))))
    if not parts:
        return rows.select(key, F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"))
    if len(parts) == 1:
        whole = parts[0]
    else:
        whole = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return whole.select(key, "n", F.col("first.pattern").alias("first"), F.col("last.pattern").alias("last"))
