"""Periodic runs of words: for every shift the words are compared with themselves, and true stretches are measured.

A run is a stretch of words in which words one period apart are equal, of at least ``exponent`` periods and ``least``
words, that its neighbours do not extend. For the shift p it is a stretch of equal places (i and i + p) of the run's length
less p. Shifts go up to n / exponent. A run found at a multiple of its period has the same start and length there, so
the smallest shift of each (start, length) is its period.

Texts of up to ``LONG`` bytes are scanned where they are read. The shifts of longer ones are divided into ranges of
bounded work, which Spark deals out; the stretches found meet again by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EXPONENT, LEAST = 4, 6
#: Bytes of text up to which one task scans all shifts.
LONG = 1 << 16
#: Comparisons of two words that one range of shifts makes at the most.
CELLS = 1 << 30
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def stretches(ids: np.ndarray, low: int, high: int, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, shift) of the maximal stretches that repeat at a shift of ``low`` or more, below ``high``.

    A stretch of (exponent - 1) * p equal places holds as many multiples of p in a row, so a shift is first compared at
    these places alone, and at all places only if so many of them are equal one after the other.
    """
    found = []
    for p in range(max(1, low), min(high, len(ids) // exponent + 1)):
        at = ids[::p]
        equal = at[1:] == at[:-1]
        if p > 1:
            together = equal[exponent - 2 :].copy()
            for k in range(exponent - 2):
                together &= equal[k : len(equal) - (exponent - 2 - k)]
            if not together.any():
                continue
            equal = ids[p:] == ids[:-p]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
        begin, end = edges[::2], edges[1::2]
        long_enough = end - begin >= max(least, exponent * p) - p
        found += [(int(b), int(e - b) + p, p) for b, e in zip(begin[long_enough], end[long_enough])]
    return found


def smallest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) by start, then period: of one start and length the smallest shift."""
    period: dict[tuple[int, int], int] = {}
    for start, length, p in found:
        period[start, length] = min(p, period.get((start, length), p))
    return sorted(((s, n, p) for (s, n), p in period.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep) if runs else words)


def _words(doc_id: int | None, text: bytes | None, rewrite: Rewrite | None) -> list[bytes]:
    words = (text or b"").split()  # on bytes, split() knows ASCII white space only
    return rewrite(doc_id, words) if rewrite else words


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, runs, texts = zip(*rows) if rows else ((), (), (), ())
    each = [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in runs]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(each, _RUN), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def _short(docs: DataFrame, exponent: int, least: int, rewrite: Rewrite | None) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(doc_id, text, rewrite)
                runs = smallest(stretches(numbered(words), 1, len(words), exponent, least))
                rows.append((doc_id, len(words), runs, collapsed(words, runs)))
            yield _batch(rows)

    return docs.mapInArrow(scan, FOUND)


def _long(docs: DataFrame, exponent: int, least: int, rewrite: Rewrite | None, cells: int) -> DataFrame:
    docs = common.stored(docs.withColumn("row", F.monotonically_increasing_id()), "long-texts")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                ids = numbered(_words(doc_id, text, rewrite))
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["row", "n", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, ids, low, high in zip(*(batch.column(c).to_pylist() for c in ("row", "ids", "low", "high"))):
                rows += [(row, *s) for s in stretches(np.frombuffer(ids, np.int32), low, high, exponent, least)]
            cells_ = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(cells_[:, k]) for k in range(4)], ["row", "start", "length", "shift"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                words, runs = _words(doc_id, text, rewrite), sorted(((r["start"], r["length"], r["period"]) for r in runs or ()), key=lambda r: (r[0], r[2]))
                rows.append((doc_id, len(words), runs, collapsed(words, runs)))
            yield _batch(rows)

    parts = F.greatest(F.ceil(F.col("n") * F.col("n") / (exponent * cells)), F.lit(1).cast("long"))
    ranges = docs.select("row", "doc_id", "text").mapInArrow(number, "row long, n long, ids binary").withColumn("width", F.ceil(F.floor(F.col("n") / exponent) / parts)).where("width > 0")
    ranges = ranges.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.floor(F.col("n") / exponent) - 1) / F.col("width")))))
    ranges = ranges.select("row", "ids", (F.col("part") * F.col("width") + 1).alias("low"), ((F.col("part") + 1) * F.col("width") + 1).alias("high"))
    found = ranges.repartition(F.xxhash64("row", "low")).mapInArrow(scan, "row long, start long, length long, shift long")
    runs = found.groupBy("row", "start", "length").agg(F.min("shift").alias("period"))
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return docs.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(finish, FOUND)


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, rewrite: Rewrite | None = None, long: int = LONG, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, one row for each row of ``docs``.

    Words lie between ASCII white space, numbered from 0; ``collapsed`` has those that no run holds after its first
    period, joined by one space. ``rewrite`` gets an id and its words and returns the words to look at. A null or empty
    text has no words, no runs and an empty ``collapsed``. Rows that repeat an id, or have none, are looked at each by
    itself; other columns are not looked at. ``exponent`` is 2 or more.
    """
    given = common.in_small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    found = _short(given.where(~is_long), exponent, least, rewrite).unionByName(_long(given.where(is_long), exponent, least, rewrite, cells))
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of one id in ten with a tail that repeats: what the query looks at. Without an id as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    once = words[a : a + p]
    return words[:a] + (once * -(-(n - a) // p))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """One row of figures for each document of ``periodic_runs``; a document without runs has null for the longest one's."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.s")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / -F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(common.table(spark, sf_dir, "documents"), rewrite=repeated_tail))
