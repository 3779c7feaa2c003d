"""Exact deduplication with an extendible-hash index kept on shared files.

Each different text gets an entry under a 64-bit key. The directory maps a prefix of the key to a bucket; it starts
with two slots and doubles while an overfull bucket has to be split. Owner tasks take whole buckets, that is, ranges of
the key: they read a bucket's entries in key order, chain the entries that share a key, and compare their bytes, so
that texts whose keys collide stay apart. Only texts whose key is met more than once have to be compared, so only these
travel. The directory and the index, one row for each different text in a folder for each bucket, are tables in the
shared folder; a document finds its bucket through the directory and its entry in the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Texts (not copies) and their bytes that a bucket holds before it is split. Beyond BUCKETS buckets' worth of bytes the
#: capacities grow with the input, so that the directory stays of bounded size; owners read buckets as streams, of any size.
CAPACITY, CAPACITY_BYTES, BUCKETS = 4_000, 8 << 20, 1 << 15
#: Rows of keys up to which they go to every task.
SMALL = 500_000
#: Bytes of different texts that a task holds before it passes them on.
HELD_BYTES = 16 << 20
#: Longest prefix, in bits, that the directory can be asked for, and that with which it starts.
MAX_DEPTH, MIN_DEPTH = 20, 1


def normalised(text: Column) -> Column:
    """White space runs become one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def build_directory(cells: list[tuple[int, int, int]], depth: int = MIN_DEPTH, capacity: int = CAPACITY, capacity_bytes: int = CAPACITY_BYTES, max_depth: int = 16) -> tuple[int, np.ndarray]:
    """The global depth and, for each of its 2**depth slots, the number of its bucket.

    cells: (first ``max_depth`` bits of the key, texts, bytes). A bucket over a capacity is split by its next bit; where
    it already uses all bits of the directory, the directory doubles first. A bucket at ``max_depth`` holds a few texts
    of more than its capacity in bytes and cannot be split to any use.
    """
    texts, size = np.zeros(1 << max_depth, np.int64), np.zeros(1 << max_depth, np.int64)
    for cell, n, b in cells:
        texts[cell] += n
        size[cell] += b
    slots = np.arange(1 << depth)
    local = np.full(len(slots), depth)
    overfull = [*range(len(slots))]
    load = {i: (int(t), int(b)) for i, (t, b) in enumerate(zip(texts.reshape(1 << depth, -1).sum(1), size.reshape(1 << depth, -1).sum(1)))}
    while overfull:
        bucket = overfull.pop()
        if (load[bucket][0] <= capacity and load[bucket][1] <= capacity_bytes) or local[bucket] == max_depth:
            continue
        if local[bucket] == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        own = np.flatnonzero(slots == bucket)
        upper = own[len(own) // 2 :]
        new = len(local)
        slots[upper] = new
        local[bucket] += 1
        local = np.append(local, local[bucket])
        width = 1 << (max_depth - depth)
        for b, part in ((bucket, own[: len(own) // 2]), (new, upper)):
            of = slice(part[0] * width, (part[-1] + 1) * width)
            load[b] = int(texts[of].sum()), int(size[of].sum())
            overfull.append(b)
    return depth, slots


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def combined(batches: Iterator[pd.DataFrame], depth: int, slots: np.ndarray) -> Iterator[pd.DataFrame]:
    """The entries of a task, with the bucket of each key: copies become one entry while at most HELD_BYTES are held."""
    entries: dict[tuple[int, str], list] = {}
    held = 0

    def passed_on() -> pd.DataFrame:
        keys = np.array([k for k, _ in entries], np.int64)
        return pd.DataFrame({
            "bucket": slots[(keys.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)],
            "key": keys,
            "doc": np.array([e[0] for e in entries.values()], np.int64),
            "n": np.array([e[1] for e in entries.values()], np.int64),
            "text": pd.Series([t for _, t in entries], dtype=object),
        })

    for b in batches:
        for key, doc, text in zip(b["key"].to_numpy(), b["doc"].to_numpy(), b["text"]):
            e = entries.get((key, text))
            if e is None:
                entries[key, text] = [doc, 1]
                held += len(text)
            else:
                e[0], e[1] = min(e[0], doc), e[1] + 1
        if held > HELD_BYTES:
            yield passed_on()
            entries, held = {}, 0
    if entries:
        yield passed_on()


def owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An owner's index rows. The entries come in the order of bucket and key; only one key's chain is held."""
    at, chain = None, []

    def close() -> list[tuple]:
        return [(bucket, key, place, doc, n, text) for place, (bucket, key, doc, n, text) in enumerate(chain)]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["bucket", "key", "chain", "keep", "n", "text"])

    for b in batches:
        out = []
        for bucket, key, doc, n, text in zip(b["bucket"].to_numpy(), b["key"].to_numpy(), b["doc"].to_numpy(), b["n"].to_numpy(), b["text"]):
            if key != at:
                out += close()
                at, chain = key, []
            for link in chain:
                if link[4] == text:
                    link[2], link[3] = min(link[2], doc), link[3] + n
                    break
            else:
                chain.append([bucket, key, doc, n, text])
        yield frame(out)
    yield frame(close())


def keyed(docs: DataFrame) -> DataFrame:
    """The stored doc, raw (of the text as it is), key, text_sha256 and bytes (of the normalised text) of every row."""
    text = normalised(docs["text"])
    rows = docs.select(common.key_of(docs).alias("doc"), F.xxhash64(common.text_of(docs)).alias("raw"), text.alias("text"))
    return common.stored(rows.select("doc", "raw", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("bytes")), "keyed-rows")


def build_index(docs: DataFrame, rows: DataFrame, capacity: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The stored index and directory (slot, bucket) of ``rows``, which are ``keyed(docs)``, and the directory's depth.

    The index has bucket, key, chain (place among the texts of the key), text_sha256, keep and n. ``keep`` is the
    smallest doc_id of the text (``common.NO_ID`` is least of all and stands for null), n the number of its documents.
    """
    spark = docs.sparkSession
    # copies count once: a text's key meets itself here, in rows of a few bytes
    met = common.stored(rows.groupBy("key").agg(F.max("bytes").alias("bytes"), F.count("*").alias("times")), "keys")
    whole = met.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    capacity, capacity_bytes = max(capacity or CAPACITY, whole["n"] // BUCKETS), max(CAPACITY_BYTES, whole["bytes"] // BUCKETS)
    # enough bits for buckets half as full, and three more for those that chance fills
    bits = min(MAX_DEPTH, max(MIN_DEPTH, (2 * whole["n"] // capacity).bit_length(), (2 * whole["bytes"] // capacity_bytes).bit_length()) + 3)
    cells = met.groupBy(prefix(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # at most 2**MAX_DEPTH rows
    depth, slots = build_directory([tuple(r) for r in cells], capacity=capacity, capacity_bytes=capacity_bytes, max_depth=bits)
    directory = common.stored(spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(slots), dtype=np.int32), "bucket": slots.astype(np.int32)})), "hash-directory")

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from combined(batches, depth, slots)

    repeated = met.where("times > 1").select("key")
    raw = common.stored(rows.join(common.sized(repeated, SMALL), "key", "left_semi").select("raw").distinct(), "repeated-texts")
    plain = common.in_small_batches(docs).select(common.key_of(docs).alias("doc"), docs["text"].alias("text"), F.xxhash64(common.text_of(docs)).alias("raw"))
    again = plain.join(common.sized(raw, SMALL), "raw", "left_semi")
    again = again.select("doc", normalised(again["text"]).alias("text")).withColumn("key", F.xxhash64("text")).join(common.sized(repeated, SMALL), "key", "left_semi")
    local = again.select("key", "doc", "text").mapInPandas(combine, "bucket int, key long, doc long, n long, text string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = local.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key")
    of_repeated = in_order.mapInPandas(owned, "bucket int, key long, chain int, keep long, n long, text string").select("bucket", "key", "chain", F.sha2("text", 256).alias("text_sha256"), "keep", "n")
    once = rows.join(met.where("times = 1").select("key"), "key", "left_semi").withColumn("slot", prefix(F.col("key"), depth)).join(F.broadcast(directory), "slot")
    of_once = once.select("bucket", "key", F.lit(0).alias("chain"), "text_sha256", F.col("doc").alias("keep"), F.lit(1).cast("long").alias("n"))
    path = common.new_folder(spark, "hash-index")
    index = of_repeated.unionByName(of_once)
    index.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
    return spark.read.schema(index.schema).parquet(path), directory, depth


def answered(docs: DataFrame) -> DataFrame:
    """doc, raw, text_sha256, keep and n of every row, each found through the directory in its bucket of the index."""
    rows = keyed(docs)
    index, directory, depth = build_index(docs, rows)
    placed = rows.withColumn("slot", prefix(F.col("key"), depth)).join(F.broadcast(directory), "slot").select("doc", "raw", "bucket", "key", "text_sha256")
    entries = index.select("bucket", "key", "text_sha256", "keep", "n")
    return placed.join(entries, ["bucket", "key", "text_sha256"]).select("doc", "raw", "text_sha256", "keep", "n")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each row of ``docs``.

    A null text is empty, and empty texts are copies of each other. A null doc_id is smaller than all others, so its
    row stays, with keep_id null. Rows that repeat both text and the smallest id are all kept here, since nothing
    tells them apart; ``unique_documents`` leaves one of them. Other columns are not looked at.
    """
    id_of = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return answered(docs).select(id_of("doc").alias("doc_id"), id_of("keep").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc") == F.col("keep")).alias("kept"), "text_sha256")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each different text: that with the smallest doc_id, with all its columns.

    Of rows that also share that id, one stays.
    """
    kept = answered(docs).where(F.col("doc") == F.col("keep")).groupBy("doc", "text_sha256", "raw").agg(F.count("*").alias("rows"))
    kept = kept.groupBy("doc", "text_sha256").agg(F.min(F.struct("raw", "rows")).alias("first")).select(F.col("doc").alias("keep_key"), F.col("first.raw").alias("keep_raw"), F.col("first.rows").alias("rows_of_id"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc = F.coalesce(plain[names[docs.columns.index("doc_id")]].cast("long"), F.lit(common.NO_ID))
    raw = F.xxhash64(common.text_of(plain, names[docs.columns.index("text")]))
    stay = plain.join(kept, (doc == kept["keep_key"]) & (raw == kept["keep_raw"]))
    once = stay.where("rows_of_id = 1").select(*names)
    repeated = stay.where("rows_of_id > 1").dropDuplicates(["keep_key", "keep_raw"]).select(*names)
    return once.unionByName(repeated).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
