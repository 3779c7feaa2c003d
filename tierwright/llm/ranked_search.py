"""Ranked lexical search: trees of greatest scores over ranges of documents, opened best first.

The index is a table of blocks, each a range of up to ``DOCS`` documents with their terms and counts. Over a block each
term has a tree: the greatest score that it adds to a document of the block, of each 256 documents and of each 16. The sum
over an item's terms bounds what any document of a range can score. The search looks at the roots of all blocks first and
opens, for each item, the blocks of the highest bounds; the score of the tenth document found there is the item's floor.
Then every block whose root reaches the floor is opened: of its nodes always the one of the highest bound, down to
documents, until no bound reaches the tenth best. Nodes whose bound equals it are opened too, for they can hold an equal
score of a smaller id. All trees of a block are made and searched in one task; blocks are independent.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOP = 10
#: Documents and postings of a block, at the most (a single document may have more postings).
DOCS, POSTINGS = 4096, 1_000_000
#: Documents of a node below a block's root, and of a node below that.
WIDE, NARROW = 256, 16
#: Blocks that are opened for each item before its floor is known.
FIRST = 4
#: (item, term) rows, and bytes of terms, that tasks are given at a time; more items are searched slice by slice.
ITEM_TERMS, ITEM_BYTES = 500_000, 16 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
INDEX = "block long, n_docs long, n_words long, terms array<binary>, df array<int>, ids binary, lengths binary, begins binary, term binary, tf binary"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: what stands between ASCII signs other than digits and letters, A-Z in lower case."""
    return text.translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each, of the items; rows that share an item_id, or have none, are one item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted({*terms_of(t or b"")}) for t in batch.column(1).to_pylist()]
            place = np.repeat(np.arange(len(each)), [len(t) for t in each])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array([t for terms in each for t in terms], pa.binary())], ["item_id", "term"])

    given = items.select("item_id", items["text"].cast("string").cast("binary").alias("text"))
    schema = given.select("item_id", F.lit(b"").alias("term")).schema
    return given.mapInArrow(read, schema).distinct()


class _Block:
    """Documents and their counted terms while a block is filled."""

    def __init__(self, number: int):
        self.number, self.n_docs, self.n_words, self.local = number, 0, 0, {}
        self.ids, self.lengths, self.begins, self.term, self.tf = array("q"), array("q"), array("q", [0]), array("i"), array("q")

    def add(self, doc_id: int, text: bytes, vocabulary: frozenset[bytes] | None) -> None:
        words = terms_of(text)
        if not words:
            return
        self.n_docs += 1
        self.n_words += len(words)
        counts = Counter(words)
        if vocabulary is not None:
            counts = {t: counts[t] for t in counts.keys() & vocabulary}
        if counts:
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.term.extend([self.local.setdefault(t, len(self.local)) for t in counts])
            self.tf.extend(counts.values())
            self.begins.append(len(self.term))

    def full(self, docs: int) -> bool:
        return len(self.ids) >= docs or len(self.term) >= POSTINGS

    def batch(self) -> pa.RecordBatch:
        df = np.bincount(np.frombuffer(self.term, np.int32), minlength=len(self.local)) if self.term else np.zeros(0, np.int64)
        columns = [
            pa.array([self.number], pa.int64()), pa.array([self.n_docs], pa.int64()), pa.array([self.n_words], pa.int64()), pa.array([[*self.local]], pa.list_(pa.binary())), pa.array([df.astype(np.int32)], pa.list_(pa.int32())),
            *(pa.array([x.tobytes()], pa.binary()) for x in (self.ids, self.lengths, self.begins, self.term, self.tf)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "n_docs", "n_words", "terms", "df", "ids", "lengths", "begins", "term", "tf"])


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, block_docs: int = DOCS) -> DataFrame:
    """The stored blocks of all documents; of the terms in ``vocabulary`` (term: binary) alone, if it is small enough to
    be given to tasks, of all terms otherwise. Documents without a term are left out, and counted nowhere."""
    known = None
    if vocabulary is not None:
        size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
        if size["n"] <= ITEM_TERMS and size["bytes"] <= ITEM_BYTES:
            known = frozenset(bytes(r["term"]) for r in vocabulary.collect())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    block.add(doc_id, text.as_py(), known)
                if block.full(block_docs):
                    yield block.batch()
                    number += 1
                    block = _Block(number)
        if block.n_docs:
            yield block.batch()

    given = common.in_small_batches(docs).select(common.key_of(docs).alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    path = common.new_folder(docs.sparkSession, "search-index")
    # few rows in a row group, so that a reader holds few blocks at a time
    given.mapInArrow(fill, INDEX).write.option("parquet.block.row.count.limit", "2").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class _Items:
    """Some items' terms with their weights: what tasks are given."""

    def __init__(self, rows: list[tuple[int, bytes]], weight: dict[bytes, int], n_items: int, n_docs: int, n_words: int):
        """rows: (item's place, term), by place."""
        rows = [(i, t) for i, t in rows if weight.get(t, 0) > 0]
        self.number = {t: k for k, t in enumerate(dict.fromkeys(t for _, t in rows))}
        self.weight = np.array([weight[t] for t in self.number], np.int64)
        self.terms = np.array([self.number[t] for _, t in rows], np.int64)
        self.begins = np.searchsorted(np.array([i for i, _ in rows], np.int64), np.arange(n_items + 1))
        self.n_items, self.n_docs, self.n_words = n_items, n_docs, n_words


class _Trees:
    """The trees of a block's terms, as far as the items have them."""

    def __init__(self, row: dict, items: _Items):
        read = lambda c, t: np.frombuffer(row[c], t)
        self.items, self.ids, self.ptr = items, read("ids", np.int64), read("begins", np.int64)
        of_local = np.array([items.number.get(t, -1) for t in row["terms"]], np.int64)
        # m and the scores are whole numbers, division rounds down
        m = 10 + (90 * read("lengths", np.int64) * items.n_docs) // items.n_words
        tf, doc = read("tf", np.int64), np.repeat(np.arange(len(self.ids)), np.diff(self.ptr))
        self.term = of_local[read("term", np.int32)] if len(of_local) else np.zeros(0, np.int64)
        self.score = np.where(self.term >= 0, items.weight[self.term] if len(items.weight) else 0, 0) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        mine = np.flatnonzero(self.term >= 0)
        self.narrow, self.n_narrow = self._level(self.term[mine], doc[mine] // NARROW, self.score[mine], NARROW)
        term, node, best = self.narrow
        self.wide, self.n_wide = self._level(term, node * NARROW // WIDE, best, WIDE)
        self.root = np.zeros(len(items.weight) + 1, np.int64)  # the last one stays zero
        np.maximum.at(self.root, self.wide[0], self.wide[2])
        self.key = term * self.n_narrow + node
        self.wanted = np.zeros(len(items.weight) + 1, bool)  # the last one is asked for by -1

    def _level(self, term: np.ndarray, node: np.ndarray, score: np.ndarray, size: int) -> tuple[tuple, int]:
        """The greatest score by term and node, sorted; and the number of nodes."""
        n = max(1, -(-len(self.ids) // size))
        key = term * n + node
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        best = np.maximum.reduceat(score[order], first) if len(first) else score[:0]
        return (key[first] // n, key[first] % n, best), n

    def bounds(self) -> np.ndarray:
        """Each item's bound over the block."""
        sums = np.concatenate(([0], np.cumsum(self.root[self.items.terms])))
        return sums[self.items.begins[1:]] - sums[self.items.begins[:-1]]

    @staticmethod
    def _sums(low: np.ndarray, high: np.ndarray, node: np.ndarray, best: np.ndarray, first: int, n: int) -> np.ndarray:
        """The summed scores by node, of the entries in the ranges (low, high), for n nodes from ``first``."""
        size = high - low
        place = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.bincount(node[place] - first, weights=best[place], minlength=n)  # whole numbers far below 2**53

    def best(self, item: int, floor: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the documents that can be among the item's first k, given that scores below ``floor`` cannot."""
        terms = self.items.terms[self.items.begins[item] : self.items.begins[item + 1]]
        at = np.searchsorted(self.wide[0], terms), np.searchsorted(self.wide[0], terms + 1)
        found: list[tuple[int, bool, int]] = []  # a heap, the worst of the best first
        self.wanted[terms] = True
        queue = [(-int(b), 0, j) for j, b in enumerate(self._sums(*at, self.wide[1], self.wide[2], 0, self.n_wide)) if b]
        heapq.heapify(queue)
        floor = max(1, floor)
        while queue and -queue[0][0] >= floor:
            _, deep, j = heapq.heappop(queue)
            if not deep:
                first, n = j * WIDE // NARROW, WIDE // NARROW
                low, high = (np.searchsorted(self.key, terms * self.n_narrow + min(c, self.n_narrow)) for c in (first, first + n))
                for i, b in enumerate(self._sums(low, high, self.narrow[1], self.narrow[2], first, n)):
                    if b >= floor:
                        heapq.heappush(queue, (-int(b), 1, first + i))
                continue
            a, z = j * NARROW, min((j + 1) * NARROW, len(self.ids))
            part = slice(self.ptr[a], self.ptr[z])
            scores = np.add.reduceat(np.where(self.wanted[self.term[part]], self.score[part], 0), self.ptr[a:z] - self.ptr[a])
            for d in np.flatnonzero(scores >= floor):
                doc = int(self.ids[a + d])
                entry = (int(scores[d]), doc != common.NO_ID, -doc)  # without an id last, else the smaller id first
                if len(found) < k:
                    heapq.heappush(found, entry)
                else:
                    heapq.heappushpop(found, entry)
                if len(found) == k:
                    floor = max(floor, found[0][0])
        self.wanted[terms] = False
        return [(s, -d) for s, _, d in found]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cells = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(cells[:, k]) for k in range(len(names))], names)


def _highest_blocks(index: DataFrame, items: _Items) -> DataFrame:
    """item, block and bound: the highest bounds of each task's blocks."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, block = np.zeros((FIRST, items.n_items), np.int64), np.zeros((FIRST, items.n_items), np.int64)
        for row in _rows_of(batches):
            new = _Trees(row, items).bounds()
            bound, block = np.vstack([bound, new]), np.vstack([block, np.full(items.n_items, row["block"])])
            order = np.argsort(-bound, axis=0, kind="stable")[:FIRST]
            bound, block = np.take_along_axis(bound, order, 0), np.take_along_axis(block, order, 0)
        _, item = np.nonzero(bound)
        yield _columns(np.column_stack([item, block[bound > 0], bound[bound > 0]]), ["item", "block", "bound"])

    return index.mapInArrow(look, "item long, block long, bound long")


def _documents(index: DataFrame, items: _Items, floors: np.ndarray, k: int, blocks: dict[int, list[int]] | None = None) -> DataFrame:
    """item, score and doc (its id) that can be among the first k; of ``blocks`` alone, for the items there, if given."""

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            trees = _Trees(row, items)
            asked = np.flatnonzero(trees.bounds() >= np.maximum(floors, 1)) if blocks is None else blocks[row["block"]]
            yield _columns([(i, s, d) for i in asked for s, d in trees.best(i, int(floors[i]), k)], ["item", "score", "doc"])

    if blocks is not None:
        index = index.where(F.col("block").isin([*blocks]))
    return index.mapInArrow(open_blocks, "item long, score long, doc long")


def _ranked(rows: DataFrame) -> DataFrame:
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.when(F.col("doc") != common.NO_ID, F.col("doc")).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(by_score))


def _search_slice(index: DataFrame, terms: DataFrame, n_docs: int, n_words: int, k: int) -> DataFrame:
    """item_id, rank, doc_id and score for items whose terms fit ``ITEM_TERMS`` and ``ITEM_BYTES``."""
    spark = index.sparkSession
    ids = [r["item_id"] for r in terms.select("item_id").distinct().collect()]
    place = {x: i for i, x in enumerate(ids)}
    rows = sorted((place[r["item_id"]], bytes(r["term"])) for r in terms.collect())
    counted = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df")).groupBy("term").agg(F.sum("df").alias("df"))
    weight = {bytes(r["term"]): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in counted.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").collect()}
    items = _Items(rows, weight, len(ids), n_docs, n_words)

    highest = _highest_blocks(index, items).withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block"))).where(F.col("n") <= FIRST)
    blocks: dict[int, list[int]] = {}
    for r in highest.collect():
        blocks.setdefault(r["block"], []).append(r["item"])
    floors = np.zeros(len(ids), np.int64)
    if blocks:
        for r in _ranked(_documents(index, items, floors, k, blocks)).where(F.col("rank") == k).collect():
            floors[r["item"]] = r["score"]
    found = _ranked(_documents(index, items, floors, k)).where(F.col("rank") <= k)
    names = spark.createDataFrame([*enumerate(ids)], f"item long, item_id {terms.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc") != common.NO_ID, F.col("doc")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_docs: int = DOCS, item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: for each item the k documents of the highest score above 0, or all, if fewer.

    Equal scores go by ascending doc_id, a null id last. A null or empty text holds no term, on either side, and an
    item without terms, or whose terms no document holds, has no rows. Rows of ``items`` that share an item_id, or have
    none, are one item with the terms of all. Rows of ``docs`` that repeat an id are documents of their own. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    terms = common.stored(item_terms(items), "item-terms")
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    index = build_index(docs, terms.select("term").distinct(), block_docs)
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    slices = max(1, -(-size["n"] // item_terms_at_once), -(-size["bytes"] // ITEM_BYTES))
    if not size["n"] or not total["docs"]:
        return spark.createDataFrame([], f"item_id {terms.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    of = lambda s: terms if slices == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == s)
    return reduce(DataFrame.unionByName, (_search_slice(index, of(s), total["docs"], total["words"], k) for s in range(slices)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS doc, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM terms WHERE len(w) > 0),
tf AS (SELECT doc, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM terms) GROUP BY ALL),
weight AS (SELECT term, floor(1000::DOUBLE * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1), size),
scored AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_words)))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term), size GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
