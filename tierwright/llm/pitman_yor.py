"""Language-model scoring with a hierarchical Pitman-Yor model.

Three levels share statistical strength. The base is uniform over the vocabulary. The root restaurant seats all words
without context, each as a dish of its own. Every training token, as the token before, has a context restaurant whose
parent is the root. A Gibbs sampler lets all customers of a dish get up and sit down together: what a seating tells is
its number of tables, which is drawn from its distribution given the tables of the restaurant's other dishes and the
parent's probability, with generalised Stirling numbers for the ways to sit. Predictive probabilities are averaged over
its samples.

Words go by 64-bit hashes; the HOT commonest ones that are met twice have numbers too. Pairs of numbered words are kept
in shards by their mixed numbers, as arrays of one row for each shard: tasks count, seat and look up whole arrays. The
tables that contexts hold and send to the root are summed by slices of the numbers. A pair met once has one table
whatever is drawn, and so has all of a word met once; they follow from the words' counts. Words beyond the numbered ones
that are met twice, and their pairs, are rows that are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard_join import STEP, mixed, word_hashes

FOLDS = 5
#: Words that have numbers (at most 2**BITS), and pairs whose predictions go to every task (the commonest ones).
HOT, BITS, COMMON_PAIRS = 2_000_000, 21, 2_000_000
#: Rounds of the sampler between sums over all restaurants, those at the begin that are not kept, and draws of a round.
ROUNDS, BURN_IN, SWEEPS, SEED = 3, 1, 2, 11
#: Customers up to which the ways to sit are counted; beyond, they come from a corrected saddle point. Numbers of tables that a draw
#: looks at then, cells worked on at a time, and steps to the saddle point.
COUNTED, CELLS, HELD_CELLS, STEPS = 400, 256, 1 << 18, 12
#: Tokens that a task works on at a time, and numbers of words in a slice.
HELD_TOKENS, SLICE = 1_500_000, 1 << 14
#: Shards for each shuffle partition.
SHARDS = 4
#: END, the end of a text as a token, among the hashes of words.
END_KEY = np.uint64(0)
BLOCKS = "kind int, at long, x binary, y binary, z binary, b binary"
#: Kinds of blocks: pairs of numbered words, other pairs, sums by slice, and classes of counts.
PAIRS, OTHERS, SUMS, CLASSES = range(4)
#: Numbers of pairs are spread over 2 * BITS bits by an odd factor, which can be undone.
MASK = np.uint64((1 << 2 * BITS) - 1)
FACTOR = np.uint64(0x9E3779B97F4A7C15 & int(MASK) | 1)
BACK = np.uint64(pow(int(FACTOR), -1, 1 << 2 * BITS))


def followers(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every token's token before and of itself, and the tokens of each text; a text begins after END."""
    raw = [t.encode("utf-8", "replace").lower() for t in texts]
    h, begins = word_hashes(b" ".join(raw))
    last = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in raw]))
    after = np.insert(h, last, END_KEY)
    return np.append(END_KEY, after[:-1]), after, np.diff(last, prepend=0) + 1


def pair_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + STEP) + after)


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, the first of all elements before the second of all: what is alike stands together."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def array_of(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(dtype).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their steps, in four bytes each where these suffice."""
    steps = np.diff(keys, prepend=keys[:1])
    small = not len(steps) or int(steps.max()) < 1 << 32
    return (b"\x04" if small else b"\x08") + keys[:1].astype("<u8").tobytes() + planes(steps.astype("<u4" if small else "<u8"))


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    steps = array_of(data[9:], f"<u{data[0]}").astype(np.uint64)
    return np.cumsum(steps, dtype=np.uint64) + np.frombuffer(data[1:9], "<u8")[0]


def numbered(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The key of pairs of word numbers."""
    return ((u.astype(np.uint64) << np.uint64(BITS)) | w.astype(np.uint64)) * FACTOR & MASK


def numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = keys * BACK & MASK
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


def cuts(keys: np.ndarray, shards: int, bits: int = 2 * BITS) -> np.ndarray:
    """Where the shards of sorted keys begin, and the end."""
    bounds = [-(-(s << bits) // shards) for s in range(1, shards)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]])


def summed(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different keys and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, c = keys[order], c[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(c, first) if len(first) else c


def block(kind: int, at: int, *parts: bytes) -> tuple:
    return (kind, at, *parts, *[b""] * (4 - len(parts)))


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "at", "x", "y", "z", "b"])


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """Token hashes, tokens of each text, and the texts' rows without the text, some HELD_TOKENS tokens at a time."""
    held, size = [], 0
    for b in batches:
        _, after, sizes = followers(b["text"])
        held.append((after, sizes, b.drop(columns="text")))
        size += len(after)
        if size > HELD_TOKENS:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pd.concat([h[2] for h in held], ignore_index=True)
            held, size = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pd.concat([h[2] for h in held], ignore_index=True)


def word_counts(train: DataFrame) -> DataFrame:
    """word (its hash) and n of every token, END too, of whole texts; copies meet within a task before they are sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for after, _, _ in chunks(batches):
            words, n = np.unique(after, return_counts=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    return train.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The numbered words: hashes in order, and counts."""

    hashes: np.ndarray
    n: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers; -1 for words without one."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def of_tokens(self, tokens: np.ndarray) -> np.ndarray:
        different, at = np.unique(tokens, return_inverse=True)
        return self.of(different)[at]


class Sums:
    """Sums over the numbered words in a task, which are sent by slices."""

    def __init__(self, words: int, kinds: int):
        self.totals = np.zeros((kinds, words), np.int64)

    def add(self, kind: int, at: np.ndarray, x: np.ndarray) -> None:
        np.add.at(self.totals[kind], at, x)

    def blocks(self) -> Iterator[tuple]:
        for begin in range(0, self.totals.shape[1], SLICE):
            part = self.totals[:, begin : begin + SLICE]
            at = np.flatnonzero(part.any(0))
            if len(at):
                yield block(SUMS, begin // SLICE, planes(at.astype("<u2")), planes(part[:, at].astype("<u4").ravel()))


def total_sums(blocks: DataFrame, words: int, kinds: int) -> np.ndarray:
    """The sums of all tasks (kinds, words), at most HOT of each."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x, y in zip(b["at"].tolist(), b["x"], b["y"]):
                place = array_of(x, "<u2")
                of.setdefault(at, np.zeros((kinds, SLICE), np.int64))[:, place] += array_of(y, "<u4").reshape(kinds, -1)
        yield frame([block(SUMS, at, total.tobytes()) for at, total in of.items()])

    out = np.zeros((kinds, -(-words // SLICE) * SLICE), np.int64)
    sums = common.stored(blocks.where(F.col("kind") == SUMS).select("at", "x", "y").repartition(tasks, "at").mapInPandas(run, BLOCKS).select("at", "x"), "sums")
    for r in sums.toLocalIterator():  # some slices at a time, so that the driver holds the sums once
        out[:, r["at"] * SLICE : (r["at"] + 1) * SLICE] = np.frombuffer(r["x"], np.int64).reshape(kinds, SLICE)
    common.removed(sums)
    return out[:, :words]


def pair_blocks(train: DataFrame, words, shards: int) -> DataFrame:
    """The stored blocks of pairs by shard, with the sums over pairs met twice and classes of their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for after, _, _ in chunks(batches):
            w = words.value.of_tokens(after)
            before = np.append(END_KEY, after[:-1])
            u = np.append(words.value.of(np.array([END_KEY])), w[:-1])
            both = (u >= 0) & (w >= 0)
            keys, c = np.unique(numbered(u[both], w[both]), return_counts=True)
            at = cuts(keys, shards)
            yield frame([block(PAIRS, s, packed(keys[i:j]), planes(c[i:j].astype("<u4"))) for s, (i, j) in enumerate(zip(at, at[1:])) if j > i])
            before, after = before[~both], after[~both]
            keys, first, c = np.unique(pair_key(before, after), return_index=True, return_counts=True)
            at = cuts(keys, shards, 64)
            yield frame([block(OTHERS, s, planes(before[first[i:j]]), planes(after[first[i:j]]), planes(c[i:j].astype("<u4"))) for s, (i, j) in enumerate(zip(at, at[1:])) if j > i])

    def merged(kind: int, at: int, parts: list[tuple], sums: Sums, classes: np.ndarray) -> tuple:
        if kind == PAIRS:
            keys, c = summed(np.concatenate([unpacked(x) for x, _, _ in parts]), np.concatenate([array_of(y, "<u4") for _, y, _ in parts]).astype(np.int64))
            twice = c > 1
            u, w = numbers(keys[twice])
            for kind_of, place, x in ((0, u, c[twice]), (1, u, np.ones(len(u), np.int64)), (2, w, c[twice])):
                sums.add(kind_of, place, x)
            np.add.at(classes, count_class(c), 1)
            return block(PAIRS, at, packed(keys[twice]), planes(c[twice].astype("<u4")), packed(keys[~twice]))
        before, after, c = (np.concatenate([array_of(p[i], t) for p in parts]) for i, t in enumerate(("<u8", "<u8", "<u4")))
        keys, total = summed(pair_key(before, after), c.astype(np.int64))
        _, first = np.unique(pair_key(before, after), return_index=True)
        np.add.at(classes[1024:], np.minimum(total, 3), 1)
        return block(OTHERS, at, planes(before[first]), planes(after[first]), planes(total.astype("<u4")))

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, classes, now, parts = Sums(len(words.value.n), 3), np.zeros(1028, np.int64), None, []
        for b in batches:
            for kind, at, *part in zip(b["kind"].tolist(), b["at"].tolist(), b["x"], b["y"], b["z"]):
                if parts and (kind, at) != now:
                    yield frame([merged(*now, parts, sums, classes)])
                    parts = []
                now = kind, at
                parts.append(part)
        if parts:
            yield frame([merged(*now, parts, sums, classes)])
        yield frame([*sums.blocks(), block(CLASSES, 0, classes.tobytes())])

    tasks = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = train.select("text").mapInPandas(run, BLOCKS)
    return common.stored(found.repartition(tasks, "at").sortWithinPartitions("kind", "at").mapInPandas(reduce, BLOCKS), "pair-blocks")


def count_class(c: np.ndarray) -> np.ndarray:
    return np.minimum((16 * np.log2(c)).astype(np.int64), 1023)


@lru_cache(4)
def counted_ways(d: float) -> np.ndarray:
    """Logarithms of the weighted ways for c customers to sit at t tables, c and t up to COUNTED: a table of k customers
    weighs (1 - d)(2 - d)...(k - 1 - d)."""
    out = np.full((COUNTED + 1, COUNTED + 1), -np.inf)
    out[0, 0] = 0.0
    tables = np.arange(1, COUNTED + 1)
    with np.errstate(invalid="ignore"):
        for c in range(COUNTED):
            joins = np.log(np.maximum(c - d * tables, 1e-300)) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], joins)
    return out


def saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithm of y = 1 - x where the saddle point of g(x)**t / x**c lies, g = (1 - y**d) / d: x * g' / g is c / t there.

    Newton's steps from the left in log y come to it.
    """
    ratio = np.log(c / t)
    log_y = np.minimum((np.log(d) - ratio) / (1 - d), -1e-9)
    for _ in range(STEPS):
        y, power = np.exp(log_y), np.exp(d * log_y)
        x, g = np.maximum(-np.expm1(log_y), 1e-12), np.maximum(-np.expm1(d * log_y), 1e-12)
        value = np.log(x) + (d - 1) * log_y + np.log(d) - np.log(g) - ratio
        log_y = np.minimum(log_y - value / np.minimum(-y / x + (d - 1) + d * power / g, -1e-9), -1e-9)
    return log_y


def saddle_coefficient(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The logarithm of the coefficient of x**c in g**t by the saddle point alone."""
    log_y = saddle(c, t, d)
    x, g = -np.expm1(log_y), -np.expm1(d * log_y) / d
    first = x * np.exp((d - 1) * log_y) / g
    spread = t * (first + (1 - d) * x * x * np.exp((d - 2) * log_y) / g - first * first)
    return t * np.log(g) - c * np.log(x) - 0.5 * np.log(np.maximum(2 * np.pi * spread, 1e-300))


def coefficient(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same (of c and t in one dimension) by an integral along y = s * (1 + iu)**2, a parabola around the cut y < 0.

    Where few tables make g**t nearly constant, the constant, which has no part in the coefficient, is taken off first.
    """
    s = np.maximum(np.exp(saddle(c, t, d)), 4 / c)
    end = np.sqrt(45 / ((1 - d) * c * s))
    u = np.linspace(0, 1, 513) * end[:, None]
    y = s[:, None] * (1 + 1j * u) ** 2
    power, rest = t[:, None] * np.log(1 - y**d), -(c[:, None] + 1) * np.log(1 - y)
    level = (t * s**d < 1)[:, None]
    top = np.where(level, 0, power[:, :1].real) + rest[:, :1].real
    value = np.where(level, np.expm1(np.where(level, power, 0)) * np.exp(np.where(level, rest - top, 0)), np.exp(np.where(level, 0, power + rest - top)))
    along = (value * (1 + 1j * u)).real
    along[:, 0] /= 2
    return np.log(along.sum(1) * end / 512 * 2 * s / np.pi) + top[:, 0] - t * np.log(d)


#: Steps of the grid on which the saddle point is corrected, in the logarithms of customers and tables, and rows of it.
GRID, GRID_ROWS = 0.35, 60


@lru_cache(4)
def corrections(d: float) -> np.ndarray:
    """What the saddle point lacks, on a grid of customers from COUNTED on and tables from 1 on."""
    c = np.repeat(COUNTED * np.exp(GRID * np.arange(GRID_ROWS)), GRID_ROWS + 20)
    t = np.minimum(np.tile(np.exp(GRID * np.arange(GRID_ROWS + 20)), GRID_ROWS), 0.9 * c)
    out = np.concatenate([coefficient(c[i : i + 100], t[i : i + 100], d) - saddle_coefficient(c[i : i + 100], t[i : i + 100], d) for i in range(0, len(c), 100)])
    return out.reshape(GRID_ROWS, GRID_ROWS + 20)


def saddle_ways(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """As ``counted_ways``, less what hangs on c alone, for c from COUNTED on.

    The ways are c! / t! times the coefficient of x**c in g**t: its saddle point, corrected between the grid's points.
    """
    t = np.minimum(t, c - 0.5)
    table = corrections(d)
    i, j = np.minimum(np.log(c / COUNTED) / GRID, GRID_ROWS - 1.001), np.minimum(np.log(t) / GRID, GRID_ROWS + 18.999)
    k, m = i.astype(np.int64), j.astype(np.int64)
    i, j = i - k, j - m
    more = (1 - i) * ((1 - j) * table[k, m] + j * table[k, m + 1]) + i * ((1 - j) * table[k + 1, m] + j * table[k + 1, m + 1])
    return saddle_coefficient(c, t, d) + more - log_gamma(t + 1)


def drawn(log_weight: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """SWEEPS columns of each row by the exponentials of its weights."""
    total = np.cumsum(np.exp(log_weight - log_weight.max(1, keepdims=True)), 1)
    return [(total <= rng.random(len(total))[:, None] * total[:, -1:]).sum(1) for _ in range(SWEEPS)]


def tables_of(c: np.ndarray, p: np.ndarray, theta: float, d: float, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """SWEEPS draws of the tables of dishes with c customers, given the tables ``others`` of each restaurant's other dishes.

    t tables have the weight p**t * theta' * (theta' + d) ... (theta' + (t - 1) d) times the ways to sit at them, with
    theta' = theta + d * others. Up to COUNTED customers the ways are counted; beyond, CELLS equal cells around the
    weightiest number (all numbers there, where they are no more) have the weights of their middles, by a corrected saddle point.
    """
    t = np.tile(np.minimum(c, 1), (SWEEPS, 1))
    start, log_p = theta / d + others, np.log(d * np.maximum(p, 1e-300))
    ways, few = counted_ways(d), np.flatnonzero((c > 1) & (c <= COUNTED))
    few = few[np.argsort(c[few], kind="stable")]
    ends = np.append(np.flatnonzero(np.diff(c[few])) + 1, len(few)) if len(few) else []
    begin = 0
    for end in ends:
        k = int(c[few[begin]])
        step = max(1, HELD_CELLS // k)
        for at in range(begin, end, step):
            i = few[at : min(at + step, end)]
            rising = np.cumsum(np.log(start[i, None] + np.arange(k)) + log_p[i, None], 1)
            t[:, i] = drawn(rising + ways[k, 1 : k + 1], rng)
            t[:, i] += 1
        begin = end
    many, step = np.flatnonzero(c > COUNTED), HELD_CELLS // CELLS // 4
    for at in range(0, len(many), step):
        i = many[at : at + step]
        t[:, i] = far_tables(c[i].astype(float), start[i], log_p[i], d, rng)
    return t


def far_tables(c: np.ndarray, start: np.ndarray, log_p: np.ndarray, d: float, rng: np.random.Generator) -> list[np.ndarray]:
    """``tables_of`` dishes of more than COUNTED customers."""

    def weight(t: np.ndarray) -> np.ndarray:
        wide = lambda x: x if t.ndim == 1 else x[:, None]
        return saddle_ways(wide(c), t, d) + log_gamma(wide(start) + t) + t * wide(log_p)

    low, high = np.ones(len(c)), c.copy()
    while (high - low > 0.5).any():  # the weightiest number: the first from which one more table weighs less
        mid = np.floor((low + high) / 2)
        rises = (weight(np.minimum(mid + 1, c)) > weight(mid)) & (mid < c)
        low, high = np.where(rises, mid + 1, low), np.where(rises, high, mid)
    best = low
    # how far the weight falls by e**-18 to either side, by doubling
    top, reach = weight(best), np.full(len(c), 8.0)
    for _ in range(40):
        near = np.maximum(weight(np.maximum(best - reach, 1)) * (best - reach > 1) + (top - 99) * (best - reach <= 1), weight(np.minimum(best + reach, c)) * (best + reach < c) + (top - 99) * (best + reach >= c)) > top - 18
        if not near.any():
            break
        reach = np.where(near, 2 * reach, reach)
    first, last = np.maximum(best - reach, 1), np.minimum(best + reach, c)
    step = np.ceil((last - first + 1) / CELLS)
    cells = first[:, None] + step[:, None] * np.arange(CELLS)
    inside = cells <= last[:, None]
    middles = np.minimum(cells + (step[:, None] - 1) / 2, c[:, None])
    found = drawn(np.where(inside, weight(middles), -np.inf), rng)
    return [np.minimum(first + step * x + np.floor(rng.random(len(c)) * step), last).astype(np.int64) for x in found]


def strength(customers: np.ndarray, tables: np.ndarray, times: np.ndarray, d: float, rng: np.random.Generator) -> float:
    """A draw of theta from its posterior on a grid, given customers and tables of restaurants that share it."""
    grid = np.geomspace(0.1, 1000, 25)
    key, order = customers.astype(np.int64), np.lexsort((tables, customers))
    key, t = key[order], tables.astype(np.int64)[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])))
    m, c, t = np.add.reduceat(times[order], first), key[first].astype(float), t[first].astype(float)
    score = np.array([(m * (t * np.log(d) + log_gamma(th / d + t) - lgamma(th / d) - log_gamma(th + c) + lgamma(th))).sum() - np.log(th) for th in grid])
    w = np.exp(score - score.max())
    return float(rng.choice(grid, p=w / w.sum()))


def kinds_of(customers: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (customers, tables) of restaurants and how often each is met, found by slices; some may repeat."""
    found = []
    for begin in range(0, len(customers), SLICE):
        c, t = customers[begin : begin + SLICE], tables[begin : begin + SLICE]
        order = np.lexsort((t, c))
        c, t = c[order], t[order]
        first = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])))
        found.append((c[first], t[first], np.diff(np.append(first, len(c)))))
    return tuple(np.concatenate([x[i] for x in found] or [np.zeros(0)]).astype(float) for i in range(3))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - sum(np.log(x + k) for k in range(8))


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))


@dataclass
class Level:
    """What restaurants are seated with in a round: tables of each numbered context, the root's probability of each
    numbered word, and the contexts' strength."""

    tables: np.ndarray
    p: np.ndarray
    theta: float
    d: float


@dataclass
class Fitted:
    """The whole model.

    a and p (kept rounds, numbered words): what each context leaves to the root, and the root's predictions. once and
    fresh: the root's prediction of a word met once, and of a new one, by round. rest: word, n, a_k and p_k of the words
    without a number. pairs: blocks with the sums b of what the rounds predict of pairs met twice, and the keys of others.
    others: before, after and b of the pairs without numbers.
    """

    words: Words
    total: int
    vocabulary: int
    tail: bool
    d: float
    pairs: DataFrame
    classes: np.ndarray
    others: DataFrame
    rest: DataFrame
    thetas: list[float] = field(default_factory=list)
    once: list[float] = field(default_factory=list)
    fresh: list[float] = field(default_factory=list)
    a: list[np.ndarray] = field(default_factory=list)
    p: list[np.ndarray] = field(default_factory=list)


def one_round(c: np.ndarray, t: np.ndarray, tables: np.ndarray, p: np.ndarray, theta: float, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables after a round over dishes that have t of their restaurants' tables, and the sum of tables over its draws."""
    found = tables_of(c, p, theta, d, np.maximum(tables - t, 0), rng)
    return found[-1], found.sum(0)


def seated_blocks(pairs: DataFrame, words, level, turn: int) -> DataFrame:
    """The stored blocks after a round, with the sums over contexts (tables, tables of all sweeps) and words (tables)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n = level.value, words.value.n
        sums = Sums(len(n), 3)
        for batch in batches:
            out = []
            for at, x, y, z, b in zip(batch["at"].tolist(), batch["x"], batch["y"], batch["z"], batch["b"]):
                rng = np.random.default_rng([SEED, turn, at])
                u, w = numbers(unpacked(x))
                c = array_of(y, "<u4").astype(np.int64)
                before = array_of(z, "<u4").astype(np.int64) if turn else np.ones(len(c), np.int64)
                t, met = one_round(c, before, now.tables[u], now.p[w], now.theta, now.d, rng)
                predicted = array_of(b, "<f4").astype(float) if turn > BURN_IN else np.zeros(len(c))
                if turn >= BURN_IN:
                    predicted = predicted + (c - now.d * met / SWEEPS) / (now.theta + n[u])
                for kind, place, v in ((0, u, t), (1, u, met), (2, w, t)):
                    sums.add(kind, place, v)
                out.append(block(PAIRS, at, x, y, planes(t.astype("<u4")), planes(predicted.astype("<f4"))))
            yield frame(out)
        yield frame([*sums.blocks()])

    return common.stored(pairs.mapInPandas(run, BLOCKS), f"seats-{turn}")


def seated_rows(rows: DataFrame, words, level, turn: int) -> DataFrame:
    """The stored rows (before, after, c, t, b, met) after a round; rows have tables of contexts and p of words
    that have no number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, hot = level.value, words.value
        rng = np.random.default_rng([SEED, turn, 1 << 20, TaskContext.get().partitionId()])
        for batch in batches:
            if not len(batch):
                continue
            c = batch["c"].to_numpy(np.int64)
            u, w = (hot.of(batch[x].to_numpy(np.int64).view(np.uint64)) for x in ("before", "after"))
            of = lambda at, table, own: np.where(at >= 0, table[np.maximum(at, 0)] if len(table) else 0.0, own.to_numpy(float))
            n = of(u, hot.n, batch["n"])
            t, met = one_round(c, batch["t"].to_numpy(np.int64), of(u, now.tables, batch["tables"]), of(w, now.p, batch["p"]), now.theta, now.d, rng)
            b = batch["b"].to_numpy(float) + ((c - now.d * met / SWEEPS) / (now.theta + n) if turn >= BURN_IN else 0)
            yield batch[["before", "after", "c"]].assign(t=t, b=b, met=met)

    return common.stored(rows.mapInPandas(run, "before long, after long, c long, t long, b double, met long"), f"seated-rows-{turn}")


def root_tables(c: np.ndarray, t: np.ndarray, base: float, theta: float, d: float, tables: float, rng: np.random.Generator) -> np.ndarray:
    """The root's tables of dishes with c customers after a round, from t of its ``tables`` before."""
    out = np.empty(len(c), np.int64)
    for begin in range(0, len(c), SLICE):  # dishes do not look at each other, so some are seated at a time
        part = slice(begin, begin + SLICE)
        size = len(c[part])
        out[part] = one_round(c[part], t[part], np.full(size, tables), np.full(size, base), theta, d, rng)[0]
    return out


def root_rows(rows: DataFrame, base: float, theta: float, d: float, tables: float, turn: int) -> DataFrame:
    """The stored words without number (word, n, tables, c and what else they have) with the root's tables t, after a round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([SEED, turn, 2 << 20, TaskContext.get().partitionId()])
        for b in batches:
            yield b.assign(t=root_tables(b["c"].to_numpy(np.int64), b["t"].to_numpy(np.int64), base, theta, d, tables, rng))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return common.stored(rows.mapInPandas(run, schema), f"root-{turn}")


def added(total: np.ndarray, words: Words, sums: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> np.ndarray:
    """``total`` of the numbered words with the sums (word, x) of rows; of these at most HOT have a number."""
    rows = kept(sums).toArrow().to_pandas()
    at = words.of(rows["word"].to_numpy(np.int64).view(np.uint64))
    out = total.copy()
    np.add.at(out, at, rows["x"].to_numpy(np.int64))
    return out


def fit(train: DataFrame) -> tuple[Fitted, DataFrame]:
    """The model of the training texts, and the stored counts of all their words."""
    spark, rng = train.sparkSession, np.random.default_rng(SEED)
    counts = common.stored(word_counts(train), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    twice = counts.where("n > 1")
    is_hot = (F.col("n") > 1) & common.commonest(twice, "n", HOT)
    found = counts.where(is_hot).toArrow()
    hashes = found["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    words = Words(hashes[order], found["n"].to_numpy().astype(np.int64)[order])
    del found, hashes, order
    tail = twice.where(~is_hot)
    has_tail = whole["v"] - whole["once"] > len(words.n)
    shared = spark.sparkContext.broadcast(words)
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pair_blocks(train, shared, shards)
    common.tidied(spark)
    classes = np.sum([np.frombuffer(r["x"], np.int64) for r in blocks.where(F.col("kind") == CLASSES).select("x").collect()] or [np.zeros(1028, np.int64)], 0)  # one row a task
    d, d_root, theta, theta_root = discount(int(classes[0] + classes[1025]), int(classes[16] + classes[1026])), 0.5, 1.0, 1.0
    with_sums = total_sums(blocks, len(words.n), 3)
    others = other_pairs(blocks)
    v, n = whole["v"], words.n
    base = 1 / (v + 1)
    state = blocks.where(F.col("kind") == PAIRS)
    rows = common.stored(others.where("c > 1").select("before", "after", "c", F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("b")), "other-pairs") if has_tail else None

    def numbered_only(sums: DataFrame) -> DataFrame:
        return sums.join(tail.select("word"), "word", "left_anti")

    def by(side: str, x: Column) -> DataFrame:
        return rows.groupBy(F.col(side).alias("word")).agg(F.sum(x).alias("x"))

    def joined(t: DataFrame, side: str, x: Column, name: str) -> DataFrame:
        return t.join(by(side, x).withColumnRenamed("x", name), "word", "left")

    ones_u, ones_w = n - with_sums[0], n - with_sums[2]
    tables = ones_u + with_sums[1]
    if has_tail:
        one = F.lit(1).cast("long")
        lone = lambda side: (F.col("n") - F.coalesce(f"c_{side}", F.lit(0)))
        ones_u, ones_w = added(ones_u, words, by("before", -F.col("c")), numbered_only), added(ones_w, words, by("after", -F.col("c")), numbered_only)
        tables = added(added(tables, words, by("before", -F.col("c")), numbered_only), words, by("before", one), numbered_only)
        rest = joined(joined(joined(tail, "before", F.col("c"), "c_b"), "after", F.col("c"), "c_a"), "before", one, "k")
        rest = common.stored(rest.select("word", "n", lone("b").alias("ones_b"), lone("a").alias("ones_a"), (lone("b") + F.coalesce("k", F.lit(0))).alias("tables"), one.alias("t"), (F.col("n") / F.lit(float(whole["n"]))).alias("p")), "words-without-number")
    p, t, all_t = n / max(1, whole["n"]), np.ones(len(n), np.int64), float(v)
    del with_sums
    out = Fitted(words, whole["n"], v, has_tail, d, state, classes, others, counts)
    a_names: list[str] = []
    for turn in range(ROUNDS):
        if turn:
            level.destroy()  # what was made with it is stored
        level = spark.sparkContext.broadcast(Level(tables.astype(float), p.astype(float), theta, d))
        last, state = state, seated_blocks(state.where(F.col("kind") == PAIRS), shared, level, turn)
        if turn:
            common.removed(last)
        sat, over, root = total_sums(state, len(n), 3)
        tables, mean, c = ones_u + sat, ones_u + over / SWEEPS, ones_w + root
        del sat, over, root
        tail_c = tail_t = 0
        if has_tail:
            u = rest.select(F.col("word").alias("before"), "n", "tables")
            w = rest.select(F.col("word").alias("after"), "p")
            rows = seated_rows(rows.join(u, "before", "left").join(w, "after", "left"), shared, level, turn)
            tables, c = added(tables, words, by("before", F.col("t")), numbered_only), added(c, words, by("after", F.col("t")), numbered_only)
            mean = added(mean * SWEEPS, words, by("before", F.col("met")), numbered_only) / SWEEPS
            rest = joined(joined(joined(rest.drop("tables", "c"), "before", F.col("t"), "s"), "before", F.col("met"), "m"), "after", F.col("t"), "r")
            more = [((F.lit(theta) + d * (F.col("ones_b") + F.coalesce("m", F.lit(0)) / SWEEPS)) / (F.lit(theta) + F.col("n"))).alias(f"a_{len(out.a)}")] if turn >= BURN_IN else []
            rest = rest.select("word", "n", "t", "ones_b", "ones_a", *a_names, *more, (F.col("ones_b") + F.coalesce("s", F.lit(0))).alias("tables"), (F.col("ones_a") + F.coalesce("r", F.lit(0))).alias("c"))
            rest = root_rows(rest, base, theta_root, d_root, all_t, turn)
            sums = rest.agg(F.sum("c").alias("c"), F.sum("t").alias("t")).first()
            tail_c, tail_t = sums["c"], sums["t"]
        t = root_tables(c, t, base, theta_root, d_root, all_t, rng)
        all_c, all_t = float(c.sum() + tail_c + whole["once"]), float(t.sum() + tail_t + whole["once"])
        fresh = (theta_root + d_root * all_t) / (theta_root + all_c) * base
        p = (c - d_root * t) / (theta_root + all_c) + fresh
        if has_tail:
            name = [f"p_{len(out.p)}"] if turn >= BURN_IN else []
            rest = rest.withColumn("p", (F.col("c") - d_root * F.col("t")) / (theta_root + all_c) + fresh)
            rest = rest.withColumns({x: F.col("p") for x in name})
            a_names += [f"a_{len(out.a)}", *name] if name else []
        del c
        if turn >= BURN_IN:
            out.thetas.append(theta)
            out.once.append((1 - d_root) / (theta_root + all_c) + fresh)
            out.fresh.append(fresh)
            out.a.append(((theta + d * mean) / (theta + n)).astype(np.float32))
            out.p.append(p.astype(np.float32))
        del mean
        cells = [kinds_of(n, tables), (np.ones(1), np.ones(1), np.full(1, whole["once"]))]
        if has_tail:
            # few kinds of restaurants: no such word is met more often than the rarest with a number
            kinds = rest.groupBy("n", "tables").agg(F.count("*").alias("m")).toArrow().to_pandas()
            cells.append(tuple(kinds[x].to_numpy(float) for x in ("n", "tables", "m")))
        theta = strength(*(np.concatenate([x[i] for x in cells]) for i in range(3)), d, rng)
        theta_root = strength(np.array([all_c]), np.array([all_t]), np.ones(1), d_root, rng)
    out.pairs = state.where(F.col("kind") == PAIRS).select("kind", "at", "x", "y", "b").unionByName(blocks.where(F.col("kind") == PAIRS).select(F.lit(PAIRS + 10).alias("kind"), "at", F.col("z").alias("x"), F.lit(b"").alias("y"), F.lit(b"").alias("b")))
    of_pairs = others.select("before", "after", "c")
    out.others = of_pairs.where("c = 1").withColumn("b", F.lit(None).cast("double")) if not has_tail else of_pairs.where("c = 1").withColumn("b", F.lit(None).cast("double")).unionByName(rows.select("before", "after", "c", "b"))
    columns = [x for k in range(len(out.a)) for x in (f"a_{k}", f"p_{k}")]
    constant = {x: (lambda k: (out.thetas[k] + d) / (out.thetas[k] + 1) if x[0] == "a" else out.once[k])(int(x[2:])) for x in columns}
    singles = counts.where("n = 1").select("word", "n", *(F.lit(float(constant[x])).alias(x) for x in columns))
    out.rest = singles.unionByName(rest.select("word", "n", *columns)) if has_tail else singles
    return out, counts


def other_pairs(blocks: DataFrame) -> DataFrame:
    """before, after and c of the pairs without numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y, z in zip(b["x"], b["y"], b["z"]):
                yield pd.DataFrame({"before": array_of(x, "<u8").view(np.int64), "after": array_of(y, "<u8").view(np.int64), "c": array_of(z, "<u4").astype(np.int64)})

    return blocks.where(F.col("kind") == OTHERS).select("x", "y", "z").mapInPandas(run, "before long, after long, c long")


PARTS = "kind int, at long, chunk long, pos int, doc_id long, n_tokens long, n_known long, base double, model double, x binary, y binary, z binary"
ROW, ASKED, APART = range(3)


@dataclass
class Scorer:
    """What tasks score with: the model's arrays, and the commonest pairs' keys and predictions."""

    words: Words
    base: np.ndarray
    keys: np.ndarray
    b: np.ndarray
    a: np.ndarray
    p: np.ndarray
    thetas: np.ndarray
    once: np.ndarray
    d: float
    tail: bool


def common_pairs(model: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and predictions of the commonest pairs, at most COMMON_PAIRS."""
    total, least = 0, 1024
    for k in range(1023, 15, -1):
        total += int(model.classes[k])
        if total > COMMON_PAIRS:
            break
        least = k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y, z in zip(b["x"], b["y"], b["b"]):
                often = count_class(array_of(y, "<u4").astype(np.int64)) >= least
                yield pd.DataFrame({"key": unpacked(x)[often].view(np.int64), "b": array_of(z, "<f4")[often]})

    found = model.pairs.where(F.col("kind") == PAIRS).mapInPandas(run, "key long, b float").toArrow()
    keys, b = found["key"].to_numpy(), found["b"].to_numpy()
    order = np.argsort(keys)
    return keys[order].view(np.uint64), b[order]


def scored_parts(rows: DataFrame, scorer, shards: int, floor: float) -> DataFrame:
    """The stored parts: rows with what a task knows by itself, pairs that are asked for by shard, and tokens apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, number = scorer.value, 0
        part = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in PARTS.split(", ")]
        blank = (None, None, None, None, None, None)
        for after, sizes, texts in chunks(batches):
            chunk, number = part + number, number + 1
            of = np.repeat(np.arange(len(sizes)), sizes)
            w = m.words.of_tokens(after)
            before = np.append(END_KEY, after[:-1])
            u = np.append(m.words.of(np.array([END_KEY])), w[:-1])
            hot_w = w >= 0
            both = (u >= 0) & hot_w
            trained = ~texts["held_out"].to_numpy(bool)
            score, known = np.zeros(len(after)), hot_w.copy()
            base = np.where(hot_w, m.base[np.maximum(w, 0)] if len(m.base) else 0.0, 0.0)
            at = np.flatnonzero(both)
            keys = numbered(u[at], w[at])
            order = np.argsort(keys)
            at, keys = at[order], keys[order]
            place = np.minimum(np.searchsorted(m.keys, keys), max(0, len(m.keys) - 1))
            hit = m.keys[place] == keys if len(m.keys) else np.zeros(len(keys), bool)
            i = at[hit]
            score[i] = np.log10(((m.a[:, u[i]] * m.p[:, w[i]]).sum(0) + m.b[place[hit]]) / len(m.a))
            apart = np.flatnonzero(~both)
            if not m.tail:
                # all pairs of a training text were met, and one without numbers has a word met once
                own = apart[trained[of[apart]]]
                a = np.where(u[own] >= 0, m.a[:, np.maximum(u[own], 0)] if m.a.shape[1] else 1.0, ((m.thetas + m.d) / (m.thetas + 1))[:, None])
                p = np.where(w[own] >= 0, m.p[:, np.maximum(w[own], 0)] if m.p.shape[1] else 1.0, m.once[:, None])
                n = np.where(u[own] >= 0, m.words.n[np.maximum(u[own], 0)] if len(m.words.n) else 1, 1)
                score[own] = np.log10((a * p + (1 - m.d) / (m.thetas[:, None] + n)).mean(0))
                once = own[w[own] < 0]
                known[once], base[once] = True, np.log10(1.5 / floor)
                apart = apart[~trained[of[apart]]]
            sums = [np.bincount(of, x, len(sizes)) for x in (known, base, score)]
            out = pd.DataFrame({"kind": ROW, "at": 0, "chunk": chunk, "pos": np.arange(len(sizes)), "doc_id": texts["doc_id"], "n_tokens": sizes, "n_known": sums[0].astype(np.int64), "base": sums[1], "model": sums[2]})
            yield out.assign(x=None, y=None, z=None)[names]
            keys, asked = keys[~hit], of[at[~hit]].astype("<u4")
            ends = cuts(keys, shards)
            yield pd.DataFrame([(ASKED, s, chunk, *blank, packed(keys[i:j]), planes(asked[i:j]), None) for s, (i, j) in enumerate(zip(ends, ends[1:])) if j > i], columns=names)
            if len(apart):
                yield pd.DataFrame([(APART, 0, chunk, *blank, planes(before[apart]), planes(after[apart]), planes(of[apart].astype("<u4")))], columns=names)

    return common.stored(rows.mapInPandas(run, PARTS), "scored-parts")


def answered(model: Fitted, parts: DataFrame, scorer) -> DataFrame:
    """chunk, pos and the model's log probability of the pairs that were asked for, by shards and then by chunks."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ask = parts.where(F.col("kind") == ASKED).select(F.lit(20).alias("kind"), "at", "chunk", "x", "y", F.lit(b"").alias("b"))
    known = model.pairs.withColumn("chunk", F.lit(0).cast("long")).select("kind", "at", "chunk", "x", "y", "b")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, shard, empty = scorer.value, None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for kind, at, chunk, x, y, b in zip(batch["kind"].tolist(), batch["at"].tolist(), batch["chunk"].tolist(), batch["x"], batch["y"], batch["b"]):
                if at != shard:
                    shard, twice, of_twice, once = at, empty, np.zeros(0), empty
                keys = unpacked(x)
                if kind == PAIRS:
                    twice, of_twice = keys, array_of(b, "<f4").astype(float)
                elif kind == PAIRS + 10:
                    once = keys
                else:
                    u, w = numbers(keys)
                    total = (m.a[:, u] * m.p[:, w]).sum(0)
                    for table, values in ((twice, of_twice), (once, None)):
                        if len(table):
                            place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                            hit = table[place] == keys
                            total[hit] += values[place[hit]] if values is not None else ((1 - m.d) / (m.thetas[:, None] + m.words.n[u[hit]])).sum(0)
                    pos, of = np.unique(array_of(y, "<u4"), return_inverse=True)
                    out.append((chunk, planes(pos), np.bincount(of, np.log10(total / len(m.a)), len(pos)).tobytes()))
            yield pd.DataFrame(out, columns=["chunk", "x", "y"])

    found = known.unionByName(ask).repartition(tasks, "at").sortWithinPartitions("at", "kind").mapInPandas(resolve, "chunk long, x binary, y binary")

    def collected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(0)

        def rows() -> pd.DataFrame:
            pos = np.flatnonzero(total)
            return pd.DataFrame({"chunk": now, "pos": pos.astype(np.int32), "model": total[pos]})

        for b in batches:
            for chunk, x, y in zip(b["chunk"].tolist(), b["x"], b["y"]):
                if chunk != now:
                    if now is not None:
                        yield rows()
                    now, total = chunk, np.zeros(0)
                pos = array_of(x, "<u4")
                if len(pos) and pos[-1] >= len(total):
                    total = np.append(total, np.zeros(int(pos[-1]) + 1 - len(total)))
                total[pos] += np.frombuffer(y, float)
        if now is not None:
            yield rows()

    return found.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInPandas(collected, "chunk long, pos int, model double")


def apart(model: Fitted, parts: DataFrame, scorer, floor: float) -> DataFrame:
    """chunk, pos, n_known, base and model of the tokens whose pair has no numbers, each joined with what is known."""
    k = range(len(model.a))
    columns = [x for i in k for x in (f"a{i}", f"p{i}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = scorer.value
        for b in batches:
            for chunk, x, y, z in zip(b["chunk"].tolist(), b["x"], b["y"], b["z"]):
                before, after = array_of(x, "<u8"), array_of(y, "<u8")
                u, w = m.words.of(before), m.words.of(after)
                of = lambda at, table: pd.array(np.where(at >= 0, table[np.maximum(at, 0)] if len(table) else 0.0, np.nan), "Float64")
                values = {f"a{i}": of(u, m.a[i]) for i in k} | {f"p{i}": of(w, m.p[i]) for i in k} | {"nu": of(u, m.words.n)}
                for c in values:
                    values[c][np.isnan(values[c].to_numpy(float, na_value=np.nan))] = pd.NA
                yield pd.DataFrame({"chunk": chunk, "pos": array_of(z, "<u4").astype(np.int32), "before": before.view(np.int64), "after": after.view(np.int64)} | values)

    schema = "chunk long, pos int, before long, after long, " + ", ".join(f"{c} double" for c in (*(f"a{i}" for i in k), *(f"p{i}" for i in k), "nu"))
    rows = parts.where(F.col("kind") == APART).select("chunk", "x", "y", "z").mapInPandas(run, schema)
    # words with a number get keys that match nothing and do not meet in one task
    alone = F.xxhash64("chunk", "pos", "before", "after")
    rows = rows.withColumns({"key_u": F.when(F.col("nu").isNull(), F.col("before")).otherwise(alone), "key_w": F.when(F.col("p0").isNull(), F.col("after")).otherwise(alone)})
    of = lambda side: model.rest.select(F.col("word").alias(f"key_{side}"), F.col("n").alias(f"n_{side}"), *(F.col(f"{c}_{i}").alias(f"{c}_{i}_{side}") for i in k for c in "ap"))
    met = rows.join(of("u"), "key_u", "left").join(of("w"), "key_w", "left").join(model.others.select("before", "after", "c", "b"), ["before", "after"], "left")
    n = F.coalesce("nu", "n_u", F.lit(0.0))
    a = [F.coalesce(f"a{i}", f"a_{i}_u", F.lit(1.0)) for i in k]
    p = [F.coalesce(f"p{i}", f"p_{i}_w", F.lit(model.fresh[i])) for i in k]
    once = [F.lit(1 - model.d) / (F.lit(th) + n) for th in model.thetas]
    total = sum((x * y for x, y in zip(a, p)), F.lit(0.0)) + F.when(F.col("c") == 1, sum(once, F.lit(0.0))).otherwise(F.coalesce("b", F.lit(0.0)))
    c = F.when(F.col("p0").isNull(), F.coalesce("n_w", F.lit(0)))
    return met.groupBy("chunk", "pos").agg(F.sum(F.coalesce((c > 0).cast("long"), F.lit(0))).alias("n_known"), F.sum(F.coalesce(F.log10((c + 0.5) / floor), F.lit(0.0))).alias("base"), F.sum(F.log10(total / len(model.a))).alias("model"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity, one row a row of ``docs``.

    A null or empty text is its end only. Rows may repeat; each is scored by itself. A null id counts as training.
    Without training tokens all words are unknown and the model is uniform. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = common.in_small_batches(docs).select(common.key_of(docs).alias("doc_id"), common.text_of(docs).alias("text"), common.held_out(docs["doc_id"], FOLDS).alias("held_out"))
    model, _ = fit(rows.where(~F.col("held_out")))
    floor = float(model.total + 0.5 * (model.vocabulary + 1))
    keys, b = common_pairs(model)
    common.tidied(spark)
    scorer = spark.sparkContext.broadcast(Scorer(model.words, np.log10((model.words.n + 0.5) / floor), keys, b, np.array(model.a), np.array(model.p), np.array(model.thetas), np.array(model.once), model.d, model.tail))
    parts = scored_parts(rows, scorer, SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions")), floor)
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    columns = ["chunk", "pos", "doc_id", "n_tokens", "n_known", "base", "model"]
    of_pairs = answered(model, parts, scorer).select("chunk", "pos", none("long", "doc_id"), none("long", "n_tokens"), none("long", "n_known"), none("double", "base"), "model")
    of_others = apart(model, parts, scorer, floor).select("chunk", "pos", none("long", "doc_id"), none("long", "n_tokens"), "n_known", "base", "model")
    whole = parts.where(F.col("kind") == ROW).select(*columns).unionByName(of_pairs).unionByName(of_others)
    whole = whole.groupBy("chunk", "pos").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), *(F.sum(c).alias(c) for c in ("n_known", "base", "model"))).withColumn("doc_id", common.id_of())
    return whole.select(
        "doc_id", common.held_out(F.col("doc_id"), FOLDS).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("model").alias("score"), F.pow(F.lit(10.0), -F.col("model") / F.col("n_tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
