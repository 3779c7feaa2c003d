"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles under one global order: shingles that many documents share stand last. Two
similar sets must share l of the first n - T + l elements (T: the least overlap, n: the size), for every l; each
document takes the l that an estimate of its candidate cost favours, so costly documents get longer prefixes and need
more shared prefix elements. Equal sets are one class from the outset. Within a posting list, the documents first meet
the list's likely origins, by which most lists become one component. What is left outside a list's largest part is met
with the list where it is little. A longer list is taken apart by what sets its documents apart from its origin: two of
them that are not near it are similar only if they share some of these elements, by prefixes again, and most of such
elements are one document's own. No link between components is lost, and no group's pairs are enumerated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components, merged

#: Shingles whose prefix postings number at least this many are put last in the order; of them the commonest KNOWN.
COMMON, KNOWN = 24, 400_000
#: Prefix surpluses (l) that a document chooses from, and the cost of verifying a candidate in posting reads.
CHOICES, VERIFY = (1, 2, 3, 4, 6, 8), 40.0
#: Rows of a batch that a task works on at a time, where their sets are large beside their texts.
TOGETHER = 500
#: Documents outside a list's main part up to which each is met with the whole list, and those of a group that are sent
#: one copy of the set that the group is compared with.
FEW, SALTED = 32, 64
#: Documents of a group that are asked what most of it hold, and rounds in which variants are taken out of groups.
ASKED, ROUNDS = 64, 8
HEAVY = np.uint64(1 << 63)
NOTHING = np.zeros(1, np.uint64)
#: Signatures of sets that a task remembers.
SEEN = 200_000
#: Bytes of texts whose words are hashed side by side; words of more than this many bytes are hashed one by one.
HELD_BYTES, LONG_WORD = 1 << 20, 64
STEP = np.uint64(0x9E3779B97F4A7C15)
IN_WORD = ~np.isin(np.arange(256), [*range(0x09, 0x0E), 0x20])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the murmur3 finalizer's fixed constants)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A value for each byte of a word.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)


class Shingler:
    """Sets of hashed word shingles, many texts in one numpy array."""

    def __init__(self, words: int):
        self.width = words

    def shingles(self, text: str) -> np.ndarray:
        """The sorted different shingle hashes; a text of fewer words is one shingle, one without words has none."""
        return next(self.sets([text]))

    def sets(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """``shingles`` of each text."""
        waiting, held = [], 0
        for text in texts:
            waiting.append(text.encode("utf-8", "replace").lower())  # on bytes, lower() knows ASCII only
            held += len(waiting[-1])
            if held >= HELD_BYTES:
                yield from self._sets(waiting)
                waiting, held = [], 0
        yield from self._sets(waiting)

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        joined = b" ".join(texts)
        h, begins = word_hashes(joined)
        ends = np.cumsum([len(t) + 1 for t in texts])
        last = np.searchsorted(begins, ends).tolist()
        rolled = combined(h, self.width) if len(h) >= self.width else h[:0]
        for lo, hi in zip([0, *last], last):
            if hi - lo < self.width:
                yield combined(h[lo:hi], hi - lo) if hi > lo else h[:0]
                continue
            own = np.sort(rolled[lo : hi - self.width + 1])
            yield own[np.append(True, own[1:] != own[:-1])]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the begin of each word between runs of ASCII white space, in their order."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], IN_WORD[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begins, lengths = edge[::2], edge[1::2] - edge[::2]
    order = np.argsort(-lengths, kind="stable")
    at, size = begins[order], lengths[order]
    h = size.astype(np.uint64)
    long_ones = int(np.searchsorted(-size, -LONG_WORD, "left"))
    for i in range(long_ones):
        h[i] = xxhash.xxh64_intdigest(text[at[i] : at[i] + size[i]])
    # the words that have a k-th byte are the first ones, since they stand by length
    still = np.searchsorted(-size, -np.arange(LONG_WORD), "left")
    for k in range(LONG_WORD):
        part = slice(long_ones, int(still[k]))
        if part.stop <= part.start:
            break
        h[part] = h[part] * STEP + BYTE_VALUES[raw[at[part] + k]]
    out = np.empty_like(h)
    out[order] = mixed(h)
    return out, begins


def combined(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` words that stand together."""
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * STEP + h[k : len(h) - width + 1 + k]
    return mixed(out)


def least_overlap(n: int, percent: int) -> int:
    """Elements of a set of n that any set similar to it holds."""
    return -(-percent * n // 100)


def keys_under(shingles: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The set's elements as sortable keys: a rare shingle by its hash, a common one after all of them by its rank.

    heavy: hashes of common shingles sorted by hash, and their ranks, as two rows.
    """
    keys = shingles >> np.uint64(1)
    if heavy.shape[1]:
        at = np.minimum(np.searchsorted(heavy[0], shingles), heavy.shape[1] - 1)
        hit = heavy[0][at] == shingles
        keys[hit] = HEAVY | heavy[1][at[hit]]
    keys.sort()
    return keys


def surplus(keys: np.ndarray, df_of_rank: np.ndarray, percent: int) -> int:
    """The l of least estimated cost: postings read, and candidates, at most one for every l postings, verified."""
    n = len(keys)
    first = n - least_overlap(n, percent)
    lead = keys[: first + CHOICES[-1]]
    heavy = lead >= HEAVY
    if not heavy[: first + 1].any():
        return 1
    df = np.ones(len(lead))
    df[heavy] = df_of_rank[(lead[heavy] ^ HEAVY).astype(np.int64)]
    total = np.cumsum(df)
    costs = [(total[first + c - 1] * (1 + VERIFY / c), c) for c in CHOICES if first + c <= min(n, len(lead))]
    return min(costs)[1] if costs else 1


def first_share(n: int, percent: int) -> int:
    """How many elements of a set, first by their hashes, are counted: half as many again as a prefix has."""
    return -(-n * (100 - percent) * 3 // 200) + 2


def signature(s: np.ndarray) -> tuple[int, int, int]:
    """n, s1 and s2, which name a set."""
    return len(s), int(s.sum(dtype=np.uint64)), int(mixed(s).sum(dtype=np.uint64))


def signed(rows: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    t = np.array(rows, np.uint64).reshape(-1, 3).view(np.int64)
    return {"n": t[:, 0], "s1": t[:, 1], "s2": t[:, 2]}


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The stored (doc, x, n, s1, s2, firsts) of every row; s1 and s2 name the set, firsts are its first elements."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in batches:
            out, firsts = [], []
            for s in shingler.sets(b["text"]):
                out.append(signature(s))
                firsts.append(s[: first_share(len(s), percent)].astype("<u8").tobytes() if len(s) else b"")
            yield pd.DataFrame({"doc": b["doc"].to_numpy(), "x": b["x"].to_numpy()} | signed(out) | {"firsts": firsts})

    return common.stored(docs.mapInPandas(name, "doc long, x long, n long, s1 long, s2 long, firsts binary"), "signatures")


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), TOGETHER):
            yield b.iloc[at : at + TOGETHER]


def tallied(sets: list[np.ndarray]) -> pd.DataFrame:
    """shingle and df of some sets, summed before they are sent."""
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    return pd.DataFrame({"shingle": values.view(np.int64), "df": n.astype(np.int64)})


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= COMMON)


def frequent(named: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The commonest shingles (at most KNOWN) with their counts.

    First, all documents' first elements are counted. Where that leaves a document fewer rare elements than its
    prefix needs, what comes next in it was never counted: all shingles of such documents (one of each class) are
    counted in a second step.
    """

    def count_firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield tallied([np.frombuffer(b"".join(b["firsts"]), "<u8")])

    first = common.stored(summed(named.select("firsts").mapInPandas(count_firsts, "shingle long, df long")), "first-counts")
    known = first.where(common.commonest(first, "df", KNOWN)).select("shingle").toArrow().to_pandas()["shingle"]
    shared = named.sparkSession.sparkContext.broadcast(np.sort(known.to_numpy(np.int64).view(np.uint64)))

    def lacking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            keep = []
            for n, blob in zip(b["n"].tolist(), b["firsts"]):
                s = np.frombuffer(blob, "<u8")
                common_ones = (known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s).sum() if len(known) else 0
                keep.append(bool(common_ones) and len(s) - common_ones < n - least_overlap(n, percent) + 1)
            yield b.loc[keep, ["doc"]]

    dense = named.select("doc", "n", "firsts").join(classes.select(F.col("class").alias("doc")).distinct(), "doc", "left_semi").mapInPandas(lacking, "doc long").distinct()
    dense = common.sized(common.stored(dense, "dense-documents"), 500_000)

    def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in pieces(batches):
            yield tallied([*shingler.sets(b["text"])])

    second = summed(texts.join(dense, "doc", "left_semi").select("text").mapInPandas(count_all, "shingle long, df long"))
    both = common.stored(first.unionByName(second).groupBy("shingle").agg(F.max("df").alias("df")), "counts")
    return both.where(common.commonest(both, "df", KNOWN))


def heavy_table(common_ones: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks (the commonest last) for ``keys_under``, and the postings by rank; at most KNOWN rows."""
    rows = common_ones.toArrow().to_pandas()
    hashes, df = rows["shingle"].to_numpy(np.int64).view(np.uint64), rows["df"].to_numpy(np.int64)
    order = np.lexsort((hashes, df))
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    by_hash = np.argsort(hashes)
    return np.stack([hashes[by_hash], rank[by_hash]]), df[order].astype(float)


def whole_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The stored (doc, set) of the classes that ``wanted`` (doc) names; texts that share an id are told apart by their sets."""
    chosen = classes.join(common.sized(wanted, 500_000), "doc", "left_semi")
    holders = common.sized(chosen.select(F.col("class").alias("doc")).distinct(), 500_000)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in pieces(batches):
            sets = [*shingler.sets(b["text"])]
            yield pd.DataFrame(signed([signature(s) for s in sets]) | {"set": [s.view(np.int64) for s in sets]})

    sets = texts.join(holders, "doc", "left_semi").select("text").mapInPandas(whole, "n long, s1 long, s2 long, set array<long>")
    own = common.sized(chosen.select("n", "s1", "s2", "doc"), 500_000)
    return common.stored(sets.join(own, ["n", "s1", "s2"]).select("doc", "set").dropDuplicates(["doc"]), "candidate-sets")


def verified(pairs: DataFrame, prefixes: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: first by their prefixes, where these rule them out, then whole."""
    of = lambda t, side, *cs: t.select(F.col("doc").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in cs))

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for n, m, x, y in zip(b["n_a"], b["n_b"], b["lead_a"], b["lead_b"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                need = -(-percent * (n + m) // (100 + percent))
                last = min(x[-1], y[-1])
                p, q = np.searchsorted(x, last, "right"), np.searchsorted(y, last, "right")
                shared = len(np.intersect1d(x[:p], y[:q], True))
                keep.append(n - (p - shared) >= need and m - (q - shared) >= need)
            yield b.loc[keep, ["a", "b"]]

    pairs = pairs.join(of(prefixes, "a", "n", "lead"), "a").join(of(prefixes, "b", "n", "lead"), "b")
    pairs = common.stored(pairs.select("a", "b", "n_a", "n_b", "lead_a", "lead_b").mapInPandas(possible, "a long, b long"), "possible-pairs")
    sets = whole_sets(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), classes, texts, words)
    return similar_pairs(pairs, sets, percent)


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose whole sets are similar."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b")), "b")
    met = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    similar = (F.col("shared") > 0) & (F.col("shared") * 100 >= (F.col("sizes") - F.col("shared")) * percent)
    return common.stored(met.where(similar).select("a", "b"), "links")


def similar_sizes(n: str, m: str, percent: int) -> F.Column:
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def room(n: str, m: F.Column, percent: int) -> F.Column:
    """Elements that a set of n may have for itself and still be similar to one of m."""
    return F.col(n) - F.ceil((F.col(n) + m) * percent / (100 + percent))


def star_pairs(lists: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the documents of each list with its hubs (key, hub, m, hub_alone), where they may be similar."""
    possible = similar_sizes("n", "m", percent) & (F.col("alone") <= room("n", F.col("m"), percent)) & (F.col("hub_alone") <= room("m", F.col("n"), percent))
    return lists.join(hubs, "key").where((F.col("doc") != F.col("hub")) & possible).select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def apart_lists(lists: DataFrame, place: DataFrame) -> DataFrame:
    """The stored lists that components (node, component) leave in several parts: with part, main (the largest) and outside,
    the number of postings that are not in main."""
    apart = lists.join(place.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "doc", "n", "l", "alone", "singles", "density", F.coalesce("component", "doc").alias("part"))
    parts = apart.groupBy("key", "part").agg(F.count("*").alias("members")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("part", F.struct("members", "part")).alias("main"), (F.sum("members") - F.max("members")).alias("outside"))
    return common.stored(apart.join(parts.where("parts > 1").drop("parts"), "key"), "open-lists")


def differing(members: DataFrame, refs: DataFrame, sets: DataFrame, heavy: Broadcast, percent: int) -> DataFrame:
    """The stored (group, doc, n, d, key, pos) of what sets the members (group, doc, ref) of groups apart from the set of ref
    (refs: ref, of_ref).

    d is the number of elements that only one of the two sets holds. Of these come first those that the document adds,
    the rare ones before the common ones, and then those that it lacks. Two documents of a group that are similar share
    all but so many of them as ``most_apart`` says, so those further back are not kept. A document equal to ref has a
    row without key.
    """
    salts = members.groupBy("ref").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    refs = refs.join(salts, "ref").select("ref", "salts", "of_ref", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    own = members.join(sets, "doc").join(common.sized(salts, 500_000), "ref").withColumn("salt", F.pmod(F.xxhash64("doc"), "salts").cast("int")).drop("salts")
    both = own.join(refs.drop("salts"), ["ref", "salt"]).select("group", "doc", "set", "of_ref")

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, _ = heavy.value
        for b in batches:
            out, keys = [], []
            for group, doc, x, h in zip(b["group"].tolist(), b["doc"].tolist(), b["set"], b["of_ref"]):
                x, h = np.asarray(x, np.int64).view(np.uint64), np.asarray(h, np.int64).view(np.uint64)
                added, lacks = keys_under(np.setdiff1d(x, h, True), table), keys_under(np.setdiff1d(h, x, True), table)
                lead = np.concatenate([added, lacks])[: (100 - percent) * len(x) // percent + 1]
                out.append((group, doc, len(x), len(added) + len(lacks)))
                keys.append(lead if len(lead) else NOTHING)
            if out:
                times = np.array([len(k) for k in keys])
                table_of = np.repeat(np.array(out, np.int64), times, 0)
                pos = np.arange(len(table_of)) - np.repeat(np.cumsum(times) - times, times)
                key = pd.arrays.IntegerArray(np.concatenate(keys).view(np.int64), np.repeat([k is NOTHING for k in keys], times))
                yield pd.DataFrame(table_of, columns=["group", "doc", "n", "d"]).assign(key=key, pos=pos.astype(np.int32))

    return common.stored(both.mapInPandas(apart, "group long, doc long, n long, d long, key long, pos int"), "differences")


def most_apart(n: F.Column, m: F.Column, percent: int) -> F.Column:
    """Elements that only one of two similar sets of n and m elements may hold."""
    return F.floor((n + m) * (100 - percent) / (100 + percent))


def met_apart(x: DataFrame, y: DataFrame, percent: int, once: F.Column) -> DataFrame:
    """Pairs (a, b) of x with y (rows of ``differing`` with part and main) that may be similar though both do not lie near ref.

    Of what sets two such documents apart from ref, they share ``least`` elements, the first of them where enough others
    still follow on both sides. Most elements that documents add are theirs alone, and those stand first, so that of a
    group's pairs only few meet.
    """
    name = lambda t, s: t.where("key IS NOT NULL").select("group", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "d", "pos", "part", "main")))
    c = F.col
    least = F.ceil((c("d_x") + c("d_y") - most_apart(c("n_x"), c("n_y"), percent)) / 2)
    enough = (least >= 1) & (F.least(c("d_x") - c("pos_x"), c("d_y") - c("pos_y")) >= least) & (c("pos_x") + c("pos_y") <= most_apart(c("n_x"), c("n_y"), percent))
    met = name(x, "x").join(name(y, "y"), ["group", "key"]).where(once & enough & similar_sizes("n_x", "n_y", percent))
    return met.select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).distinct()


def consensus(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored (group, of_ref) of the groups (group, doc): the elements that more than half of their documents hold.

    Of large groups ``ASKED`` documents are asked. A set of no single document is nearer to all of them than any of
    theirs, which has what is that document's alone. A group of up to ``FEW`` documents, whose pairs are few whatever the
    set, has the set of its first document.
    """
    size = common.stored(members.groupBy("group").agg(F.count("*").alias("m"), F.min("doc").alias("doc")), "group-sizes")
    of_first = size.where(F.col("m") <= FEW).join(sets, "doc").select("group", F.col("set").alias("of_ref"))
    large = size.where(F.col("m") > FEW).select("group")
    nth = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("doc"), "doc"))
    asked = members.join(common.sized(large, 500_000), "group").select("group", "doc", nth.alias("nth")).where(F.col("nth") <= ASKED).drop("nth")
    held = asked.join(sets, "doc").select("group", F.explode("set").alias("element")).groupBy("group", "element").agg(F.count("*").alias("c"))
    asked_of = F.least(F.col("m"), F.lit(ASKED))
    most = held.join(size, "group").where(F.col("c") * 2 > asked_of).groupBy("group").agg(F.collect_list("element").alias("of_ref"))
    of_most = large.join(most, "group", "left").select("group", F.coalesce("of_ref", F.array().cast("array<long>")).alias("of_ref"))
    return common.stored(of_first.unionByName(of_most), "consensus")


def beyond(n: str, d: str, percent: int) -> F.Column:
    """v: two documents of a group with v + v' <= 0 are similar, whatever they share."""
    return F.col(d) * (100 + percent) - F.col(n) * (100 - percent)


def variants(places: DataFrame, sets: DataFrame, heavy: Broadcast, percent: int) -> tuple[DataFrame, DataFrame]:
    """The components (node, component) in groups around consensus sets: the rows of ``differing`` with component, and the
    sets (group, component, of_ref).

    More than ``FEW`` documents that are far from their group's consensus and share what sets them apart from it, as a
    variant of a page does, become a group with a consensus of their own, again and again. An element that more than half
    of a group hold is in its consensus, so a group's variants have less than half of it, and few rounds do.
    """
    members = places.select(F.col("component").alias("group"), F.col("node").alias("doc"), "component")
    whole, refs = [], []
    for _ in range(ROUNDS):
        ref = consensus(members.select("group", "doc"), sets)
        refs.append(ref.join(members.select("group", "component").distinct(), "group"))
        apart = differing(members.select("group", "doc", F.col("group").alias("ref")), ref.withColumnRenamed("group", "ref"), sets, heavy, percent).join(members, ["group", "doc"])
        far = apart.where("key IS NOT NULL").where(beyond("n", "d", percent) > 0)
        hot = far.groupBy("group", "key").agg(F.count("*").alias("df")).where(F.col("df") > FEW)
        # of the elements that many share each document goes by the one that most share
        moved = far.join(common.sized(hot, 500_000), ["group", "key"]).groupBy("group", "doc", "component").agg(F.max_by("key", F.struct("df", "key")).alias("by"))
        moved = common.stored(moved.select(F.xxhash64("group", "by").alias("to"), "group", "doc", "component"), "variants")
        whole.append(apart.join(moved.select("group", "doc"), ["group", "doc"], "left_anti"))
        members = moved.select(F.col("to").alias("group"), "doc", "component")
        if not moved.limit(1).count():
            break
    else:
        ref = consensus(members.select("group", "doc"), sets)
        refs.append(ref.join(members.select("group", "component").distinct(), "group"))
        whole.append(differing(members.select("group", "doc", F.col("group").alias("ref")), ref.withColumnRenamed("group", "ref"), sets, heavy, percent).join(members, ["group", "doc"]))
    return common.stored(reduce(DataFrame.unionByName, whole), "apart"), common.stored(reduce(DataFrame.unionByName, refs), "references")


def across(own: DataFrame, refs: DataFrame, sets: DataFrame, heavy: Broadcast, percent: int) -> DataFrame:
    """The rows of ``differing`` of documents against the sets of other groups of their component, the groups with smaller
    names; of groups so far apart that no two of their documents can be similar, none."""
    size = own.where("pos = 0").groupBy("group", "component").agg(F.max("d").alias("radius"), F.max("n").alias("n"))
    several = size.groupBy("component").agg(F.count("*").alias("groups")).where("groups > 1").select("component")
    each = size.join(several, "component").join(refs.select("group", "of_ref"), "group")
    of = lambda s: each.select("component", *(F.col(c).alias(f"{c}_{s}") for c in ("group", "radius", "n", "of_ref")))
    between = F.size("of_ref_x") + F.size("of_ref_y") - 2 * F.size(F.array_intersect("of_ref_x", "of_ref_y"))
    near = of("x").join(of("y"), "component").where(F.col("group_x") < F.col("group_y"))
    near = near.where(between <= F.col("radius_x") + F.col("radius_y") + most_apart(F.col("n_x"), F.col("n_y"), percent)).select(F.col("group_x").alias("ref"), F.col("group_y").alias("group"))
    pairs = common.stored(own.where("pos = 0").select("group", "doc").join(near, "group").select(F.col("ref").alias("group"), "doc", "ref"), "across")
    return differing(pairs, refs.select(F.col("group").alias("ref"), "of_ref"), sets, heavy, percent)


def degrees(places: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int, heavy: Broadcast) -> DataFrame:
    """doc and links: how many classes each is similar to, for all classes in components (node, component).

    Similar classes share a component. Two of them are looked at against one set, the consensus of a group that one of
    them, at least, belongs to. Two with v + v' <= 0 (``beyond``) are similar whatever they share, and are counted by a
    running sum over the values of v. Others have to share elements that set them apart; they are met by these and
    compared. What many documents of a group share does not set them apart, so few pairs meet, whatever the group's size.
    """
    sets = whole_sets(places.select(F.col("node").alias("doc")), classes, texts, words)
    own, refs = variants(places, sets, heavy, percent)
    columns = ["group", "doc", "n", "d", "key", "pos"]
    apart = own.select(*columns, F.lit(True).alias("part")).unionByName(across(own, refs, sets, heavy, percent).select(*columns, F.lit(False).alias("part")))
    apart = common.stored(apart.withColumn("main", F.lit(True)), "apart-all")
    each = apart.where("pos = 0").select("group", "doc", F.col("part").alias("own"), beyond("n", "d", percent).alias("v"))
    cells = each.groupBy("group", "v").agg(F.count("*").alias("m"), F.count_if("own").alias("m_own"))
    # a question for -v stands after the values that equal it
    none = F.lit(0).cast("long")
    events = cells.select("group", F.col("v").alias("at"), F.lit(0).alias("asks"), "m", "m_own", "v").unionByName(cells.select("group", (-F.col("v")).alias("at"), F.lit(1).alias("asks"), none.alias("m"), none.alias("m_own"), "v"))
    so_far = Window.partitionBy("group").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    below = events.select("group", "v", "asks", F.sum("m").over(so_far).alias("near"), F.sum("m_own").over(so_far).alias("near_own")).where("asks = 1").drop("asks")
    # the group's own count all that was measured against its set, the others count the group's own
    counted = F.when(F.col("own"), F.col("near") - F.when(F.col("v") <= 0, 1).otherwise(0)).otherwise(F.col("near_own"))
    near = each.join(below, ["group", "v"]).select("doc", counted.alias("links"))
    once = ~F.col("part_y") | (F.col("doc_x") < F.col("doc_y"))
    pairs = similar_pairs(met_apart(apart.where("part"), apart, percent, once), sets, percent)
    found = pairs.select(F.col("a").alias("doc"), F.lit(1).cast("long").alias("links")).unionByName(pairs.select(F.col("b").alias("doc"), F.lit(1).cast("long").alias("links")))
    return near.unionByName(found).groupBy("doc").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id and links of every row of ``docs``.

    Sets of ``words``-word shingles link when their Jaccard similarity is at least ``percent`` hundredths.
    component_id is the smallest doc_id that links lead to. class_id is the smallest doc_id with an equal set. links is
    the number of other classes that the class is similar to; copies of it are not counted.
    A text without words, empty or null, has no shingles and is linked with nothing, not even its likes. A null id
    is an id like others. Rows that share an id but not the text are rows of their own. Other columns are not looked at.
    """
    rows = linked(docs, words, percent)
    id_of = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return rows.select(id_of("doc").alias("doc_id"), F.col("n").alias("n_shingles"), id_of("component_id").alias("component_id"), id_of("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def linked(docs: DataFrame, words: int, percent: int, count_links: bool = True) -> DataFrame:
    """doc, x (the text's hash), n, class, component_id and part of every row, and links where they are to be counted.

    Classes of equal sets have numbers of their own; ids name them in the result only. part is the component's number,
    null for texts without words.
    """
    spark = common.in_small_batches(docs).sparkSession
    texts = docs.select(common.key_of(docs).alias("doc"), common.text_of(docs).alias("text"), F.xxhash64(common.text_of(docs)).alias("x"))
    named = signatures(texts, words, percent)
    classes = named.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("class"))
    classes = common.stored(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    heavy, df_of_rank = heavy_table(frequent(named, classes, texts, words, percent))
    shared = spark.sparkContext.broadcast((heavy, df_of_rank))

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, df = shared.value
        shingler, weight, met = Shingler(words), np.log2(np.maximum(df, 1)), set()
        for b in batches:
            out, names = [], []
            for s in shingler.sets(b["text"]):
                if not len(s) or (named_as := signature(s)) in met:
                    continue  # one of a task's equal sets is enough
                if len(met) > SEEN:
                    met.clear()
                met.add(named_as)
                keys = keys_under(s, table)
                if len(keys):
                    l = surplus(keys, df, percent)
                    common_ones = (keys[keys >= HEAVY] ^ HEAVY).astype(np.int64)
                    length = len(keys) - least_overlap(len(keys), percent) + l
                    names.append(named_as)
                    out.append((l, float(weight[common_ones].sum()) / len(keys), keys[:length].astype("<u8").tobytes()))
            yield pd.DataFrame(out, columns=["l", "density", "lead"]).assign(**signed(names))

    leads = texts.select("text").mapInPandas(lead, "n long, s1 long, s2 long, l int, density double, lead binary")
    prefixes = leads.join(classes.drop("class"), ["n", "s1", "s2"]).select("doc", "n", "l", "density", "lead").dropDuplicates(["doc"])
    prefixes = common.stored(prefixes, "prefixes")
    common.tidied(spark)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            times = b["lead"].map(len).to_numpy() // 8
            keys = np.frombuffer(b"".join(b["lead"]), "<u8").view(np.int64)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"key": keys, "doc": np.repeat(b["doc"].to_numpy(), times), "place": place.astype(np.int32)})

    # most postings are alone under their key and go no further, so they travel without their document's other columns
    postings = prefixes.select("doc", "lead").mapInPandas(post, "key long, doc long, place int")
    shared_keys = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    met = postings.join(shared_keys, "key").join(prefixes.select("doc", "n", "l", "density", (F.octet_length("lead") / 8).cast("int").alias("length")), "doc")
    # Elements of a prefix that no other prefix has: ``alone`` stand before a posting, and the two documents that meet
    # there both lack all of the other's.
    of_doc = Window.partitionBy("doc")
    met_before = F.row_number().over(of_doc.orderBy("place")) - 1
    lists = met.withColumn("alone", F.col("place") - met_before).withColumn("singles", F.col("length") - F.count("*").over(of_doc))
    least = F.ceil(F.col("n") * percent / 100)
    lists = common.stored(lists.where(F.col("alone") <= room("n", least, percent)).select("key", "doc", "n", "l", "alone", "singles", "density"), "posting-lists")

    # The first hub has least of its own, so it is the likely origin of the list's near copies.
    origin, dense = F.struct("singles", (-F.col("density")).alias("d"), "doc"), F.struct((-F.col("density")).alias("d"), "doc")
    hubs = lists.groupBy("key").agg(F.min_by(F.struct("doc", "n", "alone"), origin).alias("first"), F.min_by(F.struct("doc", "n", "alone"), dense).alias("densest"))
    hubs = common.stored(hubs, "hubs")
    as_hub = lambda t, h: t.select("key", F.col(f"{h}.doc").alias("hub"), F.col(f"{h}.n").alias("m"), F.col(f"{h}.alone").alias("hub_alone"))
    stars = star_pairs(lists, as_hub(hubs, "densest").unionByName(as_hub(hubs.where("first <> densest"), "first")), percent)
    near = verified(stars, prefixes, classes, texts, words, percent)
    place = components(near)
    common.tidied(spark)
    open_lists, far = apart_lists(lists, place), []
    long = open_lists.where(F.col("outside") > FEW)
    if count := long.where("part <> main").select("doc").distinct().count():
        # a second star in each long list, from what lies nearest to its origin outside the main part
        second = long.where("part <> main").groupBy("key").agg(F.min_by(F.struct("doc", "n", "alone"), origin).alias("first"))
        more = verified(star_pairs(long, as_hub(second, "first"), percent), prefixes, classes, texts, words, percent)
        far.append(more)
        if more.count() * 16 > count:
            place, far = merged(place, more), []
            open_lists = apart_lists(lists, place)
            long = open_lists.where(F.col("outside") > FEW)
    few = open_lists.where(F.col("outside") <= FEW)
    side = lambda t, s: t.select("key", "main", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "l", "alone", "part")))
    x, y = side(few.where("part <> main"), "x").drop("main"), side(few, "y")
    once = (F.col("part_x") != F.col("part_y")) & ((F.col("part_y") == F.col("main")) | (F.col("doc_x") < F.col("doc_y")))
    enough = (F.col("alone_x") <= room("n_x", F.col("n_y"), percent)) & (F.col("alone_y") <= room("n_y", F.col("n_x"), percent))
    met = x.join(y, "key").where(once & similar_sizes("n_x", "n_y", percent) & enough)
    counted = met.groupBy(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b")).agg(F.count("*").alias("met"), F.first(F.least("l_x", "l_y")).alias("least"))
    far.append(verified(counted.where("met >= least").select("a", "b"), prefixes, classes, texts, words, percent))

    # A list with much outside its main part is a group around its densest document, with which all of it was compared.
    of_hub = long.join(hubs.select("key", F.col("densest.doc").alias("ref")), "key").select(F.col("ref").alias("group"), "doc", "ref", "part").distinct()
    of_hub = common.stored(of_hub.unionByName(of_hub.select("group", F.col("ref").alias("doc"), "ref").distinct().join(place.select(F.col("node").alias("doc"), "component"), "doc", "left").select("group", "doc", "ref", F.coalesce("component", "doc").alias("part"))).distinct(), "groups")
    if of_hub.limit(1).count():
        sets = whole_sets(of_hub.select("doc").distinct(), classes, texts, words)
        apart = differing(of_hub.select("group", "doc", "ref"), sets.select(F.col("doc").alias("ref"), F.col("set").alias("of_ref")), sets, shared, percent).join(of_hub.select("group", "doc", "part"), ["group", "doc"])
        main = of_hub.where("doc = ref").select("group", F.col("part").alias("main"))
        apart = common.stored(apart.join(common.sized(main, 500_000), "group"), "differences-of-parts")
        once = (F.col("part_x") != F.col("part_y")) & ((F.col("part_y") == F.col("main_y")) | (F.col("doc_x") < F.col("doc_y")))
        far.append(similar_pairs(met_apart(apart.where("part <> main"), apart, percent, once), sets, percent))
    common.tidied(spark)
    final = merged(place, reduce(DataFrame.union, far))
    of_class = classes.join(final.select(F.col("node").alias("doc"), F.col("component")), "doc", "left").withColumn("part", F.coalesce("component", "doc"))
    if count_links:
        of_class = of_class.join(degrees(final, classes, texts, words, percent, shared), "doc", "left")
    names = of_class.where("component IS NOT NULL").groupBy("component").agg(F.min("class").alias("name"))
    of_class = of_class.join(names, "component", "left").withColumn("component_id", F.coalesce("name", "class")).drop("component", "name", "doc")
    rows = named.select("doc", "x", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left")
    return rows.withColumn("class", F.coalesce("class", "doc")).withColumn("component_id", F.coalesce("component_id", "doc"))


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that come first in their component, by doc_id and then the text's hash, with all their columns.

    Texts without words are all kept.
    """
    found = common.stored(linked(docs, words, percent, count_links=False).where("part IS NOT NULL").select("part", "doc", "x"), "linked")
    first = found.groupBy("part").agg(F.min(F.struct("doc", "x")).alias("first"))
    dropped = found.join(first, "part").where(F.struct("doc", "x") != F.col("first")).select(F.col("doc").alias("drop_key"), F.col("x").alias("drop_x")).distinct()
    return docs.join(dropped, (common.key_of(docs) == dropped["drop_key"]) & (F.xxhash64(common.text_of(docs)) == dropped["drop_x"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"), words=3, percent=90)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (sh) GROUP BY ALL),
l AS (SELECT a, b, k = na.n AND k = nb.n AS same FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, min(b) AS class_id FROM l WHERE same GROUP BY 1),
t AS (SELECT l.a, count(DISTINCT k.class_id) AS links FROM l JOIN k ON k.a = l.b WHERE NOT same GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(links, 0) AS links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id LEFT JOIN t ON t.a = d.doc_id
"""
