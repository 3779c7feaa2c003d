"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf of a word's tree holds the rank of the pair that starts at that symbol, joined with its position, and each
inner node the least of its two children. The root therefore names the leftmost pair of the lowest rank. A merge
changes three leaves and the paths above them; the word is finished when the root holds no pair. The trees of many
words are kept in one array and take their merges side by side.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words whose codes a Python worker remembers; beyond that it starts anew (speed only, never results).
REMEMBERED = 150_000
#: Characters of texts whose new words are merged side by side.
TOGETHER = 1_000_000
NONE = np.iinfo(np.int64).max
#: Unicode white space, as the pattern's regular expression engine has it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each of the 256 bytes."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary file of a word-level BPE tokenizer: words end in a suffix, white space is dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.token = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.final = np.array([vocab[s + suffix] for s in signs], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", SPACES), regex.V0)
        self._pairs: dict[int, int] = {}
        self.codes: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            classes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for leaves, members in classes.items():
            if len(members) < 48:
                for i in members:
                    out[i] = self._merge_one(words[i], leaves)
                continue
            step = max(1, (1 << 20) // leaves)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge_class([words[i] for i in part], leaves)):
                    out[i] = ids
        return out

    def _merge_one(self, word: bytes, n: int) -> np.ndarray:
        """The same tree for a single word: numpy's calls would cost more than they spare."""
        pairs, size = self.pairs(), self.size
        symbol = [*self.inner[np.frombuffer(word, np.uint8)].tolist()]
        symbol[-1] = int(self.final[word[-1]])
        length = len(symbol)
        following, before = [*range(1, length), n], [*range(-1, length - 1)]
        tree = [NONE] * (2 * n)

        def leaf(at: int) -> int:
            after = following[at]
            rank = pairs.get(symbol[at] * size + symbol[after]) if after < n else None
            return NONE if rank is None else rank * n + at

        def put(at: int, value: int) -> None:
            node = at + n
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        tree[n : n + length] = map(leaf, range(length))
        for node in range(n - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != NONE:
            rank, i = divmod(tree[1], n)
            gone = following[i]
            symbol[i], symbol[gone] = int(self.merged[rank]), -1
            following[i] = after = following[gone]
            if after < n:
                before[after] = i
            put(gone, NONE)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([x for x in symbol if x >= 0], np.int64)

    def pairs(self) -> dict[int, int]:
        if not self._pairs:
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self._pairs

    def _merge_class(self, words: list[bytes], n: int) -> list[np.ndarray]:
        rows, lengths = len(words), np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(rows, n)
        place = np.arange(n)
        symbol = self.inner[raw]
        last = np.arange(rows), lengths - 1
        symbol[last] = self.final[raw[last]]
        following = np.where(place + 1 < lengths[:, None], place + 1, n)
        before = np.broadcast_to(place - 1, (rows, n)).copy()
        alive = place < lengths[:, None]

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, rank * n + at)

        tree = np.full((rows, 2 * n), NONE)
        first = self.rank_of(symbol[:, :-1], symbol[:, 1:])
        first[~alive[:, 1:]] = NONE
        tree[:, n : 2 * n - 1] = leaf(first, place[:-1])
        level = n
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + n
            tree[r, node] = value
            while n > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        r = np.flatnonzero(tree[:, 1] != NONE)
        while len(r):
            rank, i = np.divmod(tree[r, 1], n)
            gone = following[r, i]
            after = following[r, gone]
            symbol[r, i] = self.merged[rank]
            alive[r, gone] = False
            following[r, i] = after
            put(r, gone, np.full(len(r), NONE))
            inside = after < n
            before[r[inside], after[inside]] = i[inside]
            right = np.full(len(r), NONE)
            right[inside] = self.rank_of(symbol[r[inside], i[inside]], symbol[r[inside], after[inside]])
            put(r, i, leaf(right, i))
            prior = before[r, i]
            has = prior >= 0
            if has.any():
                q, p = r[has], prior[has]
                put(q, p, leaf(self.rank_of(symbol[q, p], symbol[q, i[has]]), p))
            r = r[tree[r, 1] != NONE]
        return [s[a] for s, a in zip(symbol, alive)]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens; per-character lower case, as the library has it."""
        text = unicodedata.normalize("NFC", text)
        return self.word.findall(text.replace("Σ", "σ").lower())

    def learn(self, found: set[str]) -> None:
        if len(self.codes) > REMEMBERED:
            self.codes, self.texts = {}, {}
        new = sorted(w for w in found if w not in self.codes)
        for w, ids in zip(new, self.merge([w.encode("utf-8", "replace") for w in new])):
            self.codes[w] = ids.astype("<u4").tobytes()
            self.texts[w] = self.decode(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode gives for a vocabulary without a decoder: its tokens, joined by spaces."""
        return " ".join([self.token[i] for i in ids])

    def encode_batch(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        waiting: list[list] = []
        chars = 0
        for text in texts:
            parts = self.cut.split(text) if "<|" in text else [text]
            waiting.append([part if k % 2 else self.words(part) for k, part in enumerate(parts)])
            chars += len(text)
            if chars >= TOGETHER:
                yield from self._encoded(waiting)
                waiting, chars = [], 0
        yield from self._encoded(waiting)

    def _encoded(self, parted: list[list]) -> Iterator[tuple[bytes, str]]:
        """The texts' codes, after the words new to all of them were merged together."""
        found = {w for parts in parted for words in parts[::2] for w in words}
        self.learn(found)
        for parts in parted:
            ids, back = [], []
            for k, part in enumerate(parts):
                if k % 2:
                    ids.append(self.special[part].to_bytes(4, "little"))
                    back.append(self.decode([self.special[part]]))
                else:
                    ids += map(self.codes.__getitem__, part)
                    back += map(self.texts.__getitem__, part)
            yield b"".join(ids), " ".join(back)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded if ``with_ids``.

    One row for each row of ``docs``, repeated or not; the id is carried as it is, null too. A null text is empty and
    has no tokens. Whole texts of any length are encoded. Other columns are not looked at. ``vocabulary`` names a file
    that every executor has.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(vocabulary)
        for b in batches:
            out = pd.DataFrame({"doc_id": b["doc_id"]})
            rows, ids, decoded = [], [], []
            for code, back in bpe.encode_batch(b["text"]):
                rows.append((len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                if with_ids:
                    ids.append(np.frombuffer(code, "<u4").astype(np.int32))
                    decoded.append(back)
            out[["n_tokens", "ids_sha256", "decoded_sha256"]] = pd.DataFrame(rows, out.index, range(3)) if rows else None
            if with_ids:
                out["ids"], out["decoded"] = pd.Series(ids, out.index, object), pd.Series(decoded, out.index, object)
            yield out

    # pandas would make floats of ids among which one is null
    texts = docs.select(common.key_of(docs).alias("doc_id"), common.text_of(docs).alias("text"))
    return common.in_small_batches(texts).mapInPandas(run, schema).withColumn("doc_id", common.id_of())
