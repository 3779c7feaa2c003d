"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on a small labelled table (``labelled_table``) by maximum likelihood and decoded by Viterbi over
many lines at once in numpy. A line of tokens for which no labelling but "outside" can win, by a bound on the learned
weights, is not decoded; this changes no result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TAG = {t: i for i, t in enumerate(TAGS)}
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
#: Words that announce personal data.
CUES = ("tel", "tel:", "phone", "phone:", "call", "fax", "fax:", "mobile", "mobile:", "card", "card:", "visa", "ip", "ip:", "host", "mail", "mail:", "email", "email:")
REMEMBERED = 200_000
#: Tokens whose scores are held at a time; longer lines are decoded in blocks of so many.
CELLS = 200_000
STEPS, RATE, L2 = 200, 0.15, 0.003


def luhn(digits: str) -> bool:
    double = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in double)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlaps within a kind, by kind and start."""
    out = []
    if "@" in text:
        # every run of local-part signs is met once; only those with a domain behind them count
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


def shape(word: str) -> str:
    """The word with its letters and digits by kind and runs of a kind as one sign, at most 12 signs."""
    kinds = ("9" if c in "0123456789" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    out: list[str] = []
    for c in kinds:
        if not out or out[-1] != c:
            out.append(c)
        if len(out) == 12:
            break
    return "".join(out)


def features(word: str) -> tuple[str, ...]:
    """One value of each feature family: bias, shape, whether digits or signs are there, digit count, and cue word."""
    s, digits = shape(word), re.sub("[^0-9]", "", word)
    has = ("9" if digits else "") + ("@" if "@" in word else "") + ("." if "." in word[:-1] else "") + ("a" if re.search(r"[^\W\d_]", word) else "")
    low = word.lower().rstrip(".,;!?")
    check = "luhn" if 16 <= len(digits) <= 19 and luhn(digits) else ""
    return "bias", f"shape {s}", f"has {has}", f"digits {len(digits) if len(digits) < 20 else 20}{check}" if digits else "no digits", f"cue {low}" if low in CUES else "no cue"


PLAIN_WORD, PLAIN_NAME = features("word"), features("Name")


def plain(feature: str) -> bool:
    """Whether words without digits, at signs, brackets and cues have the feature."""
    return not feature.startswith(("digits", "cue", "has .")) and not re.search(r"[9@()\[\]_]", feature)


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """The labelled table: tokens and tags of lines that were written for it, with numbers from a fixed rule."""
    fill = ("the and of a", "der die und", "le de la", "el que los", "Thing and", "was erst.", "On ea, thi", "(see note)", "| thed |", "an### ti%%%", "wh*** re$$$", "INGNT!! OF!!")
    state = [12345]

    def number(low: int, high: int) -> int:
        state[0] = (state[0] * 1103515245 + 12345) % 2**31
        return low + (state[0] >> 8) % (high - low)

    def valid_card() -> str:
        digits = f"{number(4000, 5600)}{number(0, 10**6):06d}{number(0, 10**5):05d}"
        return digits + next(str(c) for c in range(10) if luhn(digits + str(c)))

    names = ("anna", "j.weber", "Li", "marie_d", "omar7")
    lines: list[list[tuple[str, str]]] = []

    def span(kind: str, words: list[str]) -> list[tuple[str, str]]:
        return [(w, f"{'B' if i == 0 else 'I'}-{kind}") for i, w in enumerate(words)]

    for i in range(15):
        name, site = names[i % 5], ("mail", "example", "post")[i % 3]
        local = [f"({number(100, 999)})", f"555-{number(0, 10**4):04d}"]
        card = valid_card()
        spans = [
            span("email", [f"{name}.{number(1, 99)}@{site}{i % 9}.example.com"]),
            span("email", [f"{name}@{site}"]),
            span("ip", [".".join(str(number(1, 255)) for _ in range(4))]),
            span("card", [card]),
            span("card", [card[k : k + 4] for k in range(0, 16, 4)]),
            span("phone", ["+1", *local]),
            span("phone", local),
            span("phone", [f"{number(200, 999)}-{number(200, 999)}-{number(0, 10**4):04d}"]),
            span("phone", [f"0{number(10, 100)}", f"{number(1000, 10**4)}", f"{number(0, 10**4):04d}"]),
            span("phone", [f"00{number(30, 60)}", f"{number(20, 100)}", f"{number(10**6, 10**7)}"]),
            [(str(number(1900, 2030)), "O")],
            [(f"{number(1, 99)}.{number(0, 99)}", "O"), ("EUR", "O")],
            [(f"1{number(0, 10**9):09d}{number(0, 10**5):05d}", "O")],
            [("token", "O"), ("=", "O"), (f'"{number(0, 2**31):08x}{number(0, 2**31):08x}"', "O")],
            [("Version", "O"), (f"{number(1, 9)}.0.", "O")],
            [(f"({number(1, 99)})", "O"), ("card", "O"), ("of", "O")],
            [],
        ]
        for k, s in enumerate(spans):
            head = [(w, "O") for w in fill[(i + k) % len(fill)].split()]
            tail = [(w, "O") for w in fill[(i * 5 + k + 3) % len(fill)].split()]
            lines.append(head + s + tail)
    return [([w for w, _ in line], [t for _, t in line]) for line in lines]


@dataclass
class Field:
    """Weights of the field: for the features of the token before, the token and the token after, and of transitions."""

    number: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray


def allowed() -> np.ndarray:
    """Zero for a transition that may be, -inf for an inside tag that does not follow its own kind."""
    return np.array([[-np.inf if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in TAGS] for a in TAGS])


START = np.array([-np.inf if t[0] == "I" else 0.0 for t in TAGS])


def emissions(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Scores (rows, places, tags) from feature numbers (rows, places, families); -1 is a feature never met."""
    out = np.zeros((*feats.shape[:2], weights.shape[2]))
    for family in range(feats.shape[2]):
        at = feats[..., family]
        known = (at >= 0)[..., None]
        for side, to, of in ((1, slice(None), slice(None)), (0, slice(1, None), slice(None, -1)), (2, slice(None, -1), slice(1, None))):
            out[:, to] += (weights[side][np.maximum(at, 0)] * known)[:, of]
    return out


def train(table: list[tuple[list[str], list[str]]]) -> Field:
    """Maximum likelihood with a quadratic penalty, by forward-backward over the padded table and Adam."""
    number: dict[str, int] = {}
    met = [[[number.setdefault(f, len(number)) for f in features(w)] for w in words] for words, _ in table]
    rows, places, k = len(table), max(len(x) for x in met), len(TAGS)
    feats = np.full((rows, places, 5), -1)
    gold = np.zeros((rows, places), np.int64)
    for i, (x, (_, tags)) in enumerate(zip(met, table)):
        feats[i, : len(x)] = x
        gold[i, : len(x)] = [TAG[t] for t in tags]
    length = np.array([len(x) for x in met])
    here = np.arange(places) < length[:, None]
    mask, size = allowed(), len(number)
    theta = np.zeros(3 * size * k + k * k)
    m = v = np.zeros_like(theta)

    own = np.zeros((rows, places, size))
    np.put_along_axis(own, np.maximum(feats, 0), 1.0, 2)
    own *= here[..., None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[:, 1:], after[:, :-1] = own[:, :-1], own[:, 1:]
    sides = [x.reshape(rows * places, size).T.copy() for x in (before, own, after)]

    def counts(by: np.ndarray) -> np.ndarray:
        """Sums of tag weights (rows, places, tags) for each offset and feature."""
        return np.stack([side @ by.reshape(rows * places, k) for side in sides])

    truth = np.eye(k)[gold] * here[..., None]
    true_moves = np.einsum("rpa,rpb->ab", truth[:, :-1], truth[:, 1:])
    true_counts = counts(truth)
    lse = lambda x, axis: np.logaddexp.reduce(x, axis)
    for step in range(1, STEPS + 1):
        w, t = theta[: 3 * size * k].reshape(3, size, k), theta[3 * size * k :].reshape(k, k) + mask
        e = sum(side.T @ x for side, x in zip(sides, w)).reshape(rows, places, k)
        a, b = np.zeros((rows, places, k)), np.zeros((rows, places, k))
        a[:, 0] = START + e[:, 0]
        for p in range(1, places):
            a[:, p] = np.where(here[:, p, None], lse(a[:, p - 1, :, None] + t, 1) + e[:, p], a[:, p - 1])
        z = lse(a[:, -1], 1)
        for p in range(places - 2, -1, -1):
            b[:, p] = np.where(here[:, p + 1, None], lse(t + (e[:, p + 1] + b[:, p + 1])[:, None, :], 2), 0)
        tag = np.exp(a + b - z[:, None, None]) * here[..., None]
        pair = np.exp(a[:, :-1, :, None] + t + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * here[:, 1:, None, None]
        g = np.concatenate([(counts(tag) - true_counts).ravel(), (pair.sum((0, 1)) - true_moves).ravel()]) + L2 * theta * np.sqrt(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(number, theta[: 3 * size * k].reshape(3, size, k), theta[3 * size * k :].reshape(k, k) + mask)


def viterbi(e: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags (rows, places) of rows of scores padded to one length."""
    rows, places, k = e.shape
    best, back = START + e[:, 0], np.zeros((rows, places, k), np.int8)
    for p in range(1, places):
        to = best[:, :, None] + moves
        back[:, p] = to.argmax(1)
        on = (p < length)[:, None]
        best = np.where(on, to.max(1) + e[:, p], best)
        back[:, p] = np.where(on, back[:, p], np.arange(k))
    tags = np.zeros((rows, places), np.int64)
    tags[:, -1] = best.argmax(1)
    for p in range(places - 1, 0, -1):
        tags[:, p - 1] = back[np.arange(rows), p, tags[:, p]]
    return tags


def best_of_line(weights: np.ndarray, moves: np.ndarray, feats: np.ndarray, block: int) -> np.ndarray:
    """The best tags of one line of any length from its feature numbers (places, families).

    Scores of ``block`` places are there at a time; the path's scores are carried over, so that the tags are those of
    ``viterbi`` over the whole line.
    """
    n, k = len(feats), moves.shape[0]
    back, best = np.zeros((n, k), np.int8), None
    for begin in range(0, n, block):
        low = max(0, begin - 1)
        e = emissions(weights, feats[None, low : begin + block + 1])[0][begin - low :][:block]
        for p, own in enumerate(e, begin):
            if best is None:
                best = START + own
                continue
            to = best[:, None] + moves
            back[p] = to.argmax(0)
            best = to.max(0) + own
    tags = np.zeros(n, np.int64)
    tags[-1] = best.argmax()
    for p in range(n - 1, 0, -1):
        tags[p - 1] = back[p, tags[p]]
    return tags


def outside_wins(field: Field) -> bool:
    """Whether no line of plain tokens can have a better labelling than "outside" throughout.

    Bounds each tag's advantage by the best that a plain token and two plain neighbours (or none) can give, and looks
    for a way from "outside" back to it, or a cycle, that gains anything.
    """
    gain = field.weights - field.weights[:, :, :1]
    by_side = np.zeros((3, len(TAGS)))
    for family in ("bias", "no digits", "no cue"):  # which every plain token has
        by_side += gain[:, field.number[family]] if family in field.number else 0
    for family in ("shape", "has"):
        own = [i for f, i in field.number.items() if f.startswith(family) and plain(f)]
        by_side += np.maximum(gain[:, own].max(1), 0) if own else 0
    advantage = by_side[1] + np.maximum(by_side[[0, 2]], 0).sum(0)
    step = field.moves - field.moves[0, 0] + advantage
    gained = START + np.maximum(step[0], advantage)  # after an outside token, or first in the line
    gained[0] = -np.inf
    for _ in TAGS:
        if (gained + np.maximum(field.moves[:, 0] - field.moves[0, 0], 0)).max() >= 0:  # before one, or last
            return False
        longer = (gained[:, None] + step).max(0)
        longer[0] = -np.inf
        if (longer > gained).any() and _ == len(TAGS) - 1:
            return False
        gained = np.maximum(gained, longer)
    return True


class Decoder:
    """Finds the field's spans in texts; remembers which group of features a token belongs to."""

    def __init__(self, field: Field):
        self.field = field
        self.groups: dict[tuple[int, ...], int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.open: list[bool] = []
        self.tokens: dict[str, int] = {}
        self.skip = outside_wins(field)

    def group(self, token: str) -> int:
        """The token's group; of groups that are plain, -1 less it."""
        g = self.tokens.get(token)
        if g is None:
            if len(self.tokens) > REMEMBERED:
                self.tokens = {}
            names = self.alike(token)
            key = (*(self.field.number.get(f, -1) for f in names), self.skip and all(map(plain, names)))
            if key not in self.groups:
                self.groups[key] = len(self.rows)
                self.rows.append(key[:5])
                self.open.append(not key[5])
            g = self.groups[key]
            g = self.tokens[token] = g if self.open[g] else -1 - g
        return g

    def alike(self, token: str) -> tuple[str, ...]:
        """The token's features, found quicker for the two commonest kinds of words."""
        if token.isalpha() and token.lower() not in CUES:
            if token.islower():
                return PLAIN_WORD
            if len(token) > 1 and token[0].isupper() and token[1:].islower():
                return PLAIN_NAME
        return features(token)

    def lines(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Start and groups of each line that needs decoding."""
        at = 0
        for line in text.split("\n"):
            groups = list(map(self.group, line.split()))
            if groups and max(groups) >= 0:
                yield at, [g if g >= 0 else -1 - g for g in groups]
            at += len(line) + 1

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) found by the field in each text; signs at the ends that belong to no token are cut."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        work = [(i, at, groups) for i, text in enumerate(texts) for at, groups in self.lines(text)]
        work.sort(key=lambda x: len(x[2]))
        begin = 0
        while begin < len(work):
            end = begin + 1
            while end < len(work) and (end - begin + 1) * len(work[end][2]) <= CELLS and len(work[end][2]) <= 2 * len(work[begin][2]) + 8:
                end += 1
            self._decode(work[begin:end], texts, out)
            begin = end
        return out

    def _decode(self, part: list[tuple[int, int, list[int]]], texts: list[str], out: list) -> None:
        length = np.array([len(g) for _, _, g in part])
        table = np.array(self.rows, np.int32)
        if length[0] > CELLS:
            tags = best_of_line(self.field.weights, self.field.moves, table[part[0][2]], CELLS)[None]
        else:
            feats = np.full((len(part), length.max(), 5), -1)
            for r, (_, _, groups) in enumerate(part):
                feats[r, : len(groups)] = table[groups]
            tags = viterbi(emissions(self.field.weights, feats), length, self.field.moves)
        for r in np.flatnonzero((tags > 0).any(1)):
            i, at, groups = part[r]
            stop = texts[i].find("\n", at)
            marked = tags[r] > 0
            places = {p: m.span() for p, m in enumerate(TOKEN.finditer(texts[i], at, len(texts[i]) if stop < 0 else stop)) if marked[p]}
            p = 0
            while p < len(groups):
                t, q = int(tags[r, p]), p + 1
                if t:
                    while q < len(groups) and tags[r, q] and TAGS[tags[r, q]][0] == "I":
                        q += 1
                    a, b = places[p][0], places[q - 1][1]
                    while b > a and not (texts[i][b - 1].isalnum() or texts[i][b - 1] in ")]"):
                        b -= 1
                    while a < b and not (texts[i][a].isalnum() or texts[i][a] in "+([" or texts[i][a] == "_"):
                        a += 1
                    if a < b:
                        out[i].append(((t - 1) // 2, a, b))
                p = q


def apart_from(found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``found`` that overlap none of ``base``."""
    begins, ends = [], []
    for _, x, y in sorted(base, key=lambda s: s[1]):
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            begins.append(x)
            ends.append(y)
    return [s for s in found if (i := bisect_right(ends, s[1])) == len(ends) or begins[i] >= s[2]]


def find(docs: DataFrame, with_spans: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row of ``docs``.

    The counts and base_sha256 are of the fixed patterns. ``spans`` also has what the field adds: spans that overlap no
    span of the patterns. A null or empty text has none. Rows may repeat, ids may be null; each row is read by itself,
    whole. Other columns are not looked at.
    """
    field = train(labelled_table())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(field)
        for b in batches:
            texts, rows = b["text"].tolist(), []
            for text, found in zip(texts, decoder.spans(texts)):
                base = base_spans(text)
                added = apart_from(found, base)
                write = lambda spans: ",".join(f"{KINDS[k]}:{x}:{y}" for k, x, y in sorted(spans))
                counts = [sum(s[0] == k for s in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(write(base).encode()).hexdigest(), write(base + added), len(added)))
            out = pd.DataFrame(rows, b.index, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    # pandas would make floats of ids among which one is null
    texts = docs.select(common.key_of(docs).alias("doc_id"), common.text_of(docs).alias("text"))
    found = common.in_small_batches(texts).mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return found.withColumn("doc_id", common.id_of())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"))
