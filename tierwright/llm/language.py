"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are added as log likelihoods: the text (hashed character trigrams), the language that the markup
declares, the address suffix, and the host. How well declarations and suffixes tell the language, and what languages a
host has, is learned from the texts' own posteriors by grouped aggregation; a host's prior is smoothed towards its
domain's, that towards all documents', and leaves the document itself out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled texts that the trigram model is fitted on (about, and at most twice as many; each language has at least one).
FIT_ROWS = 20_000
SLOTS = 1 << 14
#: Trigrams depend on each other: a text counts as so many at most, in the proportions of the whole text.
TRUST = 60.0
#: Weight of the level above in a host's and a domain's prior, in documents.
ABOVE = 5.0
FOLDS = 3
#: Values of a kind of evidence up to which their table is broadcast, after a count.
VALUES = 200_000
SCRIPT = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
MARKUP = re.compile(r"<[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""")


def trigrams(text: str) -> np.ndarray:
    """Slots of the text's byte trigrams, letters in lower case, digits and signs as space."""
    b = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    return ((b[:-2] * 7919 + b[1:-1] * 193 + b[2:] * 31 + (b[:-2] ^ b[2:])) * np.uint32(2654435761) >> np.uint32(18)) & np.uint32(SLOTS - 1)


def visible(html: str) -> str:
    return unescape(MARKUP.sub(" ", SCRIPT.sub(" ", html)))


def host_parts(url: str) -> tuple[str, str, str]:
    """Host, its last two labels, and its last label; empty where there is none."""
    try:
        host = (urlsplit(url).hostname or "").rstrip(".").lower()
    except ValueError:
        host = ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


class Trigrams:
    """Log probabilities of slots by language, sparse: what each language's slots have above that of a slot never met."""

    def __init__(self, names: list[str], lang: np.ndarray, slot: np.ndarray, n: np.ndarray):
        """Parallel arrays: the number of times that a language (its place among the names) has a slot."""
        self.names = names or ["und"]
        k = len(self.names)
        total = np.bincount(lang, n, k) + 0.5 * SLOTS
        self.never = np.log(0.5 / total)
        order = np.argsort(slot, kind="stable")
        self.lang, self.above = lang[order].astype(np.int32), (np.log((n[order] + 0.5) / total[lang[order]]) - self.never[lang[order]]).astype(np.float32)
        self.begins = np.searchsorted(slot[order], np.arange(SLOTS + 1))

    def evidence(self, text: str) -> np.ndarray:
        """The text's log likelihood by language, the greatest being 0."""
        slots, times = np.unique(trigrams(text), return_counts=True)
        size = self.begins[slots + 1] - self.begins[slots]
        at = np.repeat(self.begins[slots] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(slots) else slots, size) + np.arange(size.sum())
        at = at.astype(np.int64)
        n = int(times.sum())
        ll = (n * self.never + np.bincount(self.lang[at], self.above[at] * np.repeat(times, size), len(self.names))) * min(1.0, TRUST / max(1, n))
        return ll - ll.max()


def fit(docs: DataFrame) -> Trigrams:
    """The trigrams of all languages among the labelled texts outside the held-out fold; about ``FIT_ROWS`` texts are read."""
    given = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~common.held_out(F.col("doc_id"), FOLDS))
    by_lang = common.stored(given.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    total = by_lang.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # of each language as many as of any other, as far as it has them, so that rare ones are learned too
    least = max(1, FIT_ROWS // max(1, by_lang.count()))
    share = F.greatest(F.lit(min(1.0, FIT_ROWS / max(1, total)) / 2), F.least(F.lit(1.0), F.lit(float(least)) / F.col("n"))) if total > FIT_ROWS else F.lit(1.0)
    chosen = given.join(common.sized(by_lang.select("lang", share.alias("share")), VALUES), "lang")
    sample = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.col("share") * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"]):
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(text), minlength=SLOTS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "slot": at.astype(np.int32), "n": n[at].astype(np.int64)})

    names = sorted(r["lang"] for r in by_lang.select("lang").collect())
    sums = sample.select("text", "lang").mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    place = {x: i for i, x in enumerate(names)}
    lang = np.array([place[x] for x in sums["lang"].to_pylist()], np.int64)
    return Trigrams(names, lang, sums["slot"].to_numpy().astype(np.int64), sums["n"].to_numpy().astype(float))


def softmax(scores: np.ndarray) -> np.ndarray:
    """By row."""
    powers = np.exp(scores - scores.max(1, keepdims=True))
    return powers / powers.sum(1, keepdims=True)


def evidence(items: DataFrame, model: Trigrams) -> DataFrame:
    """The stored id columns of items (doc_id, page_id, text, html, url, host), text evidence ll and its posterior p, and address parts."""
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, html, url, host in zip(b["text"], b["html"], b["url"], b["host"]):
                declared = DECLARED.search(html) if html else None
                ll = shared.value.evidence(visible(html) if html is not None else text or "")
                full, domain, suffix = host_parts(url or "")
                out.append((ll, softmax(ll[None])[0], declared[1].lower() if declared else "", full or host or "", domain, suffix))
            ids = b[["doc_id", "page_id"]].reset_index(drop=True)
            yield pd.concat([ids, pd.DataFrame(out, columns=["ll", "p", "declared", "host", "domain", "suffix"])], axis=1)

    return common.stored(items.select("doc_id", "page_id", "text", "html", "url", "host").mapInPandas(run, "doc_id string, page_id string, ll array<double>, p array<double>, declared string, host string, domain string, suffix string"), "language-evidence")


def summed(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """The keys and s: the sums of an array column, place by place; summed where the rows are read before they meet."""
    places = rows.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum("_x").alias("_x"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda e: e["_x"]).alias("s"))


def fuse(found: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``found`` with lang, confidence and text_lang.

    Languages are places of arrays, so the plan is the same for any number of them.
    """
    k = len(names)
    whole = np.zeros(k)
    for r in found.select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row for each language
        whole[r["i"]] = r["x"]
    base = (whole + 1) / (whole + 1).sum()

    def by_value(column: str) -> DataFrame:
        """The column's values with their summed posteriors."""
        table = summed(found.where(F.col(column) != ""), "p", column).select(F.col(column).alias(f"of_{column}"), F.col("s").alias(f"s_{column}"))
        return common.stored(table, f"languages-by-{column}")

    said: dict[str, np.ndarray] = {}
    joined = found
    tables = {c: by_value(c) for c in ("declared", "suffix")}
    for c, table in tables.items():
        said[c] = np.zeros(k)
        for r in table.select(F.posexplode(f"s_{c}").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
            said[c][r["i"]] = r["x"]
    hosts = common.stored(summed(found.where("host <> ''"), "p", "host", "domain"), "languages-by-host")
    domains = summed(hosts.where("domain <> ''"), "s", "domain").withColumnRenamed("s", "s_domain")
    tables["host"] = common.stored(hosts.join(domains, "domain", "left").select(F.col("host").alias("of_host"), F.col("s").alias("s_host"), "s_domain"), "host-priors")
    for c, table in tables.items():
        # rows that say nothing get keys of their own that match nothing, so that they do not meet in one task
        nothing = F.concat(F.lit(" "), F.coalesce("doc_id", "page_id", F.lit("")))
        joined = joined.withColumn("_by", F.when(F.col(c) != "", F.col(c)).otherwise(nothing)).join(common.sized(table, VALUES), F.col("_by") == F.col(f"of_{c}"), "left").drop("_by", f"of_{c}")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            def rows(c: str) -> tuple[np.ndarray, np.ndarray]:
                """A column of arrays as a matrix, zeros for null, and where it is not null."""
                column, out = b.column(b.schema.get_field_index(c)), np.zeros((b.num_rows, k))
                there = column.is_valid().to_numpy(zero_copy_only=False)
                out[there] = np.asarray(column.drop_null().flatten(), float).reshape(-1, k)
                return out, there

            ll, p = rows("ll")[0], rows("p")[0]
            final = ll.copy()
            for c in said:
                s, there = rows(f"s_{c}")
                # P(what is declared | language), smoothed; a missing value says nothing
                final += np.where(there[:, None], np.log((s + 0.1) / (said[c] + 1.0)), 0.0)
            prior = np.broadcast_to(base, p.shape)
            for level in ("s_domain", "s_host"):
                others = np.maximum(rows(level)[0] - p, 0.0)
                prior = (others + ABOVE * prior) / (others.sum(1, keepdims=True) + ABOVE)
            final = softmax(final + np.log(prior))
            pick = lambda x: pa.array([names[i] for i in x.argmax(1)], pa.string())
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "page_id", "declared", "host")]
            yield pa.RecordBatch.from_arrays([*keep[:2], pick(final), pa.array(final.max(1) if b.num_rows else [], pa.float64()), pick(p), *keep[2:]], ["doc_id", "page_id", "lang", "confidence", "text_lang", "declared", "host"])

    columns = joined.select("doc_id", "page_id", "declared", "host", "ll", "p", "s_declared", "s_suffix", "s_host", "s_domain")
    return columns.mapInArrow(decide, "doc_id string, page_id string, lang string, confidence double, text_lang string, declared string, host string")


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_id, lang, confidence, text_lang, declared and host of every document and every page.

    A document has a doc_id, its source stands for its host, and it has no markup and no address; a page has a
    page_id, and the text is what its markup shows. Null and empty texts have no text evidence, so the other kinds
    decide. The model is fitted on the documents' lang outside the held-out fold (crc32 of the id, remainder 1 of 3).
    Rows may repeat, ids may be null. Without labelled documents the language is "und". All labelled languages, however
    many, are told apart.
    """
    none = F.lit(None).cast("string")
    source = docs["source"].cast("string") if "source" in docs.columns else none
    of_docs = docs.select(docs["doc_id"].cast("string").alias("doc_id"), none.alias("page_id"), docs["text"].cast("string").alias("text"), none.alias("html"), none.alias("url"), source.alias("host"))
    of_pages = pages.select(none.alias("doc_id"), pages["page_id"].cast("string").alias("page_id"), none.alias("text"), common.text_of(pages, "html").alias("html"), common.text_of(pages, "url").alias("url"), none.alias("host"))
    model = fit(common.in_small_batches(docs))
    found = evidence(of_docs.unionByName(of_pages), model)
    return fuse(found, model.names).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("page_id", F.col("page_id").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "pages"))
