"""WARC archives of pages with a two-level capture index.

Tasks write gzipped WARC records, one member each, to files in the shared folder. The index sorts all captures by
reversed-host URL key and cuts them into compressed blocks; each index shard has a sparse directory with the first key
of every block, and the shards' own first keys are few. A search takes the shard by binary search, then the block,
reads that range only, finds the capture's line by binary search, and reads the record's range from its archive.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads of fewer bytes are never written as revisits.
LEAST_BYTES = 100
#: Captures in a block of the index, and bytes after which a task begins another archive.
BLOCK, ARCHIVE_BYTES = 500, 256 << 20
#: Resolved responses, blocks and directories that a searching task remembers.
REMEMBERED, OPEN_BLOCKS = 20_000, 8
#: Repeated payloads up to which their first captures go to every task.
REPEATED = 300_000
LEVEL = 3
CAPTURE = "key string, page long, digest string, url string, file string, offset long, length long"
#: The order of the index; a search names the first of these columns, one or more, and a row of its own all of them.
ORDER = ("key", "page", "digest", "file", "offset")
#: Pages have no capture time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str) -> str:
    """The URL's key: host labels from the last to the first, then path and query; the scheme is left out."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.split(".")))
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def header_value(text: str) -> str:
    """A value that fits on one header line."""
    return quote(text, safe="%/:=&?~#+!$,;'@()*[]{}|\\^`<>\" ") if not text.isprintable() or not text.isascii() else text


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str) -> bytes:
    """A response record, or a revisit without the payload if ``refers_to`` names the page it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{page}>", "WARC-Date": DATE, "WARC-Target-URI": header_value(url), "WARC-Payload-Digest": f"sha256:{digest}"}
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Refers-To-Target-URI": header_value(refers_url)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return packed(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and HTTP payload."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def page_of(urn: str) -> int:
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def referred(headers: dict[str, str]) -> tuple[str, int, str]:
    """Key, page and payload digest of the response that a revisit refers to."""
    return surt(headers["WARC-Refers-To-Target-URI"]), page_of(headers["WARC-Refers-To"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page and returns the stored captures.

    Every attempt of a task writes files of its own names, and only a finished attempt's captures are kept, so lost
    and repeated attempts leave files that nothing refers to.
    """
    rows = common.in_small_batches(pages).select(common.key_of(pages, "page_id").alias("page"), common.text_of(pages, "url").alias("url"), common.text_of(pages, "html").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= LEAST_BYTES)
    first = rows.where("long").groupBy(F.col("digest").alias("of")).agg(F.min("page").alias("first_page"), F.min_by("url", F.struct("page", "url")).alias("first_url"), F.count("*").alias("met"))
    # only payloads met twice need a decision; html is not shuffled while these are few
    repeated = common.sized(common.stored(first.where("met > 1").drop("met"), "repeated-payloads"), REPEATED)
    decided = rows.join(repeated, rows["long"] & (rows["digest"] == repeated["of"]), "left").select("page", "url", "html", "digest", "first_page", "first_url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        try:
            for b in batches:
                out = []
                for page, url, html, digest, first_page, first_url in zip(b["page"].tolist(), b["url"], b["html"], b["digest"], b["first_page"].tolist(), b["first_url"]):
                    if sink is None or at > ARCHIVE_BYTES:
                        if sink:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        sink = files.open_output_stream(f"{base}/{name}", compression=None)
                    to = None if pd.isna(first_page) or int(first_page) == page else int(first_page)
                    raw = record(page, url, html.encode("utf-8", "replace"), digest, to, first_url or "")
                    sink.write(raw)
                    out.append((surt(header_value(url)), page, digest, url, name, at, len(raw)))
                    at += len(raw)
                yield pd.DataFrame(out, columns=["key", "page", "digest", "url", "file", "offset", "length"])
        finally:
            if sink:
                sink.close()

    # nullable page numbers would pass pandas as floats
    safe = decided.withColumn("first_page", F.coalesce("first_page", "page"))
    return common.stored(safe.mapInPandas(write, CAPTURE), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted index shards with their directories and returns the stored shards: first key and files."""
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = captures.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        name, at, directory, lines, sink = uuid.uuid4().hex, 0, [], [], None

        def close_block() -> None:
            nonlocal at
            raw = packed("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            sink.write(raw)
            directory.append([*lines[0][: len(ORDER)], at, len(raw)])
            at += len(raw)
            lines.clear()

        for b in batches:
            for row in zip(b["key"], b["page"].tolist(), b["digest"], b["file"], b["offset"].tolist(), b["length"].tolist()):
                sink = sink or files.open_output_stream(f"{base}/{name}.blocks", compression=None)
                lines.append(row)
                if len(lines) == BLOCK:
                    close_block()
        if sink:
            if lines:
                close_block()
            sink.close()
            with files.open_output_stream(f"{base}/{name}.directory", compression=None) as f:
                f.write(packed(json.dumps(directory).encode()))
            yield pd.DataFrame([(*directory[0][: len(ORDER)], name)], columns=[*ORDER, "name"])

    return common.stored(in_order.mapInPandas(write, "key string, page long, digest string, file string, offset long, name string"), "index-shards")


@dataclass
class Index:
    """An archive folder, its index folder, and the first keys of the index shards in order (one for each shard)."""

    archives: str
    folder: str
    firsts: list[tuple[str, int, str, str, int]]
    names: list[str]


class Searcher:
    """Finds captures by the first columns of the index's order with binary searches and range reads; lives in a task."""

    def __init__(self, index: Index):
        self.index = index
        self.files, self.base = opened(index.folder)
        self.archives, self.archive_base = opened(index.archives)
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.blocks: OrderedDict[tuple, list] = OrderedDict()
        self.streams: OrderedDict[str, object] = OrderedDict()

    @staticmethod
    def _cached(cache: OrderedDict, key, make, most: int):
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            if len(cache) > most:
                old = cache.popitem(last=False)[1]
                if hasattr(old, "close"):
                    old.close()
        return cache[key]

    def _range(self, files: fs.FileSystem, path: str, at: int, length: int) -> bytes:
        f = self._cached(self.streams, path, lambda: files.open_input_file(path), 64)
        return f.read_at(length, at)

    def _directory(self, name: str) -> list:
        def load() -> list:
            with self.files.open_input_stream(f"{self.base}/{name}.directory", compression=None) as f:
                return [(tuple(d[: len(ORDER)]), *d[len(ORDER) :]) for d in json.loads(zlib.decompress(f.read(), 31))]

        return self._cached(self.directories, name, load, 4)

    def captures(self, *want: str | int) -> Iterator[tuple[int, str, int, int]]:
        """(page, file, offset, length) of the captures that begin with the wanted values of ``ORDER``, in that order."""
        begin = lambda line: tuple(line[: len(want)])
        shard = max(0, bisect_left(self.index.firsts, want, key=begin) - 1)
        while shard < len(self.index.names):
            directory = self._directory(self.index.names[shard])
            block = max(0, bisect_left(directory, want, key=lambda d: begin(d[0])) - 1)
            while block < len(directory):
                _, at, length = directory[block]
                path = f"{self.base}/{self.index.names[shard]}.blocks"
                lines = self._cached(self.blocks, (path, at), lambda: [json.loads(x) for x in zlib.decompress(self._range(self.files, path, at, length), 31).decode().split("\n")], OPEN_BLOCKS)
                for line in lines[bisect_left(lines, want, key=begin) :]:
                    if begin(line) != want:
                        return
                    yield line[1], *line[3:]
                block += 1
            shard += 1

    def read(self, capture: tuple[int, str, int, int]) -> tuple[dict[str, str], bytes]:
        _, file, offset, length = capture
        return parsed(self._range(self.archives, f"{self.archive_base}/{file}", offset, length))


def build(pages: DataFrame) -> tuple[DataFrame, Index]:
    """Archives and index of all pages: the stored captures, and what searches need."""
    spark = pages.sparkSession
    archives, folder = common.new_folder(spark, "warc"), common.new_folder(spark, "warc-index")
    captures = write_archives(pages, archives)
    shards = sorted(tuple(r) for r in build_index(captures, folder).collect())  # one row a shard
    return captures, Index(archives, folder, [r[:-1] for r in shards], [r[-1] for r in shards])


def look_up(urls: DataFrame, index: Index, column: str = "url") -> DataFrame:
    """page_id, url, html and record_type of all captures of the URLs; a revisit has the html it refers to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(index)
        for b in batches:
            out = []
            for url in b["url"]:
                for capture in searcher.captures(surt(header_value(url))):
                    headers, payload = searcher.read(capture)
                    if headers["WARC-Type"] == "revisit":
                        payload = searcher.read(next(searcher.captures(*referred(headers))))[1]
                    out.append((None if capture[0] == common.NO_ID else capture[0], url, payload.decode(), headers["WARC-Type"]))
            yield pd.DataFrame(out, columns=["page_id", "url", "html", "record_type"]).astype({"page_id": "Int64"})

    return urls.select(common.text_of(urls, column).alias("url")).mapInPandas(run, "page_id long, url string, html string, record_type string")


def read_back(captures: DataFrame, index: Index) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type and refers_to (page) of every capture, from its record.

    Tasks take ranges of the key, so each meets few shards and reads each block once; what a revisit refers to is
    searched in the index, too, and its payload's size and digest are taken from the response found there.
    """
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = captures.select(*ORDER).repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher, follower = Searcher(index), Searcher(index)
        met: OrderedDict[tuple[str, int, str], tuple[int, str]] = OrderedDict()

        def response(*to: str | int) -> tuple[int, str]:
            payload = follower.read(next(follower.captures(*to)))[1]
            return len(payload), hashlib.sha256(payload).hexdigest()

        for b in batches:
            out = []
            for place in zip(*(b[c].tolist() for c in ORDER)):
                headers, payload = searcher.read(next(searcher.captures(*place)))
                if headers["WARC-Type"] == "revisit":
                    to = referred(headers)
                    size, digest = Searcher._cached(met, to, lambda: response(*to), REMEMBERED)
                    out.append((place[1], size, digest, "revisit", to[1]))
                else:
                    out.append((place[1], len(payload), hashlib.sha256(payload).hexdigest(), "response", None))
            yield pd.DataFrame(out, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"refers_to": "Int64"})

    return wanted.mapInPandas(run, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as read back, for every row of ``pages``.

    A null html is an empty payload, a null url an empty one. A null page_id is smaller than all others. Rows that
    share page_id and url have a record each, and each reads its own back. Of equal payloads of at
    least ``LEAST_BYTES``, every row with the smallest page_id is a response. Other columns are not looked at.
    """
    captures, index = build(pages)
    id_of = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return read_back(captures, index).select(id_of("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(common.table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY h)
SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, sha256(p.h) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
