"""WARC archives with a two-level capture index.

``write`` puts one record per page into archive files in the shared folder, each record a gzip member of its own, and
sorts the captures by reversed-host URL key over index parts. A part is a file of compressed blocks of ``BLOCK`` lines
and a sparse block directory (the first key and the byte range of each block). The table of parts (one row a part, so
at most as many as shuffle partitions) has each part's first key.

``lookup`` finds captures by URL and page id: a binary search in the table of parts says where a key belongs, keys are
shuffled to their parts, a binary search in the part's directory gives the block, one range read brings it, and one
range read of the archive brings the record.

Records with equal payloads of at least ``SHARED`` bytes are stored once: that of the largest page id is a response, the
others revisit it. Files are written under new names and renamed when complete, and only files of finished tasks are
named in the index, so a task that runs again leaves nothing wrong behind.

A null html is an empty payload, a null url has the key ``-``, a null page id is the smallest id. Repeated rows are
records of their own; of a repeated row with the largest page id each is a response.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import os
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.common import give_back_id, id_column, partitions, small_batches
from cohortloom.runtime import fresh_path, join_small, settle

BLOCK = 500
SHARED = 1000
ARCHIVE_BYTES = 256 << 20


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query, in lower case; the scheme, a user name and the fragment are left out."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder:
        folder = "file://" + os.path.abspath(folder.removeprefix("file:"))
    return pafs.FileSystem.from_uri(folder)


def record(kind: str, page: int, url: str | None, payload: bytes, digest: str, of: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head only and says how long the payload was."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if url:
        lines.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{of}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


@dataclass
class Record:
    page: int
    kind: str
    refers_to: int | None
    payload: bytes | None
    payload_bytes: int
    digest: str


def parse(raw: bytes) -> Record:
    """Read a record back and check its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record doesn't end where it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name].removeprefix("<urn:page:").removesuffix(">"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "revisit":
        return Record(number("WARC-Record-ID"), kind, number("WARC-Refers-To"), None, int(said["Content-Length"]), digest)
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    return Record(number("WARC-Record-ID"), kind, None, payload, len(payload), digest)


class _Writer:
    """Archive files of one task."""

    def __init__(self, folder: str, stem: str):
        self.files, self.root = store(folder)
        self.stem, self.name, self.out, self.at = stem, "", None, 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name, self.at = f"{self.stem}-{uuid.uuid4().hex}", 0
            self.files.create_dir(self.root, recursive=True)
            self.out = self.files.open_output_stream(f"{self.root}/.{self.name}.part")
        self.out.write(raw)
        self.at += len(raw)
        return self.name, self.at - len(raw), len(raw)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(f"{self.root}/.{self.name}.part", f"{self.root}/{self.name}")
            self.out = None


def record_types(pages: DataFrame, id: str, html: str) -> DataFrame:
    """``page``, ``of`` for the pages that revisit another; counted before the shuffle, whatever one payload's share."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    seen = pages.select(id_column(id).alias("page"), body.alias("body")).filter(F.length("body") >= SHARED).select(
        "page", F.sha1("body").alias("digest"), F.length("body").alias("size"))
    first = settle(seen.groupBy("digest", "size").agg(F.max("page").alias("of"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return settle(seen.join(first, ["digest", "size"]).filter("page <> of").select("page", "of").distinct())


@dataclass
class Archive:
    folder: str
    parts: list[tuple[list, int]]  # (first key, part number), in order


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    spark = pages.sparkSession
    small_batches(spark)
    revisits = record_types(pages, id, html)
    rows = pages.select(id_column(id).alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))

    def archive(batches):
        out = _Writer(folder, "archive")
        for batch in batches:
            found = []
            for page, url_, html_, of in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "of"))):
                payload = html_.encode("utf-8", "surrogatepass")
                kind = "response" if of is None else "revisit"
                raw = record(kind, page, url_, payload, hashlib.sha1(payload).hexdigest(), of)
                found.append((url_key(url_), page, *out.add(gzip.compress(raw, 6, mtime=0))))
            if out.at > ARCHIVE_BYTES:
                out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)] if found else
                                             [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())],
                                             ["key", "page", "file", "at", "size"])
        out.close()

    captures_at = fresh_path(spark, "captures")
    join_small(rows, revisits, "page", "left").mapInArrow(
        archive, "key string, page long, file string, at long, size long").write.parquet(captures_at)
    captures = spark.read.parquet(captures_at)

    def index(batches):
        out, directory, lines, count = _Writer(folder, "index"), [], [], 0

        def flush():
            if lines:
                block = zlib.compress("\n".join(lines).encode(), 6)
                _, at, size = out.add(block)
                directory.append((json.loads(lines[0])[:2], at, size))
                lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page", "file", "at", "size"))):
                lines.append(json.dumps(row, ensure_ascii=False))
                count += 1
                if len(lines) == BLOCK:
                    flush()
        flush()
        out.close()
        if directory:
            sparse = _Writer(folder, "directory")
            sparse.add(json.dumps(directory, ensure_ascii=False).encode())
            sparse.close()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (json.dumps(directory[0][0]), out.name, sparse.name, count)],
                                             ["first", "file", "directory", "lines"])

    parts_at = fresh_path(spark, "parts")
    (captures.repartitionByRange(partitions(spark), "key", "page", "file", "at").sortWithinPartitions("key", "page", "file", "at")
     .mapInArrow(index, "first string, file string, directory string, lines long").write.parquet(parts_at))
    found = sorted((json.loads(r.first), r.file, r.directory) for r in spark.read.parquet(parts_at).select(
        F.col("first").alias("first"), "file", "directory").toArrow().to_pandas().itertuples())
    return Archive(folder, found)


def lookup(archive: Archive, wanted: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """The records of the wanted (page, url) rows, each distinct row once: ``page_id``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``payload`` (null for a revisit), ``url_key`` and ``file``.

    A row per capture: a page that was archived several times gives several rows.
    """
    spark = wanted.sparkSession
    folder, parts = archive.folder, archive.parts
    firsts = [p[0] for p in parts]

    def keys(batches):
        for batch in batches:
            found = [(url_key(u), p) for p, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            # equal (key, page) pairs may cross into the next part, so the part of the first one is taken and the search goes on from there
            at = [max(0, bisect.bisect_left(firsts, list(k)) - 1) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), batch.column(0), pa.array(at, pa.int64())],
                                             ["key", "page", "part"])

    def find(batches):
        files, root = store(folder)
        opened, blocks = {}, {}

        def ranged(name, at, size):
            if name not in opened:
                if len(opened) > 64:
                    opened.pop(next(iter(opened))).close()
                opened[name] = files.open_input_file(f"{root}/{name}")
            return opened[name].read_at(size, at)

        def directory(part):
            if ("d", part) not in blocks:
                with files.open_input_stream(f"{root}/{parts[part][2]}") as held:
                    blocks["d", part] = json.loads(held.read())
            return blocks["d", part]

        def captures(key, page):
            """All captures of a key and page: from the block that may hold the first of them on."""
            part, want = None, [key, page]
            part = max(0, bisect.bisect_left(firsts, want) - 1)
            while part < len(parts) and (firsts[part] <= want):
                sparse = directory(part)
                n = max(0, bisect.bisect_left([d[0] for d in sparse], want) - 1)
                while n < len(sparse) and sparse[n][0] <= want:
                    if (part, n) not in blocks:
                        if len(blocks) > 200:
                            blocks.clear()
                            sparse = directory(part)
                        lines = zlib.decompress(ranged(parts[part][1], *sparse[n][1:])).decode().split("\n")
                        blocks[part, n] = [json.loads(line) for line in lines]
                    lines = blocks[part, n]
                    first = bisect.bisect_left(lines, want, key=lambda line: line[:2])
                    for line in lines[first:]:
                        if line[:2] != want:
                            break
                        yield line
                    n += 1
                part += 1

        for batch in batches:
            found = []
            for key, page in zip(batch.column("key").to_pylist(), batch.column("page").to_pylist()):
                for _, _, name, at, size in captures(key, page):
                    r = parse(gzip.decompress(ranged(name, at, size)))
                    found.append((r.page, r.payload_bytes, r.digest, r.kind, r.refers_to, r.payload, key, name))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string())
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["page", "payload_bytes", "payload_digest", "record_type", "of", "payload", "url_key", "file"])
        for file in opened.values():
            file.close()

    rows = wanted.select(id_column(id).alias("page"), F.col(url).cast("string").alias("url")).mapInArrow(
        keys, "key string, page long, part long").distinct()
    found = (rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "key", "page").mapInArrow(
        find, "page long, payload_bytes long, payload_digest string, record_type string, of long, payload binary, "
              "url_key string, file string"))
    return found.select(give_back_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        give_back_id("of").alias("refers_to"), "payload", "url_key", "file")


def round_trip(spark: SparkSession, pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive all pages in a new folder and read every capture back through the index."""
    archive = write(pages, fresh_path(spark, "warc"), id, url, html)
    return lookup(archive, pages, id, url)
