"""Operator 6: WARC archives with a two-level capture index.

``write`` stores one WARC/1.1 record per page, each its own gzip member. Pages are
range-partitioned by their reversed-host URL key, as many partitions as their bytes ask for,
so a partition makes one archive of about ``ARCHIVE_BYTES`` in key order and one index file: sorted capture lines in compressed blocks of
``BLOCK_LINES``, then a sparse directory (the first key and place of each block) and the
directory's length. A manifest with one row per block, committed by Spark, names the
files that count; names are unique, so retried tasks only leave orphans.

``CaptureIndex`` finds a URL by binary search over the files, then over a file's
directory, then within one block, and range-reads the record. ``read_back`` asks for the
first key of each block: a task opens an archive and reads its directory once, finds the
blocks by binary search in it, and reads each block and its span of the archive in one piece. Of the manifest it uses the
names and the first keys only, no places.

Payloads are compared by SHA-256. Of records with equal payloads of at least
``MIN_REVISIT`` bytes, those with the smallest page_id are responses and the others
revisit it. First holders are found by an aggregate (combined before the shuffle); the
table of repeated digests is written first, so that its size decides on a broadcast, and
beyond that Spark's skew join splits a digest that many pages share.

Defined cases: page_id is an integer or casts to one (other strings are an error);
null html is an empty payload; null url has an empty key and no target
header; control characters and spaces in a URL are percent-encoded; null page_ids come
last and have no id header; rows that share the smallest page_id of a payload are all
responses; an empty table gives no archive and no rows. Only page_id, url and html are
read.
"""

from __future__ import annotations

import bisect
import functools
import gzip
import hashlib
import io
import itertools
import json
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlathe.llm.storage import Scratch

MIN_REVISIT = 100
#: Payloads that one archive holds, about, before they are compressed.
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 512
GZIP_LEVEL = 5
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^#]*)", re.S)


def surt(url: str | None) -> str:
    """Reversed-host key: https://A.example.com:443/x?y#z becomes com,example,a)/x?y."""
    if not url:
        return ""
    m = _URL.match(url)
    if not m:
        return url.split("#", 1)[0]
    host = re.sub(r":\d*$", "", m[1].rpartition("@")[2]).lower()
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def surt_column(url: Column) -> Column:
    """``surt`` as a column."""
    pattern = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^#]*).*$"
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, pattern, 1), r"(?s)^.*@", ""), r":\d*$", ""))
    rest = F.regexp_extract(url, pattern, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.when(url.rlike(pattern), key).otherwise(F.substring_index(url, "#", 1)), F.lit(""))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload facts of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Page"), "payload": payload, "fields": fields}


_MANIFEST = "archive string, part int, block int, first_key string, last_key string, index_offset long, index_bytes long, captures long, first_offset long, span long"


def _write(folder: str, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    part = TaskContext.get().partitionId()
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    archive = index = None
    at = index_at = 0
    lines: list[tuple] = []
    blocks: list[tuple] = []

    def flush() -> None:
        nonlocal index_at
        data = zlib.compress("\n".join(json.dumps(line) for line in lines).encode(), level)
        index.write(data)
        blocks.append((name, part, len(blocks), lines[0][0], lines[-1][0], index_at, len(data), len(lines), lines[0][2], at - lines[0][2]))
        index_at += len(data)
        lines.clear()

    for batch in batches:
        for page_id, url, html, key, digest, refers_to in zip(*[batch.column(i) for i in range(6)]):
            if archive is None:
                fs.create_dir(root, recursive=True)
                archive, index = fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None), fs.open_output_stream(f"{root}/{name}.idx", compression=None)
            payload = (html.as_py() or "").encode()
            raw = record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py())
            member = gzip.compress(raw, level, mtime=0)
            archive.write(member)
            lines.append((key.as_py(), page_id.as_py(), at, len(member)))
            at += len(member)
            if len(lines) == BLOCK_LINES:
                flush()
    if archive is not None:
        if lines:
            flush()
        directory = zlib.compress(json.dumps([(b[3], b[5], b[6]) for b in blocks]).encode(), level)
        index.write(directory + struct.pack("<Q", len(directory)))
        archive.close()
        index.close()
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
    columns = list(zip(*blocks)) if blocks else [()] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _MANIFEST.split(", ")])


def write(pages: DataFrame, folder: str, scratch: Scratch, min_revisit: int = MIN_REVISIT, level: int = GZIP_LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives and indexes below ``folder``; returns the manifest (one row per index block)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    sized = rows.where(F.octet_length("html") >= min_revisit)
    repeated = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    firsts = scratch.cut(repeated, "firsts")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = rows.join(firsts, F.col("digest") == F.col("of"), "left").select("page_id", "url", "html", surt_column(F.col("url")).alias("key"), "digest", refers_to.alias("refers_to"))
    order = [F.col("key"), F.col("page_id").asc_nulls_last()]
    # as many archives as their bytes ask for, but work for every core
    size = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // archive_bytes))
    placed = marked.repartitionByRange(archives, *order).sortWithinPartitions(*order, "digest")
    return scratch.cut(placed.mapInArrow(functools.partial(_write, folder, level), _MANIFEST), "manifest")


def index_lines(block: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(block).decode().split("\n")]


def _range(f, offset: int, size: int) -> bytes:
    f.seek(offset)
    return f.read(size)


def read_directory(f) -> list[list]:
    """The sparse directory at the end of an open index file: (first key, offset, length) of each block."""
    end = f.size()
    size = struct.unpack("<Q", _range(f, end - 8, 8))[0]
    return json.loads(zlib.decompress(_range(f, end - 8 - size, size)))


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the blocks (archive, first key), sorted: an archive is opened, and its directory read, once."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    rows = ((row["archive"], row["first_key"]) for batch in batches for row in batch.to_pylist())
    for name, mine in itertools.groupby(rows, operator.itemgetter(0)):
        with fs.open_input_file(f"{root}/{name}.idx") as index, fs.open_input_file(f"{root}/{name}.warc.gz") as archive:
            directory = read_directory(index)
            for _, key in mine:
                k = bisect.bisect_left(directory, key, key=lambda b: b[0])
                if k == len(directory) or directory[k][0] != key:
                    raise ValueError(f"no block of {name} begins with {key!r}")
                while k < len(directory) and directory[k][0] == key:
                    lines = index_lines(_range(index, directory[k][1], directory[k][2]))
                    begin, end = lines[0][2], lines[-1][2] + lines[-1][3]
                    span = _range(archive, begin, end - begin)
                    found = [parse(gzip.decompress(span[offset - begin : offset - begin + size])) for _, _, offset, size in lines]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(columns, kinds)], columns)
                    k += 1


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = manifest.agg(F.countDistinct("archive")).first()[0]
    spread = manifest.select("archive", "first_key").distinct().repartition(max(1, archives), "archive").sortWithinPartitions("archive", "first_key")
    return spread.mapInArrow(functools.partial(_read, folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class CaptureIndex:
    """Look-ups of single URLs. ``files``: (archive, first key, last key), one for each archive."""

    def __init__(self, folder: str, files: list[tuple[str, str, str]]):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.files = sorted(files, key=lambda f: (f[1], f[2]))
        self.directories: dict[str, list] = {}

    @classmethod
    def of(cls, manifest: DataFrame, folder: str) -> CaptureIndex:
        per_file = manifest.groupBy("archive").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b"))
        return cls(folder, [tuple(r) for r in per_file.collect()])

    def directory(self, archive: str) -> list:
        """The sparse directory at the end of an index file."""
        if archive not in self.directories:
            with self.fs.open_input_file(f"{self.root}/{archive}.idx") as f:
                self.directories[archive] = read_directory(f)
        return self.directories[archive]

    def find(self, url: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of each capture of ``url``."""
        key, out = surt(url), []
        last = bisect.bisect_right(self.files, key, key=lambda f: f[1])
        for archive, _, top in self.files[:last][::-1]:
            if top < key:
                break
            blocks = self.directory(archive)
            k = max(0, bisect.bisect_left(blocks, key, key=lambda b: b[0]) - 1)
            with self.fs.open_input_file(f"{self.root}/{archive}.idx") as f:
                while k < len(blocks) and blocks[k][0] <= key:
                    lines = index_lines(_range(f, blocks[k][1], blocks[k][2]))
                    at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    while at < len(lines) and lines[at][0] == key:
                        out.append((archive, lines[at][2], lines[at][3]))
                        at += 1
                    k += 1
        return out

    def read(self, archive: str, offset: int, size: int) -> dict:
        with self.fs.open_input_file(f"{self.root}/{archive}.warc.gz") as f:
            return parse(gzip.GzipFile(fileobj=io.BytesIO(_range(f, offset, size))).read())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("archives")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, scratch)
    return read_back(manifest, folder)


QUERIES = {"op6_warc": op6_warc}

ORACLE_SQL = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
}
