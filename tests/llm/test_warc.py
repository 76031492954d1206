import gzip
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))
import oracle  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from twinlathe.llm import warc  # noqa: E402
from twinlathe.llm.storage import Scratch  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    oracle.same(spark, SF, warc.op6_warc, warc.ORACLE_SQL["op6_warc"])


def test_lookups_and_edges(spark):
    big = "<p>" + "payload " * 40
    rows = [
        (1, "https://User@B.example.com:443/x?q=1#frag", big), (2, "http://a.example.com", big), (3, None, None), (None, "http://a.example.com/\r\nX: y", big), (5, "http://b.example.com/x?q=1", "short"),
        (6, "not a url", "é" * 99), (7, "http://a.example.com", "other " * 40), (7, "http://a.example.com", "other " * 40),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "test")
    folder = scratch.folder("archives")
    manifest = warc.write(pages, folder, scratch)
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_back(manifest, folder).collect())
    assert got == sorted([
        (1, "response", None, len(big)), (2, "revisit", 1, len(big)), (3, "response", None, 0), (0, "revisit", 1, len(big)), (5, "response", None, 5), (6, "response", None, 198),
        (7, "response", None, 240), (7, "response", None, 240),
    ], key=lambda t: t[0])
    index = warc.CaptureIndex.of(manifest, folder)
    found = [index.read(*c) for c in index.find("http://a.example.com/")]
    assert sorted(r["page_id"] for r in found) == [2, 7, 7]
    assert index.read(*index.find("http://b.example.com/x?q=1")[0])["fields"]["WARC-Type"] == "response"
    assert index.find("http://zzz.example.com/") == []
    assert warc.read_back(warc.write(pages.limit(0), folder, scratch), folder).count() == 0


def test_every_page_is_found(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    scratch = Scratch(spark, "test")
    folder = scratch.folder("archives")
    index = warc.CaptureIndex.of(warc.write(pages, folder, scratch), folder)
    for r in pages.limit(25).collect():
        assert r["page_id"] in {index.read(*c)["page_id"] for c in index.find(r["url"])}


def test_keys_agree(spark):
    urls = ["https://A.example.com:80/x?y#z", "http://u:p@b.org", "//c.net/p", "mailto:x", "", None, "http://[::1]:8/x", "http://h/a//b"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", warc.surt_column(F.col("url")).alias("k")).orderBy("i")
    assert [r["k"] for r in df.collect()] == [warc.surt(u) for u in urls]


def test_record_round_trip():
    raw = warc.record(4, "http://x.org/", b"\r\n\r\nbody", __import__("hashlib").sha256(b"\r\n\r\nbody").hexdigest(), None)
    assert warc.parse(gzip.decompress(gzip.compress(raw)))["payload"] == b"\r\n\r\nbody"


def test_read_back_finds_blocks_through_the_directories(spark):
    """A manifest without places will do, also where many blocks begin with one key."""
    rows = [(i, "http://hot.example.com/" if i % 4 else f"http://h{i % 50}.example.com/{i}", f"<p>{i % 900} " + "word " * 30) for i in range(3000)]
    scratch = Scratch(spark, "test")
    folder = scratch.folder("archives")
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder, scratch)
    assert manifest.groupBy("archive", "first_key").count().where("count > 1").count() > 0
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    got = warc.read_back(manifest.select("archive", "first_key"), folder).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got) == [(i, len(h), None if first[h] == i else first[h]) for i, _, h in rows]


def test_an_archive_is_opened_once(spark, monkeypatch):
    """Directory reads, counted, of all blocks of several archives; archives are sized by bytes."""
    rows = [(i, f"http://h{i % 700}.example.com/{i}", f"<p>{i} " + "word " * 30) for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "test")
    folder = scratch.folder("archives")
    manifest = warc.write(pages, folder, scratch, archive_bytes=100_000)
    archives = manifest.select("archive").distinct().count()
    assert archives >= 9 and manifest.count() > archives
    reads, read = [], warc.read_directory
    monkeypatch.setattr(warc, "read_directory", lambda f: reads.append(1) or read(f))
    blocks = manifest.select("archive", "first_key").distinct().orderBy("archive", "first_key").toArrow().to_batches()
    found = [i for b in warc._read(folder, iter(blocks)) for i in b.column(0).to_pylist()]
    assert sorted(found) == list(range(6000)) and len(reads) == archives
