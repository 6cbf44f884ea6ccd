"""WARC files: read back, compared with plain Python, and equal however Spark deals the rows."""

import base64
import gzip
import hashlib
from pathlib import Path

from orbweave.llm.warc import Limits, read_warc, round_trip, write_warc

ROWS = [
    (5, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://c/x y\n", None), (4, "http://d/", ""),
    (7, "http://e/", "é語" * 4000), (7, "http://e/", "é語" * 4000), (8, "http://f/", "é語" * 4000), (6, "http://g/", "\r\n\r\nWARC/1.1\r\n"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for page_id, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", page_id)
    met = set()
    for page_id, _, html in sorted(rows, key=lambda r: (r[0], r[2] or "")):
        response = first[html or ""] == page_id and (page_id, html) not in met
        met.add((page_id, html))
        yield page_id, len((html or "").encode()), digest(html), "response" if response else "revisit", None if response else first[html or ""]


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def pages(spark, rows, parts):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, shard string").repartition(parts)


def test_round_trip(spark):
    many = ROWS + [(100 + i, f"http://h/{i % 7}", f"page {i % 40} " * (i % 13)) for i in range(300)]
    assert found(round_trip(pages(spark, many, 5))) == sorted(expected(many), key=str)
    assert round_trip(pages(spark, many, 1).limit(0)).count() == 0
    (only,) = round_trip(pages(spark, [(None, None, "x")], 1)).collect()
    assert (only.page_id, only.record_type, only.refers_to) == (None, "response", None)


def test_files_do_not_depend_on_partitions(spark, tmp_path):
    many = [(i, f"http://h/{i}", f"text {i * 7919 % 1000} " * (i % 50)) for i in range(400)]
    limits = Limits(file_bytes=3000, shard_bytes=20000)
    contents = []
    for parts in (1, 6):
        folder = tmp_path / f"out{parts}"
        manifest = write_warc(pages(spark, many, parts), str(folder), limits)
        names = sorted(r.name for r in manifest.collect())
        assert names == sorted(p.name for p in folder.glob("*.warc.gz")) and len(names) > 5
        assert not (folder / "_temporary").exists()
        contents.append({n: (folder / n).read_bytes() for n in names})
        assert found(read_warc(manifest, str(folder)).drop("file")) == sorted(expected(many), key=str)
    assert contents[0] == contents[1]
    assert all(gzip.decompress(c).startswith(b"WARC/1.1") for c in contents[0].values())


def test_small_payloads_stay_responses(spark, tmp_path):
    manifest = write_warc(pages(spark, [(1, "u", "ab"), (2, "u", "ab")], 1), str(Path(tmp_path) / "w"), Limits(least_revisit=3))
    assert {r.record_type for r in read_warc(manifest, str(Path(tmp_path) / "w")).collect()} == {"response"}
