"""A deterministic sharded WARC writer, and its reader.

Records are dealt by ranges of page_id (cut from a sample that a hash of the ids chooses, weighted by
bytes), sorted, and written in gzip members of their own; a file is closed when its compressed size
passes a limit. What a file holds depends on the pages and the limits only, not on Spark's partitions.
Tasks write to temporary names; the rows that a finished job yields are the manifest, and only files
of the manifest get their final names, so a task that ran twice or was lost leaves nothing behind.
Headers and digests are made anew from the payload.

Of equal payloads the one with the smallest page_id is a response and the others are revisits of it.

Defined results: null html is an empty payload; a null URL is written as urn:page:<page_id>; of rows
that repeat page_id and payload, the first is the response (if the page is) and the others revisit it;
a null page_id comes first, and is a response only if no row with an id has its payload; an empty
table makes no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import attach, bounds_at_most, cut, shared_folder, small_batches


@dataclass(frozen=True)
class Limits:
    """Compressed bytes after which a file ends; payload bytes of a shard, and most shards;
    payloads with fewer bytes than least_revisit are all responses; the date of all records."""

    file_bytes: int = 64 << 20
    shard_bytes: int = 12 << 20
    shards: int = 20_000
    least_revisit: int = 0
    date: str = "2024-01-01T00:00:00Z"


NO_ID = "-"
#: Tasks that commit or read the files of an archive, at most.
FILE_TASKS = 20_000


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}|{digest}'.encode()).digest()[:16])}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}", "", ""]
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + member.flush()


def page_record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """The gzip member of one page; first: the page_id of the response that a revisit refers to, or ()."""
    shown = NO_ID if page_id is None else page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{shown}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if first == () else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", str(shown)),
    ]
    if first != ():
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)),
                    ("X-Refers-To-Page-ID", NO_ID if first is None else str(first))]
        return _record(headers, http)
    return _record(headers, http + payload)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


MANIFEST = "shard int, file int, temporary string, name string, bytes long, records long"


def _write_shards(batches: Iterator, folder: str, limits: Limits) -> Iterator:
    """Rows (shard, is_page, page_id, url, html, sha1, first), sorted, to files; yields the manifest."""
    import pyarrow as pa

    store, root = _store(folder)
    written, out = [], None
    shard = number = None
    marks: dict = {}
    met: set = set()

    def close():
        nonlocal out
        if out is not None:
            stream, name, size, records = out
            stream.close()
            written.append((shard, number, name, f"shard-{shard:06d}-{number:05d}.warc.gz", size, records))
            out = None

    def put(member: bytes, count: int):
        nonlocal out, number
        if out is not None and out[2] >= limits.file_bytes:
            close()
            number += 1
        if out is None:
            name = f"_temporary/{uuid.uuid4().hex}"
            info = f"software: orbweave\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {shard}\r\n".encode()
            head = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", f"{shard}-{number}")), ("WARC-Date", limits.date), ("Content-Type", "application/warc-fields")], info)
            out = [store.open_output_stream(f"{root}/{name}", compression=None), name, 0, 0]
            out[0].write(head)
            out[2] += len(head)
        out[0].write(member)
        out[2] += len(member)
        out[3] += count

    last = None
    for batch in batches:
        for start in range(0, batch.num_rows, 100):
            for of, is_page, page_id, url, html, sha1, first in zip(*(c.slice(start, 100).to_pylist() for c in batch.columns), strict=True):
                if of != shard:
                    close()
                    shard, number = of, 0
                if (of, page_id) != last:
                    marks, met, last = {}, set(), (of, page_id)
                if not is_page:
                    marks[sha1] = first
                    continue
                payload = (html or "").encode("utf-8")
                raw = hashlib.sha1(payload).hexdigest()
                digest = base64.b32encode(bytes.fromhex(raw)).decode()
                refers = marks[raw] if raw in marks else page_id if raw in met and len(payload) >= limits.least_revisit else ()
                met.add(raw)
                put(page_record(page_id, url, payload, digest, refers, limits.date), 1)
    close()
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*written, strict=True) if written else [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])


def _commit(batches: Iterator, folder: str) -> Iterator:
    """Give files their final names; may run again."""
    from pyarrow import fs

    store, root = _store(folder)
    for batch in batches:
        for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
            if store.get_file_info(f"{root}/{temporary}").type == fs.FileType.File:
                store.move(f"{root}/{temporary}", f"{root}/{name}")
        yield batch


def _dealt(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest, one a file, over as many tasks as there are files (FILE_TASKS at most).

    The number is stated, as Spark would put the few bytes of a manifest into one task.
    """
    return manifest.repartitionByRange(max(1, min(FILE_TASKS, manifest.count())), "name")


def write_warc(pages: DataFrame, folder: str, limits: Limits = Limits()) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files into folder; returns the manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    slim = cut(rows.select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("bytes")))
    rows_n, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    groups = cut(slim.filter(F.col("bytes") >= limits.least_revisit).groupBy("sha1")
                 .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    repeats = (attach(slim.select("page_id", "sha1"), groups, "sha1", "n", rows_n)
               .filter("first is not null and (page_id is null or page_id <> first)").select("page_id", "sha1", "first").distinct())
    shards = max(1, min(limits.shards, total // limits.shard_bytes))
    sampled = min(1.0, shards * max(20, min(200, 200_000 // shards)) / max(1, rows_n))
    sample = sorted((r.page_id, r.bytes) for r in slim.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < sampled * (1 << 20)).filter("page_id is not null").select("page_id", "bytes").collect())
    bounds, seen, share = [], 0, sum(b + 1 for _, b in sample) / shards
    for page_id, size in sample:
        if seen >= share * (len(bounds) + 1) and (not bounds or bounds[-1] < page_id):
            bounds.append(page_id)
        seen += size + 1
    shard = bounds_at_most(F.col("page_id"), bounds).alias("shard")
    none = F.lit(None).cast("string")
    stream = rows.select(shard, F.lit(True).alias("is_page"), "page_id", "url", "html", none.alias("sha1"), F.lit(None).cast("long").alias("first")).unionAll(
        repeats.select(shard, F.lit(False), "page_id", none, none, "sha1", "first"))
    store, root = _store(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    manifest = cut(stream.repartition("shard").sortWithinPartitions("shard", "page_id", "is_page", "url", "html")
                   .mapInArrow(partial(_write_shards, folder=folder, limits=limits), MANIFEST))
    done = cut(_dealt(manifest).mapInArrow(partial(_commit, folder=folder), MANIFEST)).drop("temporary")
    done.write.parquet(f"{folder}/manifest")
    store.delete_dir(f"{root}/_temporary")
    return spark.read.schema(done.schema).parquet(f"{folder}/manifest")


def members(stream: io.RawIOBase) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream, read in portions."""
    offset, data = 0, b""
    while True:
        inflate, out, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not data and not (data := stream.read(1 << 20)):
                if used:
                    raise ValueError(f"the gzip member at {offset} is cut short")
                return
            out.append(inflate.decompress(data))
            used += len(data) - len(inflate.unused_data)
            data = inflate.unused_data
        yield offset, b"".join(out)
        offset += used


def parse_record(content: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case) and block of one record, whose block digest must hold."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"record {headers.get('warc-record-id')} is damaged")
    return headers, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long"


def _read_files(batches: Iterator, folder: str) -> Iterator:
    import pyarrow as pa

    store, root = _store(folder)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in READ.split(", ")]
    number = lambda text: None if text in (None, NO_ID) else int(text)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            rows = []
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for at, content in members(stream):
                    headers, block = parse_record(content)
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    if kind == "response" and (digest32(payload) != digest or len(payload) != size):
                        raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
                    rows.append((number(headers["x-page-id"]), headers["warc-target-uri"], size, digest, kind, number(headers.get("x-refers-to-page-id")), name, at))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files in a manifest, digests checked."""
    return _dealt(manifest.select("name")).mapInArrow(partial(_read_files, folder=folder), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """The rows of op9: pages written to the shared folder and read back from there."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file")
