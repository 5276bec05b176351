"""Operator 8, WARC in ZIP: archives of stored members with record indexes, read by ranges.

Every task writes one ZIP to the shared folder: a member ``archive/*.warc.gz`` whose records are gzip members of their own,
and a member ``indexes/*.idx`` with a line of fixed width for each record. The name holds the attempt's own id and the
manifest, a written table, lists what successful attempts wrote, so a retried task leaves nothing that is read. Readers
get a range of index lines each: they parse the end record, the ZIP64 record and the central directory, find both members,
read their lines and then the records' bytes, neighbours in one request, and never extract a member.

Of records with equal payloads of at least ``least`` bytes (equal SHA-256), those with the largest page_id are responses and
the others are revisits of it; only keys and ids are shuffled to find out. Null html is an empty payload; a null page_id is
never the largest unless its group has no other; rows that repeat the largest page_id are all responses. An empty table
gives an empty table. Other columns are ignored; a table without ``url`` writes records without a target.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh_path, ship, task_count
from .zipstore import Reader, Writer

LINE, RANGE, REQUEST = 64, 2048, 4 << 20
MANIFEST = "path string, name string, size long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_DATE = "2000-01-01T00:00:00Z"


def open_fs(uri: str):
    """(file system, path) of a URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _head(fields: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """A WARC record; ``refers``: the page whose equal payload this one revisits."""
    revisit = refers is not None
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", _DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if " " < c else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Refers-To", _urn(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", "sha1:" + digest32(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def parse(data: bytes) -> tuple:
    """A record's (page_id, payload_bytes, payload_digest, type, refers_to, payload); a revisit has no payload of its own, its digest and length are those its headers tell of the full one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
    if kind == "revisit":
        return _page(f["warc-record-id"]), int(_fields(http)["content-length"]), told, kind, _page(f["warc-refers-to"]), None
    if (found := digest32(payload)) != told:
        raise ValueError(f"record {f['warc-record-id']}: its payload's digest is {found}, not {told}")
    return _page(f["warc-record-id"]), len(payload), told, kind, None, payload


def _written(folder: str):
    def run(batches):
        out = zip_ = None
        lines: list[bytes] = []
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        for b in batches:
            for page, url, html, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if zip_ is None:
                    system, path = open_fs(folder)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.zip")
                    zip_ = Writer(out)
                    zip_.begin(f"archive/{name}.warc.gz")
                packed = gzip.compress(record(page, url, (html.as_py() or "").encode(), refers), 1, mtime=0)
                lines.append(b"%20s %20d %20d\n" % (b"none" if page is None else b"%d" % page, zip_.write(packed), len(packed)))
        if zip_ is not None:
            zip_.end()
            zip_.begin(f"indexes/{name}.idx")
            for lo in range(0, len(lines), 4096):
                zip_.write(b"".join(x.rjust(LINE) for x in lines[lo : lo + 4096]))
            zip_.end()
            zip_.close()
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name}.zip"]), pa.array([name]), pa.array([zip_.at], pa.int64()), pa.array([len(lines)], pa.int64())], names=["path", "name", "size", "records"])

    return run


def write_archives(pages: DataFrame, least: int = 0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes the archives and returns their manifest: path, name, size, records."""
    spark = pages.sparkSession
    ship(spark)
    url = F.col(f"`{url_col}`").cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    keys = rows.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size")).filter(F.col("size") >= least)
    keys = durable(keys.select("page_id", "sha"), "payload-keys")
    last = keys.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "refers_to")
    again = keys.join(last, "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to").distinct()
    told = rows.withColumn("_key", F.sha2(F.coalesce("html", F.lit("")), 256))
    told = told.join(again, told["page_id"].eqNullSafe(again["_id"]) & (told["_key"] == again["_sha"]), "left").select("page_id", "url", "html", "refers_to")
    return durable(told.mapInArrow(_written(fresh_path(spark, "archives")), MANIFEST), "manifest")


def _read(batches):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for b in batches:
        for uri, name, size, first, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
            system, path = open_fs(uri)
            with system.open_input_file(path) as file:
                read = lambda at, n, file=file: file.read_at(n, at)
                archive = Reader(read, size)
                base, index = archive.data_start(f"archive/{name}.warc.gz"), archive.data_start(f"indexes/{name}.idx")
                lines = read(index + first * LINE, count * LINE)
                places = [(int(x[-43:-22]), int(x[-22:])) for x in (lines[i : i + LINE] for i in range(0, len(lines), LINE))]
                i = 0
                while i < len(places):
                    j, start = i, places[i][0]
                    while j < len(places) and (j == i or places[j][0] + places[j][1] - start <= REQUEST):
                        j += 1
                    data = read(base + start, places[j - 1][0] + places[j - 1][1] - start)
                    rows = [parse(gzip.decompress(data[at - start : at - start + n])) for at, n in places[i:j]]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    i = j


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    ship(manifest.sparkSession)
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(RANGE).cast("long"))).alias("first")
    ranges = manifest.filter("records > 0").select("path", "name", "size", "records", cuts).select("path", "name", "size", "first", F.least(F.lit(RANGE).cast("long"), F.col("records") - F.col("first")).alias("count"))
    return ranges.repartition(task_count(manifest.sparkSession), "path", "first").mapInArrow(_read, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records written and read again."""
    return read_archives(write_archives(pages, least)).drop("payload")
