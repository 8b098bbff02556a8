"""Legacy ARC archives converted to WARC, written and read back (operator 1)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import prepare, shared_dir, store, text_or_empty

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: An archive file is closed at this many bytes.
FILE_BYTES = 64 << 20
PAGE_HEADER = "X-Page-Id"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    """The identifier of a page's record: the same whenever and wherever it is made."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1}')}>"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 duotrace\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes) -> bytes:
    """A page as a legacy record: an HTTP response after a header line of the version's fields."""
    page = "" if page_id is None else str(page_id)
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: {page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    when = datetime(2000, 1, 1) + timedelta(seconds=(page_id or 0) % 1_000_000_000)
    safe = "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "unknown:")
    values = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": when.strftime("%Y%m%d%H%M%S"), "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(content))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def arc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of an ARC file, of version 1 or 2, by its declared length.

    The file's own version block says which fields a header line has. A URL may hold spaces: fields are taken from the
    right. A file without a version block, or a record shorter than it declares, is refused.
    """
    fields = None
    while line := stream.readline():
        if not line.strip():
            continue
        if fields is None and not line.startswith(b"filedesc://"):
            raise ValueError("no version block")
        length = int(line.rsplit(None, 1)[1])
        content = stream.read(length)
        if len(content) != length:
            raise ValueError("a record is shorter than its declared length")
        if fields is None:
            version = int(content.split(None, 1)[0])
            fields = ARC_FIELDS.get(version)
            if fields is None:
                raise ValueError(f"unknown ARC version {version}")
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError("a header line lacks fields")
        yield dict(zip(fields, values)), content


def warc_date(arc_date: str) -> str:
    """14 digits (or fewer: the rest are the earliest) to an ISO time."""
    digits = arc_date[:14]
    return datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def split_http(content: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if head.startswith(b"HTTP/") and mark else (b"", content)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.decode("latin-1").lower() == name.lower():
            return value.strip().decode("latin-1")
    return None


def to_warc(fields: dict[str, str], content: bytes, original: int | None = None) -> bytes:
    """A legacy record as a WARC record. original: the page whose record holds the same payload; then this one is a revisit without it."""
    head, payload = split_http(content)
    sha1 = hashlib.sha1(payload).hexdigest()
    page = http_field(head, PAGE_HEADER)
    kind = "revisit" if original is not None else "response" if head else "resource"
    body = head if kind == "revisit" else content
    named = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(int(page) if page else None, sha1),
        "WARC-Date": warc_date(fields["Archive-date"]),
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(body)}",
        "Content-Type": "application/http; msgtype=response" if head else fields["Content-type"],
    }
    if kind == "revisit":
        named |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(original, sha1)}
    named["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def warc_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record; a block that doesn't match its digest is refused."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        named = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            named[key.strip()] = value.strip()
        block = stream.read(int(named["Content-Length"]))
        digest = named.get("WARC-Block-Digest")
        if digest and digest != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"{named.get('WARC-Record-ID')}: the block doesn't match its digest")
        yield named, block


def _files(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def _write(folder: str):
    """A partition's pages through a legacy archive into WARC files, a compressed member a record. Files of a failed attempt are never listed."""

    def run(batches):
        from pyspark import TaskContext

        system, path = _files(folder)
        system.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name, out, size, records, number = None, None, 0, 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            version = 1 + (part + number) % 2
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            legacy = io.BytesIO(arc_version_block(version, f"pages-{part}") + b"".join(arc_record(version, url, page, html.encode()) for page, url, html, _ in rows))
            for (fields, content), (page, _, _, original) in zip(arc_records(legacy), rows):
                if out is None:
                    name, size, records = f"part-{part:05}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(to_warc(fields, content, original if original is not None and original != page else None), 6, mtime=0)
                out.write(member)
                size += len(member)
                records += 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
            number += 1
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 0) -> DataFrame:
    """Writes a WARC record for each row of pages to files in a shared folder; returns their path, records and bytes.

    Of records with equal payloads of at least `revisit_from` bytes, that with the largest page_id is a response and the
    others are revisits that refer to it. Null html is an empty payload, a null url is `unknown:`; a page without a
    page_id is always a response. Rows that repeat a page_id and payload are each written as responses or revisits alike.
    """
    spark = prepare(pages.sparkSession)
    body = text_or_empty(html)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    keyed = rows.withColumn("sha", F.when(F.octet_length("html") >= revisit_from, F.sha1("html")))
    groups = keyed.filter("sha is not null and page_id is not null").groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = store(groups.filter("n > 1").select("sha", "original"))
    # Both sides are plain shuffles, so that Spark splits the partition of a payload that very many pages share.
    placed = keyed.join(groups, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNotNull(), F.col("original")).alias("original"))
    return store(placed.mapInArrow(_write(folder), "path string, records long, bytes long"))


def _read(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, path = _files(uri)
            out = [[] for _ in range(6)]
            with system.open_input_stream(path, compression=None) as raw, gzip.open(raw) as stream:
                for named, block in warc_records(stream):
                    head, payload = split_http(block)
                    page = http_field(head, PAGE_HEADER)
                    whole = named["WARC-Type"] != "revisit"
                    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and base32_sha1(payload) != digest:
                        raise ValueError(f"{named['WARC-Record-ID']}: the payload doesn't match its digest")
                    row = (int(page) if page else None, named["WARC-Record-ID"], named["WARC-Type"], named.get("WARC-Refers-To"), len(payload) if whole else None, digest)
                    for column, v in zip(out, row):
                        column.append(v)
                    if len(out[0]) >= 5000:
                        yield _rows(out)
                        out = [[] for _ in range(6)]
            yield _rows(out)


def _rows(columns):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["page_id", "record_id", "record_type", "refers_to_id", "bytes", "payload_digest"])


def read_archives(files: DataFrame, tasks: int) -> DataFrame:
    """One row a record of the WARC files in column `path`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload_bytes and refers_to come from the record that it refers to; the job fails if no file has that one.
    """
    found = files.select("path").repartition(max(1, tasks)).mapInArrow(_read, "page_id long, record_id string, record_type string, refers_to_id string, bytes long, payload_digest string")
    found = store(found)
    whole = found.filter("refers_to_id is null")
    kept = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("payload_bytes"))
    kept = store(kept.dropDuplicates(["refers_to_id"]))
    again = found.filter("refers_to_id is not null").join(kept, "refers_to_id", "left")
    again = again.filter(F.assert_true(F.col("payload_bytes").isNotNull(), F.concat(F.lit("a revisit's record is missing: "), "refers_to_id")).isNull())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(*columns))


def op1(spark, sf_dir: str) -> DataFrame:
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark))
    return read_archives(files, files.count())
