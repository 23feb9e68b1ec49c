"""WARC archives of pages: written in order of page id by many tasks, committed by manifest, read back.

Of pages with equal payloads the one with the largest id becomes a response record, the others
revisit records that name it. Only ids and digests are grouped to find that out; the pages
themselves are shuffled once, by ranges of page id, together with the rows that mark revisits.

Every task writes gzip members, one record each, to files under ``_temporary`` whose names hold the
attempt, and starts a new file when the compressed size is reached. Its manifest rows (file, records,
size, digest) are committed by Spark's writer; then files named in the manifest, and only those, are renamed to their final
names. A task that runs twice or dies leaves nothing but temporary files, which go at the end.
Renaming again is harmless.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalsift.llm.common import Workspace, small_batches

ROLL_BYTES = 32 << 20
LEVEL = 4
#: The profile of the WARC standard for a payload that equals another record's.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

MANIFEST = "name string, temporary string, records long, bytes long, digest string, first_page long, last_page long"
_ARROW_MANIFEST = pa.schema([
    ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()),
    ("digest", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64()),
])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ARROW_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, whichever task writes it."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def build_record(
    page_id: int | None, url: str | None, payload: bytes, date: str, revisits: tuple[int | None] | None
) -> bytes:
    """A WARC/1.1 record; ``revisits`` holds the page that a revisit record refers to."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        f"WARC-Type: {'response' if revisits is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', '_', url or 'urn:none')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisits is None:
        block += payload
    else:
        lines += [
            f"WARC-Refers-To: {record_id(revisits[0], digest)}",
            f"WARC-Profile: {SAME_PAYLOAD}",
            f"Refers-To-Page-ID: {'' if revisits[0] is None else revisits[0]}",
        ]
    lines += [
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """A record's row; digests of block and payload are computed anew and compared."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda text: int(text) if text else None
    return {
        "page_id": number(fields["Page-ID"]), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(fields.get("Refers-To-Page-ID", "")),
    }


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a record")
            chunk = view[at : at + step]
            parts.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        yield b"".join(parts)


class _File:
    """One archive under its temporary name."""

    def __init__(self, files, folder: str, name: str, attempt: int):
        self.name, self.temporary = name, f"_temporary/{attempt}-{name}"
        self.stream = files.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.digest, self.bytes, self.records, self.pages = hashlib.sha1(), 0, 0, []

    def add(self, record: bytes, page_id: int | None) -> None:
        deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = deflate.compress(record) + deflate.flush()
        self.stream.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1
        self.pages = [self.pages[0] if self.pages else page_id, page_id]

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        row = {
            "name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes,
            "digest": self.digest.hexdigest(), "first_page": self.pages[0], "last_page": self.pages[1],
        }
        return pa.RecordBatch.from_pylist([row], schema=_ARROW_MANIFEST)


def file_system(folder: str):
    """A folder's file system and its path there, for local paths and pyarrow's URI schemes."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, date: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        files.create_dir(f"{path}/_temporary", recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        out, rolled = None, 0
        here: tuple | None = None
        marks: dict[str, int | None] = {}
        for batch in batches:
            for page_id, is_page, digest, refers_to, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (page_id,):
                    here, marks = (page_id,), {}
                if not is_page:
                    marks[digest] = refers_to
                    continue
                payload = (html or "").encode("utf-8")
                own = hashlib.sha1(payload).hexdigest()
                if out is None:
                    out = _File(files, path, f"pages-{part:06d}-{rolled:05d}.warc.gz", attempt)
                revisits = (marks[own],) if own in marks else None
                out.add(build_record(page_id, url, payload, date, revisits), page_id)
                # A second row with this id and payload refers to the first.
                marks.setdefault(own, page_id)
                if out.bytes >= roll_bytes:
                    yield out.close()
                    out, rolled = None, rolled + 1
        if out is not None:
            yield out.close()

    return write


def _committer(folder: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        files, path = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                target, source = f"{path}/{row['name']}", f"{path}/{row['temporary']}"
                if files.get_file_info(source).type == FileType.File:
                    files.move(source, target)
                info = files.get_file_info(target)
                if info.type != FileType.File or info.size != row["bytes"]:
                    raise OSError(f"{row['name']} was not committed")
            yield batch.select(["name"])

    return rename


def revisits(work: Workspace, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload another page's response record holds.

    Digests are counted before the join, and the join's keyed side is stored and unique, so
    adaptive execution can split a payload that a third of the pages share.
    """
    digests = work.store("digests", pages.select(
        "page_id", F.sha1(F.encode("html", "utf-8")).alias("digest"),
        F.octet_length("html").alias("n_bytes"),
    ).filter(F.col("n_bytes") >= least_bytes).drop("n_bytes"))
    shared = work.store("shared", digests.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("n"),
    ).filter("n > 1").drop("n"))
    return digests.join(shared, "digest").filter(
        "page_id < refers_to or (page_id is null and refers_to is not null)"
    ).select("page_id", "digest", "refers_to").distinct()


def write_archives(
    work: Workspace, pages: DataFrame, date: str = "2000-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES,
    least_bytes: int = 0,
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest of committed files.

    A null html is an empty payload, a null url is recorded as missing. Null ids come before all others
    and are never the response of a payload that a page with an id has. Of rows that share id and payload
    the first is the response and the others revisit it. Equal payloads below ``least_bytes`` are all
    responses, except for such repeated rows. Other columns are ignored; an empty table gives no file.
    """
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html")
    )
    rows = pages.select(
        "page_id", F.lit(True).alias("is_page"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("long").alias("refers_to"), "url", "html",
    ).unionByName(revisits(work, pages, least_bytes).withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    archives = f"{work.folder}/archives"
    written = (
        rows.repartitionByRange("page_id")
        .sortWithinPartitions("page_id", "is_page", "html", "url")
        .mapInArrow(_writer(archives, date, roll_bytes), MANIFEST)
    )
    manifest = work.store("manifest", written)
    work.store("committed", manifest.mapInArrow(_committer(archives), "name string"))
    files, path = file_system(archives)
    if files.get_file_info(f"{path}/_temporary").type.name == "Directory":
        files.delete_dir(f"{path}/_temporary")
    return manifest


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in a folder, checked against its own digests."""
    small_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for record in members(data.as_py()):
                    rows.append(parse_record(record))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RECORDS)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_RECORDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    work = Workspace(pages.sparkSession, "archives")
    manifest = write_archives(work, pages, **options)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORDS)
    return read_archives(pages.sparkSession, f"{work.folder}/archives")
