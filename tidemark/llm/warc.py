"""WARC: writing archives, reading them back, and assembling transactions.

``write_archives`` writes three records per page: request, response (or revisit, where an equal payload has
its response elsewhere) and metadata; request and metadata name the response by WARC-Concurrent-To.
Archives are gzip files with one member per record, in the folder all executors share, written under a
name of the attempt and renamed when whole, so a repeated task replaces a file by the same bytes.
``read_records`` reads archives record by record, and ``transactions`` joins the records of an archive through
their concurrent-to identifiers into one nested row per capture.

Null html is the empty payload. Equal payloads of at least ``least`` bytes have one response, at the largest
page_id (a page_id that repeats with an equal payload: its first row responds, the others revisit it); below that size all respond. A page with null
page_id always responds. An empty table gives no archive and no capture. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, scratch, table

LEAST_BYTES = 0
ROLL_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "file string, record_id string, type string, concurrent_to string, refers_to string, page_id long, uri string, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, copy: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{copy}')}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One gzip member that holds one WARC record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def capture(page_id: int | None, url: str, payload: bytes, copy: int, refers: int | None) -> bytes:
    """The three records of a page. ``copy``: how many rows of this page_id had this payload before; ``refers``: the page
    that responds for it, None if it responds itself."""
    sha = digest(payload)
    copy, uri = f"{sha}/{copy}", url.replace("\r", "%0D").replace("\n", "%0A")
    own = record_id(page_id, copy)
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    path = "/" + uri.split("://", 1)[-1].partition("/")[2]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_id(page_id, f"{copy}/request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")]
    kind = [("WARC-Type", "response")] if refers is None else [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, f"{sha}/0")), ("X-Refers-To-Page", refers)]
    answer = [*kind, ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    note = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(page_id, f"{copy}/metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")]
    return b"".join(
        (
            record(request, f"GET {path} HTTP/1.1\r\nHost: {uri.split('://', 1)[-1].partition('/')[0]}\r\n\r\n".encode()),
            record(answer, http + (payload if refers is None else b"")),
            record(note, b"" if page_id is None else f"page-id: {page_id}\r\n".encode()),
        )
    )


class Archive:
    """An archive that gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder)
        self.name, self.part = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.fs.open_output_stream(self.part), 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.name)
        return self.name.rsplit("/", 1)[-1]


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, archive, last = TaskContext.get().partitionId(), 0, None, None
        seen: Counter[bytes] = Counter()
        for batch in batches:
            done = []
            for page_id, url, html, ref in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or Archive(folder, f"part-{part:05}-{number:04}.warc.gz")
                payload = html or b""
                if page_id != last:  # rows of a page_id are neighbours
                    last = page_id
                    seen.clear()
                sha = hashlib.sha1(payload).digest()
                first = ref is None or ref == page_id and not seen[sha]
                archive.add(capture(page_id, url or "", payload, seen[sha], None if first else ref))
                seen[sha] += 1
                if archive.size >= ROLL_BYTES:
                    done.append(archive.close())
                    archive, number = None, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["file"])
        if archive:
            yield pa.RecordBatch.from_arrays([pa.array([archive.close()], pa.string())], ["file"])

    return write




def responders(pages: DataFrame, least: int) -> DataFrame:
    """page_id and, by payload, the page that responds for it, for payloads that others have too."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("n")).filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    shared = keys.groupBy("sha").agg(F.max("page_id").alias("ref"), F.count("*").alias("copies")).filter("copies > 1")
    return keys.join(shared, "sha").groupBy(F.col("page_id").alias("of")).agg(F.collect_set(F.struct("sha", "ref")).alias("refs"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, partitions: int | None = None) -> list[str]:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; returns the names of the files."""
    prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    refs = responders(pages, least)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # one exchange of payloads, by page_id; pages without one are dealt by their payload and match nothing
    rows = pages.select("*", F.coalesce(F.col("page_id"), F.xxhash64("html")).alias("of"))
    if partitions:
        rows, refs = rows.repartition(partitions, "of"), refs.repartition(partitions, "of")
    rows = rows.join(refs.hint("merge"), "of", "left")
    own = F.filter("refs", lambda r: (r["sha"] == F.unhex(F.sha1(payload))) & F.col("page_id").isNotNull())
    rows = rows.select("page_id", "url", payload.alias("html"), F.get(own, F.lit(0))["ref"].alias("ref"))
    files = rows.sortWithinPartitions("page_id", "url").mapInArrow(_writer(folder), "file string")
    return sorted(r.file for r in files.collect())


def members(stream: pafs.FileSystem | io.RawIOBase) -> Iterator[bytes]:
    """The content of each gzip member of a stream, one at a time."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(1 << 20):
        parts.append(unpack.decompress(chunk))
        rest = b""
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("a record is shorter than its Content-Length")
    return fields, rest[:size]


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        kind, page, sha, n, payload = fields["warc-type"], None, None, None, None
                        refers = fields.get("x-refers-to-page")
                        if kind in ("response", "revisit"):
                            head, _, payload = block.partition(b"\r\n\r\n")
                            n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            sha = digest(payload) if kind == "response" else fields["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and (n != len(payload) or fields["warc-payload-digest"] != f"sha1:{sha}"):
                                raise ValueError(f"{name}: a payload differs from its digest")
                        elif kind == "metadata" and block.startswith(b"page-id:"):
                            page = int(block.split(b":", 1)[1])
                        rows.append((name, fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), refers, page, fields.get("warc-target-uri"), sha, n, payload if with_payload else None))
                        size += len(payload or b"") * with_payload + 400
                        if size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_records(spark: SparkSession, folder: str, files: list[str], with_payload: bool = True) -> DataFrame:
    """A row per record of the archives; every payload is read and held against its digest either way."""
    prepare(spark)
    names = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)))
    return names.mapInArrow(_reader(folder, with_payload), RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata, joined by concurrent-to.

    The three are rows of one group keyed by (archive, identifier), so one shuffle assembles them.
    """
    key = F.when(F.col("type").isin("request", "metadata"), F.col("concurrent_to")).otherwise(F.col("record_id"))
    pick = lambda cond, *cols: F.first(F.when(cond, F.struct(*cols)), ignorenulls=True)
    return (
        records.groupBy("file", key.alias("capture"))
        .agg(
            pick(F.col("type") == "request", "record_id", "uri").alias("request"),
            pick(F.col("type").isin("response", "revisit"), "record_id", "type", "uri", "payload_digest", "payload_bytes", "refers_to", "payload").alias("response"),
            pick(F.col("type") == "metadata", "record_id", "page_id").alias("metadata"),
        )
        .filter(F.col("response").isNotNull())
    )


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    # the query needs no payload column, so payloads are checked by the reader and not shuffled
    found = transactions(read_records(spark, folder, files, with_payload=False))
    return found.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("response.refers_to").cast("long").alias("refers_to"),
        F.col("request.uri").alias("uri"),
    )
