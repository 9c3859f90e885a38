"""WARC archives without repeated payloads: revisit records refer to one response of equal payload."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import materialize
from lexweave.sources.scratch import scratch

#: Originals (digest and id of payloads that occur more than once) up to this number are broadcast, more are joined by
#: a shuffle.
BROADCAST_ROWS = 100_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("7a3d8f52-6d0e-4c49-9a55-0c4b5b1f7e21")


#: File systems that executors write archives to.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


def _named(rows: DataFrame) -> DataFrame:
    """rows with name (a hash of id, url and digest) and row: 0, or a number that tells rows of one name apart.

    Headers alone are counted by name; only where a name repeats are its rows written, payloads included, so that
    their numbers stay what they are."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    rows = rows.withColumn("name", F.sha1(F.concat_ws("|", mark(F.col("id").cast("string")), mark(F.sha1("url")), F.col("digest"))))
    repeated = materialize(rows.groupBy("name").count().where("count > 1").select(F.col("name").alias("again")), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long"))
    on = F.col("name") == F.col("again")
    twice = materialize(rows.join(repeated, on, "left_semi").withColumn("row", F.monotonically_increasing_id()), "numbered")
    return rows.join(repeated, on, "left_anti").withColumn("row", F.lit(0).cast("long")).unionByName(twice)


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """id, url, payload, digest (hex SHA-1), name and row (of its record), type (response or revisit) and, for revisits, to,
    to_url, to_name and to_row: those of the response. Of rows with equal payloads of at least least_bytes bytes those
    with the largest id are responses; of these the one with the largest url and smallest row is referred to.

    Headers alone (digest, id, url) are shuffled by digest, and pre-aggregated before; payloads are only where the
    payloads that occur more than once are too many to broadcast. The digest's hot rows can be split."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = _named(rows)
    long = rows.where(F.octet_length("payload") >= least_bytes)
    top = F.max(F.when(F.col("id").isNotNull(), F.struct("id", "url", "name", (-F.col("row")).alias("row"))))
    originals = long.groupBy("digest").agg(top.alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    originals = materialize(originals.select(F.col("digest").alias("same"), F.col("top.id").alias("to"), F.col("top.url").alias("to_url"), F.col("top.name").alias("to_name"), (-F.col("top.row")).alias("to_row")), "originals")
    if originals.count() <= BROADCAST_ROWS:
        originals = F.broadcast(originals)
    joined = rows.join(originals, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= least_bytes), "left")
    revisit = F.col("same").isNotNull() & ~F.col("id").eqNullSafe(F.col("to"))
    response = [F.when(revisit, F.col(c)).alias(c) for c in ("to", "to_url", "to_name", "to_row")]
    return joined.select("id", "url", "payload", "digest", "name", "row", F.when(revisit, "revisit").otherwise("response").alias("type"), *response)


def _record_id(name: str, row: int) -> str:
    """Of its own for each row: name is a hash of id, url and payload, row tells equal ones apart."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name}/{row}')}>"


def _digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def information(file: str, date: str) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: lexweave\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{file} {date}')}>", f"WARC-Date: {date}", f"WARC-Filename: {file}"]
    head += [f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(key: str | None, url: str | None, payload: bytes, digest: str, name: str, row: int, kind: str, to: str | None, to_url: str | None, to_name: str | None, to_row: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers only. Row-Id and Payload-Length are extension fields."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(name, row)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Block-Digest: {_digest(block)}", f"X-Payload-Length: {len(payload)}"]
    if key is not None:
        head.append(f"X-Row-Id: {key}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(to_name, to_row)}", f"WARC-Refers-To-Target-URI: {_clean(to_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Row-Id: {to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _filesystem(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write .warc.gz files (a gzip member a record, a new file after file_bytes of records) below path, a folder that
    all executors share, and return the manifest: path, records, bytes of each file. The manifest, itself written, is
    what counts: a file's name holds its task attempt, so files of lost or repeated attempts are in no manifest. Each
    file begins with a warcinfo record, which the manifest does not count. Executors write through pyarrow's file
    systems, to a path of SCHEMES (hdfs needs libhdfs there); any other is refused before anything is read."""
    if (scheme := urlparse(path).scheme) not in SCHEMES:
        raise ValueError(f"archives go to {', '.join(filter(None, SCHEMES))}, not to {scheme}")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolve(pages, id_col, url_col, payload_col, least_bytes)
    rows = rows.select(F.col("id").cast("string"), "url", "payload", "digest", "name", "row", "type", F.col("to").cast("string"), "to_url", "to_name", "to_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, folder = _filesystem(path)
        fs.create_dir(folder, recursive=True)
        out, name, seq, count, size, done = None, "", 0, 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(11)), strict=True):
                if out is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{seq:04d}.warc.gz"
                    out, seq, count, size = fs.open_output_stream(f"{folder}/{name}", compression=None), seq + 1, 0, 0
                    out.write(gzip.compress(information(name, date), level, mtime=0))
                raw = record(*(x.as_py() for x in row), date)
                out.write(gzip.compress(raw, level, mtime=0))
                count, size = count + 1, size + len(raw)
                if size >= file_bytes:
                    out.close()
                    done.append((f"{path}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count, size))
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in done])

    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of WARC records."""
    while line := stream.readline():
        if not line.strip():
            continue
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


class _Members(io.RawIOBase):
    """The content of a gzip file of many members, read a piece at a time."""

    def __init__(self, raw):
        self.raw, self.inflate, self.left = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            piece = self.left or self.raw.read(1 << 16)
            if not piece:
                return 0
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(piece, len(buffer))
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                buffer[: len(got)] = got
                return len(got)


def read_archives(manifest: DataFrame, id_type: str = "long", payload: bool = True) -> DataFrame:
    """The records of a manifest's files: id, url, record_type, payload_bytes, payload_digest (hex SHA-1), refers_to, record_id,
    refers_to_record and, if asked for, payload (null for revisits). A response's size and digest are those of the payload as read (a digest
    that differs from the record's header is an error); a revisit's are its headers'."""
    tasks = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "refers_to_record") + (("payload",) if payload else ())
        kinds = pa.schema([(f, pa.int64() if f == "payload_bytes" else pa.binary() if f == "payload" else pa.string()) for f in fields])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(name, compression=None) as raw:
                    for head, block in parse(io.BufferedReader(_Members(raw), 1 << 18)):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        body, n = None, int(head["x-payload-length"])
                        if head["warc-type"] == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            n = len(body)
                            if hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"{path}: {head['warc-record-id']} does not have the payload of its digest")
                        rows.append((head.get("x-row-id"), head["warc-target-uri"], head["warc-type"], n, digest, head.get("x-refers-to-row-id"), head["warc-record-id"], head.get("warc-refers-to"), body))
                        size += len(body or b"") if payload else 0
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=False)], schema=kinds)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=False)], schema=kinds)

    kinds = "id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, record_id string, refers_to_record string" + (", payload binary" if payload else "")
    out = manifest.select("path").repartition(tasks, "path").mapInArrow(read, kinds)
    return out.withColumns({"id": F.col("id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def revisit(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, payload: bool = False) -> DataFrame:
    """Write the pages as deduplicated archives and read them back; one row a page, as read_archives() gives it.

    Null payload: empty. Payloads under least_bytes bytes: always responses. Null id: a response where all ids of its
    group are null, else a revisit; its record has no Row-Id. Rows that repeat the largest id of a group: all responses,
    records of their own.
    Null url: empty. Very long payloads: a record each, held in memory one at a time. Empty table: no files, no rows.
    Columns besides the three named are not read."""
    path = path or scratch(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, path, id_col, url_col, payload_col, least_bytes), pages.schema[id_col].dataType.simpleString(), payload)
