"""WARC archives as a Python data source, read and written.

Reading plans one partition per file: only from its first record on are the
bounds of a file's records certain, since a payload may hold records itself.
Headers are parsed first; a record that fails the pushed-down predicates on its
type, id, target or date is skipped by its length, and its block is neither read
nor decoded. The payload is read only when asked for (option ``payload``).

Writing is two-phase: tasks write files of about ``file_bytes`` to a staging
folder of their own write, the commit moves those that belong to the result. With
the option ``compress`` every record is a gzip member of its own, as crawlers keep it.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from mailglass.llm.shared import materialize, open_folder

VERSION = b"WARC/1.1\r\n"
#: Column and header of each field that is kept.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To",
          "payload_digest": "WARC-Payload-Digest", "payload_type": "WARC-Identified-Payload-Type"}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", headers map<string,string>, block_bytes long, payload_bytes long, payload binary, file string, offset long"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A revisit has no payload; this header of our own says how long the one was that it stands for.
LENGTH_HEADER = "X-Original-Payload-Length"
FILE_BYTES = 32 << 20
#: Of gzip; higher ones take several times as long for a few per cent less.
LEVEL = 1


@dataclass
class Archive(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def header_block(headers: dict[str, str], length: int) -> bytes:
    """A record's head. Line ends inside a value would break it and become blanks."""
    clean = {k: " ".join(v.split("\n")).replace("\r", " ") for k, v in headers.items() if v is not None}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in clean.items()).encode() + f"Content-Length: {length}\r\n\r\n".encode()


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields of a record's head; a folded line goes on the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


class _Unzipped:
    """The content of an archive of gzip members, read once from front to back."""

    def __init__(self, stream):
        self.stream, self.at = gzip.GzipFile(fileobj=stream), 0

    def read_at(self, n: int, at: int) -> bytes:
        while self.at < at and (skipped := self.stream.read(min(1 << 20, at - self.at))):
            self.at += len(skipped)
        parts = []
        while n > 0 and (part := self.stream.read(n)):
            parts.append(part)
            n -= len(part)
            self.at += len(part)
        return b"".join(parts)


class _Window:
    """Reads of a file through one buffer, with skips that do not read."""

    def __init__(self, source, size: int, chunk: int = 1 << 20):
        self.source, self.size, self.chunk, self.at, self.data = source, size, chunk, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            held = self.data[at - self.at :] if self.at <= at else b""
            more = min(max(n - len(held), self.chunk), self.size - at - len(held))
            read = self.source.read_at(more, at + len(held)) if more > 0 else b""
            if len(read) < more:
                self.size = at + len(held) + len(read)  # a compressed file's end is known when it is reached
            self.at, self.data = at, held + read
        return self.data[at - self.at : at - self.at + n]

    def until(self, at: int, mark: bytes) -> int:
        """Position of the next ``mark`` from ``at``, or -1."""
        while at < self.size:
            own = self.bytes(at, min(self.chunk, self.size - at))
            if (found := own.find(mark)) >= 0:
                return at + found
            if at + len(own) >= self.size:
                return -1
            at += len(own) - len(mark) + 1
        return -1


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest", "payload_type")

    def __init__(self, options):
        self.path, self.payload = options.get("path"), options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):  # noqa: N802
        """Takes equality and IN on the header columns; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in self.PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, path = open_folder(self.path)
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        host = "" if not scheme or scheme == "file://" else self.path[len(scheme) :].split("/")[0]
        own = system.get_file_info(path)
        files = [own] if own.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        uri = lambda p: f"{scheme}{host}{p}" if scheme else p
        return [Archive(uri(f.path)) for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz")) and "/_staging" not in f.path] or [Archive("")]

    def read(self, part: Archive) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        system, path = open_folder(part.file)
        zipped = path.endswith(".gz")
        with system.open_input_stream(path, compression=None) if zipped else system.open_input_file(path) as source:
            window = _Window(_Unzipped(source), 1 << 62) if zipped else _Window(source, source.size())
            at, rows, held = 0, [], 0
            while window.bytes(at, 1):
                end = window.until(at, b"\r\n\r\n")
                if end < 0 or window.bytes(at, len(VERSION)) != VERSION:
                    raise ValueError(f"{part.file}: no record at {at}")
                headers = parse_headers(window.bytes(at, end - at))
                length = int(headers["Content-Length"])
                values = {c: headers.get(h) for c, h in FIELDS.items()}
                if all(values[c] in v for c, v in self.wanted.items()):
                    payload = None
                    # the head of an HTTP message in the block is short; the payload behind it is read only if wanted
                    inner = 0
                    if headers.get("Content-Type", "").startswith("application/http") and length:
                        inner = window.until(end + 4, b"\r\n\r\n") + 4 - (end + 4)
                        inner = inner if 0 < inner <= length else 0
                    if self.payload:
                        payload = window.bytes(end + 4 + inner, length - inner)
                        held += len(payload)
                    rows.append((*values.values(), list(headers.items()), length, length - inner, payload, part.file, at))
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, held = [], 0
                at = end + 4 + length + 4
            if rows:
                yield _batch(rows)


_ARROW = pa.schema([(c, pa.string()) for c in FIELDS] + [("headers", pa.map_(pa.string(), pa.string())), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, date, refers_to, payload_digest, payload_bytes, payload."""

    def __init__(self, options):
        self.folder, self.run = options["path"], uuid.uuid4().hex
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.compress = options.get("compress", "false").lower() == "true"

    def _staging(self):
        system, path = open_folder(self.folder)
        return system, path, f"{path}/_staging-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, _, staging = self._staging()
        names, out, written = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compress else ""))
                    system.create_dir(staging, recursive=True)
                    out, written = system.open_output_stream(f"{staging}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
                body, headers = self._record(row)
                record = header_block(headers, len(body)) + body + b"\r\n\r\n"
                out.write(gzip.compress(record, LEVEL, mtime=0) if self.compress else record)
                written += len(record)  # what a reader of the file goes through
                if written >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def _record(self, row: dict) -> tuple[bytes, dict]:
        headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"],
                   "WARC-Payload-Digest": row["payload_digest"], "Content-Type": "application/http; msgtype=response"}
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        if row["record_type"] == "revisit":
            return head, headers | {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row["refers_to"], LENGTH_HEADER: str(row["payload_bytes"])}
        return head + (row["payload"] or b""), headers

    def commit(self, messages) -> None:
        system, path, staging = self._staging()
        system.create_dir(path, recursive=True)
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(f"{staging}/{name}", f"{path}/{name}")
        self._clear(system, staging)

    def abort(self, messages) -> None:
        system, _, staging = self._staging()
        self._clear(system, staging)

    @staticmethod
    def _clear(system, staging: str) -> None:
        from pyarrow import fs

        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def record_urn(page_id) -> object:
    return F.concat(F.lit("<urn:x-page:"), page_id.cast("string"), F.lit(">"))


def records_of(pages: DataFrame, shortest: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html), also where a page_id repeats.

    The payload is the html in UTF-8, null taken as empty. Of the records with equal
    payloads of at least ``shortest`` bytes the one with the smallest page_id is a
    response and the others revisit it; shorter ones are responses. The rows of one page
    are told apart by their digests. Only ids and digests are grouped; payloads move
    once, by page_id and digest, and a revisit's is left out. A row without a page_id
    revisits like any other, and is never the one that is revisited if another has an id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    narrow = materialize(own.select("page_id", "digest", "payload_bytes"))
    first = narrow.filter(F.col("payload_bytes") >= shortest).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    again = narrow.filter(F.col("payload_bytes") >= shortest).join(first, "digest").filter("NOT (page_id <=> first)").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first").distinct()
    joined = own.join(again, (own["digest"] == again["_digest"]) & own["page_id"].eqNullSafe(again["_page"]), "left")
    revisit = F.col("first").isNotNull()
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_urn(F.col("page_id")).alias("record_id"), "target_uri", F.lit(date).alias("date"),
        F.when(revisit, record_urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, compress: bool = False) -> None:
    """Archives of about ``file_bytes`` of records each, before they are compressed."""
    register(records.sparkSession)
    records.write.format("warc").option("file_bytes", str(file_bytes)).option("compress", str(compress).lower()).mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records below a folder. Filters on header columns are pushed into the scan;
    without ``payload`` only heads are parsed and payload is null."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def page_index(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives of pages.

    A response's length and digest are taken from the payload that is read; a digest
    that is not the one in its header raises an error. A revisit's are in its header.
    """
    number = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+)>$", 1).cast("long")
    responses = read_warc(spark, folder).filter("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
        F.substring_index("payload_digest", ":", -1).alias("said"))
    wrong = F.raise_error(F.concat(F.lit("payload of page "), F.col("page_id").cast("string"), F.lit(" is damaged"))).cast("string")
    responses = responses.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("said"), F.col("payload_digest")).otherwise(wrong)).drop("said")
    revisits = read_warc(spark, folder, payload=False).filter("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), F.element_at("headers", LENGTH_HEADER).cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
