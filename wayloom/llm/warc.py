"""WARC archives: writing with segments and revisits, reading with reassembly.

Archives are gzip files of one member a record.  Large responses are cut into a
first record and ``continuation`` records; the HTTP body of a segmented response
uses chunked framing.  Readers yield segments; Spark groups them by origin,
orders them by number, checks the total length and decodes the framing.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.taskcontext import TaskContext

from wayloom.llm.memory import bounded
from wayloom.llm.scratch import Scratch

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
REVISIT_LEAST = 100
READ_BYTES = 1 << 20
STEP_BYTES = 1 << 14
BATCH_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def encode_chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(body[i : i + size]), body[i : i + size]) for i in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped, a short chunk is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if at + size > len(body):
            raise ValueError("a chunk ends beyond its block")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The decoded HTTP payload of a whole response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return decode_chunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def response_records(urn: str, url: str, payload: bytes, digest: str, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    common = {"WARC-Type": "response", "WARC-Record-ID": f"<{urn}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if len(payload) <= segment:
        yield serialise(common, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + encode_chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    for i, piece in enumerate(pieces, 1):
        headers = common | {"WARC-Segment-Number": "1"} if i == 1 else {
            "WARC-Type": "continuation", "WARC-Record-ID": f"<{urn}/segment/{i}>", "WARC-Date": DATE, "WARC-Target-URI": url,
            "WARC-Segment-Origin-ID": f"<{urn}>", "WARC-Segment-Number": str(i)}
        if i == len(pieces) and i > 1:
            headers["WARC-Segment-Total-Length"] = str(len(block))
        yield serialise(headers, piece)


def revisit_record(urn: str, url: str, size: int, digest: str, refers_to: str) -> bytes:
    return serialise(
        {"WARC-Type": "revisit", "WARC-Record-ID": f"<{urn}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha256:{digest}",
         "WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": PROFILE, "WARC-Truncated": "length", "Content-Type": "application/http;msgtype=response"},
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size)


class _Inflated:
    """Bytes of a plain or gzip stream (any number of members), inflated in bounded steps; a position moves, nothing is cut off the front."""

    def __init__(self, stream):
        self.stream, self.raw, self.from_, self.z = stream, memoryview(b""), 0, None
        self.buf, self.at, self.packed = b"", 0, None

    def _next(self) -> bytes:
        while True:
            if self.from_ == len(self.raw):
                self.raw, self.from_ = memoryview(self.stream.read(READ_BYTES)), 0
                if not len(self.raw):
                    return b""
                if self.packed is None:
                    self.packed = bytes(self.raw[:2]) == b"\x1f\x8b"
            if not self.packed:
                out, self.from_ = bytes(self.raw[self.from_ :]), len(self.raw)
                return out
            # a small step, since zlib copies what follows the end of a member
            step = self.raw[self.from_ : self.from_ + STEP_BYTES]
            self.z = self.z or zlib.decompressobj(31)
            out = self.z.decompress(step, READ_BYTES)
            left = len(self.z.unused_data) if self.z.eof else len(self.z.unconsumed_tail)
            self.from_ += len(step) - left
            if self.z.eof:
                self.z = None
            if out:
                return out

    def more(self) -> bool:
        got = self._next()
        self.buf, self.at = self.buf[self.at :] + got, 0
        return bool(got)

    def head(self) -> bytes | None:
        """What stands before the next empty line; None at the end."""
        while True:
            while self.buf[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            end = self.buf.find(b"\r\n\r\n", self.at)
            if end >= 0:
                out, self.at = self.buf[self.at : end], end + 4
                return out
            if not self.more():
                if self.buf[self.at :].strip():
                    raise ValueError("an archive ends inside a record")
                return None

    def take(self, size: int) -> bytes:
        parts, have = [self.buf[self.at : self.at + size]], min(size, len(self.buf) - self.at)
        self.at += have
        while have < size:
            if not self.more():
                raise ValueError("an archive ends inside a block")
            parts.append(self.buf[: size - have])
            self.at = len(parts[-1])
            have += self.at
        return b"".join(parts)


def records(stream) -> Iterator[Record]:
    """Records of an archive, read in bounded steps; plain and gzip (one member a record or one for all)."""
    source = _Inflated(stream)
    while (head := source.head()) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers: dict[str, str] = {}
        key = None
        for line in lines[1:]:
            if line[:1] in " \t" and key:
                headers[key] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            key = name.strip().lower()
            headers[key] = value.strip()
        yield Record(headers, source.take(int(headers["content-length"])))


def _open(uri: str, write: bool = False):
    fs, path = pafs.FileSystem.from_uri(uri)
    return (fs.open_output_stream(path), fs, path) if write else (fs.open_input_stream(path, compression=None), fs, path)


SEGMENT_SCHEMA = "archive string, record_id string, origin_id string, segment int, total_length long, warc_type string, url string, digest string, refers_to string, block binary"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One archive a task, named by its partition: a repeated task writes the same file again."""
        part = TaskContext.get().partitionId()
        uri, n = f"{root}/part-{part:06d}.warc.gz", 0
        stream = None
        for batch in batches:
            if stream is None:
                fs, folder = pafs.FileSystem.from_uri(root)
                fs.create_dir(folder, recursive=True)
                own = f"{uri}.{TaskContext.get().taskAttemptId()}"
                stream, fs, path = _open(own, True)
            for urn, url, html, digest, refers_to in zip(*batch.columns):
                address = (url.as_py() or "").replace("\r", "%0D").replace("\n", "%0A")
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                if not refers_to.is_valid:
                    for raw in response_records(urn.as_py(), address, payload, digest.as_py()):
                        stream.write(raw)
                else:
                    stream.write(revisit_record(urn.as_py(), address, len(payload), digest.as_py(), refers_to.as_py()))
                n += 1
        if stream is not None:
            stream.close()
            fs.move(path, path.rsplit(".", 1)[0])
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], ["archive", "n"])

    return run


def _read(wanted: bool | None):
    """Rows of SEGMENT_SCHEMA.  wanted: only records that are (True) or are not (False) segments."""
    names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                stream, _, _ = _open(uri)
                rows, held = [], 0
                for r in records(stream):
                    h = r.headers
                    number = int(h.get("warc-segment-number", 0))
                    if wanted is not None and wanted != (number > 0):
                        continue
                    own, total = h.get("warc-record-id", "").strip("<>"), h.get("warc-segment-total-length")
                    rows.append((uri, own, h.get("warc-segment-origin-id", own).strip("<>"), number, int(total) if total else None, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to", "").strip("<>") or None, r.block))
                    held += len(r.block) + 500
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                stream.close()
                if rows:
                    yield batch_of(rows)

    return run


def write_archives(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows (urn, url, html, digest, refers_to) and returns (archive, n), one row a file."""
    return rows.select("urn", "url", "html", "digest", "refers_to").mapInArrow(bounded(_write(root)), "archive string, n long")


def read_segments(archives: DataFrame, segmented: bool | None = None) -> DataFrame:
    """One row a record of the archives; records without segments have segment 0.  segmented: only segments, or only the others."""
    return archives.select("archive").mapInArrow(bounded(_read(segmented)), SEGMENT_SCHEMA)


WHOLE = "record_id string, warc_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, intact boolean"


def _whole(kind: str, block: bytes | None, digest: str | None) -> tuple:
    """(payload_bytes, payload_digest, payload, intact) of a block; None: its segments do not join."""
    stated = digest.removeprefix("sha256:") if digest is not None else None
    if block is None:
        return None, stated, None, False
    if kind == "revisit":
        m = re.search(rb"(?im)^content-length:\s*(\d+)", block)
        return int(m[1]) if m else 0, stated, None, True
    payload = payload_of(block)
    own = hashlib.sha256(payload).hexdigest()
    return len(payload), own, payload, stated in (None, own)


def _joined(parts: list[tuple[int, bytes]], total: int | None) -> bytes | None:
    """The blocks of segments in order; None if one is missing, there twice with another content, or the length is not the stated total."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(b for _, b in parts)
    return block if [n for n, _ in parts] == list(range(1, len(parts) + 1)) and len(block) == total else None


def _payloads(segmented: bool):
    names, types = zip(*(c.split() for c in WHOLE.split(", ")))
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t] for t in types]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for own, kind, url, digest, refers_to, block, total in zip(*batch.columns):
                raw = _joined([(p["segment"].as_py(), p["block"].as_buffer().to_pybytes()) for p in block], total.as_py()) if segmented else block.as_buffer().to_pybytes()
                size, computed, payload, intact = _whole(kind.as_py(), raw, digest.as_py())
                rows.append((own.as_py(), kind.as_py(), url.as_py(), size, computed, refers_to.as_py(), payload, intact))
                held += len(payload or b"") + 500
                if held > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    return run


def reassemble(segments: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Whole records: record_id, warc_type, url, payload_bytes, payload_digest, refers_to, payload, intact.

    ``whole`` are the rows of ``read_segments`` that are no segments (by default
    they are among ``segments``).  Segments of one origin are ordered by number and joined;
    ``intact`` is false if a number is missing or repeated with another content,
    if the joined length is not the stated total, or if the payload's digest is
    not the stated one.  Repeated identical segments (a record archived twice)
    count once.  Only segments are shuffled, keyed by origin; one record's
    segments have to fit into a row, as its payload does.
    """
    whole = segments.where("segment = 0") if whole is None else whole
    parts = segments.where("segment > 0").groupBy("origin_id").agg(
        F.collect_set(F.struct("segment", "block")).alias("block"), F.max("total_length").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("warc_type", "url", "digest", "refers_to")),
    )
    columns = ("record_id", "warc_type", "url", "digest", "refers_to", "block", "total")
    single = whole.withColumn("total", F.lit(None).cast("long")).select(*columns).mapInArrow(bounded(_payloads(False)), WHOLE)
    return single.unionByName(parts.withColumnRenamed("origin_id", "record_id").select(*columns).mapInArrow(bounded(_payloads(True)), WHOLE))


def verified(records: DataFrame) -> DataFrame:
    """Whole records without payloads (a written table); a revisit is intact only if a response of the page it refers to has its digest."""
    page = F.regexp_extract("record_id", "^(.*):[^:]*$", 1)
    held = records.where("warc_type = 'response' and intact").select(page.alias("refers_to"), "payload_digest").distinct().withColumn("held", F.lit(True))
    again = records.where("refers_to is not null").join(held, ["refers_to", "payload_digest"], "left").withColumn("intact", F.col("intact") & F.coalesce("held", F.lit(False)))
    return records.where("refers_to is null").unionByName(again.select(*records.columns))


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(manifest of written archives, whole records read back) of a page table.

    Of pages with equal payloads of REVISIT_LEAST bytes or more, that with the
    smallest id is the response; the others revisit it.  Record ids carry the
    page id and a row number.  Defined cases: null html is an empty payload,
    null urls are empty; pages without an id are never revisited and never
    revisit unless another page with an id has the payload; rows that share the
    smallest id are all responses; an empty table gives no records.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    first = rows.where(F.octet_length("html") >= REVISIT_LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = scratch.save(first.select("digest", "first"), "firsts")
    page = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    placed = rows.join(first.hint("merge"), "digest", "left").select(
        F.concat(page(F.col("page_id")), F.lit(":"), F.monotonically_increasing_id().cast("string")).alias("urn"), "url", "html", "digest", F.when(again, page(F.col("first"))).alias("refers_to"))
    manifest = scratch.save(write_archives(placed, scratch.path("archives")), "manifest")
    spread = manifest.repartition(spark.sparkContext.defaultParallelism * 4, "archive")
    return manifest, reassemble(read_segments(spread, True), read_segments(spread, False))


def page_of(urn):
    """The page id inside a record id, null for pages without one."""
    return F.nullif(F.split(urn, ":")[2], F.lit("none")).cast("long")
