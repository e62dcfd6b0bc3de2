"""Web archives as a table of chunks: no step holds a whole record.

Writing: a payload over ``chunk_bytes`` becomes a first record and ``continuation`` records,
the WARC standard's own segments, so that a row of the writer is one segment at most. Spark's text
sink writes the bytes of the rows, one gzip file per task; it commits files, so a lost executor leaves none
half written.

Reading: gzip files are not split, so a task gets a file's lines in order. A parser takes them as a
stream and hands out rows of record identifier and chunk number with the digest so far; between
rows it holds one chunk and the state of the digest."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, written

CHUNK_BYTES = 1 << 16
DATE = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"
_CHUNKS = (
    "record_id string, chunk_no long, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_offset long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"
)


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal, five bits a letter."""

    def letter(i: Column) -> Column:
        quad = F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        bits = F.pmod(F.floor(quad / F.pow(F.lit(2), 15 - 5 * (i % 4))), F.lit(32)).cast("int")
        return F.substring(F.lit(_BASE32), bits + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _header(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))).otherwise(F.lit(""))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> None:
    """Writes a WARC/1.1 record for each row of pages under the folder ``path``.

    Of rows with equal payloads of ``least_revisit`` bytes or more, the one with the smallest id is a response and the others are
    revisits of it; smaller payloads are responses. Payloads are the UTF-8 bytes of strings, or binary; null is empty. Rows that
    repeat an id and its payload are the same kind. A null url has no target header, line breaks in one are
    percent-encoded. Null ids are larger than all others. An empty table gives an archive without records."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    seen = rows.where(F.octet_length("payload") >= least_revisit).select("id", "sha", F.octet_length("payload").alias("n"))
    first = seen.groupBy("sha", "n").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = written(first, "copies")  # else each use would hash all payloads again
    again = join_unique(seen, first, ["sha", "n"], "copies", rows.count()).where(~F.col("id").eqNullSafe(F.col("first_id"))).select("id", "sha", "first_id").distinct()
    again = again.select(F.coalesce("id", F.lit(-(2**63))).alias("key"), "sha", "first_id")
    rows = rows.withColumn("key", F.coalesce("id", F.lit(-(2**63)))).join(again, ["key", "sha"], "left")

    def name(i: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))

    revisit = F.col("first_id").isNotNull()
    # The payload is cut once into an array of chunks; after the explode no row has more than one of them.
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / chunk_bytes).cast("int") - 1)), lambda i: F.substring("payload", i * chunk_bytes + 1, F.lit(chunk_bytes)))
    chunks = F.when(revisit, F.array(F.lit("").cast("binary"))).when(F.octet_length("payload") <= chunk_bytes, F.array("payload")).otherwise(chunks)
    cut = rows.select("id", "url", "first_id", base32(F.col("sha")).alias("digest"), F.octet_length("payload").alias("size"), chunks.alias("chunks"))
    parts = cut.select("id", "url", "first_id", "digest", "size", F.size("chunks").alias("segments"), F.posexplode("chunks").alias("segment", "chunk"))
    parts = parts.withColumn("segment", F.col("segment") + 1)
    size, chunk = F.col("size"), F.col("chunk")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), size.cast("string"), F.lit(_EOL * 2))
    block = F.when(F.col("segment") == 1, F.concat(http.cast("binary"), chunk)).otherwise(chunk)
    kind = F.when(revisit, "revisit").when(F.col("segment") == 1, "response").otherwise("continuation")
    several = F.col("segments") > 1
    own = F.when(F.col("segment") == 1, name(F.col("id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("segment"), F.lit(">")))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", own),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, name(F.col("first_id")))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Segment-Number", F.when(several, F.col("segment").cast("string"))),
        _header("WARC-Segment-Origin-ID", F.when(F.col("segment") > 1, name(F.col("id")))),
        _header("WARC-Segment-Total-Length", F.when(several & (F.col("segment") == F.col("segments")), size.cast("string"))),
        _header("Content-Type", F.when(F.col("segment") == 1, F.lit("application/http;msgtype=response"))),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_EOL),
    )
    records = parts.withColumn("block", block).select(F.concat(head.cast("binary"), F.col("block")).cast("string").alias("value"))
    records.write.option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


class _Parser:
    """Takes the lines of one file in order and returns chunk rows as their bytes come in."""

    def __init__(self, chunk_bytes: int, payloads: bool) -> None:
        self.chunk_bytes, self.payloads = chunk_bytes, payloads
        self.state, self.head, self.left = "between", {}, 0
        self.record: dict | None = None

    def line(self, line: bytes, rows: list) -> None:
        if self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.head = "head", {}
            elif line.strip():
                raise ValueError("a WARC record must start here")
            return
        if self.state == "head":
            if line.strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                self.head[key.strip().lower()] = value.strip()
                return
            self._begin(rows)
            self.left = int(self.head["content-length"])
            self.state = "http" if self.head.get("content-type", "").startswith("application/http") else "payload"
            if not self.left:
                self._end(rows)
            return
        taken = line[: self.left]
        self.left -= len(taken)
        if self.state == "http":
            if not taken.strip(b"\r\n"):
                self.state = "payload"
        else:
            self._payload(taken, rows)
        if not self.left:
            self._end(rows)

    def _begin(self, rows: list) -> None:
        h = self.head
        if h.get("warc-type") == "continuation" and self.record and self.record["id"] == h.get("warc-segment-origin-id"):
            return
        self.finish(rows)
        self.record = {
            "id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "refers": h.get("warc-refers-to"),
            "digest": (h.get("warc-payload-digest") or "").partition(":")[2] or None, "no": 0, "size": 0, "sha": hashlib.sha1(), "held": bytearray(),
        }

    def _payload(self, data: bytes, rows: list) -> None:
        r = self.record
        r["sha"].update(data)
        r["size"] += len(data)
        r["held"] += data
        while len(r["held"]) > self.chunk_bytes:
            rows.append(self._row(bytes(r["held"][: self.chunk_bytes]), False))
            del r["held"][: self.chunk_bytes]
            r["no"] += 1

    def _row(self, chunk: bytes, last: bool) -> tuple:
        r = self.record
        so_far = base64.b32encode(r["sha"].digest()).decode()
        start = r["size"] - len(r["held"])
        return r["id"], r["no"], r["type"], r["uri"], r["refers"], r["digest"], start, chunk if self.payloads else None, r["size"], so_far, last

    def _end(self, rows: list) -> None:
        self.state = "between"
        h = self.head
        if "warc-segment-number" not in h or "warc-segment-total-length" in h:
            self.finish(rows)

    def finish(self, rows: list) -> None:
        if self.record:
            rows.append(self._row(bytes(self.record["held"]), True))
            self.record = None


def _parsed(chunk_bytes: int, payloads: bool):
    names = re.findall(r"(\w+) \w+(?:,|$)", _CHUNKS)
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, rows = None, None, []
        for batch in batches:
            for value, path in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py()
                if name != file:
                    if parser:
                        parser.finish(rows)
                    parser, file = _Parser(chunk_bytes, payloads), name
                parser.line(value.as_py() + b"\n", rows)
                if len(rows) >= 256:
                    yield out(rows)
                    rows = []
        if parser:
            parser.finish(rows)
        if rows:
            yield out(rows)

    return run


def read_archive(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """One row per chunk of a record of the gzip WARC files under ``path``: identifiers and headers, ``chunk_no``, the
    chunk (null unless ``payloads``) and its offset, bytes and base32 SHA-1 up to its end (for chunks before the last: up to all that was
    read), and whether it is the last. A record without payload has one empty chunk."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path")).mapInArrow(_parsed(chunk_bytes, payloads), _CHUNKS)


def archived_pages(chunks: DataFrame) -> DataFrame:
    """One row per record of an archive from :func:`write_archive`: page_id, payload_bytes, payload_digest, record_type and
    refers_to. A response's are worked out from its payload; a revisit has those of the response it names."""

    def page(name: Column) -> Column:
        return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    ends = chunks.where("last").select(page(F.col("record_id")).alias("page_id"), "record_id", "record_type", F.col("refers_to").alias("target"), F.col("bytes_so_far").alias("size"), F.col("digest_so_far").alias("digest"), "payload_digest")
    ends = written(ends, "records")  # else each branch would read the archive again
    own = ends.where("record_type = 'response'")
    whole = own.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    named = own.select(F.col("record_id").alias("target"), F.col("digest").alias("payload_digest"), F.col("size").alias("payload_bytes")).distinct()
    revisits = ends.where("record_type = 'revisit'").select("page_id", "record_type", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("payload_digest", F.lit("")).alias("payload_digest"))
    asked = revisits.groupBy("target", "payload_digest").agg(F.count(F.lit(1)).alias("weight")).join(named, ["target", "payload_digest"], "left")
    asked = written(asked, "targets")
    revisits = join_unique(revisits, asked, ["target", "payload_digest"], "weight", ends.count())
    return whole.unionByName(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", page(F.col("target")).alias("refers_to")))
