"""Operator 11: web archives written, read back and assembled into transactions.

Writing: each page becomes three WARC 1.1 records - a response (or a revisit of
an earlier equal payload), the request and a metadata record - the last two
naming the first by WARC-Concurrent-To.  Spark's text writer writes them: the
separator after a row is the CRLF CRLF that ends a record, so a file is a plain
concatenation of records, compressed as a whole (.gz), and its commit protocol
leaves no half-written or doubled file when executors are lost.

Reading: gzip files are not split, so the text reader gives one task the lines
of a file in order; ``frames`` joins them again and cuts records by their
Content-Length.  A task holds one record and one Arrow batch, however large the
archive.  Archives of other writers (one gzip member a record) read the same way.

Assembly: requests and metadata are joined to their response by concurrent-to
(metadata that names a request goes on to that request's response), giving one
nested row per capture.

Of equal payloads of MIN_REVISIT bytes or more the row with the smallest page_id
is the response.  The first of each payload is an aggregate over digests; rows
meet it by (digest, salt), so one payload in a third of all rows is spread.

Defined cases: a null html is an empty payload; a null url has no target URI;
line breaks in a url are percent-encoded; null page_ids come after all others;
of rows with equal page_id and payload one is the response; repeated rows are
captures of their own; empty tables give an empty archive and result; other
columns are ignored.  Reading: records without an id are captures of their own
(responses) or belong to none; requests and metadata without a response make a
capture with a null response; of a cut-off last record what is there is kept and
``complete`` is false; bytes between records are skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe.llm.common import frugal, written
from recframe.session import checkpoint_dir

MIN_REVISIT = 100
SALTS = 16
#: Records in one file: bounds the work of the task that reads it.
RECORDS_PER_FILE = 30_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records handed on at once by the reader.
OUT_BYTES = 2 << 20
_END = "\r\n\r\n"


def _record(fields: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A record without its closing CRLF CRLF; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v) for k, v in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines, length), F.lit(_END), block)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write page_id, url and html of ``pages`` as WARC files under ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # written once, so that a row keeps its number through retries
    rows = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
                                html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"),
                                F.monotonically_increasing_id().alias("uid")))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")
    # written, so that the planner knows its size: where few payloads repeat the pages need no exchange
    first = written(rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
                    .where("copies > 1").select(F.col("digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    met = rows.join(first, (F.col("digest") == F.col("d")) & (F.pmod("uid", F.lit(SALTS)) == F.col("salt")), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.uid") != F.col("uid"))

    def name(page_id: Column, uid: Column, kind: str) -> Column:
        return F.concat(F.lit("<urn:x-capture:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), uid.cast("string"), F.lit(f":{kind}>"))

    own = lambda kind: name(F.col("page_id"), F.col("uid"), kind)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        [("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", own("response")), *common,
         ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, name(F.col("first.page_id"), F.col("first.uid"), "response")))],
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))))
    target = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", own("request")), *common, ("Content-Type", "application/http; msgtype=request"),
         ("WARC-Concurrent-To", own("response"))],
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END)))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", own("metadata")), *common, ("Content-Type", "application/warc-fields"),
         ("WARC-Concurrent-To", own("request"))],
        F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    (met.select(F.explode(F.array(response, request, metadata)).alias("value"))
     .write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


# ----------------------------------------------------------------------- reading
class Framer:
    """Cuts a stream of bytes into records by their Content-Length."""

    def __init__(self) -> None:
        self.data, self.need, self.fields = bytearray(), 0, None

    def feed(self, more: bytes, last: bool = False) -> Iterator[tuple[dict[str, list[str]], bytes, bool]]:
        """(header fields, block, whole) of every record that ends in the data so far."""
        self.data += more
        at = 0
        while True:
            if self.fields is None:
                at = self._start(at, last)
                stop = self.data.find(b"\r\n\r\n", at)
                if stop < 0:
                    break
                self.fields, at = self._header(bytes(self.data[at:stop])), stop + 4
                length = self.fields.get("content-length", ["0"])[0]
                self.need = int(length) if length.isdigit() else 0
            if len(self.data) - at < self.need:
                break
            yield self.fields, bytes(self.data[at:at + self.need]), True
            at, self.fields = at + self.need, None
        del self.data[:at]
        if last:
            if self.fields is not None:
                yield self.fields, bytes(self.data), False
            self.__init__()

    def _start(self, at: int, last: bool) -> int:
        """Next place where a record can start."""
        while at < len(self.data) and not self.data.startswith(b"WARC/", at):
            if self.data[at] in b"\r\n":
                at += 1
            elif not last and len(self.data) - at < 5 and b"WARC/".startswith(bytes(self.data[at:])):
                break
            else:
                stop = self.data.find(b"\n", at)
                at = len(self.data) if stop < 0 else stop + 1
        return at

    @staticmethod
    def _header(head: bytes) -> dict[str, list[str]]:
        fields: dict[str, list[str]] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            key, colon, value = line.partition(":")
            if colon:
                fields.setdefault(key.strip().lower(), []).append(value.strip())
        return fields


RECORD = ("record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, content_type string,"
          " payload_digest string, http_head string, payload binary, complete boolean")


def _row(fields: dict[str, list[str]], block: bytes, whole: bool) -> tuple:
    one = lambda key: fields.get(key, [None])[0]
    http_head, payload = None, block
    if (one("content-type") or "").startswith("application/http"):
        head, end, rest = block.partition(b"\r\n\r\n")
        if end:
            http_head, payload = head.decode("latin-1"), rest
    return (one("warc-record-id"), one("warc-type"), fields.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"),
            one("content-type"), one("warc-payload-digest"), http_head, payload, whole)


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, line) of whole files, in order, to records."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
                        ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("payload_digest", pa.string()),
                        ("http_head", pa.string()), ("payload", pa.binary()), ("complete", pa.bool_())])
    framer, file, out, size = Framer(), None, [], 0

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def read(data: bytes, last: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal out, size
        for found in framer.feed(data, last):
            out.append(_row(*found))
            size += 500 + len(found[1])
            if size > OUT_BYTES:
                yield packed(out)
                out, size = [], 0

    for batch in batches:
        names, lines = batch.column("file").to_pylist(), batch.column("line").to_pylist()
        start = 0
        while start < len(names):
            stop = start
            while stop < len(names) and names[stop] == names[start]:
                stop += 1
            if names[start] != file:
                yield from read(b"", True)
                file = names[start]
            yield from read(b"\n".join(lines[start:stop]) + b"\n")
            start = stop
    yield from read(b"", True)
    if out:
        yield packed(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzip WARC files under ``path``."""
    lines = (spark.read.option("lineSep", "\n").text(path)
             .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")))
    return lines.mapInArrow(frugal(frames), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (struct, null if there is none),
    requests and metadata (arrays of structs, by record_id).

    ``records`` has record_id, type, concurrent_to and any columns more, which the
    structs carry."""
    whole = F.struct(*records.columns)
    anchors = records.where(F.col("type").isin("response", "revisit", "resource")).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    joined = (records.where(F.col("type").isin("request", "metadata"))
              .select("type", whole.alias("record"), F.explode_outer("concurrent_to").alias("to")))
    via = (records.where("type = 'request'").select(F.col("record_id").alias("via"), F.explode("concurrent_to").alias("on")).distinct())
    members = (joined.join(via, F.col("to") == F.col("via"), "left").select("type", "record", F.coalesce("on", "to").alias("anchor")))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(F.col("record.record_id").alias("k"), "record"))),
                                   lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))["record"]
    grouped = members.groupBy("anchor").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = F.array().cast(grouped.schema["requests"].dataType)
    return (anchors.join(grouped, F.col("capture_id") == F.col("anchor"), "full")
            .select(F.coalesce("capture_id", "anchor").alias("capture_id"), "response", F.coalesce("requests", none).alias("requests"),
                    F.coalesce("metadata", none).alias("metadata")))


def archive_digest(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of the registered query, from the archives as read back."""
    spark = pages.sparkSession
    path = path or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = read_archives(spark, path)
    revisit = F.col("type") == "revisit"
    stated = F.regexp_extract("http_head", r"(?i)\ncontent-length: *([0-9]+)", 1)
    # fingerprints are taken before the join: archives are read once and payloads do not enter an exchange
    light = written(records.select(
        "record_id", "type", "concurrent_to", "refers_to",
        F.when(revisit, stated.try_cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract("payload_digest", "^sha256:(.*)$", 1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.when(F.col("type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"page_id: (-?[0-9]+)", 1).try_cast("long")).alias("page_id")))
    return assemble(light).where("response is not null").select(
        F.col("metadata")[0]["page_id"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"urn:x-capture:(-?[0-9]+):", 1).try_cast("long").alias("refers_to"))


SQL = f"""
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages),
r as (select *, row_number() over (partition by h order by page_id nulls last) as k, first_value(page_id) over (partition by h order by page_id nulls last) as f from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(h) as payload_digest,
       case when n >= {MIN_REVISIT} and k > 1 then 'revisit' else 'response' end as record_type,
       case when n >= {MIN_REVISIT} and k > 1 then f end as refers_to
from r
"""
