"""WARC archives of pages: a writer, and a reader that salvages damaged archives.

**Writing.** Pages of equal payload become one response record and revisit records that refer to it. Tasks frame
the records, compress each to a gzip member of its own if asked to, and collect them to archives of about
``archive_bytes``; every archive is one row of at most that size and a record, which Spark's text
writer puts into a file of its own, so any file system that Spark writes to will do.

**Reading.** An archive is read front to back, gzip members and plain records alike. A member must decompress
with its checksum and length; a record must have a version line, a header, a block of the declared length with
its end marks, and the declared digests. Where a check fails, the reader goes on at the declared end of
the record if another one begins there, else it searches for the next gzip magic or version line
at which a whole valid member or record can be read. The bytes skipped are reported as a
gap with the failed check; records and gaps together cover the archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, inputs, stage

by_value(__name__)

DATE = "2000-01-01T00:00:00Z"
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LONGEST_HEADER = 1 << 16
FOUND = (
    "archive string, offset long, length long, gap string, type string, record_id string, refers_to_id string, "
    "uri string, page_id long, payload_digest string, payload_bytes long, payload binary"
)


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    digest = hashlib.sha256(block).hexdigest()
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha256:{digest}"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


def page_record(page_id, url: str, payload: bytes, digest: str, record_id: str, refers_to_id: str | None) -> bytes:
    """A response with its HTTP message, or a revisit with the head of that message."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to_id is not None
    fields = [
        ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", f"<{refers_to_id}>" if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return record("revisit" if revisit else "response", fields, http if revisit else http + payload)


def info_record() -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, "warcinfo").urn
    fields = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
    return record("warcinfo", fields, b"format: WARC File Format 1.1\r\n")


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    """A failed check, and where the record would have ended if that is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


def fields_of(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("broken header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields


def checked(declared: str | None, data, reason: str, end: int) -> None:
    name, _, value = (declared or "").partition(":")
    if name.lower() == "sha256" and hashlib.sha256(data).hexdigest() != value.lower():
        raise Damaged(reason, end)


def read_record(data, at: int) -> tuple[int, dict, bytes | None]:
    """End, header fields and payload (None for a revisit) of the plain record at ``at``."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    stop = data.find(END, version.end(), version.end() + LONGEST_HEADER)
    if stop < 0:
        raise Damaged("no end of header")
    fields = fields_of(data[version.end() : stop])
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    start = stop + len(END)
    end = start + int(fields["content-length"])
    if end + len(END) > len(data):
        raise Damaged("truncated block")
    if data[end : end + len(END)] != END:
        raise Damaged("block of another length")
    block = data[start:end]
    end += len(END)
    checked(fields.get("warc-block-digest"), block, "block digest", end)
    if fields.get("warc-type") == "revisit":
        return end, fields, None
    if fields.get("content-type", "").startswith("application/http"):
        _, _, block = block.partition(END)
    checked(fields.get("warc-payload-digest"), block, "payload digest", end)
    return end, fields, block


def unpacked(data, at: int) -> tuple[int, bytes]:
    """End and content of the gzip member at ``at``; it must begin with a version line or be empty."""
    opener, parts, fed, first = zlib.decompressobj(31), [], at, True
    try:
        while not opener.eof:
            if fed >= len(data):
                raise Damaged("truncated member")
            piece = data[fed : fed + (512 if first else 1 << 20)]
            fed += len(piece)
            parts.append(opener.decompress(piece))
            if first and parts[0] and not b"WARC/1.".startswith(parts[0][:7]):
                raise Damaged("member without a record")
            first = first and not parts[-1]
    except zlib.error:
        raise Damaged("broken member") from None
    return fed - len(opener.unused_data), b"".join(parts)


def read_at(data, at: int) -> tuple[int, list[tuple[dict, bytes | None]]]:
    """End of the member or record at ``at`` and the records in it."""
    if data[at : at + 3] != b"\x1f\x8b\x08":
        end, fields, payload = read_record(data, at)
        return end, [(fields, payload)]
    end, content = unpacked(data, at)
    records, inside = [], 0
    while inside < len(content):
        try:
            inside, fields, payload = read_record(content, inside)
        except Damaged as damage:
            raise Damaged(damage.reason, end) from None
        records.append((fields, payload))
    return end, records


def read_archive(data: bytes):
    """(start, end, failed check or None, records) of consecutive spans that cover ``data``."""
    at, size = 0, len(data)

    def begins(place):
        return place is not None and (place == size or MARK.match(data, place) is not None)

    while at < size:
        try:
            end, records = read_at(data, at)
            yield at, end, None, records
            at = end
            continue
        except Damaged as damage:
            reason, resume = damage.reason, damage.end
        if not begins(resume):
            place = at + 1
            while True:
                mark = MARK.search(data, place)
                if mark is None:
                    resume = size
                    break
                try:
                    read_at(data, mark.start())
                    resume = mark.start()
                    break
                except Damaged as damage:
                    # A record of known extent is part of the gap; nothing inside it counts as a record.
                    place = damage.end if begins(damage.end) else mark.start() + 1
        yield at, resume, reason, []
        at = resume


def named(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def found_rows(archive: str, data: bytes, payloads: bool):
    """Rows of FOUND for one archive."""
    for start, end, reason, records in read_archive(data):
        if reason:
            yield (archive, start, end - start, reason, *[None] * 8)
        for fields, payload in records:
            key = fields.get("warc-page-id", "")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            if payload is not None and digest is None:
                digest = hashlib.sha256(payload).hexdigest()
            yield (
                archive, start, end - start, None, fields.get("warc-type"), named(fields.get("warc-record-id")),
                named(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
                int(key) if re.fullmatch("-?[0-9]{1,19}", key) else None, digest,
                None if payload is None else len(payload), payload if payloads else None,
            )


def urn(page_id, digest):
    """A record id that depends on the page and its payload only."""
    md5 = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(" "), digest))
    parts = [F.substring(md5, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *parts))


def plan_records(pages: DataFrame, least_bytes: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_id, refers_to_id): what is written for every row of ``pages``.

    The payload is the text in UTF-8 (null: empty). Among equal payloads of ``least_bytes`` or more the rows of
    the least id are responses and all others, also those without an id, revisit them. If no row has an id all are
    responses. White space, control characters and pointed brackets of the url are percent-encoded; a
    null or empty url is ``about:blank``.
    """
    pages = inputs(pages, "pages", page_id=page_id, url=url, html=html)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.cast("binary").alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"),
    )
    # Only digests that repeat under different ids; written, so the optimizer knows their size.
    shared = stage(
        rows.filter(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("shared"))
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("rows"), F.count("page_id").alias("ids"))
        .filter("first < last OR 0 < ids AND ids < rows").select("shared", "first")
    )
    met = rows.join(shared, rows.digest == shared.shared, "left")
    later = F.col("first").isNotNull() & F.coalesce(F.col("page_id") > F.col("first"), F.lit(True))
    odd = r"[\x00-\x20\x7F<>]"
    safe = F.when(
        F.col("url").rlike(odd),
        F.array_join(F.transform(F.split("url", ""), lambda c: F.when(c.rlike(odd), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), ""),
    ).otherwise(F.col("url"))
    return met.select(
        "page_id", F.coalesce(F.when(F.length(safe) > 0, safe), F.lit("about:blank")).alias("url"), "payload", "digest",
        urn(F.col("page_id"), F.col("digest")).alias("record_id"),
        F.when(later, urn(F.col("first"), F.col("digest"))).alias("refers_to_id"),
    )


def write_archives(records: DataFrame, path: str, archive_bytes: int = 1 << 25, compress: bool = True) -> None:
    """Write the rows of ``plan_records`` as archives under ``path``, each beginning with a warcinfo record.

    Every task fills archives of its own. No row, no archive.
    """

    def run(batches):
        pack = member if compress else bytes
        # The text writer ends each file with a separator, so the last byte of an archive is left to it:
        # of an empty member's length, or of a plain record's end marks.
        tail = member(b"")[:-1] if compress else b""
        held, size = [], 0

        def flush():
            content = b"".join([pack(info_record()), *held, tail])
            return pa.RecordBatch.from_arrays([pa.array([content if compress else content[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for at in range(batch.num_rows):
                held.append(pack(page_record(*[column[at].as_py() for column in batch.columns])))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    plain = records.select("page_id", "url", "payload", "digest", "record_id", "refers_to_id")
    contents = plain.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    separator = "\x00" if compress else "\n"
    contents.write.option("lineSep", separator).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps (FOUND) of all archives under ``path``.

    ``offset`` and ``length`` locate the record's member or the gap in its archive; ``gap`` is null for records
    and names the failed check for gaps. A revisit has no payload and no ``payload_bytes``. One
    archive at a time is held by a task.
    """

    def run(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        kinds = [types[c.split()[1]] for c in FOUND.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for row in found_rows(archive.as_py(), content.as_py(), payloads):
                    rows.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held > 1 << 24:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FOUND)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of response and revisit records.

    A revisit takes size and id from the response that it refers to; if that was not recovered, they are null.
    """
    records = found.filter("gap IS NULL AND type IN ('response', 'revisit')")
    targets = (
        records.filter("type = 'response'").groupBy(F.col("record_id").alias("target"))
        .agg(F.first("page_id").alias("target_page"), F.first("payload_bytes").alias("target_bytes"))
    )
    columns = ("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"))
    own = records.filter("type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    revisits = records.filter("type = 'revisit'").join(targets, F.col("refers_to_id") == F.col("target"), "left")
    return own.unionByName(
        revisits.select("page_id", F.col("target_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("target_page").alias("refers_to"))
    )


def archive_sql(least_bytes: int = 100) -> str:
    """The rows of ``op12_warc_salvage`` over a view ``pages``, as DuckDB SQL."""
    return f"""
WITH sized AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS least FROM sized),
marked AS (
  SELECT *, CAST(strlen(t) AS BIGINT) AS payload_bytes,
    strlen(t) >= {least_bytes} AND least IS NOT NULL AND coalesce(page_id > least, true) AS later FROM first)
SELECT page_id, payload_bytes, sha256(t) AS payload_digest, CASE WHEN later THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN later THEN least END AS refers_to
FROM marked"""
