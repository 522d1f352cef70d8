"""WARC archives: a writer with one gzip member per record, and a reader that salvages damaged archives.

Writing goes through Spark's text writer, so archives land on any store Spark can write to; reading takes them as
binary files. One archive is one file of `records_per_archive` records and `archive_bytes` bytes at most, and is read by
one task; a record that is larger by itself has an archive of its own, which may have 2 GB (Spark's limit of a file in a
row). So a record may have as many bytes as a task's memory holds a few times.

Defined cases: a null payload is empty; a null or repeated `page_id` is kept (equal smallest ids are each a response;
null ids count as the largest); payloads shorter than `revisit_from` bytes never make revisits; an empty table gives an
archive folder without records; a damaged region is skipped, logged with its byte range and reason, and the records
after it are recovered; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docket.llm.shared import small, written

#: Fixed values of the format: the first bytes of a gzip member and an empty member, which may stand between others.
GZIP_MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
RECORDS = "archive string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_reason string"


def with_revisits(pages: DataFrame, revisit_from: int = 100) -> DataFrame:
    """`pages` (page_id, url, html) as (page_id, url, payload, payload_digest, refers_to).

    Only digests of repeated payloads are looked up. Those are broadcast if they are few; otherwise payloads that are too
    short to be looked up stay out of the join, and the rows of frequent digests are split.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= revisit_from
    first = (
        digested.where(long_enough)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "first_id")
    )
    first = written(first, "repeated")
    joined = digested.where(long_enough).join(small(first), "digest", "left").unionByName(
        digested.where(~long_enough).withColumn("first_id", F.lit(None).cast(first.schema["first_id"].dataType))
    )
    return joined.select(
        "page_id",
        "url",
        "payload",
        F.col("digest").alias("payload_digest"),
        F.when(F.col("first_id") != F.coalesce("page_id", F.lit(2**63 - 1)), F.col("first_id")).alias("refers_to"),
    )


def make_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(records: DataFrame, path: str, records_per_archive: int = 1000, archive_bytes: int = 256_000_000) -> None:
    """Writes the rows of with_revisits() as archives of gzip members. An empty member ends each record's line.

    Each task numbers its volumes, a new one where the next record would exceed `archive_bytes`; a volume is a folder.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, size = 0, 0
        for b in batches:
            volumes, packed = [], []
            for row in b.to_pylist():
                member = gzip_member(make_record(*row.values()))
                length = len(member) + len(EMPTY_MEMBER)
                if size and size + length > archive_bytes:
                    volume, size = volume + 1, 0
                size += length
                volumes.append(volume)
                packed.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(volumes, pa.int64()), pa.array(packed, pa.binary())], ["volume", "value"])

    (
        records.select(F.col("page_id").cast("string"), "url", "payload", "payload_digest", F.col("refers_to").cast("string"))
        .mapInArrow(members, "volume long, value binary")
        .select("volume", F.col("value").cast("string"))
        .write.partitionBy("volume")
        .option("maxRecordsPerFile", records_per_archive)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .text(path)
    )


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at `at`: (fields, its end, ''), or (None, at, what is wrong)."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at, "headers without end"
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad header line"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        return None, at, "no content length"
    begin, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None, at, "content length is wrong"
    block = data[begin:stop]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha256:") and hashlib.sha256(block).hexdigest() != said[7:]:
        return None, at, "block digest differs"
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        length = int(n) if (n := head.get("x-payload-length", "")).isdigit() else None
    else:
        length, actual = len(payload), hashlib.sha256(payload).hexdigest()
        if re.fullmatch("[0-9a-f]{64}", digest) and actual != digest:
            return None, at, "payload digest differs"
        digest = actual
    page = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-record-id", ""))
    refers = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-refers-to", ""))
    return (
        {
            "page_id": int(page[1]) if page else None,
            "url": head.get("warc-target-uri"),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": int(refers[1]) if refers else None,
            "payload": payload if kind != "revisit" else None,
        },
        stop + 4,
        "",
    )


def inflate(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    """The gzip member at `at`: (content, its end, ''), or (None, at, what is wrong). zlib checks CRC and length."""
    unpacker, parts, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not unpacker.eof:
            parts.append(unpacker.decompress(data[end : end + 65536]))
            end += 65536
    except zlib.error as e:
        return None, at, f"gzip member: {str(e)[:60]}"
    if not unpacker.eof:
        return None, at, "gzip member is cut off"
    return b"".join(parts), min(end, len(data)) - len(unpacker.unused_data), ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, and gaps ({'gap_reason': ...}), each with start and end bytes in the archive.

    Where a check fails, the search goes on from the next byte for a gzip member or version line that passes all
    checks. A candidate that fails is part of the same gap. Bytes between `start` and `end` of a gap are skipped.
    """
    at, gap, reason = 0, None, ""
    candidate = re.compile(re.escape(GZIP_MAGIC) + rb"|WARC/1\.[01]\r\n")
    while at < len(data):
        found: list[dict] = []
        if data.startswith(GZIP_MAGIC, at):
            content, end, why = inflate(data, at)
            if content is not None:
                inner, ok = list(salvage_plain(content)), True
                ok = not content or any("gap_reason" not in x for x in inner)
                why = "" if ok else inner[0]["gap_reason"]
                found = [x | {"start": at, "end": end} for x in inner]
        else:
            fields, end, why = parse_record(data, at)
            found = [fields | {"start": at, "end": end}] if fields else []
        if why:
            if gap is None:
                gap, reason = at, why
            following = candidate.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "gap_reason": reason}
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield {"start": gap, "end": len(data), "gap_reason": reason}


def salvage_plain(data: bytes) -> Iterator[dict]:
    """As salvage(), for uncompressed bytes: only version lines are looked for."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        fields, end, why = parse_record(data, at)
        if fields is None:
            if gap is None:
                gap, reason = at, why
            following = VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield {"start": gap, "end": at, "gap_reason": reason}
            gap = None
        yield fields | {"start": at, "end": end}
        at = end
    if gap is not None:
        yield {"start": gap, "end": len(data), "gap_reason": reason}


def recover(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records without their payloads, log of quarantined gaps) of the archives in a folder, each archive read once.

    The log (archive, start, end, gap_reason) stays beside the archives, at `path`-quarantine.
    """
    found = written(read_archives(spark, path, payloads=False).drop("payload"), "records")
    log = found.where("gap_reason is not null").select("archive", "start", "end", "gap_reason")
    log.write.parquet(f"{path}-quarantine")
    return found.where("gap_reason is null").drop("gap_reason"), spark.read.parquet(f"{path}-quarantine")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and every gap (gap_reason not null) of the archives in a folder; columns as in RECORDS."""
    schema = to_arrow_schema(T.StructType.fromDDL(RECORDS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for x in salvage(content.as_py()):
                    rows.append(x | {"archive": archive} | ({} if payloads else {"payload": None}))
                    if len(rows) == 100:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORDS)
