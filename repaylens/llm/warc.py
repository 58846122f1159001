"""WARC archives: records written in segments and put together again.

Writing: each row becomes a response record, an HTTP message whose body is framed in
chunks. A block longer than ``segment_bytes`` is written as a first record and
continuation records that name it. A payload that an earlier record holds becomes a
revisit record without body. Records are lines of Spark's text writer whose separator is
the blank lines that end a record; the number of records a file holds is bounded, and so
is the size of a file.

Reading: every archive file is parsed in one task (its size is bounded by the writer).
Records in one piece are decoded where they are read. Segments are grouped by the origin
they name, ordered by number and joined; the total length, the chunk framing and the
payload digest are verified.

Defined results: null html is an empty payload; rows that repeat id and payload are
records of their own and alike; a null id is written as an empty name and read back as
null; a null url leaves its header out; line breaks in a url are percent-encoded; other
columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.llm.common import stored, table
from repaylens.session import shared_path

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: Bounds a file: at most this many records of SEGMENT_BYTES and their headers.
RECORDS_PER_FILE = 512
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def cuts(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that do not split a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in HTTP chunk framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in cuts(payload, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunk framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) < size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk framing")
        at += size + 2


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> str:
    """One record without the blank lines at its end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n{block.decode()}"


def write_rows(segment_bytes: int, chunk_bytes: int):
    """A function for ``mapInPandas``: pages with their roles to records."""

    def records(row) -> Iterator[str]:
        name = "" if row.page_id is None else str(row.page_id)
        own = f"<urn:page:{name}:{row.row}>"
        common = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z")]
        if row.url is not None:
            common.append(("WARC-Target-URI", row.url.replace("\r", "%0D").replace("\n", "%0A")))
        common.append(("WARC-Payload-Digest", f"sha256:{row.digest}"))
        if row.refers_to is not None:
            fields = [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
            fields.append(("WARC-Refers-To", f"<urn:page:{row.refers_to}>"))
            yield record("revisit", fields, HTTP)
            return
        block = HTTP + chunked(bytes(row.payload), chunk_bytes)
        pieces = cuts(block, segment_bytes)
        if len(pieces) == 1:
            yield record("response", common, block)
            return
        yield record("response", [*common, ("WARC-Segment-Number", "1")], pieces[0])
        for number, piece in enumerate(pieces[1:], 2):
            fields = [
                ("WARC-Record-ID", f"<urn:page:{name}:{row.row}:{number}>"),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Number", str(number)),
            ]
            if number == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
            yield record("continuation", fields, piece)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for column in ("page_id", "refers_to"):
                batch[column] = batch[column].astype(object).where(batch[column].notna(), None)
            yield pd.DataFrame({"value": [r for row in batch.itertuples(index=False) for r in records(row)]}, dtype=object)

    return run


def roles(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)``: the smallest id of an equal payload, for all ids but that."""
    named = stored(pages.select("page_id", "digest", F.octet_length("payload").alias("bytes")).distinct())
    first = stored(
        named.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return named.join(first, "digest").where("first <> page_id").select(
        "page_id", "digest", F.col("first").cast("string").alias("refers_to")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write ``pages(page_id, url, html)`` as compressed WARC files below ``path``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.col("page_id").alias("id"))
    role = roles(rows.select(F.col("id").alias("page_id"), "payload", "digest"))
    role = stored(role.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to"))
    placed = rows.join(role, (rows.id == role.r_id) & (rows.digest == role.r_digest), "left").select(
        "page_id", "url", "payload", "digest", "refers_to", F.monotonically_increasing_id().alias("row")
    )
    placed.mapInPandas(write_rows(segment_bytes, chunk_bytes), "value string").write.option(
        "lineSep", END.decode()
    ).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + len(END)
        stop = start + int(fields["content-length"])
        if data[stop : stop + len(END)] != END:
            raise ValueError(f"record at byte {at} has another length than it says")
        yield fields, data[start:stop]
        at = stop + len(END)


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, freed of chunk framing where its header says so."""
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def finished(block: bytes, digest: str) -> tuple[int, str, str | None]:
    """Length and digest of the payload, and what is wrong with it."""
    try:
        payload = payload_of(block)
    except ValueError as error:
        return 0, "", f"chunk framing: {error}"
    found = hashlib.sha256(payload).hexdigest()
    return len(payload), found, None if digest == f"sha256:{found}" else "payload digest differs"


PIECE = (
    "origin string, kind string, digest string, refers_to string, number int, total long, block binary,"
    " payload_bytes long, payload_digest string, problem string"
)


def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PIECE.split(",")]
    for batch in batches:
        for content in batch["content"]:
            content = bytes(content)
            data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
            out = []
            for f, block in parse(data):
                kind, number = f["warc-type"], f.get("warc-segment-number")
                total = f.get("warc-segment-total-length")
                row = [f.get("warc-segment-origin-id", f["warc-record-id"]), kind, f.get("warc-payload-digest"), f.get("warc-refers-to")]
                if number is not None:
                    row += [int(number), None if total is None else int(total), block, None, None, None]
                elif kind == "response":
                    row += [None, None, None, *finished(block, f["warc-payload-digest"])]
                else:
                    row += [None] * 6
                out.append(row)
            frame = pd.DataFrame(out, columns=names, dtype=object)
            yield frame


def join_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for origin, segments in zip(batch["origin"], batch["segments"]):
            parts = sorted(segments, key=lambda s: s["number"])
            block = b"".join(bytes(s["block"]) for s in parts)
            digest = next((s["digest"] for s in parts if s["digest"]), "")
            total = next((s["total"] for s in parts if s["total"] is not None and not pd.isna(s["total"])), None)
            if [s["number"] for s in parts] != list(range(1, len(parts) + 1)):
                got = (0, "", "a segment is missing or repeated")
            elif total is None or len(block) != int(total):
                got = (0, "", "total length differs")
            else:
                got = finished(block, digest)
            out.append((origin, *got))
        yield pd.DataFrame(out, columns=["origin", "payload_bytes", "payload_digest", "problem"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, problem)`` of every record.

    A revisit has length and digest of the payload it refers to. ``problem`` says what
    is wrong with a record, else it is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    pieces = stored(files.mapInPandas(read_files, PIECE))
    result = ["origin", "payload_bytes", "payload_digest", "problem"]
    whole = pieces.where("kind = 'response' AND number IS NULL").select(*result)
    joined = (
        pieces.where("number IS NOT NULL")
        .groupBy("origin")
        .agg(F.collect_list(F.struct("number", "total", "digest", "block")).alias("segments"))
        .mapInPandas(join_segments, "origin string, payload_bytes long, payload_digest string, problem string")
    )
    name = F.regexp_extract("origin", "^<urn:page:(-?[0-9]*)", 1)
    response = stored(whole.unionByName(joined).withColumn("page", name))
    held = stored(response.groupBy("page", "payload_digest").agg(F.max("payload_bytes").alias("bytes")))
    revisits = stored(
        pieces.where("kind = 'revisit'").select(
            name.alias("page_id"),
            F.regexp_extract("refers_to", "^<urn:page:(-?[0-9]*)", 1).alias("page"),
            F.regexp_replace("digest", "^sha256:", "").alias("payload_digest"),
        )
    )
    page = F.expr("try_cast(page_id AS bigint)").alias("page_id")
    resolved = revisits.join(held, ["page", "payload_digest"], "left").select(
        page,
        F.col("bytes").alias("payload_bytes"),
        "payload_digest",
        F.lit("revisit").alias("record_type"),
        F.expr("try_cast(page AS bigint)").alias("refers_to"),
        F.when(F.col("bytes").isNull(), "no such response").alias("problem"),
    )
    return response.withColumnRenamed("page", "page_id").select(
        page, "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), "problem",
    ).unionByName(resolved)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP5_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to,
  NULL::VARCHAR AS problem
FROM f
"""
