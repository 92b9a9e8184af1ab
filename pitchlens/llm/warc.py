"""Web archives (WARC 1.1): written with an index, read back by coalesced byte ranges.

Every record is a gzip member of its own, so a byte range of the archive is enough to read it. The
index (archive, offset, length, URL, digest per record) is what the writing tasks return; it is
stored by Spark's own commit, so it names the archives of successful attempts only. Archives go
to the shared folder through pyarrow's file systems (local mounts, HDFS, S3 and others).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlens.llm.common import table
from pitchlens.staging import new_path, stage

#: An archive is closed once it is this long.
ARCHIVE_BYTES = 256 << 20
#: Neighbouring records are read at once if no more than GAP_BYTES lie between them, up to RUN_BYTES.
GAP_BYTES, RUN_BYTES = 64 << 10, 8 << 20
#: Records that one group of the reading shuffle covers.
SPAN_BYTES = 64 << 20
INDEX = (
    "page_id long, url string, payload_digest string, record_type string, refers_to long,"
    " archive string, offset long, length long"
)
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


def _record_id(page: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}:{digest}').urn}>"


def _header_value(text: str) -> str:
    """Control characters would end a header line: they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def encode_record(
    page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One record as a gzip member. A record that refers to another has no payload of its own."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _header_value(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to, digest),
        "X-Page-ID": None if page is None else str(page),
        "X-Refers-To-Page-ID": None if refers_to is None else str(refers_to),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"WARC/1.1\r\n" + lines.encode() + END + block + END + END
    return packer.compress(whole) + packer.flush()


def decode_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a gzip member."""

    def headers(part: bytes) -> dict[str, str]:
        lines = part.decode().split("\r\n")[1:]
        return dict(line.split(": ", 1) for line in lines if ": " in line)

    head, _, rest = zlib.decompress(member, 31).partition(END + END)
    warc = headers(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(END + END)
    return warc, headers(http), payload


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                places = []
                for row in batch.to_pylist():
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    member = encode_record(
                        row["page_id"], row["url"], row["payload"], row["payload_digest"],
                        row["refers_to"], date,
                    )
                    out.write(member)
                    places.append((name, offset, len(member)))
                    offset += len(member)
                kept = [batch.column(c) for c in ("page_id", "url", "payload_digest", "record_type", "refers_to")]
                archive, start, length = zip(*places) if places else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(archive, pa.string()), pa.array(start, pa.int64()), pa.array(length, pa.int64())],
                    ["page_id", "url", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = 1000,
    date: str = "2000-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder``; returns the stored index.

    Of records with equal payloads (by SHA-1) of at least ``least`` bytes, that with the largest
    page id is a response and the others are revisits that refer to it; smaller ones are all
    responses. A null text is an empty payload, a null URL leaves its header out, rows without an id
    are revisits if a copy has an id and responses otherwise, repeated rows with the largest id are
    all responses, an empty table gives an empty index. Only digests that occur more than once
    are joined; a payload that very many pages have is split by Spark's skew join.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"),
    )
    copies = keyed.filter(F.octet_length("payload") >= least).groupBy("payload_digest")
    copies = copies.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = copies.filter("n > 1 and first is not null").drop("n")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = keyed.join(copies, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(other, "revisit").otherwise("response").alias("record_type"),
        F.when(other, F.col("first")).alias("refers_to"),
    )
    return stage(typed.mapInArrow(_write(folder, date), INDEX), "warc-index")


def _read(folder: str):
    def parsed(system, path: str, rows: list[dict]) -> Iterator[dict]:
        start = rows[0]["offset"]
        with system.open_input_file(path) as file:
            data = file.read_at(rows[-1]["offset"] + rows[-1]["length"] - start, start)
        for row in rows:
            at = row["offset"] - start
            warc, http, payload = decode_record(data[at : at + row["length"]])
            whole = warc["WARC-Type"] == "response"
            told = base64.b32decode(warc["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            page, other = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
            yield {
                "page_id": None if page is None else int(page),
                "url": warc.get("WARC-Target-URI"),
                "payload_bytes": len(payload) if whole else int(http["Content-Length"]),
                "payload_digest": hashlib.sha1(payload).hexdigest() if whole else told,
                "record_type": warc["WARC-Type"],
                "refers_to": None if other is None else int(other),
                "payload": payload if whole else None,
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        kinds = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload", pa.binary())]
        )
        for batch in batches:
            rows = batch.to_pylist()
            i = 0
            while i < len(rows):
                j, end = i + 1, rows[i]["offset"] + rows[i]["length"]
                while (
                    j < len(rows)
                    and rows[j]["archive"] == rows[i]["archive"]
                    and 0 <= rows[j]["offset"] - end <= GAP_BYTES
                    and rows[j]["offset"] + rows[j]["length"] - rows[i]["offset"] <= RUN_BYTES
                ):
                    end, j = rows[j]["offset"] + rows[j]["length"], j + 1
                found = list(parsed(system, f"{base}/{rows[i]['archive']}", rows[i:j]))
                yield pa.RecordBatch.from_pylist(found, schema=kinds)
                i = j

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects, read by coalesced byte ranges in archive order.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null
    for a revisit, whose length and digest are those of the payload that it refers to).
    ``index`` may be filtered first by anything in it, such as URLs or digests.
    """
    span = F.floor(F.col("offset") / F.lit(SPAN_BYTES))
    placed = index.select("archive", "offset", "length").withColumn("span", span)
    placed = placed.repartition("archive", "span").sortWithinPartitions("archive", "offset")
    return placed.mapInArrow(_read(folder), RECORD)


def warc_query(spark, folder: str) -> DataFrame:
    """op1: all pages to archives and back."""
    archives = new_path(spark, "warc")
    index = write_archives(table(spark, folder, "pages"), archives)
    return read_records(index, archives).drop("payload")


ORACLE = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
