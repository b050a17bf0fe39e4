"""WARC archives of pages: written with revisit records for repeated payloads, read back by boundary-chain verification.

An archive is one row (archive, bytes) of a written table, closed at about ``archive_bytes``. Reading takes every
place where a record could begin, the offset at which its successor would begin, and follows the offsets from the
start of the file by pointer jumping: log2(candidates) steps, each doubling the distance. A record inside a payload is
never reached from the start, so it is no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import written

# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, digest_ok boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(k + b": " + re.sub(rb"[\r\n]+", b" ", v) + b"\r\n" for k, v in [*fields, (b"Content-Length", b"%d" % len(block))])
    return MAGIC + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: bytes = b"2020-01-01T00:00:00Z") -> bytes:
    urn = lambda n: b"<urn:page:%s>" % (b"" if n is None else b"%d" % n)
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"), (b"WARC-Record-ID", urn(page_id)), (b"WARC-Date", date),
        (b"WARC-Target-URI", (url or "").encode()), (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode()),
        (b"WARC-Payload-Length", b"%d" % len(payload)), (b"Content-Type", b"application/http; msgtype=response"),
    ]
    if refers_to is None:
        return record(fields, HTTP_HEAD + payload)
    return record([*fields, (b"WARC-Refers-To", urn(refers_to)), (b"WARC-Profile", REVISIT_PROFILE)], HTTP_HEAD)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Offsets at which a record could begin, the offset after each, and where each block begins and ends.

    A candidate has the magic, a header that ends, a decimal Content-Length, and a block that the file holds whole with its closing lines.
    """
    at, after, blocks = [], [], []
    start = data.find(MAGIC)
    while start >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end >= 0:
            head = dict((k.lower(), v) for k, v in FIELD.findall(data, start + len(MAGIC), end + 2))
            size = head.get(b"content-length", b"").strip()
            if size.isdigit() and (close := end + 4 + int(size)) + 4 <= len(data) and data[close : close + 4] == b"\r\n\r\n":
                at.append(start)
                after.append(close + 4)
                blocks.append((end + 4, close))
        start = data.find(MAGIC, start + 1)
    return np.array(at, np.int64), np.array(after, np.int64), blocks


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 visits, by pointer jumping. ``at`` ascends."""
    n = len(at)
    found = np.zeros(n + 1, bool)
    if not n or at[0] != 0:
        return found[:n]
    jump = np.append(np.searchsorted(at, after), n)
    jump[:n][at[np.minimum(jump[:n], n - 1)] != after] = n
    found[0] = True
    for _ in range(max(1, n.bit_length())):
        found[jump[np.flatnonzero(found)]] = True
        jump = jump[jump]
    return found[:n]


def write_archives(pages: DataFrame, archive_bytes: int = 4 << 20, min_payload: int = 0) -> DataFrame:
    """Written table (archive, bytes) with a record for each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of ``min_payload`` bytes or more, that with the largest page_id is a response and the
    others revisit it; rows that repeat this page_id with this payload are responses too. Null html: empty payload;
    null url: empty; a null page_id stays null and never is the largest (if a payload has no other, its rows are
    responses). An empty table gives no archive. Rows of one payload are joined to one row of its group, so a
    payload that a third of all pages share is only a skewed probe side, which adaptive execution splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    tops = rows.filter(F.length("payload") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    dealt = rows.join(tops, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{number:06d}"]), pa.array([b"".join(held)], pa.binary())], ["archive", "bytes"])
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not held:
                    held, size = [record([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:archive:%d:%d>" % (task, number)), (b"WARC-Date", b"2020-01-01T00:00:00Z"), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n")], 0
                held.append(page_record(page_id, url, payload, refers_to))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield row()
                    number, held = number + 1, []
        if held:
            yield row()

    return written(dealt.mapInArrow(run, "archive string, bytes binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of pages in ``archives`` (archive, bytes), as RECORDS: those that the chain from each file's start reaches.

    A chain that breaks (a cut file) keeps what comes before the break. ``payload`` is null for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", v or b"")) else None
        for batch in batches:
            for data in batch.column("bytes").to_pylist():
                data, found = data or b"", []
                at, after, blocks = candidates(data)
                for k in np.flatnonzero(reachable(at, after)):
                    begin, end = blocks[k]
                    head = {a.lower(): b for a, b in FIELD.findall(data, int(at[k]) + len(MAGIC), begin - 2)}
                    kind = head.get(b"warc-type", b"").decode()
                    if kind not in ("response", "revisit"):
                        continue
                    digest = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
                    payload = None
                    if kind == "response":
                        payload = data[data.find(b"\r\n\r\n", begin) + 4 : end]
                    real = digest if payload is None else base32_sha1(payload)
                    size = int(head.get(b"warc-payload-length", b"0")) if payload is None else len(payload)
                    found.append((number(head.get(b"warc-record-id")), size, real, kind, number(head.get(b"warc-refers-to")), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), payload, real == digest))
                if found:
                    columns = list(zip(*found, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return archives.select("bytes").mapInArrow(run, RECORDS)
