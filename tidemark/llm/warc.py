"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own, so an archive can be read from any
member on. Reading tasks get byte ranges; a task looks for gzip's magic number
in its range, takes a place for a record only if its first bytes inflate to a
WARC version line, and owns exactly the records that start in its range, which
it reads to their end beyond the range if need be.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, written

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
#: Payloads from so many bytes are written once and revisited.
LEAST = 1000
#: Bytes of a byte range; what a task holds beside the record it reads.
RANGE = 4 << 20
#: An archive is closed and the next begun after so many bytes.
ARCHIVE = 64 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(payload) + pack.compress(b"\r\n\r\n") + pack.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Payload-Length", str(len(payload)))]
        payload = b""
    return _member([*headers, ("Content-Type", "text/html;charset=utf-8"), ("Content-Length", str(len(payload)))], payload)


def _writer(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        for frame in frames:
            for page_id, url, page, digest, refers_to in zip(frame["page_id"].astype(object), frame["url"], frame["html"], frame["digest"], frame["refers_to"].astype(object), strict=True):
                if out is None:
                    # a name of its own for each attempt: what a lost task left is in no list
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                whole = lambda x: None if x is None or x != x else int(x)
                data = _record(whole(page_id), None if url is None or url != url else url, (page or "").encode("utf-8", "surrogatepass"), digest, whole(refers_to))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    done.append((name, size, records))
        if out is not None:
            out.close()
            done.append((name, size, records))
        yield pd.DataFrame(done, columns=["file", "bytes", "records"])

    return run


def write(pages: DataFrame, folder: str, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row into archives under ``folder``; returns (file, bytes, records).

    Of rows with equal payloads of at least ``least`` bytes, that with the
    largest id is a response and the others are revisits of it; rows that share
    this id are all responses, as are rows without an id and smaller payloads.
    A null page has an empty payload. The list of archives is written before it
    is returned, and only archives in the list are part of the result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    # one row for each payload that occurs under several ids
    large = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).where("first <> last").select("digest", "first")
    rows = rows.join(large, "digest", "left").withColumn("refers_to", F.when((F.col("size") >= least) & (F.col("page_id") < F.col("first")), F.col("first")))
    listed = rows.select("page_id", "url", "html", "digest", "refers_to").mapInPandas(_writer(folder), "file string, bytes long, records long")
    return written(listed, "archives")[0]


class _Source:
    """Bytes of an open file by offset, read in pieces that are kept while they are near."""

    def __init__(self, handle, size: int, piece: int = 1 << 20):
        self.handle, self.size, self.piece, self.start, self.data = handle, size, piece, 0, b""

    def upto(self, at: int, n: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.handle.seek(at)
            self.start, self.data = at, self.handle.read(max(n, self.piece))
        return self.data[at - self.start : at - self.start + n]


def _starts_record(source: _Source, at: int) -> bool:
    """Whether a gzip member at ``at`` inflates to a WARC version line."""
    head = source.upto(at, 1024)
    try:
        return zlib.decompressobj(31).decompress(head, len(VERSION)).startswith(VERSION[:5])
    except zlib.error:
        return False


def _read_record(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The inflated record at ``at`` and the place after it; None if the member is cut or broken."""
    unpack, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            data = source.upto(place, 64 << 10)
            if not data:
                return None
            parts.append(unpack.decompress(data))
            place += len(data)
    except zlib.error:
        return None
    return b"".join(parts), place - len(unpack.unused_data)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, body[: int(headers.get("content-length", len(body)))]


def _urn(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _reader(folder: str, keep_payload: bool):
    def records(store, path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
        with store.open_input_file(path) as handle:
            source = _Source(handle, handle.size())
            at = start
            while at < end:
                # magic numbers that begin in the range; the window reaches over its end by what a number needs
                window = source.upto(at, min(end - at + len(MAGIC) - 1, 256 << 10))
                found = window.find(MAGIC)
                if found < 0:
                    at += max(len(window) - len(MAGIC) + 1, 1)
                    continue
                at += found
                if at >= end:
                    return
                got = _read_record(source, at) if _starts_record(source, at) else None
                if got is None:
                    at += 1
                    continue
                record, at = got
                yield _parse(record)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for file, start, end in zip(frame["file"], frame["start"], frame["end"], strict=True):
                rows, held = [], 0
                for headers, body in records(store, f"{root}/{file}", start, end):
                    revisit = headers.get("warc-type") == "revisit"
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(body).hexdigest()
                    size = int(headers.get("warc-payload-length", 0)) if revisit else len(body)
                    rows.append((_urn(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, digest, headers.get("warc-type"), _urn(headers.get("warc-refers-to")), None if revisit or not keep_payload else body))
                    held += len(body)
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return run


_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark: SparkSession, folder: str, listed: DataFrame, id_col: str = "page_id", size: int = RANGE, keep_payload: bool = True) -> DataFrame:
    """Per record of the listed archives: id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Digests and sizes are those of the full payload; a revisit has them from its
    header and has a null payload. Ranges of ``size`` bytes are read apart.
    """
    ranges = listed.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"), "bytes")
    ranges = ranges.select("file", "start", F.least(F.col("start") + size, F.col("bytes")).alias("end"))
    count = listed.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 1
    # one range a task; a plain number is dealt round, so ranges don't meet
    dealt = ranges.repartition(min(int(count), 100_000))
    out = dealt.mapInPandas(_reader(folder, keep_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out.withColumnRenamed("page_id", id_col)


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    folder = as_uri(fresh_path(spark, "warc"))
    listed = write(pages, folder, id_col=id_col, **options)
    return read(spark, folder, listed, id_col=id_col, keep_payload=False).drop("url", "payload")
