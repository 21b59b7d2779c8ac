"""WARC archives: writing monolithic gzip streams, normalising them to a member a record, reading by index."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrank.llm.common import materialize, new_path, small
from webrank.llm.files import Output, where

CHUNK = 1 << 18
GZIP = 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, _payload (binary) and _refers_to: null for a response, else the page whose payload is the same.

    Of equal payloads of at least `least` bytes the one of largest page_id is the response.  Only
    digests are grouped, with map-side maxima, so thousands of copies cost one row; pages are joined
    with the groups of two and more alone.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_payload"))
    rows = rows.withColumns({"_size": F.octet_length("_payload"), "_sha": F.sha1("_payload")})
    groups = rows.filter(F.col("_size") >= least).groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    groups = materialize(groups.filter("_n > 1 and _first is not null").select("_sha", "_first"), "warc-groups")
    rows = rows.join(small(groups, 500_000), "_sha", "left")
    same = F.when((F.col("_size") >= least) & (F.col("page_id") != F.col("_first")), F.col("_first"))
    return rows.select("page_id", "url", "_payload", same.alias("_refers_to"))


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A WARC/1.1 record whose block is an HTTP response; a revisit's block holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%-._~''')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Reader:
    """Records of an inflated stream, one at a time; holds one record and one chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer, self.at = chunks, bytearray(), 0

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        del self.buffer[: self.at]
        self.at = 0
        self.buffer += chunk
        return True

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
                if not self.more():
                    if self.buffer[self.at :].strip():
                        raise ValueError("truncated WARC header")
                    return
            size = int(re.search(rb"(?im)^content-length:\s*(\d+)", bytes(self.buffer[self.at : end + 2]))[1])
            size += end + 8 - self.at
            while len(self.buffer) - self.at < size:
                if not self.more():
                    raise ValueError("truncated WARC record")
            yield bytes(self.buffer[self.at : self.at + size])
            self.at += size


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in fields.items()}, block[: int(fields["Content-Length"])]


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file, of however many members, each part of the file read and inflated once.

    A file that ends within a member is an error, even if it ends with a whole record.
    """
    inflater, open_ = zlib.decompressobj(GZIP), False
    while data := stream.read(CHUNK):
        while data:
            open_ = True
            if out := inflater.decompress(data, 4 * CHUNK):
                yield out
            data = inflater.unconsumed_tail
            if inflater.eof:
                data, open_ = inflater.unused_data, False
                inflater = zlib.decompressobj(GZIP)
    if open_:
        if out := inflater.flush():
            yield out
        if not inflater.eof:
            raise ValueError("truncated gzip member")


def deflate(data: bytes, level: int) -> bytes:
    gz = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return gz.compress(data) + gz.flush()


def none(x):
    return None if pd.isna(x) else x


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """archive, records: a row per archive written.  Each partition of plan()'s rows becomes one gzip stream."""

    def write(batches):
        out = gz = None
        n = 0
        for batch in batches:
            for page_id, url, payload, refers in zip(batch.page_id, batch.url, batch._payload, batch._refers_to):
                if out is None:
                    task = TaskContext.get()
                    name = f"{folder}/capture-{task.partitionId():06d}.warc.gz"
                    out, gz = Output(name, task.taskAttemptId()), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                out.write(gz.compress(record(none(page_id), none(url), bytes(payload), none(refers))))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [n]})

    ids = {name: F.col(name).cast("string") for name in ("page_id", "_refers_to")}  # as text: pandas has nullable longs as floats
    return materialize(pages.withColumns(ids).mapInPandas(write, "archive string, records long"), "warc-captures")


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """archive, offset, length, record_id: the index of the rewritten archives, a row per record.

    Each input file is inflated once, as a stream.  Every record becomes a gzip member of its own in
    a file of the same name in `folder`, and the file's index is written beside it (.idx, tab
    separated), so a record can be read alone.  Memory holds one record at a time.
    """

    def rewrite(batches):
        for batch in batches:
            for archive in batch.archive:
                name = f"{folder}/{archive.rpartition('/')[2]}"
                attempt = TaskContext.get().taskAttemptId()
                out, rows = Output(name, attempt), []
                index = Output(f"{name}.idx", attempt)
                files, path = where(archive)
                with files.open_input_stream(path, compression=None) as stream:
                    for data in Reader(inflate(stream)):
                        start = out.size
                        out.write(deflate(data, level))
                        rows.append((name, start, out.size - start, re.search(rb"(?i)\r\nwarc-record-id: <([^>]*)>", data)[1].decode()))
                        if len(rows) == 5000:
                            index.write("".join(f"{r[1]}\t{r[2]}\t{r[3]}\n" for r in rows).encode())
                            yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id"])
                            rows = []
                index.write("".join(f"{r[1]}\t{r[2]}\t{r[3]}\n" for r in rows).encode())
                out.close()
                index.close()
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "offset", "length", "record_id"])

    n = max(1, archives.count())
    schema = "archive string, offset long, length long, record_id string"
    return materialize(archives.select("archive").repartition(n, "archive").mapInPandas(rewrite, schema), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes, url, payload: a row per index row, read by offset.

    A revisit has no payload; its size and digest come from its own headers.
    """

    def load(batches):
        opened, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(batch.archive, batch.offset, batch.length):
                if archive != opened:
                    files, path = where(archive)
                    opened, stream = archive, files.open_input_file(path)
                stream.seek(int(offset))
                fields, block = parse(zlib.decompress(stream.read(int(length)), GZIP))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its headers")
                key = lambda name: int(x) if (x := re.search(r"urn:page:(-?\d*)", fields.get(name, "urn:page:"))[1]) else None
                rows.append((key("warc-record-id"), kind, key("warc-refers-to"), digest, size, fields.get("warc-target-uri"), payload if kind == "response" else None))
                held += size
                if held > 16 * CHUNK:
                    yield frame(rows)
                    rows, held = [], 0
            yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "url", "payload"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.mapInPandas(load, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, url string, payload binary")


def archive(pages: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """Write pages to monolithic archives, normalise those, and return the index of the result.

    Nulls: a null html is an empty payload, a null url has no WARC-Target-URI; a page with a null
    page_id is a response unless another page has its payload.  Repeated rows are written once each
    (all of the largest page_id are responses).  Empty tables give no archives and no rows.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = write_monolithic(plan(pages, least), f"{folder}/captured")
    return normalise(captures, f"{folder}/normalised")
