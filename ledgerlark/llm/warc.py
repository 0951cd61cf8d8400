"""WARC archives: pages written as gzip members, repeated payloads as revisits; a splittable reader that scans byte ranges for members."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import cut, fresh_path

#: Bytes of a range that one task scans, of an archive before the next begins, of a payload that others may refer to.
RANGE, ARCHIVE, LEAST_PAYLOAD = 16 << 20, 1 << 30, 100
DATE = "1970-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
_CHUNK, _FED = 1 << 20, 1 << 14
_BREAK, _END = b"\r\n", b"\r\n\r\n"
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", uri))
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri)) if "://" in uri else (fs.LocalFileSystem(), uri)


def member(block: bytes, level: int = 6) -> bytes:
    """A gzip member. A member's magic bytes inside the block are parted by a flush, so that none stands in what is stored uncompressed."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    parts = block.split(MAGIC)
    out = [packer.compress(parts[0])]
    for part in parts[1:]:
        out += [packer.compress(MAGIC[:2]), packer.flush(zlib.Z_FULL_FLUSH), packer.compress(MAGIC[2:] + part)]
    return b"".join([*out, packer.flush()])


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's text, before it is compressed."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return _BREAK.join(line.encode() for line in lines) + _END + block + _END


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone; what a header can't hold of a url is percent-encoded."""
    kind = "response" if refers_to is None else "revisit"
    name = f"{_ID}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F)))))] if url is not None else []
    headers += [("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", _PROFILE)] if refers_to is not None else []
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record([*headers, ("Content-Type", "application/http;msgtype=response")], head + (payload if refers_to is None else b""))


FILES = "path string, size long, records long"


def _write(folder: str, most: int, date: str):
    """Arrow function: (page_id, url, payload, digest, refers_to) to the archives written, each under a name of its own."""

    def run(batches):
        system, root = _file_system(folder)
        out, name, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], ["path", "size", "records"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    name, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    size = out.write(member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                size += out.write(member(page_record(*(x.as_py() for x in row), date)))
                n += 1
                if size >= most:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST_PAYLOAD, most: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Write a record for each row below ``folder``; the archives: path, size, records.

    A text's UTF-8 bytes are its payload; a null one is empty. Of rows with equal payloads (by SHA-256) of ``least`` bytes or more those
    of the least id are responses, the others revisits that refer to it; shorter ones are responses all. A row without an id is
    a response that nothing refers to; repeated rows are records of their own; an empty table gives no archive; other
    columns are ignored.

    Each task writes its own archives, of about ``most`` bytes, to any store that pyarrow opens. The list is checkpointed: a task that
    is run again after a loss leaves a file that the list doesn't name.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    repeated = given.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = given.join(repeated.select("digest", "first"), "digest", "left")
    refers_to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return cut(marked.select("page_id", "url", "payload", "digest", refers_to.alias("refers_to")).mapInArrow(_write(folder, most, date), FILES))


class Source:
    """An archive, read from any place on in chunks; one chunk is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def chunk(self, at: int) -> memoryview:
        """The bytes from ``at`` on that are held; none at the end."""
        if not self.base <= at < self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(min(_CHUNK, self.size - at))
        return memoryview(self.data)[at - self.base :]

    def magic(self, at: int, end: int) -> int:
        """The first place of the magic bytes that is not before ``at`` but before ``end``, or -1."""
        while at < end and at + len(MAGIC) <= self.size:
            if at + len(MAGIC) > self.base + len(self.data):
                self.data = b""  # the next chunk begins here
            self.chunk(at)
            found = self.data.find(MAGIC, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < end else -1
            at = self.base + len(self.data) - len(MAGIC) + 1
        return -1


def decoded(source: Source, at: int) -> tuple[int, dict[str, str], bytes] | None:
    """(bytes of the member, headers, block) of the record whose member begins at ``at``; None if none does.

    The header is looked at as soon as it is there, so that false magic bytes end after a few bytes. The member has to be whole,
    its checksum and its record's length right.
    """
    packed, out, place, known = zlib.decompressobj(31), [], at, False
    try:
        while not packed.eof and len(some := source.chunk(place)[:_FED]):
            out.append(packed.decompress(some))
            place += len(some) - len(packed.unused_data)
            if not known and sum(map(len, out)) >= 5:
                out, known = [b"".join(out)], True
                if not out[0].startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    head, _, rest = b"".join(out).partition(_END)
    first, *lines = head.split(_BREAK)
    headers = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    length = headers.get("content-length", "")
    if not packed.eof or not first.startswith(b"WARC/") or not length.isdecimal() or rest[int(length) :] != _END:
        return None
    return place - at, headers, rest[: int(length)]


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records whose members begin from ``start`` to before ``end``."""
    at = start
    while (at := source.magic(at, end)) >= 0:
        if (found := decoded(source, at)) is None:
            at += 1
        else:
            yield at, *found
            at += found[0]


RECORDS = "path string, offset long, length long, record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, http_length long, payload binary"
_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RECORDS.split(", ")])
_HTTP_LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)\s*\r\n", re.I)


def _row(path: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> tuple:
    named = lambda key: headers[key].strip("<>") if key in headers else None
    kind, payload, http_length = headers.get("warc-type"), block, None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(_END)
        http_length = int(m[1]) if (m := _HTTP_LENGTH.search(head + _BREAK)) else None
    payload = None if kind == "revisit" else payload
    return path, offset, length, kind, named("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), headers.get("warc-payload-digest"), named("warc-refers-to"), http_length, payload


def _read(batches):
    """Arrow function: ranges (path, size, start, end) to their records."""
    for batch in batches:
        for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, name = _file_system(path)
            rows, held = [], 0
            with system.open_input_file(name) as file:
                for found in records(Source(file, size), start, end):
                    rows.append(_row(path, *found))
                    held += len(found[3])
                    if held >= 4 * _CHUNK or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)


def read_warc(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """The records of the archives (path, size) of gzip members: path, offset, length, record_type, record_id, target_uri, date,
    payload_digest, refers_to, http_length, payload.

    Archives are cut into ranges of ``range_bytes``, a task's each. A task looks for gzip's magic bytes, decodes what may be a member as far as
    it takes to tell, and owns the records that begin inside its range, the last of which it reads on beyond it. A payload is what
    follows a block's HTTP head, or the whole block without one; a revisit has none, and http_length is what its
    head names. Bytes that belong to no record (damage, a member cut off at the end) are passed over.

    Rows with a null path or size, and files without bytes, have no records. A member that is stored inside
    another, uncompressed and with its magic bytes whole, would be found by a range that begins before it and inside the other;
    ``write_warc`` leaves none.
    """
    known = files.where("path is not null and size > 0").select("path", F.col("size").cast("long").alias("size"))
    step = F.lit(range_bytes).cast("long")
    ranges = cut(known.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("start")))
    n = max(1, ranges.count())
    dealt = ranges.select("path", "size", "start", F.least(F.col("start") + step, "size").alias("end")).repartition(n, "path", "start")
    return dealt.mapInArrow(_read, RECORDS)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark))
    number = lambda c: F.regexp_extract(c, f"^{_ID}(-?[0-9]+)$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    whole = F.col("payload").isNotNull()
    return read_warc(files).where("record_type in ('response', 'revisit')").select(
        page("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
