"""WARC archives compressed by Zstandard: one frame per record, dictionary in front.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary its
records are compressed with; an archive of few or odd payloads has none. Dictionaries are
trained here from the first records of each archive (at most DICTIONARY_SAMPLE bytes).

The reader takes the dictionary from that frame, decodes one frame per record, and checks
version, header syntax, required headers, Content-Length against the block, the end of the
record, and the digest of payloads that are there.

Records of equal payloads of at least `least` bytes: that of the largest id is a response,
the others are revisits that refer to it. Rows that tie for the largest id are all responses.
A null payload is an empty one. Rows with a null id are written under the id "null"; among
equal payloads with no other id they are responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import shared

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_SIZE, DICTIONARY_SAMPLE, LEAST_RECORDS = 32 << 10, 2 << 20, 32
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = "null" if page is None else str(page)
    # anything that could break a header line is written in percent form
    target = quote(url, safe="!#$&'()*+,/:;=?@[]~%") if url else URN + name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or none where there are too few or too odd samples."""
    if len(samples) < LEAST_RECORDS:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_SIZE, max(1024, sum(map(len, samples)) // 16)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    """An archive's bytes: the dictionary's frame, then a frame per record."""
    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= DICTIONARY_SAMPLE:
            break
    trained = dictionary(first)
    if trained:
        yield struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True)
    for r in first:
        yield press.compress(r)
    for r in records:
        yield press.compress(r)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; raises WarcError."""
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not end or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC record")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip() or name != name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"no {need}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the block")
    return headers, rest[:-4]


def page_of(record_id: str) -> int | None:
    name = record_id.strip("<>").removeprefix(URN)
    return None if name == "null" else int(name)


def read_archive(stream) -> Iterator[dict]:
    """Checked records: page_id, url, payload (null in revisits), payload_bytes, payload_digest, record_type, refers_to."""
    chunk, data, start, open_dict = 4 << 20, b"", True, None
    over = False
    while True:
        if not over:
            more = bytes(stream.read(chunk))
            over = not more
            data += more
        if start and len(data) >= 8 or start and over:
            start = False
            if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
                size = struct.unpack("<I", data[4:8])[0]
                while len(data) < 8 + size and (more := bytes(stream.read(chunk))):
                    data += more
                if len(data) < 8 + size:
                    raise WarcError("dictionary ends early")
                raw = data[8 : 8 + size]
                if raw[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                open_dict, data = zstandard.ZstdCompressionDict(raw), data[8 + size :]
        while data and not start:
            frame = zstandard.ZstdDecompressor(dict_data=open_dict).decompressobj() if open_dict else zstandard.ZstdDecompressor().decompressobj()
            try:
                out = frame.decompress(data)
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            if not frame.eof:
                if over:
                    raise WarcError("frame ends early")
                chunk = min(chunk * 2, 1 << 28) if len(data) >= chunk else chunk
                break
            data = frame.unused_data
            yield checked(*parse(out))
        if over:
            if data:
                raise WarcError("archive ends early")
            return


def checked(headers: dict[str, str], block: bytes) -> dict:
    kind = headers["warc-type"]
    http, end, payload = block.partition(b"\r\n\r\n")
    if not end or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP head in the block")
    size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.lower() == b"content-length"), None)
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (size != len(payload) or digest(payload) != said):
        raise WarcError("payload differs from its length or digest")
    if kind == "revisit" and (payload or size is None or "warc-refers-to" not in headers):
        raise WarcError("bad revisit")
    return {
        "page_id": page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": size,
        "payload_digest": said, "record_type": kind, "refers_to": page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
    }


def write_archives(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row to archives in the folder; a settled table (name, n_records, n_bytes)."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("body"))).withColumn("size", F.octet_length("body"))
    # only payloads that come more than once go to the other side of the join
    again = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha").alias("s"), F.col("size").alias("z"), "response")
    rows = rows.join(again, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    rows = rows.select("id", "url", "body", F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        written, seen = 0, 0
        source = (record(*(c.as_py() for c in row)) for batch in batches for row in zip(*batch.columns, strict=True))

        def some() -> Iterator[bytes]:
            nonlocal written, seen
            for r in source:
                written += len(r)
                seen += 1
                yield r
                if written >= ARCHIVE_BYTES:
                    return

        while True:
            written = seen = 0
            first = next(source, None)
            if first is None:
                return
            name = f"part-{part:06d}-{number:04d}.warc.zst"

            def chain(head=first):
                nonlocal written, seen
                written, seen = len(head), 1
                yield head
                yield from some()

            size = shared.write_file(folder, name, archive(chain()))
            yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [seen], "n_bytes": [size]})
            number += 1

    dealt = rows.select("id", "url", "body", "refers")
    return shared.settle(dealt.mapInArrow(write, "name string, n_records long, n_bytes long"), "archives")


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Checked records of all archives; payload is left null where it isn't asked for. A task reads an archive at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, seen = [], 0, 0
                with shared.open_file(folder, name) as f:
                    for r in read_archive(f):
                        seen += 1
                        held += len(r["payload"] or b"")
                        rows.append(r if payloads else r | {"payload": None})
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                if seen != n:
                    raise WarcError(f"{name}: {seen} records, {n} were written")

    n = archives.count()
    return archives.select("name", "n_records").repartitionByRange(max(1, n), "name").mapInArrow(read, READ)
