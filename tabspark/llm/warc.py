"""WARC archives with a Zstandard dictionary (operator 3).

An archive is one file: a leading skippable frame (magic 0x184D2A5D) that holds a dictionary, then one
Zstandard frame for each record, compressed with it.  The dictionary is built from the archive's own first
records (``SAMPLE_BYTES`` of them, a bound of the training sample only); with too few of them for training it is their raw
content.  Every archive can so be read alone, record by record.

Of records with equal payloads the one with the largest id is a ``response``; the others are ``revisit``
records that name it and have no payload.  Which payloads repeat is found on a narrow table of digests;
a Bloom filter keeps the other pages from being shuffled.

Defined cases: NULL html is the empty payload, and empty payloads are equal payloads; rows repeated with the same id are each
a response; a NULL url is empty; a NULL id is written as ``null``, loses to every other id and is read back as NULL;
control characters in a url are percent-encoded; an empty table gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm import bloom
from tabspark.llm.files import filesystem, new_file, prepare, saved, shared_folder

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES = 2 << 20
DICT_BYTES = 112 << 10
LEVEL = 3
READ_ROWS = 256


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC 1.1 record; a revisit has the payload's digest and length but not its bytes."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page is None else page
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples' raw content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Writer:
    """An archive being written: holds back records until there are enough for the dictionary."""

    def __init__(self, out):
        self.out, self.held, self.size, self.compressor, self.written = out, [], 0, None, 0

    def add(self, raw: bytes) -> None:
        if self.compressor is None:
            self.held.append(raw)
            self.size += len(raw)
            if self.size >= SAMPLE_BYTES:
                self.begin()
        else:
            self.put(self.compressor.compress(raw))

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.written += len(raw)

    def begin(self) -> None:
        import zstandard

        raw = make_dictionary(self.held)
        own = zstandard.ZstdCompressionDict(raw)
        own.precompute_compress(level=LEVEL)
        self.put(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        for x in self.held:
            self.put(self.compressor.compress(x))
        self.held = []

    def close(self) -> None:
        if self.compressor is None:
            self.begin()
        self.out.close()


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    own = zstandard.ZstdCompressionDict(source.read(size))
    stream = zstandard.ZstdDecompressor(dict_data=own).stream_reader(source, read_across_frames=True)
    held = b""

    def upto(mark: bytes) -> bytes:
        nonlocal held
        while (at := held.find(mark)) < 0:
            if not (more := stream.read(1 << 16)):
                return b""
            held += more
        found, held = held[:at], held[at + len(mark) :]
        return found

    def take(n: int) -> bytes:
        nonlocal held
        parts = [held]
        have = len(held)
        while have < n:
            if not (more := stream.read(max(1 << 16, n - have))):
                raise ValueError("the archive ends within a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        found, held = held[:n], held[n:]
        return found

    while head := upto(b"\r\n\r\n"):
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = take(int(headers["Content-Length"]))
        take(4)
        yield headers, block


def write(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of all rows; returns the written list of them: file, n_records, bytes."""
    spark = pages.sparkSession
    prepare(spark)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    h = F.xxhash64("sha")
    digests = saved(rows.select("id", "sha"), "page-digests")
    marked = bloom.tested(rows, bloom.repeated(digests, h, digests.count()), h, "maybe")
    last = digests.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    last = saved(last, "repeated-payloads")  # written, so that the join can split a payload that fills many pages
    maybe = marked.where("maybe").join(last, "sha", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    linked = maybe.select("id", "url", "html", refers.alias("refers_to"))
    rest = marked.where("NOT maybe").select("id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    folder = shared_folder(spark, "archives")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, n = None, 0
        for batch in batches:
            for page, address, text, refers_to in zip(*(batch[c] for c in ("id", "url", "html", "refers_to"))):
                if writer is None:
                    uri, out = new_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    writer = Writer(out)
                writer.add(record(page.as_py(), address.as_py(), text.as_py().encode(), refers_to.as_py(), date))
                n += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([writer.written], pa.int64())], ["file", "n_records", "bytes"])

    return saved(rest.unionByName(linked).mapInArrow(archive, "file string, n_records long, bytes long"), "archive-list")


def read(archives: DataFrame) -> DataFrame:
    """One row a record: page_id, record_type, payload_digest, payload_bytes, refers_to, url and, for responses, payload."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        number = lambda s: None if s == "<urn:page:null>" else int(s[len("<urn:page:") : -1])
        for batch in batches:
            for uri in batch["file"].to_pylist():
                system, path = filesystem(uri)
                with system.open_input_stream(path) as source:
                    rows = []
                    for headers, block in records(source):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        response = headers["WARC-Type"] == "response"
                        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{uri}: {headers['WARC-Record-ID']} is damaged")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Type"], digest, size, refers and number(refers), headers["WARC-Target-URI"], payload if response else None))
                        if len(rows) == READ_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = archives.select("file").repartition(max(1, archives.count()))
    return files.mapInArrow(parsed, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, url string, payload binary")
