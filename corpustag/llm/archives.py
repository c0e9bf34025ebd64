"""WARC archives compressed with a dictionary of their own.

Each task writes archives: a skippable frame with a Zstandard dictionary built from the archive's first records, then
one frame per record. Files get new names at each attempt; only those that a finished task has listed count, so
a lost executor leaves at most files that nobody reads. Reading streams a file record by record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpustag.llm.storage import Scratch, partitions

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: Payload bytes from which equal payloads are stored once.
REVISIT_BYTES = 1000
#: Records of about so many bytes are the sample that a dictionary of at most so many bytes is built from.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 15
#: An archive is closed once it is so large.
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit of the page ``refers_to`` with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    target = "".join(c if " " < c else "%%%02X" % ord(c) for c in url or "about:blank")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    block = http if revisit else http + payload
    return _framed(fields, block)


def _framed(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary built from records; from too few or too small ones, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:DICTIONARY_BYTES * 4] for r in records], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES]


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def _opened(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _writer(folder: str):
    def archive(first: list[bytes], rest: Iterator[bytes]) -> tuple[str, int, int]:
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        words = dictionary(first)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(words))
        info = _framed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        records, size = 0, 0
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(words)) + words)
            out.write(compressor.compress(info))
            for source in (first, rest):
                for one in source:
                    records += 1
                    size += out.write(compressor.compress(one)) or 0
                    if source is rest and size > ARCHIVE_BYTES:
                        return name, records, size
        return name, records, size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield record(*(batch.column(k)[i].as_py() for k in range(5)))
        stream = records()
        while True:
            first: list[bytes] = []
            size = 0
            for one in stream:
                first.append(one)
                size += len(one)
                if size >= SAMPLE_BYTES:
                    break
            if not first:
                return
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "records", "bytes"), archive(first, stream)))])
    return work


def records_of(system, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive."""
    with system.open_input_stream(path) as raw:
        magic, size = struct.unpack("<II", raw.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{path}: no dictionary in front")
        reader = zstandard.ZstdDecompressor(dict_data=_as_dictionary(raw.read(size))).stream_reader(raw, read_across_frames=True)
        with io.BufferedReader(reader, 1 << 16) as text:
            while version := text.readline():
                if not version.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no record where one should begin")
                fields = {}
                while (line := text.readline().rstrip(b"\r\n")):
                    name, _, value = line.decode().partition(": ")
                    fields[name.lower()] = value
                block = text.read(int(fields["content-length"]))
                text.read(4)
                yield fields, block


def _reader(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        number = lambda v: None if v is None else int(v)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for fields, block in records_of(system, f"{path}/{name}"):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "revisit":
                        length = int(next(h for h in http.split(b"\r\n") if h.startswith(b"Content-Length: "))[16:])
                        digest, body = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), None
                    else:
                        length, digest, body = len(payload), hashlib.sha1(payload).hexdigest(), payload
                    rows.append((number(fields.get("page-id")), fields["warc-target-uri"], length, digest, fields["warc-type"],
                                 number(fields.get("refers-to-page-id")), body))
                    size += len(block)
                    if size > 8 * SAMPLE_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)
    return work


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write(pages: DataFrame, scratch: Scratch, folder: str, id_column: str = "page_id", url_column: str = "url",
          html_column: str = "html") -> DataFrame:
    """Archives of ``pages`` in ``folder``; the result lists them (``name``, ``records``, ``bytes``).

    Of rows with equal payloads of at least ``REVISIT_BYTES`` those with the largest id are responses, the others
    revisits of it. A null payload is empty, a null url ``about:blank``; a row with a null id refers to the largest
    id, or is a response where no row has one; an empty table gives no archives; other columns are ignored.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # combined before the shuffle; written, so that Spark knows its size when it chooses the join
    groups = scratch.keep(keyed.filter(large).groupBy(F.col("digest").alias("_digest")).agg(
        F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _first IS NOT NULL"), "groups")
    revisits = large & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    decided = keyed.join(groups, F.col("digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "digest", F.when(revisits, F.col("_first")).alias("refers_to"))
    return scratch.keep(decided.mapInArrow(_writer(folder), "name string, records bigint, bytes bigint"), "archives")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives, as columns; ``payload`` is null for revisits, digests of responses are computed anew."""
    return archives.select("name").repartition(partitions(archives.sparkSession)).mapInArrow(
        _reader(folder), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                         "refers_to bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) written as archives in the shared folder and read back."""
    scratch = Scratch(pages.sparkSession, "archives")
    folder = f"{scratch.folder}/files"
    return read(write(pages, scratch, folder), folder)
