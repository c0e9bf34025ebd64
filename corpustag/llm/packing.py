"""Packing along a space-filling curve.

Documents are tokenized, their hashed token vectors projected to four dimensions, and sorted by Hilbert key, so
that neighbours on the curve are alike. They are then laid end to end along the curve and cut every
``length`` tokens: only the last sequence of all has padding.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpustag.llm import words
from corpustag.llm.ordering import running_sums
from corpustag.llm.storage import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 2048
END_ID = 1
DIMENSIONS, DEPTH = 4, 10
BUCKETS = 1024
#: Bytes (keys, values and what a dictionary adds) that a worker remembers of encoded pieces before it starts afresh.
REMEMBERED, ENTRY = 48 << 20, 160
#: Pieces up to this length are told apart by a 64-bit hash within a slice of text; longer ones are each looked up.
HASHED = 64
#: Documents of one Arrow batch that are tokenized at once.
ROWS = 256
#: The rules of a vocabulary that ``Encoder`` knows how to apply chunk by chunk.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Memo(dict):
    """A dictionary that is emptied when its entries come to ``REMEMBERED`` bytes."""

    held = 0

    def put(self, key, value, size: int):
        self.held += size + ENTRY
        if self.held > REMEMBERED:
            self.clear()
            self.held = size + ENTRY
        self[key] = value
        return value


class Encoder:
    """Token ids of texts, a slice of documents at a time.

    The rules of ``RULES`` cut at white space and into runs of letters, single digits and runs of all else, and encode each piece alone. So
    a text's ids are those of its pieces, and a piece is encoded once a slice, and remembered. Chunks between spaces and line feeds that
    are printable ASCII and Latin letters are cut into pieces here, in lower case, and merged by the tokenizer's model; all other chunks are
    one piece and go through the whole tokenizer. Texts go there whole if a vocabulary has other rules.
    """

    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
    PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(self.tokenizer.to_str())
        self.by_piece = all(rules[part] == known for part, known in RULES.items()) and rules["model"]["type"] == "BPE"
        self.known, self.powers = Memo(), words.Powers()
        # how byte-level vocabularies spell bytes: printable ones as themselves, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.spelling = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _merged(self, piece: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.spelling))]

    def piece(self, piece: bytes, simple: bool) -> bytes:
        """The ids of a simple piece, or of a chunk that is none, as bytes."""
        value = self.known.get(piece)
        if value is not None:
            return value
        if simple:
            ids = self._merged(piece)
        else:
            text = piece.decode()
            if self.PLAIN.fullmatch(text) and "<|" not in text:
                ids = [i for p in self.PIECE.findall(text.lower()) for i in self._merged(p.encode())]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        value = np.array(ids, self.dtype).tobytes()
        return self.known.put(piece, value, len(piece) + len(value))

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype)

    def encode(self, text: str) -> bytes:
        """The ids of one text, as bytes."""
        return next(self.encoded(pa.array([text.encode()]))).tobytes()

    def encoded(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if not self.by_piece:
            yield from (self.whole(t.as_py()) for t in texts)
            return
        for _, data, bounds in words.slices(texts, lower=False):
            data, starts, ends, simple = _pieces(data, bounds)
            keys = words.hashed(data, starts, ends, self.powers)
            long = np.flatnonzero(ends - starts > HASHED)
            if len(long):  # a key of its own each: the place, above all hashes of short pieces
                keys = keys >> np.uint64(1)
                keys[long] = np.uint64(1 << 63) + long.astype(np.uint64)
            _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
            raw = data.tobytes()
            encoded = [self.piece(raw[s:e], one) for s, e, one in zip(starts[first].tolist(), ends[first].tolist(), simple[first].tolist())]
            size = np.array([len(e) for e in encoded], np.int64) // self.dtype.itemsize
            flat = np.frombuffer(b"".join(encoded), self.dtype)
            at = np.cumsum(size) - size
            length = size[kind]
            out = np.cumsum(length) - length
            ids = flat[np.repeat(at[kind] - out, length) + np.arange(length.sum())]
            cuts = np.r_[out, length.sum()][np.searchsorted(starts, bounds, "left")]
            yield from (ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Bytes as small letters; and their kind: 0 between chunks, 1 letter, 2 digit, 3 other, 4 in no simple chunk."""
    small, kind = np.arange(256, dtype=np.uint8), np.full(256, 4, np.uint8)
    small[65:91] += 32
    kind[33:127] = 3
    kind[48:58], kind[97:123], kind[65:91] = 2, 1, 1
    kind[[32, 10]], kind[39] = 0, 4
    return small, kind


SMALL, KIND = _kinds()
#: First byte of a Latin letter in UTF-8, and which second bytes make letters of it.
LATIN = 0xC3


def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with simple chunks in lower case, starts and ends of pieces in order, and whether each is simple."""
    n = len(data)
    kind, small = KIND[data], SMALL[data]
    latin = np.flatnonzero(data[:-1] == LATIN) if n else np.empty(0, np.int64)
    second = data[latin + 1]
    latin, second = latin[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
    kind[latin] = kind[latin + 1] = 1
    small[latin + 1] = second + np.where(second < 0x9F, 32, 0).astype(np.uint8)
    marked = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if n else np.empty(0, np.int64)

    ink = kind != 0
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    begins = ink & (~before | edge[:-1])
    chunk_starts = np.flatnonzero(begins)
    chunk_ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    odd = kind == 4
    odd[marked] = True
    odd = np.r_[0, np.cumsum(odd)]
    is_simple = odd[chunk_ends] == odd[chunk_starts]
    # simple chunks begin a piece at each digit and where the kind changes
    turns = begins.copy()
    turns[1:] |= ink[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    starts = np.flatnonzero(turns)
    of = np.searchsorted(chunk_starts, starts, "right") - 1
    stay = is_simple[of] | (starts == chunk_starts[of])
    starts, of = starts[stay], of[stay]
    ends = np.minimum(np.r_[starts[1:], n], chunk_ends[of]) if len(starts) else starts
    depth = np.zeros(n + 1, np.int8)
    depth[chunk_starts[is_simple]] += 1
    depth[chunk_ends[is_simple]] -= 1
    return np.where(np.cumsum(depth[:-1]) > 0, small, data), starts, ends, is_simple[of]


def hilbert(points: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2^depth (Skilling's transform)."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for bit in range(depth - 1, 0, -1):
        q = one << np.uint64(bit)
        p = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for bit in range(depth - 1, 0, -1):
        q = one << np.uint64(bit)
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(depth - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as arrays of ids: counts by hashed id, damped, normed and projected."""
    buckets = (words.mix(np.arange(1 << 17, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    directions = np.random.default_rng(5).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))
    vectors = np.zeros((len(documents), BUCKETS))
    for row, ids in zip(vectors, documents):
        row += np.bincount(buckets[ids], minlength=BUCKETS)
    vectors = np.log1p(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    cells = np.clip((vectors @ directions + 4) / 8, 0, 1 - 1e-9) * (1 << DEPTH)
    return hilbert(cells.astype(np.uint64), DEPTH)


def tokenized(docs: DataFrame, path: str, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, ids, doc_tokens, width, curve) of every row; ids are little-endian, ``width`` bytes each, and end with ``END_ID``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([END_ID], encoder.dtype)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first in range(0, len(texts), ROWS):
                arrays = [np.concatenate([a, end]) for a in encoder.encoded(texts.slice(first, ROWS))]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, ROWS), pa.array([a.tobytes() for a in arrays], pa.binary()), pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array(np.full(len(arrays), encoder.dtype.itemsize)), pa.array(curve_keys(arrays))],
                    ["doc_id", "ids", "doc_tokens", "width", "curve"])
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, ids binary, doc_tokens bigint, width bigint, curve bigint")


def packed(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece of a document: the id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Texts are tokenized once and written; only (key, id, count) is sorted along the curve. A null text is
    empty and packs as its end id alone. Repeated rows are packed each by itself, ties on the curve go by id, null
    ids last. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.keep(tokenized(docs, path, id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = running_sums(tokens.select("row", "doc_id", "doc_tokens", "curve"), ["curve", "doc_id"], "doc_tokens", scratch, "order")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            pieces: list[tuple] = []
            for i in range(batch.num_rows):
                doc_id, ids, width, place = (batch.column(k)[i].as_py() for k in range(4))
                array = np.frombuffer(ids, f"<u{width}").astype("<u4")
                start = 0
                while start < len(array):
                    sequence, offset = divmod(place + start, length)
                    part = array[start: start + length - offset].tobytes()
                    pieces.append((doc_id, start, len(part) // 4, part, zlib.crc32(part), len(array), sequence, offset))
                    start += len(part) // 4
                if len(pieces) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)
                    pieces = []
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)

    placed = tokens.select("row", "doc_id", "ids", "width").join(order.select("row", F.col("start").alias("place")), "row")
    return placed.select("doc_id", "ids", "width", "place").mapInArrow(
        cut, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, doc_tokens bigint, "
             "sequence_id bigint, offset bigint").withColumnRenamed("doc_id", id_column)
