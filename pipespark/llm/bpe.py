"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of byte strings and ranks; its path is a parameter.  Every task reads the pairs
from a broadcast (bounded by the vocabulary, about 1 MB), builds a ``tokenizers`` model of them, and keeps a
bounded cache from pre-token to its ids: a corpus repeats its pre-tokens, so most are encoded once per task.

Edge cases: a null or empty text has no ids, and decodes to the empty text.  A text of any length is done whole,
in one pass that holds a bounded number of ids beyond the row's own.  Decoding works on bytes, so an id sequence
cut inside a character still gives back exactly its bytes; ``decode_text`` replaces what is not UTF-8.  Repeated
rows are encoded alike.  Columns of the input other than the text are handed on untouched by ``encode``; one named like a
result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
import pickle
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, chunks, map_batches, text_at

#: Pre-tokens that a task remembers; up to 300 bytes each.
CACHE = 400_000

#: The same where ids go back to the JVM, whose buffers need the memory more.
ENCODE_CACHE = 150_000

#: Texts that are turned into Python lists at once.
_ROWS = 256

#: Bytes of text, or one longer text, whose pieces are Python objects at once where ids go back to the JVM.
_BYTES = 256 << 10

#: Pieces that the library encodes in one call: until it is read, a result takes far more memory than its ids.
_PIECES = 1_024


def read_ranks(path: str) -> dict[bytes, int]:
    """The ``base64 rank`` lines of a rank file on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def byte_characters() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 stands for itself, the rest are shifted up from 256 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = dict(zip(own, map(chr, own), strict=True)), 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def byte_strings(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """The bytes of each id: its characters taken back through the byte table."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return {i: bytes(map(back.__getitem__, token)) for token, i in vocabulary.items()}


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two or more bytes is merged from, in order of rank.

    It is what remains of the token when it is merged with only the ranks below its own.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encodes and decodes as the ranks say, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        import regex
        from tokenizers import Tokenizer, models

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread keeps freed memory of its own
        #: str.translate takes a text of Latin-1 characters, one per byte, to the vocabulary's characters.
        self.table = dict(enumerate(byte_characters()))
        name = lambda x: x.decode("latin-1").translate(self.table)
        vocabulary = {name(k): v for k, v in ranks.items()}
        self.bytes_of = byte_strings(vocabulary)
        self.model = Tokenizer(models.BPE(vocabulary, [(name(a), name(b)) for a, b in merges], ignore_merges=True))
        self.pattern = regex.compile(pattern)
        #: The ids of a piece as C ints in a row, which take less memory than a tuple of ints.
        self.cache: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, pieces: Iterable[str], most: int = CACHE) -> None:
        """Puts the ids of pieces into the cache, encoding those that are new in one call."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > most:
            self.cache.clear()
            new = list(pieces)
        for i in range(0, len(new), _PIECES):
            part = new[i : i + _PIECES]
            got = self.model.encode_batch_fast([p.encode().decode("latin-1").translate(self.table) for p in part], add_special_tokens=False)
            self.cache.update(zip(part, (array("i", e.ids).tobytes() for e in got), strict=True))

    def known(self, pieces: Iterable[str]) -> array:
        """The ids of pieces that are in the cache."""
        return array("i", b"".join(map(self.cache.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        found = self.pieces(text)
        self.learn(set(found))
        return self.known(found).tolist()

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """For each id the characters [start, end) of the text that its bytes touch.

        A character split over several ids belongs to each of them; its start is found by counting the bytes that start a character.
        """
        data = np.frombuffer(text.encode(), np.uint8)
        nth = np.cumsum((data & 0xC0) != 0x80)  # 1-based number of the character that each byte is in
        ends = np.cumsum([len(self.bytes_of[i]) for i in self.encode(text)], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return [(int(nth[s]) - 1, int(nth[e - 1])) for s, e in zip(starts, ends, strict=True)]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids, via the table from characters back to bytes."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> str:
        return self.decode(ids).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def _codec_of(shared) -> Codec:
    """The worker's codec of a broadcast, known by a digest of the vocabulary; a worker keeps one."""
    key, parts = shared.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*pickle.loads(parts))
    return _codecs[key]


def _share(spark: SparkSession, path: str, pattern: str):
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    # A worker holds on to a broadcast's value, so this is bytes: 1.3 MB instead of tables of 16 MB.
    return spark.sparkContext.broadcast((key, pickle.dumps((ranks, merge_pairs(ranks), pattern))))


def _texts(column: pa.Array, rows: int = _ROWS) -> Iterator[list[str]]:
    for i in range(0, len(column), rows):
        yield column.slice(i, rows).to_pylist()


def _coded(codec: Codec, batches: Iterable[pa.RecordBatch], place: int, back: list[int], names: list[str], check: bool) -> Iterator[pa.RecordBatch]:
    """The columns ``back`` of batches, the ids of the text at ``place``, and on ``check`` whether they decode to its bytes; some _BYTES of text at once."""
    for b in batches:
        for i, j, *_ in chunks(b.column(place), _BYTES):
            part = b.slice(i, j - i)
            texts = [x or "" for x in part.column(place).to_pylist()]
            found = [codec.pieces(x) for x in texts]
            codec.learn(set().union(*found), ENCODE_CACHE)
            got = [codec.known(p) for p in found]
            at = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            columns = [*[part.column(k) for k in back], pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(got, dtype=np.int32)))]
            if check:
                columns.append(pa.array([codec.decode(g) == x.encode() for g, x in zip(got, texts, strict=True)]))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", whole: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with a column of ids (array<int>) after its own; ``whole`` names one more, whether the ids decode to the text's bytes.
    Without ``keep_text`` the text itself isn't sent back."""
    df = df.drop(*[c for c in (ids, whole) if c and c != text])
    shared = _share(df.sparkSession, path, pattern)
    more = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(whole, T.BooleanType(), False)] if whole else [])
    schema = T.StructType([*[f for f in df.schema.fields if keep_text or f.name != text], *more])
    back = [i for i, c in enumerate(df.columns) if keep_text or c != text]
    df, place, _ = text_at(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared)
        yield from _coded(codec, batches, place, back, schema.names, whole is not None)
        codec.cache.clear()  # an idle worker holds no memory

    return map_batches(df, run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df with the bytes of its ids after its own columns; null ids give empty bytes."""
    table = df.sparkSession.sparkContext.broadcast({i: token for token, i in read_ranks(path).items()})
    df = df.drop(*[c for c in (data,) if c != ids])
    schema, spare = T.StructType([*df.schema.fields, T.StructField(data, T.BinaryType(), False)]), "__bpe_ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                got = [b"".join(map(get, x or ())) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.binary())], names=schema.names)

    return map_batches(df.withColumn(spare, F.col(ids)), run, schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the round trip's digests, without carrying the ids through the JVM."""
    shared = _share(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared)
        said: dict[str, tuple[int, str, bytes]] = {}  # piece -> (number of ids, their decimals each followed by a space, their bytes)
        for b in batches:
            ns, a, d = [], [], []
            for rows in _texts(b.column(1)):
                found = [codec.pieces(x) for x in rows]
                new = set().union(*found) - said.keys()
                if len(said) + len(new) > CACHE:
                    said.clear()
                    new = set().union(*found)
                codec.cache.clear()
                codec.learn(new)
                for p in new:
                    ids = codec.known([p])
                    said[p] = (len(ids), "".join([f"{i} " for i in ids]), codec.decode(ids))
                for pieces in found:
                    got = [said[p] for p in pieces]
                    ns.append(sum([x[0] for x in got]))
                    a.append(hashlib.sha256("".join([x[1] for x in got])[:-1].encode()).hexdigest())
                    d.append(hashlib.sha256(b"".join([x[2] for x in got])).hexdigest())
            codec.cache.clear()
            yield batch(**{key: b.column(0), "n_tokens": pa.array(ns, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())})

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, F.coalesce(F.col(text).cast("string"), F.lit(""))), run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
