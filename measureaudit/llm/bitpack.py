"""Token-id files: fixed-width bit packing with block offsets, for vectorised unpacking and random access.

Each id takes the minimum number of bits of the vocabulary. Ids are packed most significant bit first in blocks of BLOCK ids;
a block starts at a byte, and a table of block offsets stands before the blocks, so any range of ids is read by unpacking the
blocks it touches. One file holds whole documents in order; files are the rows of a Parquet table, whose committer keeps
the output whole when executors are lost, in whatever store the cluster has.

A file: magic, width, documents, ids, ids per block; a validity byte and an int64 id per document; an uint64 local start per
document and the end; an uint64 offset per block and the end; the blocks. All little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh_path, in_arrow, pieces, shipped, table

MAGIC, BLOCK = b"FWB1", 1 << 14
#: A file is closed once it holds so many ids; its last document is never cut.
FILE_IDS = 1 << 20
END_ID = 0
#: Up to so many files' starts are broadcast; more are joined by a shuffle.
MAX_SHIPPED_FILES = 100_000
#: Cached parts of text per worker; beyond it the cache starts anew.
CACHE = 1_200_000
_HEAD = struct.Struct("<4sBIQI")


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits.reshape(-1)).tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def write_file(doc_ids: list[int | None], docs: list[np.ndarray], width: int) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    valid = np.array([i is not None for i in doc_ids], np.uint8)
    own = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, width, len(docs), len(ids), BLOCK), valid.tobytes(), own.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads one file's bytes; ids(a, b) unpacks only the blocks of that range."""

    def __init__(self, data: bytes):
        magic, self.width, n, self.n_ids, self.block = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = _HEAD.size
        valid = np.frombuffer(data, np.uint8, n, at)
        own = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [int(i) if v else None for i, v in zip(own, valid, strict=True)]
        at += 9 * n
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.offsets = np.frombuffer(data, "<u8", -(-self.n_ids // self.block) + 1, at).astype(np.int64)
        self.data, self.at = memoryview(data), at + 8 * len(self.offsets)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        parts = [
            unpack(self.data[self.at + self.offsets[k] : self.at + self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.width)
            for k in range(first, last + 1)
        ]
        return np.concatenate(parts)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: White space other than spaces and line feeds, as Python's patterns have it.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class ByteEncoder:
    """The ids of a byte-level BPE tokenizer of the tokenizers library, with a cache of text parts.

    The tokenizer's own pattern never joins text across a single space between two non-space characters, other than that the
    space opens what follows. So a text is cut there, the library encodes the parts that are not cached, and the ids of a
    text are those of its parts in order. Texts with other white space around a space are cut by the pattern's white-space
    alternatives.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.vocabulary = self.own.get_vocab_size()
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.vocabulary, bool)
        for s, i in self.own.get_vocab().items():
            self.spaced[i] = s.startswith("\u0120")  # the byte-level letter of a space
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # parts that open with their only space, named without it

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """(parts, words): a text's parts in order, the last of which, each a word after a space, are given without it."""
        if _ODD.search(text) or any(s in text for s in self.special):
            if _SEPARATORS.search(text) or any(s in text for s in self.special):
                return [text], []
            return _CHUNK.findall(text), []
        if "  " in text or "\n " in text or " \n" in text or text[-1:] == " ":
            return _CHUNK.findall(text), []
        first, *rest = text.split(" ")
        return ([first] if first else []), rest

    def _learn(self, new: list[str]) -> None:
        for p, e in zip(new, self.own.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.cache[p] = np.array(e.ids, "<u4").tobytes()

    def _learn_words(self, new: list[str]) -> None:
        """Cache the ids of words after a space. They go to the library as one text, in which each of them starts at a token that
        opens with a space; words that could be cut or joined otherwise go one by one."""
        plain = [w for w in new if not w[0].isspace() and not w[-1].isspace()]
        other = [w for w in new if w[0].isspace() or w[-1].isspace()] if len(plain) < len(new) else []
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            ids = np.array(self.own.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):
                other += some
                continue
            data, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
            self.words.update(zip(some, [data[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)], strict=True))
        for w, e in zip(other, self.own.encode_batch_fast([" " + w for w in other], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.parts(t) for t in texts]
        for known, used, learn in ((self.cache, [p for p, _ in cut], self._learn), (self.words, [w for _, w in cut], self._learn_words)):
            if len(known) > CACHE:
                known.clear()
            if new := list(set().union(*used).difference(known)):
                learn(new)
        part, word = self.cache.__getitem__, self.words.__getitem__
        return [np.frombuffer(b"".join([*map(part, p), *map(word, w)]), "<u4") for p, w in cut]


@cache
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text, append end_id, and write files of packed ids to the Parquet table at path, in ascending id order.

    The table: part and seq order the files, n_ids is a file's number of ids, file its bytes. Parts are ranges of ids, cut by
    Spark's range partitioning. Null and empty texts have the end id alone; rows without id come first; ids given twice are
    ordered by a hash of their texts. id_col must be integral. An empty table writes no file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        width, ids, held, size = width_of(enc.vocabulary), [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([write_file(ids, held, width)], pa.binary())], names=["part", "seq", "n_ids", "file"]
            )

        for b in pieces(batches):
            for d, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids.append(d)
                held.append(np.append(x, np.uint32(end_id)))
                size += len(x) + 1
                if size >= FILE_IDS:
                    yield close()
                    ids, held, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    laid = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    in_arrow(laid, of, "part int, seq int, n_ids long, file binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, per_document, schema: str) -> DataFrame:
    """Read a table of write_tokens: per_document(ids) gives a tuple for the columns of schema, kept next to doc_id, start
    (ids of all documents before it) and n_tokens. Documents come back one row each, those without id with a null one; a table
    without files gives no rows."""
    files = spark.read.parquet(path)
    # One row per part, of which there are as many as range partitions.
    totals = sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect())
    base = dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist(), strict=False))
    inside = files.select("part", "seq", "n_ids")
    from pyspark.sql import Window as W

    # One row per file: broadcast only while these are few.
    before = inside.withColumn("before", F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n_ids")
    out = spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {schema}").schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at, data in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("file"), strict=True):
                f = TokenFile(data.as_py())
                all_ids = f.ids(0, f.n_ids)
                rows = [(d, base[part] + at + int(s), int(e - s), *per_document(all_ids[s:e])) for d, s, e in zip(f.doc_ids, f.starts[:-1], f.starts[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(dict(zip(out.names, map(list, zip(*rows, strict=True)), strict=True)), schema=_arrow(out))

    return files.select("part", "seq", "file").join(shipped(before, MAX_SHIPPED_FILES), ["part", "seq"]).select("part", "before", "file").mapInArrow(of, out)


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _crc(ids: np.ndarray) -> tuple[int]:
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written and read back. Null and empty texts have the end id alone; repeats are encoded like others; an
    empty table gives no rows; further columns are ignored."""
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_file("byte_bpe_50k.json"))
    return read_tokens(spark, path, _crc, "ids_crc32 long")
