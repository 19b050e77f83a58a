"""Best-fit packing after Martello and Toth's dominance reduction.

Documents become pieces of at most `size` tokens. What packing needs to know of the pieces is how many there are of each length:
a table with no more rows than `size`, however many documents there are. On these counts, small sets of lengths (of one, two or
three) that provably are as good as any other set with their longest piece are fixed as sequences; what is left is packed by best
fit, longest first. The plan says which ranks within a length go to which sequences, so that pieces find their places by rank,
without meeting each other.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import fresh_path, in_arrow, pieces, shipped, table
from .bitpack import vocabulary_file
from .lexicon import _PIECES, chunks, normal, word_bpe

SIZE, END_ID = 4096, 1
#: Cached chunks and words of a worker, in each of two generations: so many, and of so many characters and bytes of ids.
CACHE, CACHE_BYTES = 600_000, 24 << 20
#: Up to so many (part, length) rows are broadcast; more are joined by a shuffle.
MAX_SHIPPED = 400_000


# The plan ---------------------------------------------------------------------------------------------------------------


@dataclass
class Batch:
    """`n` sequences of the same content: runs of (length, how many of it in each), and the room that is left in each."""

    n: int
    left: int
    runs: list[tuple[int, int]] = field(default_factory=list)


class Stock:
    """How many pieces are left of each length."""

    def __init__(self, counts: dict[int, int]):
        self.counts = np.zeros(max(counts, default=0) + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n
        self.lengths = np.flatnonzero(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.lengths = self.lengths[self.lengths != length]

    def longest(self, most: int) -> int:
        """The longest piece of at most that length, 0 if there is none."""
        k = np.searchsorted(self.lengths, most, "right")
        return int(self.lengths[k - 1]) if k else 0


def _without(stock: Stock, length: int) -> Stock:
    """The stock as a piece of that length sees it: all others."""
    rest = Stock({})
    rest.counts, rest.lengths = stock.counts.copy(), stock.lengths
    rest.take(length, 1)
    return rest


def _best_pair(rest: Stock, room: int) -> tuple[int, int]:
    """The two pieces, longer first, of the largest sum within room; of equal sums, the one with the longest piece; (0, 0) if none fit."""
    firsts = rest.lengths[rest.lengths < room]
    if not len(firsts):
        return 0, 0
    # Each first length with the longest second one of no more than its own length; itself only if there are two.
    most = np.minimum(firsts, room - firsts)
    k = np.searchsorted(rest.lengths, most, "right") - 1
    own = (k >= 0) & (rest.lengths[k] == firsts) & (rest.counts[firsts] < 2)
    k = k - own
    sums = np.where(k >= 0, firsts + rest.lengths[k], 0)
    if not sums.max():
        return 0, 0
    at = len(sums) - 1 - int(sums[::-1].argmax())
    return int(firsts[at]), int(rest.lengths[k[at]])


def _smallest(rest: Stock, above: int, below: int | None = None) -> list[int]:
    """The two smallest pieces longer than `above` and, if given, shorter than `below`; fewer if there are fewer."""
    own = rest.lengths[(rest.lengths > above) & (rest.lengths < below if below is not None else True)][:2].tolist()
    if own and rest.counts[own[0]] >= 2:
        return [own[0]] * 2
    return own


def dominating(stock: Stock, length: int, size: int) -> tuple[int, ...]:
    """A set with a piece of that length that dominates every other set with it, by the criterion of Martello and Toth for sets of at most
    three; () if the criterion gives none."""
    rest, room = _without(stock, length), size - length
    small = _smallest(rest, 0)
    if not small or small[0] > room:
        return (length,)
    partner = rest.longest(room)
    if partner == room or len(small) < 2 or sum(small) > room:
        return (length, partner)
    # Are three others possible? Then sets of three aren't enough to judge by.
    third = small[:]
    after = Stock({})
    after.counts, after.lengths = rest.counts.copy(), rest.lengths
    for x in small:
        after.take(x, 1)
    third += _smallest(after, 0)[:1]
    if len(third) == 3 and sum(third) <= room:
        return ()
    a, b = _best_pair(rest, room)
    if partner >= a + b:
        return (length, partner)
    if partner == a:
        between = _smallest(rest, b, a)
        if len(between) < 2 or sum(between) > room:
            return (length, a, b)
    return ()


def reduce(stock: Stock, size: int) -> list[Batch]:
    """Fix dominating sets, longest piece first, as often as the stock has them, until a pass over all lengths fixes none. Fixing a
    set takes pieces away, which never makes a set that dominated worse, so that one judgement holds for all its copies."""
    fixed: list[Batch] = []
    again = True
    while again:
        again = False
        for length in stock.lengths[::-1].tolist():
            while stock.counts[length]:
                own = dominating(stock, length, size)
                if not own:
                    break
                need = {x: own.count(x) for x in own}
                n = min(int(stock.counts[x]) // k for x, k in need.items())
                if not n:
                    break
                for x, k in need.items():
                    stock.take(x, n * k)
                fixed.append(Batch(n, size - sum(own), sorted(need.items(), reverse=True)))
                again = len(own) > 1 or again
    return fixed


def best_fit(stock: Stock, size: int) -> list[Batch]:
    """Best fit, longest first, on counts: each piece goes where it leaves the least room. A sequence that takes one piece of a length
    is then the fullest that can take the next of that length, so sequences alike are filled together."""
    open_: dict[int, list[Batch]] = {}
    rooms: list[int] = []

    def put(b: Batch) -> None:
        if b.left not in open_:
            open_[b.left] = []
            insort(rooms, b.left)
        open_[b.left].append(b)

    def fill(b: Batch, length: int, n: int) -> int:
        """Put n pieces or as many as fit into the sequences of a batch; how many are left."""
        each = min(b.left // length, n)
        full, some = divmod(n, each)
        done = min(full, b.n)
        put(Batch(done, b.left - each * length, [*b.runs, (length, each)]))
        rest, n = b.n - done, n - done * each
        if rest and n:
            put(Batch(1, b.left - some * length, [*b.runs, (length, some)]))
            rest, n = rest - 1, 0
        if rest:
            put(Batch(rest, b.left, b.runs))
        return n

    for length in stock.lengths[::-1].tolist():
        n = int(stock.counts[length])
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                n = fill(Batch(-(-n // (size // length)), size), length, n)
                continue
            own = open_[rooms[k]]
            b = own.pop()
            if not own:
                del open_[rooms.pop(k)]
            n = fill(b, length, n)
    stock.counts[:], stock.lengths = 0, stock.lengths[:0]
    return [b for bs in open_.values() for b in bs]


def pack(counts: dict[int, int], size: int = SIZE) -> list[Batch]:
    """Sequences for so many pieces of each length (1 to size): those fixed by dominance, then those of best fit."""
    stock = Stock(counts)
    return [*reduce(stock, size), *best_fit(stock, size)]


def least_sequences(counts: dict[int, int], size: int = SIZE) -> int:
    """A number of sequences below which no packing can go (Martello and Toth's L2): pieces over half each need one of their own, and
    what can't be put beside those needs its share of more."""
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    best = -(-int((lengths * n).sum()) // size) if len(lengths) else 0
    for a in [0, *(x for x in lengths.tolist() if 2 * x <= size)]:
        large, mid, small = lengths > size - a, (lengths <= size - a) & (2 * lengths > size), (2 * lengths <= size) & (lengths >= a)
        beside = int(n[mid].sum()) * size - int((lengths[mid] * n[mid]).sum())
        best = max(best, int(n[large].sum() + n[mid].sum()) + max(0, -(-(int((lengths[small] * n[small]).sum()) - beside) // size)))
    return best


def slots(plan: list[Batch]) -> np.ndarray:
    """Rows (length, first rank, pieces in each sequence, first sequence, offset), by length and rank. A batch has at most as many
    runs as different lengths fit one sequence, and there are at most a few batches per length: the plan's size is bounded by the
    sequence size alone."""
    rows, ranks, sequence = [], {}, 0
    for b in plan:
        at = 0
        for length, each in b.runs:
            rank = ranks.get(length, 0)
            rows.append((length, rank, each, sequence, at))
            ranks[length] = rank + each * b.n
            at += each * length
        sequence += b.n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# The pieces -------------------------------------------------------------------------------------------------------------


#: Marks that often follow a word.
_AFTER = frozenset(".,;:!?")
#: White space to Python, but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _words(chunk: str) -> list[str]:
    """The words of a chunk by the tokenizer's pattern; letters with one mark behind are told without it."""
    if chunk[-1] in _AFTER and chunk[:-1].isalpha():
        return [chunk[:-1], chunk[-1]]
    return _PIECES.findall(chunk)


class Recent:
    """A map from text to ids that forgets what hasn't been asked for long: when it is full, the entries become the old ones, from which
    those still in use are taken back, and the old ones before them go."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def add(self, new: dict[str, bytes]) -> None:
        if len(self.now) + len(new) > CACHE or self.held > CACHE_BYTES:
            self.now, self.old, self.held = {}, self.now, 0
        self.now.update(new)
        self.held += sum(map(len, new)) + sum(map(len, new.values()))

    def back(self, keys: list[str]) -> dict[str, bytes]:
        """The old entries among keys that are not in `now`; they are new again."""
        if not self.old:
            return {}
        found = {k: x for k in keys if (x := self.old.get(k)) is not None}
        self.add(found)
        return found


class PieceEncoder:
    """The ids of a word-level BPE file of the tokenizers library, as bytes of little-endian unsigned 32-bit ids, with caches of chunks
    between white space and of the words in them. Texts with special tokens go to the library."""

    def __init__(self, path: str):
        self.bpe, self.path, self.whole = word_bpe(path), path, None
        self.chunks, self.words = Recent(), Recent()

    def _of_words(self, used: list[str]) -> dict[str, bytes]:
        known = {w: x for w in used if (x := self.words.now.get(w)) is not None}
        known.update(self.words.back([w for w in used if w not in known]))
        unseen = [w for w in used if w not in known]
        made = dict(zip(unseen, self.bpe.merge_all([w.encode() for w in unseen]), strict=True))
        self.words.add(made)
        return known | made

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of chunks that the cache of chunks lacks; they are put there."""
        out = self.chunks.back(new)
        if len(out) < len(new):
            new = [c for c in new if c not in out]
            # Chunks hold no white space, so that all of them are normalised as one text.
            cut = [[c] if c.isalpha() else _words(c) for c in normal("\n".join(new)).split("\n")]
            known = self._of_words(list(set().union(*cut)))
            made = {c: known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws]) for c, ws in zip(new, cut, strict=True)}
            self.chunks.add(made)
            out |= made
        return out

    def _whole(self, text: str) -> bytes:
        if self.whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids. Chunks that the cache lacks are found while it is read, and learnt together."""
        out: list = []
        for t in texts:
            if "<|" in t and self.bpe.cut.search(t):
                out.append(self._whole(t))
                continue
            own = chunks(t) if any(c in t for c in _SEPARATORS) else t.split()
            found = [*map(self.chunks.now.get, own)]
            out.append((own, found) if None in found else b"".join(found))
        late = [k for k, x in enumerate(out) if type(x) is tuple]
        if late:
            known = self.learn(list({c for k in late for c, x in zip(*out[k], strict=True) if x is None}))
            for k in late:
                out[k] = b"".join([known[c] if x is None else x for c, x in zip(*out[k], strict=True)])
        return out


@cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


_PIECE_ROWS = "piece int, start long, length long, ids_crc32 long, part int, rank long"


def document_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, part, rank): every document's ids and the end id, cut into pieces of size tokens, the last
    one shorter. part is the task that made the row and rank counts the pieces of one length within it: so they are only fixed once
    the rows have been written.

    Null and empty texts have the end id alone. Rows without id and repeated rows have pieces like any others; an empty table
    gives no rows; further columns are ignored; a very long text gives as many pieces as it needs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, tail = _encoder(tokenizer), TaskContext.get().partitionId(), [0] * (size + 1), np.array([end_id], "<u4").tobytes()
        for b in pieces(batches):
            rows: list[tuple] = []
            for k, x in enumerate(enc.encode([t or "" for t in b.column(1).to_pylist()])):
                x += tail
                for p, at in enumerate(range(0, len(x), 4 * size)):
                    own = x[at : at + 4 * size] if len(x) > 4 * size else x
                    n = len(own) // 4
                    rows.append((k, p, at // 4, n, zlib.crc32(own), seen[n]))
                    seen[n] += 1
            k, p, at, n, crc, rank = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), pa.array(p.astype(np.int32)), pa.array(at), pa.array(n), pa.array(crc), pa.array(np.full(len(k), part, np.int32)), pa.array(rank)], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    made = in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of, f"id {kind}, {_PIECE_ROWS}")
    return made.withColumnRenamed("id", id_col)


def placed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (with length, part and rank, written out before) with sequence_id and offset: every sequence holds at most size tokens, its pieces
    stand without gaps from 0. Only counts by length, of which there are no more than size, come to the driver."""
    spark = rows.sparkSession
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(pack(counts, size))
    # Ranks within a part become ranks over all parts. A length has no more rows here than there are parts.
    own = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = own.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.join(shipped(base, MAX_SHIPPED), ["length", "part"])
    kept = [c for c in rows.columns if c not in ("part", "rank")]
    starts = plan[:, 0] << 44 | plan[:, 1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(starts, length << 44 | rank, "right") - 1
            _, first, each, sequence, offset = plan[at].T
            step = rank - first
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence + step // each), pa.array(offset + step % each * length)], names=[*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    return in_arrow(ranked.select(*kept, (F.col("rank") + F.col("before")).alias("rank")), of, f"{fields}, sequence_id long, offset long") if counts else spark.createDataFrame([], f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): one row per piece, as document_pieces() and placed() have them."""
    path = fresh_path(docs.sparkSession, "pieces")
    document_pieces(docs, tokenizer, id_col, text_col, size, end_id).write.parquet(path)
    return placed(docs.sparkSession.read.parquet(path), size)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document. Null and empty texts are one token, the end id; repeats are packed like others; an
    empty table gives no rows; further columns are ignored."""
    return packed(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json"))
