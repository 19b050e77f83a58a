"""SimHash near-duplicates: popcount embedding, grid range join under Manhattan distance, exact verification.

A document's 64-bit fingerprint takes the majority of each bit over the XXH64 hashes of its 3-word shingles. Two fingerprints
link when at most three bits differ. The 64 bits are cut into 32 segments of two bits; a segment's bit count (0, 1 or 2) is
written in unary (00, 01, 11), so that the Manhattan distance of two embeddings is the number of differing bits of their
codes. It never exceeds the Hamming distance of the fingerprints. If two embeddings are within three, one half of the
segments (16 of 32) is within one: the grid has one cell for each value of a half, and a point probes its own cell and the
cells one step up in one segment. Pairs that meet are tested by the whole Manhattan distance and then by the exact Hamming
distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, fitted, in_arrow, kept, pieces, shipped, table
from .components import components

MAX_BITS = 3
_PIECE = 1 << 16
_ODD = "6148914691236517205"  # 0x5555555555555555


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The unsigned fingerprint of one text; 0 where it has no word."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    k = words_in_shingle
    hashed = xxhash.xxh64_intdigest
    if len(words) <= k:
        return hashed(b" ".join(words), 42)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - k]]]
    h = np.array([hashed(line[s:e], 42) for s, e in zip(starts, ends[k - 1 :], strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _PIECE):
        bits = np.unpackbits(h[i : i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long. A null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of, f"id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """The unary codes of the bit counts of the 32 two-bit segments, as one long."""
    odd, up = F.expr(f"{_ODD}L"), F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(up).bitwiseAND(odd), fp.bitwiseAND(up).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(both, 1))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints of column fp that differ in at most three bits, each at least once."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid's cells are laid out for distances up to 3")
    points = fps.select("fp").distinct().withColumn("u", embedding(F.col("fp")))
    halves = points.select(
        "fp", "u", F.explode(F.expr("array(struct(0 as half, cast(u & 4294967295L as long) as cell), struct(1 as half, shiftrightunsigned(u, 32) as cell))")).alias("h")
    ).select("fp", "u", "h.half", "h.cell")
    # A step up in one segment sets its low bit (00 to 01) or, if that is set, its high bit (01 to 11).
    step = "case when cell & shiftleft(1L, 2 * s) = 0 then cell | shiftleft(1L, 2 * s) when cell & shiftleft(2L, 2 * s) = 0 then cell | shiftleft(2L, 2 * s) end"
    up = F.expr(f"filter(transform(sequence(0, 15), s -> {step}), c -> c is not null)")
    probes = halves.select(F.col("fp").alias("fp_a"), F.col("u").alias("u_a"), "half", F.explode(F.concat(F.array("cell"), up)).alias("probe"), "cell")
    probes = probes.select("fp_a", "u_a", "half", F.col("probe").alias("cell"), (F.col("probe") == F.col("cell")).alias("own"))
    near = probes.join(halves, ["half", "cell"]).where(f"bit_count(u_a ^ u) <= {max_bits} and bit_count(fp_a ^ fp) <= {max_bits} and (not own or fp_a < fp)")
    return near.select(F.least("fp_a", "fp").alias("a"), F.greatest("fp_a", "fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id): one row per input row.

    fingerprint is 16 lowercase hex digits; component_id is the smallest id reachable over links, the row's own included.
    Null and empty texts have fingerprint zero and link to each other. Equal texts, and rows given twice, share a fingerprint
    and so a component. A row whose id is null gets a fingerprint and its component, but its id is never chosen as
    component_id; a component without any id has null. An empty table gives an empty result; further columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    rows = cut(fingerprints(docs, id_col, text_col))
    groups = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(rows, max_bits))
    placed = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(kind)
    )


#: Near copies: five-word shingles, and the Jaccard similarity from which two texts are near copies.
COPY_WORDS, COPY_SIMILARITY = 5, 0.8
#: Frequent shingles are looked for in one text of SAMPLE and are those of FREQUENT of its texts, MAX_FREQUENT at most. They
#: come last in the order of prefixes, so that they make few pairs; results don't depend on them.
SAMPLE, FREQUENT, MAX_FREQUENT = 16, 8, 50_000


def shingles(text: str | None, n: int = COPY_WORDS) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of the five-word shingles; 1 for two texts without words."""
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 11) for x in shingles(text)], np.uint64))


def prefix(hashes: np.ndarray, least: float, rare_first: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hashes of which two texts at least that similar share one: the first in an order common to all texts."""
    if not len(hashes):
        return hashes
    often, ranks = rare_first
    rank = np.zeros(len(hashes), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        rank = np.where(often[at] == hashes, ranks[at], 0)
    n = len(hashes) - math.ceil(least * len(hashes) - 1e-9) + 1
    return hashes[np.argsort(rank, kind="stable")[:n]]


def _among(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Which of the hashes are in often, an array in order."""
    at = np.minimum(np.searchsorted(often, hashes), max(0, len(often) - 1))
    return often[at] == hashes if len(often) else np.zeros(len(hashes), bool)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, ranks by count) of shingles that a sample of docs (node, text) holds often."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t).view(np.int64))], names=["h"])

    some = in_arrow(docs.where(F.xxhash64("node") % SAMPLE == 0).select("text"), of, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).collect()
    often = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(often)
    return often[order], (len(top) - np.arange(len(top)))[order]


#: Up to so many rows are broadcast to pick out or mark texts (under 100 bytes each); more are joined by a shuffle.
MAX_PICKED = 500_000
#: A text's shingles are counted by buckets of their hashes: the sum of the lesser counts is never below the number that two
#: texts share. Texts of over LONG shingles have more buckets; with over 255 shingles in a bucket a text isn't judged by it.
BUCKETS, LONG_BUCKETS, LONG = 256, 4096, 2000
#: A key of so many texts at most is turned into pairs; texts of other keys are compared in blocks.
MAX_MET = 128
#: A block holds about so many texts, and so many shingles, at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 500_000


def sketch(hashes: np.ndarray) -> bytes:
    n = LONG_BUCKETS if len(hashes) > LONG else BUCKETS
    counts = np.bincount((hashes >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64), minlength=n)
    return counts.astype(np.uint8).tobytes() if len(hashes) and counts.max() < 256 else b""


def most_shared(x: bytes, y: bytes) -> int | None:
    """No fewer than the shingles that two texts share, by their sketches; None where these don't tell."""
    if not x or not y:
        return None
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)).sum())


def shared_counts(one: np.ndarray, others: list[np.ndarray], index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many hashes `one` shares with each of the others, by index_of(others)."""
    known, starts, owner = index
    at = np.searchsorted(known, one)
    at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == one)] if len(known) else at[:0]
    size = starts[at + 1] - starts[at]
    run = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(at) else at, size) + np.arange(size.sum())
    return np.bincount(owner[run], minlength=len(others))


def index_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, where each one's texts start, texts by hash)."""
    flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order = np.argsort(flat, kind="stable")
    known, first = np.unique(flat[order], return_index=True)
    return known, np.append(first, len(flat)), owner[order]


def _forest(names: list[int], texts: list[np.ndarray], side: list[int], block: list[int], least: float) -> list[tuple[int, int]]:
    """Links that join the similar texts of a cell's two blocks into groups, one fewer than the texts of a group.

    Texts that are there for a smaller band only (side 1) aren't compared with each other, nor texts of one block where two
    blocks meet: that is done elsewhere."""
    root, out = list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    size, side_of, block_of, index, apart = np.array([len(t) for t in texts]), np.array(side), np.array(block), index_of(texts), len(set(block)) > 1
    for i, t in enumerate(texts):
        both = shared_counts(t, texts, index)
        near = (both >= least * (size + len(t) - both)) & (side_of + side[i] < 2) & (~apart | (block_of != block[i]))
        for j in np.flatnonzero(near[:i]).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                out.append((names[i], names[j]))
    return out


def _cold_pairs(met: DataFrame, named: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of texts that share a key of few texts, early enough in both to be near copies, and that the bound by
    sketches leaves. met: (key, k, size, pos, n)."""
    enough = f"least(x.size - x.pos, y.size - y.pos) >= {least / (1 + least)} * (x.size + y.size) - 1e-6"
    each = f"transform(filter(slice(m, i + 2, size(m)), y -> {enough}), y -> struct(least(x.k, y.k) as a, greatest(x.k, y.k) as b))"
    lists = met.where(f"n <= {MAX_MET}").groupBy("key").agg(F.collect_list(F.struct("k", "size", "pos")).alias("m"))
    pairs = fitted(cut(lists.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> {each}))")).alias("p")).select("p.a", "p.b").distinct()))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ok = []
            for x, y, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                most = most_shared(x, y)
                ok.append(most is None or (1 + least) * most >= least * n - 1e-6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda x: named.select(F.col("k").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("size").alias(f"n_{x}"))
    sided = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b", (F.col("n_a") + F.col("n_b")).alias("n"))
    return fitted(cut(in_arrow(sided, bound, "a long, b long")))


def _hot_cells(hot: DataFrame, named: DataFrame) -> DataFrame:
    """(k, cell, band, side, i, j): where texts of keys with many texts are compared. hot: (k, key).

    Texts that are tied by such keys, over any number of them, make a cell; within it only texts of one band of sizes, or of
    the next, can be near copies. Large cells are cut into blocks, and each two blocks meet in a place of their own."""
    many = hot.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    own = kept(hot.join(many, "key"), "hot")
    first = own.groupBy("k").agg(F.min("key").alias("first"))
    ties = own.join(first, "k").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    cells = components(ties)
    band = F.floor(F.log("size") / math.log(1.25)).cast("int")
    placed = first.join(cells, F.col("first") == F.col("node"), "left").select("k", F.coalesce("root", "first").alias("cell")).join(named.select("k", "size"), "k").withColumn("band", band)
    sides = kept(placed.select("k", "size", "cell", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("band").alias("band")), F.struct(F.lit(1).alias("side"), (F.col("band") - 1).alias("band")))).alias("s")).select("k", "size", "cell", "s.band", "s.side"), "cells")
    counts = sides.groupBy("cell", "band").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("side").alias("own")).where("n > 1 and own = 0")
    blocks = counts.select("cell", "band", F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("g"))
    laid = sides.join(shipped(blocks, MAX_PICKED), ["cell", "band"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("g")).cast("int"))
    spread = laid.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return spread.select("k", "cell", "band", "side", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def copy_links(nodes: DataFrame, docs: DataFrame, least: float = COPY_SIMILARITY) -> DataFrame:
    """(a, b) of nodes (k, node, size, keys, often, sketch) whose texts are near copies, enough to reach all of a group.

    keys is the prefix of a text's shingles, of which those from place `often` on are frequent; size is their number; texts are
    in docs (node, text). Two near copies share a key. Keys that few texts hold give pairs, which are judged by sketches and
    then by the shingles' hashes. Keys that many hold give no pairs: their texts meet in blocks, and each two blocks give no
    more links than they have texts. Both ways are exact. Texts that share much of a frequent passage, but are no copies, are
    compared there in vain: that cost grows with the square of their number in a band of sizes.
    """
    own = nodes.select("k", "size", "often", F.posexplode("keys").alias("pos", "key"))
    met = kept(own.where("pos < often").withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1").select("key", "k", "size", "pos", "n"), "met")
    close = _cold_pairs(met, nodes, least)
    hot = own.where("pos >= often").select("k", "key").unionByName(met.where(f"n > {MAX_MET}").select("k", "key"))
    cells = kept(_hot_cells(hot, nodes), "blocks")
    wanted = close.select(F.explode(F.array("a", "b")).alias("k")).unionByName(cells.select("k")).distinct()
    wanted = cut(nodes.select("k", "node").join(wanted, "k", "left_semi"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["k", "h"])

    packed = kept(in_arrow(docs.join(shipped(wanted, MAX_PICKED), "node").select("k", "text").dropDuplicates(["k"]), pack, "k long, h binary"), "packed")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both / (len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def compare(t: pa.Table) -> pa.Table:
        texts = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("h")]
        found = _forest(t.column("k").to_pylist(), texts, t.column("side").to_pylist(), t.column("block").to_pylist(), least)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    side = lambda x: packed.select(F.col("k").alias(x), F.col("h").alias(f"h_{x}"))
    cold = in_arrow(close.join(side("b"), "b").join(side("a"), "a").select("a", "b", "h_a", "h_b"), verify, "a long, b long")
    warm = cells.join(packed, "k").groupBy("cell", "band", "i", "j").applyInArrow(compare, "a long, b long")
    said = cut(cold.unionByName(warm))
    name = lambda x: nodes.select(F.col("k").alias(x), F.col("node").alias(f"_{x}"))
    return said.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, least: float | None = None) -> DataFrame:
    """docs without the near-duplicates of a document that stays: of each group, the row with the smallest id.

    Groups are reached over fingerprint links and, with least, over near copies too: texts whose five-word shingles are at
    least that similar.
    Of rows given twice under the smallest id, one stays; rows without id come after all others, in the order of a hash of
    their text. Null and empty texts are one group. An empty table gives an empty result; all columns are kept, whatever
    their names.
    """
    names, kind = docs.columns, docs.schema[id_col].dataType.simpleString()
    # Nodes are distinct texts, named by a hash, so that exact copies meet by hash and never by pairs.
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.md5(text).alias("node"), F.col(id_col).alias("id"), text.alias("text"))
    rare_first = frequent_shingles(given) if least is not None else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column(2).to_pylist()
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            columns = [b.column(0), b.column(1), pa.array(fps)]
            if least is not None:
                hashes = [shingle_hashes(t) for t in texts]
                keys = [prefix(h, least, rare_first) for h in hashes]
                often = [int(np.sum(~_among(k, rare_first[0]))) for k in keys]
                columns += [pa.array([len(h) for h in hashes], pa.int32()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(often, pa.int32()), pa.array([sketch(h) for h in hashes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "id", "fp", "size", "keys", "often", "sketch"][: len(columns)])

    more = ("size", "keys", "often", "sketch") if least is not None else ()
    rows = in_arrow(given, of, f"node string, id {kind}, fp long" + ", size int, keys array<long>, often int, sketch binary" * bool(more))
    groups = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("fp").alias("fp"), *(F.any_value(c).alias(c) for c in more))
    nodes = kept(groups.withColumn("k", F.monotonically_increasing_id()), "nodes")
    by_fp = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    near = links(by_fp, max_bits)
    tied = near.join(by_fp.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("fp", "node").join(by_fp, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    edges = tied.unionByName(same)
    if least is not None:
        edges = edges.unionByName(copy_links(nodes, given.select("node", "text"), least))
    placed = nodes.select("node", "least", "n").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = placed.groupBy("root").agg(F.min_by("node", F.struct(F.col("least").isNull(), "least", "node")).alias("head"))
    # Marked are the texts that go, and those that stay but were given in several rows; all others stay as they are.
    stays = F.col("node") == F.col("head")
    marks = cut(placed.join(first, "root").where(~stays | (F.col("n") > 1)).select("node", stays.alias("stays"), "least"))
    # The caller's row travels as one column, so that its names meet none of ours.
    rows = docs.select(F.md5(text).alias("node"), F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    marked = rows.join(shipped(marks, MAX_PICKED), "node", "left")
    alone = marked.where("stays is null").select("row.*")
    again = marked.where(F.col("stays") & F.col("id").eqNullSafe(F.col("least"))).dropDuplicates(["node"]).select("row.*")
    return alone.unionByName(again)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates over documents. Null and empty texts share fingerprint zero and so a component; ties, repeats and rows given
    twice share theirs; an empty table gives no rows; further columns are ignored."""
    return near_duplicates(table(spark, sf_dir, "documents"))
