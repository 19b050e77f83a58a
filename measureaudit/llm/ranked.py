"""Ranked lexical search by pipelined term partitioning.

Documents are cut into posting lists of the asked terms, block by block of documents. The terms have owners, the rarest terms
first. Items travel in bundles: for each block, a bundle carries sparse accumulators (document, score so far) through one stage
after another, and meets in each, by a cogroup, the lists of the terms that the stage owns. Contributions are integers, so that
the order of additions has no part in the result. After the last stage the best documents of each block meet for the final
selection.

Between stages an accumulator is left behind only if it provably can't win: if, with the most that all later terms could add, it
would stay below what the tenth document (top, in general) of its own block has already. So the result is exact.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import fresh_path, in_arrow, pieces, table

TOP = 10
#: A block is closed when it has so many documents or postings; a bundle has so many items. So a task holds at most
#: BLOCK_DOCS x BUNDLE scores of one group at once.
BLOCK_DOCS, BLOCK_POSTINGS, BUNDLE = 2048, 2_000_000, 256
#: Items of so many different terms together are ranked in one pass over the documents; more take further passes.
MAX_TERMS = 500_000
#: Owners in order take the rarest terms up to these shares of all postings.
SHARES = (0.05, 0.25, 1.0)
#: An occurrence count and a length give less than this, whatever they are.
MOST = 1_000_000

# Which bytes belong to terms (ASCII letters and digits, all beyond ASCII), and their lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_HEAD = -1


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, repeats included, in UTF-8."""
    return text.encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def asked_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, terms, counts): each item's different terms and how often it has each."""
    kind = items.schema[item_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            own = [Counter(terms(t or "")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in own], pa.list_(pa.binary())), pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))], names=["item", "terms", "counts"])

    return in_arrow(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")), of, f"item {kind}, terms array<binary>, counts array<long>").where("size(terms) > 0")


_LISTS = "block long, term int, docs array<int>, tfs array<int>, ids array<long>, n_docs long, n_terms long"


def posting_lists(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Rows of _LISTS. Per block of documents: one row per term of the vocabulary that it holds, with document places and
    occurrences; and a head row (term _HEAD) with the ids and lengths (in tfs) of its documents, and the number of all documents
    with terms and of their terms since the head before. Documents without an asked term are counted there alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        n_docs = n_terms = n_found = 0

        def close() -> pa.RecordBatch:
            block = part << 32 | seq
            own = np.array([k for k, x in enumerate(found) for _ in range(len(x) // 2)], np.int32)
            flat = np.concatenate(found).reshape(-1, 2) if found else np.zeros((0, 2), np.int64)
            order = np.argsort(flat[:, 0], kind="stable")
            term, starts = np.unique(flat[order, 0], return_index=True)
            offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
            k = len(term)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (own, flat[:, 1])]
            head = [pa.array([[]], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32()))]
            nothing = pa.array([None] * k, pa.list_(pa.int64()))
            zeros = pa.array(np.zeros(k, np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(k + 1, block)), pa.array(np.append(term, _HEAD).astype(np.int32)), pa.concat_arrays([lists[0], head[0]]), pa.concat_arrays([lists[1], head[1]]),
                    pa.concat_arrays([nothing, pa.array([ids], pa.list_(pa.int64()))]), pa.concat_arrays([zeros, pa.array([n_docs], pa.int64())]), pa.concat_arrays([zeros, pa.array([n_terms], pa.int64())]),
                ],
                names=["block", "term", "docs", "tfs", "ids", "n_docs", "n_terms"],
            )

        get = vocabulary.get
        for b in pieces(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = terms(t or "")
                n_docs += bool(own)
                n_terms += len(own)
                count = Counter(map(get, own))
                count.pop(None, None)
                if count:
                    ids.append(i)
                    lengths.append(len(own))
                    found.append(np.array(list(count.items()), np.int64).reshape(-1))
                    n_found += len(count)
                if len(ids) >= BLOCK_DOCS or n_found >= BLOCK_POSTINGS:
                    yield close()
                    ids, lengths, found, n_docs, n_terms, n_found, seq = [], [], [], 0, 0, 0, seq + 1
        if n_docs:
            yield close()

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), of, _LISTS)


def _owners(df: dict[int, int]) -> dict[int, int]:
    """The stage that owns each term: rarest first, up to SHARES of all postings."""
    total, seen, out = sum(df.values()), 0, {}
    for t, n in sorted(df.items(), key=lambda x: (x[1], x[0])):
        seen += n
        out[t] = next(k for k, s in enumerate(SHARES) if seen <= s * total or k == len(SHARES) - 1)
    return out


_BUNDLES = "block long, bundle int, item int, ids array<long>, lengths array<int>, docs array<int>, scores array<long>"
_FOUND = "item int, doc_id long, score long"


def _stage(uses: dict, rest: np.ndarray, n_docs: int, n_terms: int, top: int, last: bool):
    """What a term owner does with a bundle's accumulators of one block and its own lists of that block.

    uses: for each bundle, by term, the places of the items that ask it and what one full contribution weighs; rest: by item, the
    most that later stages can add."""

    def of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block, bundle = key[0].as_py(), key[1].as_py()
        item = left.column("item").to_pylist()
        head = item.index(_HEAD)
        ids, lengths = left.column("ids")[head].as_py(), np.array(left.column("lengths")[head].as_py(), np.int64)
        ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64), [i is None for i in ids]
        norm = 8 * (25 + (75 * lengths * n_docs) // n_terms)
        least = min(rest.shape[0] - bundle * BUNDLE, BUNDLE)
        score = np.zeros((least, len(lengths)), np.int64)
        docs, scores = left.column("docs"), left.column("scores")
        for k, i in enumerate(item):
            if k != head:
                score[i, docs[k].values.to_numpy()] = scores[k].values.to_numpy()
        own = uses.get(bundle, {})
        for k, t in enumerate(right.column("term").to_pylist()):
            at, tf = right.column("docs")[k].values.to_numpy(), right.column("tfs")[k].values.to_numpy().astype(np.int64)
            gives = (1_000_000_000 * tf) // (1000 * tf + norm[at])
            for i, w in own.get(t, ()):
                score[i, at] += w * gives
        made = []
        for i in range(least):
            some = np.flatnonzero(score[i])
            if not len(some):
                continue
            own_scores, more = score[i, some], int(rest[bundle * BUNDLE + i])
            if len(some) > top:
                if more:
                    bar = np.partition(own_scores, len(some) - top)[len(some) - top]
                    some = some[own_scores + more >= bar]
                else:
                    some = some[np.lexsort((ids[0][some], -own_scores))[:top]]
            made.append((i, some, score[i, some]))
        offsets = np.cumsum([0, *(len(x) for _, x, _ in made)])
        places = np.concatenate([x for _, x, _ in made]) if made else np.zeros(0, np.int64)
        values = pa.array(np.concatenate([x for _, _, x in made]) if made else np.zeros(0, np.int64))
        if last:
            gone = np.array(ids[1], bool)[places]
            return pa.table({"item": pa.array(np.repeat([bundle * BUNDLE + i for i, _, _ in made], np.diff(offsets)).astype(np.int32)), "doc_id": pa.array(ids[0][places], mask=gone), "score": values})
        n = len(made)
        own_head = left.slice(head, 1)
        rows = pa.table(
            {
                "block": pa.array(np.full(n, block)), "bundle": pa.array(np.full(n, bundle, np.int32)), "item": pa.array([i for i, _, _ in made], pa.int32()),
                "ids": pa.array([None] * n, pa.list_(pa.int64())), "lengths": pa.array([None] * n, pa.list_(pa.int32())),
                "docs": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int32))), "scores": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
            }
        )
        return pa.concat_tables([own_head.cast(rows.schema), rows])

    return of


def _rank_some(docs: DataFrame, asked: list, kind: str, id_col: str, text_col: str, top: int) -> DataFrame:
    """The same as rank() for items that are given as rows of asked_terms()."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for r in asked:
        for t in r.terms:
            vocabulary.setdefault(bytes(t), len(vocabulary))
    path = fresh_path(spark, "postings")
    posting_lists(docs, vocabulary, id_col, text_col).write.parquet(path)
    lists = spark.read.parquet(path)
    # One row for each term that some item asks.
    counted = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).collect()
    n_docs, n_terms = sum(r.d for r in counted), sum(r.t for r in counted)
    df = {r.term: r.df for r in counted if r.term != _HEAD}
    owner, stages = _owners(df), len(SHARES)
    uses: list[dict] = [defaultdict(lambda: defaultdict(list)) for _ in range(stages)]
    adds = np.zeros((stages, len(asked)), np.int64)
    visits = defaultdict(set)
    for i, r in enumerate(asked):
        for t, n in zip(r.terms, r.counts, strict=True):
            k = vocabulary[bytes(t)]
            if k in df and (w := n * weight(n_docs, df[k])):
                uses[owner[k]][i // BUNDLE][k].append((i % BUNDLE, w))
                adds[owner[k], i] += w * MOST
                visits[k].add(i // BUNDLE)
    plain = [{b: dict(x) for b, x in u.items()} for u in uses]
    terms_to = spark.createDataFrame([(k, owner[k], sorted(b)) for k, b in visits.items()], "term int, owner int, bundles array<int>")
    heads = lists.where(F.col("term") == _HEAD).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit((len(asked) - 1) // BUNDLE))).alias("bundle"), F.lit(_HEAD).alias("item"), "ids", F.col("tfs").alias("lengths"), F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores")
    )
    now = heads
    for s in range(stages):
        # The table has a row for each asked term, of which one pass has MAX_TERMS or so.
        own = spark.read.parquet(path).join(F.broadcast(terms_to.where(F.col("owner") == s)), "term").select("block", F.explode("bundles").alias("bundle"), "term", "docs", "tfs")
        last = s == stages - 1
        step = _stage(plain[s], adds[s + 1 :].sum(0), n_docs, n_terms, top, last)
        now = now.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle")).applyInArrow(step, _FOUND if last else _BUNDLES)
    named = spark.createDataFrame([(i, r.item) for i, r in enumerate(asked)], f"item int, item_id {kind}")
    best = now.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0, best first, equal scores by ascending id.

    Null and empty texts, and those without terms, neither count nor are found; items without terms have no rows. Documents
    without id are found with a null one, after others of their score. A repeated row of either table is a document or an item of
    its own. Empty tables give no rows, further columns are ignored. id_col must be integral. A very long text is one document;
    what a block holds of it is bounded by the asked terms."""
    kind = items.schema[item_col].dataType.simpleString()
    made = asked_terms(items, item_col, item_text_col)
    total = made.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, math.ceil(total / MAX_TERMS))
    slice_of = F.pmod(F.xxhash64("item", "terms", "counts"), F.lit(n))
    parts = [_rank_some(docs, asked, kind, id_col, text_col, top) for k in range(n) if (asked := (made if n == 1 else made.where(slice_of == k)).collect())]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item. Null and empty texts are never found and find nothing; repeats count each;
    empty tables give no rows; further columns are ignored."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}'))"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, nn),
r AS (SELECT item_id, p.doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN w ON q.term = w.term JOIN p ON q.term = p.term JOIN d ON p.doc_id = d.doc_id, s GROUP BY 1, 2)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0) WHERE rank <= 10
"""
