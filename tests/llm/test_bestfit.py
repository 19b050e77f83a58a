"""Packing: dominance and best fit against exhaustive search and lower bounds; pieces against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from measureaudit.llm import bestfit

from .test_edges import TEXTS, WORD, prose

OWN = Tokenizer.from_file(WORD)


def ids_of(text):
    return np.array([*OWN.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def optimum(items, size):
    """The least number of sequences, by exhaustive search over sets with the longest piece."""

    @cache
    def least(rest):
        if not rest:
            return 0
        best, others = len(rest), rest[1:]

        def grow(k, room, kept, skipped):
            nonlocal best
            if k == len(others):
                best = min(best, 1 + least(tuple(skipped)))
                return
            if others[k] <= room:
                grow(k + 1, room - others[k], [*kept, others[k]], skipped)
            grow(k + 1, room, kept, [*skipped, others[k]])

        grow(0, size - rest[0], [], [])
        return best

    return least(tuple(sorted(items, reverse=True)))


def contents(plan):
    return Counter({x: sum(b.n * k for b in plan for y, k in b.runs if y == x) for x in {y for b in plan for y, _ in b.runs}})


def test_fixed_sets_are_part_of_an_optimum():
    r = random.Random(1)
    fixed = 0
    for _ in range(400):
        size = r.choice((10, 20, 30))
        items = [r.randrange(1, size + 1) if r.random() < 0.6 else r.randrange(size // 4, size // 2 + 1) for _ in range(r.randrange(1, 9))]
        stock = bestfit.Stock(Counter(items))
        own = bestfit.reduce(stock, size)
        rest = [x for x in stock.lengths.tolist() for _ in range(int(stock.counts[x]))]
        assert all(sum(x * k for x, k in b.runs) == size - b.left >= 0 for b in own)
        assert contents(own) + Counter(rest) == Counter(items)
        assert sum(b.n for b in own) + optimum(rest, size) == optimum(items, size)
        fixed += len(own)
    assert fixed > 600


def test_plans_are_whole_and_close_to_the_bound():
    r, over = random.Random(2), 0
    for k in range(120):
        size = r.choice((12, 50, 4096))
        counts = Counter(min(size, max(1, int(r.lognormvariate(3 if size > 50 else 1.5, 1.2)))) for _ in range(r.randrange(1, 400)))
        plan = bestfit.pack(counts, size)
        assert contents(plan) == counts
        assert all(0 <= b.left == size - sum(x * n for x, n in b.runs) and b.n > 0 for b in plan)
        made, least = sum(b.n for b in plan), bestfit.least_sequences(counts, size)
        assert least <= made <= least + 1 + made // 50
        over += made - least
    assert over <= 12
    small = [[r.randrange(1, 21) for _ in range(8)] for _ in range(100)]
    assert sum(sum(b.n for b in bestfit.pack(Counter(x), 20)) - optimum(x, 20) for x in small) <= 2


def test_large_counts_take_no_longer_than_small_ones():
    counts = {x: 10**9 + 7 * x for x in range(1, 4097, 3)}
    plan = bestfit.pack(counts)
    assert contents(plan) == Counter(counts) and len(bestfit.slots(plan)) < 60_000
    assert sum(b.n for b in plan) <= bestfit.least_sequences(counts) * 1.001
    assert bestfit.pack({}) == [] and len(bestfit.slots([])) == 0


def check_rows(rows, texts, size):
    """Rows against the library: pieces, digests, and sequences without gaps."""
    want = Counter()
    for i, t in texts:
        x = ids_of(t)
        for p, at in enumerate(range(0, len(x), size)):
            want[i, p, at, len(x[at : at + size]), zlib.crc32(x[at : at + size].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(n for _, n in own) <= size
    return len(by)


def test_rows_of_every_kind(spark):
    texts = [*TEXTS, (20, "<|endoftext|> and <|startoftext|>x"), (21, "ΑΣ ΟΔΟΣ Σ é ́x"), *[(30 + k, prose(1 + k % 7, k)) for k in range(80)], (200, None), (201, "DON'T 123 stop!!! <|x")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "piece", "part", "rank", "length", "before")}).repartition(3)
    for size in (4096, 64):
        rows = bestfit.packed(df, WORD, size=size).collect()
        made = check_rows(rows, texts, size)
        counts = Counter(r.length for r in rows)
        assert bestfit.least_sequences(counts, size) <= made <= bestfit.least_sequences(counts, size) + 1
    assert bestfit.packed(df.limit(0), WORD).collect() == []


def test_caches_start_anew_and_large_tables_shuffle(spark, monkeypatch):
    texts = [(k, prose(60, k)) for k in range(40)]
    old = bestfit.CACHE, bestfit.MAX_SHIPPED
    monkeypatch.setattr(bestfit, "CACHE", 30)
    enc = bestfit.PieceEncoder(WORD)
    got = [x for k in range(0, 40, 4) for x in enc.encode([t for _, t in texts[k : k + 4]])]
    assert [x + b"\1\0\0\0" for x in got] == [ids_of(t).tobytes() for _, t in texts] and old[0] > 30
    monkeypatch.setattr(bestfit, "MAX_SHIPPED", 0)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_rows(bestfit.packed(df, WORD, size=128).collect(), texts, 128)


def test_query_on_the_tables(spark, sf_dir):
    rows = bestfit.op13_packing(spark, sf_dir).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    made = check_rows(rows, texts, 4096)
    assert made <= bestfit.least_sequences(Counter(r.length for r in rows)) + 1
