"""Ranked search against brute force: many blocks, several bundles and passes, ties, repeats, nulls, clashing columns."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from measureaudit.llm import ranked

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top=10):
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, *x[1:2]))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, *x[1:2]))


def made(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    return [(k, " ".join(r.choice(vocab[: r.choice((10, 60, 400))]) for _ in range(r.randrange(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("block,bundle,most", [(2048, 256, 500_000), (7, 3, 40)])
def test_rank_is_brute_force(spark, monkeypatch, block, bundle, most):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked, "BUNDLE", bundle)
    monkeypatch.setattr(ranked, "MAX_TERMS", most)
    docs = made(1, 150)
    docs += [(200 + k, docs[3][1]) for k in range(25)]  # ties beyond the top
    docs += [(300, None), (301, ""), (302, "...!"), (303, "W1 Straße w1\x00w2 naïve É"), (303, "W1 Straße w1\x00w2 naïve É"), (304, " ".join(["w1"] * 5000 + ["w399"]))]
    items = [(k, t) for k, t in made(2, 12)] + [(20, docs[3][1]), (21, "straße É É W1"), (22, None), (23, "zzz"), (24, "w1 w1 w1"), (24, "w1 w1 w1"), (None, "w5 w6")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("id", "block", "term", "rank")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("item", "terms", "score")})
    got = rows(ranked.rank(a, b))
    assert got == rows_of(brute(docs, items)) and len(got) > 100


def rows_of(found):
    return sorted(found, key=lambda x: (x[0] is None, x[0] or 0, *x[1:2]))


def test_pruning_between_stages_loses_nothing(spark, monkeypatch):
    # Every block has far more than `top` documents of each item, so that accumulators are left behind.
    docs, items = made(5, 400), made(6, 8)
    a, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string")
    for shares in ((0.05, 0.25, 1.0), (0.5, 1.0), (0.01, 0.02, 0.05, 0.1, 0.3, 1.0)):
        monkeypatch.setattr(ranked, "SHARES", shares)
        assert rows(ranked.rank(a, b, top=3)) == brute(docs, items, top=3)


def test_rows_without_id_come_last_and_empty_tables_give_none(spark):
    a = spark.createDataFrame([(None, "a b"), (5, "a b"), (2, "a b"), (7, "c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [r[2] for r in rows(ranked.rank(a, b))] == [2, 5, None]
    assert ranked.rank(a, b.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(ranked.rank(a.limit(0), b)) == rows(ranked.rank(a, b.limit(0))) == []
