"""Fill-in-middle: cuts by rank, round trips, and the cases of nulls, marks, long texts, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from measureaudit.llm import infill


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 50), max_size=300))
def test_every_rank_is_the_sum_of_the_widths_before_it(widths):
    units = infill.SkipList(np.array(widths, np.int64))
    assert [units.place(r) for r in range(len(widths) + 1)] == [0, *np.cumsum(widths, dtype=np.int64).tolist()]
    with pytest.raises(IndexError):
        units.place(len(widths) + 1)


def test_descent_takes_few_steps():
    units = infill.SkipList(np.full(100_000, 3, np.int64))
    assert len(units.lanes) == 9 and [len(x) for x, _ in units.lanes[:3]] == [100_000, 25_000, 6_250]
    assert units.place(77_777) == 3 * 77_777


@settings(deadline=None, max_examples=80)
@given(st.text(alphabet="ab\n\r é🎉", max_size=40), st.integers(0, 10**12))
def test_transform_is_brute_force(text, doc_id):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    want = (len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out)
    assert infill.transform(text, doc_id) == want
    assert infill.transform(text, doc_id, rate=0)[1] == "plain" and (not text or infill.transform(text, doc_id, suffix_first=0)[1] == "psm")


def test_rows_of_every_kind(spark):
    r = random.Random(3)
    long = "".join(r.choice("abc é\n") for _ in range(300_000))
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, ""), (None, "x\ny\n"), (4, "has <M> mark\nb"), (5, "\n\n\n"), (6, long), (7, "one line"), (8, "a\r\nb c\x85d\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "n", "form", "output", "prefix_chars")})
    made = infill.fill_in_middle(df)
    got = made.withColumn("back", infill.restored()).collect()
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x.doc_id, x.back) for x in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    by = {x.doc_id: x for x in got}
    assert [by[k].form for k in (2, 3, 4)] == ["plain"] * 3 and by[4].output == "has <M> mark\nb" and by[8].n == 2 and by[5].n == 3
    assert by[6].n == long.count("\n") + (long[-1] != "\n")
    assert {by[k].form for k in (1, None, 5, 6, 7, 8)} <= {"psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_other_units_and_marks_kept(spark):
    df = spark.createDataFrame([(k, f"a. b. c{k}. d") for k in range(20)], "own long, body string")
    got = infill.fill_in_middle(df, "own", "body", seed=11, rate=60, suffix_first=0, end=". ").withColumn("back", infill.restored()).collect()
    assert all(x.n == 4 and x.back == f"a. b. c{x.own}. d" for x in got) and {x.form for x in got} == {"plain", "psm"}
