"""Contexts, structured queries, registers, gaps, hubs and categories on small tables."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from measureaudit.plans import census, conflicts, corpus, entities, network
from measureaudit.sources import papers


def test_contexts_are_brute_force(spark):
    r = random.Random(7)
    texts = ["".join(r.choice(["5 mM ", "12.5nm", "x", " the ", "\n", "🎉", "é", "word ", "  ", "0"]) for _ in range(r.randrange(0, 300))) for _ in range(40)]
    texts += [None, "", "7 mM", "no number the", "the 5 mM" * 400, ("a🎉" * 300) + " the 5 mM " + ("b🎉" * 300)]
    pattern = "[0-9]+(?:[.][0-9]+)?[ ]?(?:mM|nm)"

    def brute(t):
        seen, out = set(), []
        for m in re.finditer(pattern, t or ""):
            c = re.sub(r"\s+", " ", t[max(0, m.start() - 30) : m.end() + 40]).strip(" ")
            if ("the" in c or "é" in c) and c[:80] not in seen:
                seen.add(c[:80])
                out.append(c)
        return out[:12]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = corpus.contexts(df, pattern, 30, 40, ("the", "é"), 12).collect()
    want = [(k, i, c) for k, t in enumerate(texts) for i, c in enumerate(brute(t))]
    assert sorted(tuple(x) for x in got) == want and len(want) > 200
    long = spark.createDataFrame([(1, "the 5 mM and more words " * 20_000)], "doc_id long, text string")
    assert corpus.contexts(long, pattern, 160, 220, ("the",), 12).count() <= 12


def test_structured_query_by_arguments(spark):
    rows = [(f"r{k}", m, a, s, "hot", ph, t, km, None, 1.0 if k % 2 else None, "d", "human") for k, (m, a, s, ph, t, km) in enumerate([("CeO2", "oxidase", "TMB", 4.0, 25.0, 1.0), ("ceo2 x", "peroxidase", "tmb", None, 25.0, 2.0), ("Au", "oxidase", None, 5.0, None, None), ("CeO2", "oxidase", "TMB", 4.0, 20.0, None)])]
    e = spark.createDataFrame(rows, "rec_id string, material string, act string, sub string, method string, ph double, t double, km_mm double, vmax_um_s double, kcat_s double, doi string, provenance string")
    ids = lambda **k: [(x.rec_id, x.total) for x in network.structured(e, **k).collect()]
    assert ids() == [("r2", 4), ("r3", 4), ("r0", 4), ("r1", 4)] and ids(limit=1) == [("r2", 4)]
    assert ids(material="CEO2", metric="km_mm") == [("r0", 2), ("r1", 2)] and ids(activity="Oxidase", substrate="tmb", ph_min=4.0, ph_max=4.0) == [("r3", 2), ("r0", 2)]
    assert ids(t_max=24.0) == [("r3", 1)] and ids(ph_min=4.5, t_min=1.0) == [] and ids(metric="kcat_s") == [("r3", 2), ("r1", 2)]
    with pytest.raises(ValueError):
        network.structured(e, metric="rec_id")


def test_register_shows_values_as_they_are(spark):
    rows = [("a", "p", "M", "m", "act", "s", 7.0, 25.0, "10.1/a", "10.1/a", "km", 1e-7), ("b", "p", "M", "m", "act", "s", 7.0, 25.0, "10.1/b", "10.1/b", "km", 1234.5), ("c", "p", "M", "m", "act", "s", 7.0, 25.0, "10.1/b", "10.1/b", "km", 1234.5)]
    values = spark.createDataFrame(rows, "rec_id string, provenance string, material string, mat string, act string, sub string, ph double, t double, doi string, paper string, metric string, value double")
    got = conflicts.register(values).first()
    assert (got["items"], got.n_items, got.severity, got.tier) == ("10.1/a=1.0E-7 | 10.1/b=1234.5", 2, "suspicious", 2)


def test_gaps_of_either_side(spark):
    e = spark.createDataFrame([("human", "A", "a", "ox", "s", 4.0, 25.0), ("db:a", "B", "b", "cat", "s", None, 25.0), ("human", "B", "b", "pod", "s", None, 25.0), ("db:a", "A", "a", "ox", "s", 4.0, 25.0)], "provenance string, material string, mat string, act string, sub string, ph double, t double")
    assert sorted(tuple(x) for x in census.gaps(e).collect()) == [("activity", "cat", "db"), ("activity", "pod", "human"), ("system", "b|cat|s|25", "db"), ("system", "b|pod|s|25", "human")]


def test_hub_rows_and_categories(spark):
    rows = [("ox", "s", f"m{k % 15:02d}", f"r{k:03d}", None, None, None, None, None, None) for k in range(60)] + [("pod", "s", "z", "r999", "hot", 4.0, 25.0, 1.0, None, None)]
    e = spark.createDataFrame(rows, "act string, sub string, mat string, rec_id string, method string, ph double, t double, km_mm double, vmax_um_s double, kcat_s double")
    got = entities.representatives(e, 7).where("act = 'ox'").orderBy("shown").collect()
    assert [(x.shown, x.place, x.mat, x.rec_id) for x in got] == [(k + 1, 1 + k // 4, f"m{k // 4:02d}", f"r{k // 4 + 15 * (k % 4):03d}") for k in range(7)]
    assert entities.representatives(e, 100).where("act = 'ox'").orderBy(F.desc("shown")).first().place == 999
    t = spark.createDataFrame([("a", 5, 2), ("b", 9, 2), ("c", 1, 3), ("d", 1, 1)], "key string, n long, n_papers long")
    c = spark.createDataFrame([("a", "oxide"), ("b", "oxide"), ("a", "zzz"), ("q", "metal")], "key string, category string")
    assert sorted(tuple(x) for x in entities.in_categories(t, c).collect()) == [("oxide", 1, "b", 9, 2), ("oxide", 2, "a", 5, 2), ("unknown", 1, "c", 1, 3), ("unknown", 2, "d", 1, 1)]


def test_curated_lists_are_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(" \n" + json.dumps([{"nanozyme": "x"}, {"nanozyme": "y"}]))
    assert papers.read_curated_list(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.json").write_text(json.dumps({"nanozyme": "x"}))
    with pytest.raises(ValueError, match="array"):
        papers.read_curated_list(spark, str(tmp_path / "b.json"))


def test_quantities_lose_their_units_wherever_these_stand(spark):
    from measureaudit.functions import normalize as N

    cells = {"0.1 μm": 0.1, "100 Å": 100.0, "5 µM": 5.0, "5 ΜM": 5.0, "mM 3.5": 3.5, "2 mmol/L (n=3)": 2.0, "1.5e-3 s⁻¹": 0.0015, "ca. 12 units": 12.0, "3 ± 1 mM": 3.0, "none": None, "7.25 M⁻¹ s⁻¹": 7.25, "": None}
    df = spark.createDataFrame(list(enumerate(cells)), "k int, c string")
    assert [r.v for r in df.select("k", N.quantity("c").alias("v")).orderBy("k").collect()] == list(cells.values())
