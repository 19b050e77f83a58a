"""Sources, sinks, the live audit, scores and matchings, each against rows made by hand or a second way to the result."""

import json
import random

import pytest
from pyspark.sql import functions as F

from measureaudit.fixtures import entries
from measureaudit.operators import conflicts as C
from measureaudit.operators import evaluate as E
from measureaudit.plans import evaluation, models, network
from measureaudit.sources import papers as P
from measureaudit.streaming import live


def test_papers_are_read_last_per_doi_and_written_in_buckets(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x))
    put("a.json", {"doi": "10.1/a", "records": [{"nanozyme": "Fe3O4", "Km_mM": "0.5 mM"}, {"nanozyme": "CuS", "Km_mM": 1.5}]})
    put("b.json", {"doi": "10.1/a", "records": [{"nanozyme": "later"}]})
    put("_eval_30.json", {"doi": "10.1/x", "records": [{"nanozyme": "skipped"}]})
    put("~$lock.json", {"doi": "10.1/y", "records": [{"nanozyme": "skipped"}]})
    put("bad.json", "{no json")
    got = P.read_papers(spark, str(tmp_path / "*.json"))
    assert sorted((r.paper_doi, r.nanozyme, r.Km_mM) for r in got.collect()) == [("10.1/a", "CuS", "1.5"), ("10.1/a", "Fe3O4", "0.5 mM"), ("10.1/a", "later", None)]
    assert [r.nanozyme for r in P.last_per_doi(got).collect()] == ["later"]
    e = spark.createDataFrame([(f"10.1/p {k}", k) for k in range(50)], "paper string, v int")
    P.write_papers(e, str(tmp_path / "out"), buckets=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("bucket").distinct().count() <= 4 and back.where("file = '10.1_p_7'").count() == 1


def test_records_are_coerced_with_warnings(spark):
    rows = [{"nanozyme": "Mn2O3", "metal_type": "Co(27)", "metal_ratio": "Mn:Co=1:2", "metal_valence": "+2,+3", "doped_N": "yes", "doped_P": "", "size_nm": "10-20 nm", "temperature_c": "room temperature", "Km_mM": "1.2 ± 0.1", "buffer_ph_value": "n/a"}, {"nanozyme": " ", "Km_mM": "x"}]
    raw = spark.createDataFrame([tuple(r.get(k) for k in P.FIELDS) for r in rows], P.RAW)
    got = {r.nanozyme: r for r in P.coerce(raw).collect()}
    a = got["Mn2O3"]
    assert (a.metal_type, a.metal_ratio, a.metal_valence, a.doped_N, a.doped_P, a.size_nm, a.temperature_c, a.Km_mM, a.buffer_ph_value) == (27, 33.33, 3, 1, None, 15.0, 25.0, 1.2, None)
    assert a.warnings == ["buffer_ph_value"] and not a.rejected
    assert got[None].rejected and set(got[None].warnings) == {"nanozyme", "Km_mM"}
    assert [f.name for f in P.coerce(raw).drop("warnings", "rejected").schema] == list(P.FIELDS)


def test_sources_csv_lists_and_gold_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("name,activity,Vmax, mM/s\nFe–X, ,1\n,caf\xe9,2\n".replace(", mM", " mM").encode("latin-1", "replace"))
    got = P.read_source_csv(spark, str(tmp_path / "s.csv"), "ISO-8859-1")
    assert got.columns == ["name", "activity", "Vmax mM/s"] and [r.activity for r in got.collect()] == [None, "café"]
    (tmp_path / "l.json").write_text(json.dumps([{"nanozyme": "a", "km": 1}, {"nanozyme": "b"}]))
    assert sorted(r.nanozyme for r in P.read_curated_list(spark, str(tmp_path / "l.json")).collect()) == ["a", "b"]
    gold = spark.createDataFrame([("Fe", "https://doi.org/10.1/A.", "x", "7"), ("Cu", None, "y", "8")], "`Nanozyme` string, `data reference doi` string, shape string, `Buffer pH value` string")
    out = P.read_gold(gold, {"data reference doi": "doi", "Buffer pH value": "buffer_ph_value"}, ["nanozyme", "doi", "shape", "buffer_ph_value", "size_nm"])
    assert [tuple(r) for r in out.collect()] == [("Fe", "10.1/a", "x", "7", None)]
    two = spark.createDataFrame([("H2O2 + TMB",), ("ABTS",)], "s string").select(*P.pair_substrates("s"))
    assert [tuple(r) for r in two.collect()] == [("H2O2", "TMB"), ("ABTS", None)]
    mapped = P.map_source(spark.createDataFrame([("Fe", "H2O2 + TMB", "1.5", "2", None)], "formula string, act string, `Km, mM` string, `Vmax, mM/s` string, activity string"), P.Source("db:x", {"nanozyme": ("name", "formula"), "Km_mM": ("Km, mM",), "Vmax_uM_s_minus1": ("Vmax, mM/s",), "mimic_enzyme_activity": ("activity",), "substrate1": ("act",)}, vmax_unit="mM/s", activity="peroxidase", paired=True))
    r = mapped.first()
    assert (r.nanozyme, r.substrate1, r.substrate2, r.Km_mM, r.Vmax_uM_s_minus1, r.mimic_enzyme_activity, r.provenance) == ("Fe", "H2O2", "TMB", 1.5, 2000.0, "peroxidase", "db:x")


def test_register_lineage_and_graph_are_written(spark, tmp_path):
    reg = spark.createDataFrame([("km", "a", "x", "y", 1, 2.0), ("km", "b", "x", "y", 3, 5.0), ("km", "c", "x", "y", 3, 9.0)], "metric string, mat string, act string, sub string, tier int, fold double")
    P.write_register(reg.coalesce(1), str(tmp_path / "reg"))
    files = sorted((tmp_path / "reg").glob("part-*.csv"))
    assert [line.split(",")[1] for f in files for line in f.read_text().splitlines() if not line.startswith("metric")] == ["c", "b", "a"]
    P.write_lineage(reg, reg, reg, str(tmp_path / "lin"))
    assert spark.read.json(str(tmp_path / "lin/matrix")).count() == 3
    P.write_graph(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.9)], "a string, b string, weight double"), str(tmp_path / "g"))
    assert {r.node: r.degree for r in spark.read.parquet(str(tmp_path / "g/nodes")).collect()} == {"a": 2, "b": 1, "c": 1}


def test_live_audit_equals_one_run_over_all_rows(spark, sf_dir, tmp_path):
    values = C.long_form(entries(spark, sf_dir)).where("metric <> 'vmax'").cache()
    for k in range(3):
        values.where(F.pmod(F.xxhash64("rec_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(values.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = live.refresh(spark, arrivals, str(tmp_path / "store"), str(tmp_path / "cp"))
    pick = lambda df: sorted(map(str, df.select(*C.KEYS, "ph", "t", "n_values", "n_papers", "min_value", "max_value", F.round("spread", 9).alias("s"), "severity").collect()))
    assert pick(got) == pick(C.conflict_clusters(values)) and got.count() > 100


def test_scores_follow_their_formulas(spark):
    rnd = random.Random(2)
    rows = [(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(200)]
    got = models.regression_scores(spark.createDataFrame(rows, "y double, prediction double")).first()
    mean = sum(y for y, _ in rows) / len(rows)
    se = sum((y - p) ** 2 for y, p in rows)
    assert got.r2 == pytest.approx(1 - se / sum((y - mean) ** 2 for y, _ in rows), abs=1e-4) and got.rmse == pytest.approx((se / len(rows)) ** 0.5, abs=1e-4)
    said = [(rnd.choice("aab"), rnd.choice("abc")) for _ in range(300)]
    got = models.class_scores(spark.createDataFrame(said, "label string, prediction string")).first()
    f1 = []
    for c in "ab":
        tp = sum(x == y == c for x, y in said)
        f1.append(2 * tp / (sum(x == c for x, _ in said) + sum(y == c for _, y in said)))
    assert (got.accuracy, got.macro_f1, got.majority) == pytest.approx((sum(x == y for x, y in said) / 300, sum(f1) / 5, max(sum(x == c for x, _ in said) for c in "ab") / 300), abs=1e-4)


def test_gradients_need_three_values_of_one_condition(spark):
    row = lambda t, ph, km, doi="d": (doi, "m", "a", "s", ph, t, km)
    e = spark.createDataFrame([row(20.0, 7.0, 1.0), row(30.0, 7.0, 2.0), row(40.0, 7.0, 4.0), row(20.0, 5.0, 3.0), row(30.0, 5.0, 3.0), row(30.0, 6.0, 6.0), row(50.0, 7.0, 9.0, "")], "doi string, mat string, act string, sub string, ph double, t double, km_mm double")
    assert sorted((r.varying, r.fixed, r.n_points, r.fold) for r in network.gradients(e).collect()) == [("ph", 30.0, 3, 3.0), ("t", 7.0, 3, 4.0)]


def test_bundles_match_as_by_hand(spark, sf_dir):
    g, s = evaluation.gold(spark, sf_dir).where("doi like '%1'"), evaluation.system(spark, sf_dir).where("doi like '%1'")
    by_doi = {}
    for r in E.bundle_edges(g, s).collect():
        by_doi.setdefault(r.doi, []).append((r.g_id, r.s_id))

    def largest(edges):
        left = {a: [y for x, y in edges if x == a] for a, _ in edges}
        owner = {}

        def place(a, seen):
            for b in left[a]:
                if b not in seen:
                    seen.add(b)
                    if b not in owner or place(owner[b], seen):
                        owner[b] = a
                        return True
            return False

        return sum(place(a, set()) for a in left)

    got = {r.doi: r for r in evaluation.bundle_match(spark, sf_dir).collect() if r.doi.endswith("1")}
    assert {d: r.n_matched for d, r in got.items()} == {d: largest(by_doi.get(d, [])) for d in got} and sum(r.n_matched for r in got.values()) > 20
    # A row that is its own counterpart, unchanged, is an edge.
    assert all(r.n_matched <= r.n_gold for r in got.values())
