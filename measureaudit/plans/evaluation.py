"""Queries that score the system table against the curated rows; with their SQL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import REC, rec
from ..functions import normalize as N
from ..operators import evaluate as E
from ..store import kept


def _by(place: int, *values: str) -> str:
    """One of the SQL values, by a hex digit of rec_id."""
    return f"CASE substr(rec_id, {place}, 1) " + " ".join(f"WHEN '{d}' THEN {values[i % len(values)]}" for i, d in enumerate("0123456789abcdef")) + " END"


def _some(place: int, other: str, *values: str) -> str:
    """One of the SQL values by the first hex digits, else other."""
    return f"CASE substr(rec_id, {place}, 1) " + " ".join(f"WHEN '{i}' THEN {v}" for i, v in enumerate(values)) + f" ELSE {other} END"


def _texts(*values: str) -> tuple[str, ...]:
    return tuple(f"'{v}'" if v else "NULL" for v in values)


#: The fields of a curated row, in SQL for both engines; further fields are made from rec_id.
_GOLD = {
    "act": "activity_raw", **{f: _by(9 + i, "1", "1", "0", "0", "0", "NULL") for i, f in enumerate(E.FLAGS)}, "metal_type": _by(14, *_texts("Fe", "Mn", "Co", "Pd", "26", "Ce(58)", "Xx", "")),
    "metal_ratio": _some(15, "size_nm % 10 * 10.0E0", "NULL"), "metal_valence": _by(16, "NULL", "2.0E0", "3.0E0"), "shape": _by(17, *_texts("spherical", "sphere", "rod", "nanorod", "flake-like", "nanosheet", "Cubic", "nanoparticle", "Polyhedral", "star", "dendrite", "")),
    "size": "size_nm", "medium": _by(18, *_texts("NaAc-HAc buffer", "acetate", "PBS", "phosphate buffer", "Tris-HCl", "tris/hcl buffer", "water", "")), "ph": "ph", "t": "temperature_c", "km": "km_mm", "vmax": "vmax_um_s",
}
#: The system's fields: those of the curated row, some missing, some changed.
_SYSTEM = {
    "act": _some(26, "activity_raw", *_texts("", "catalase", "Peroxidase-like nanozyme")), **{f: _some(19 + i % 2, f, "NULL", f"1 - {f}") for i, f in enumerate(E.FLAGS)},
    "metal_type": _some(20, "metal_type", "NULL", "'Cu'", *["CASE metal_type WHEN 'Fe' THEN '26' WHEN 'Co' THEN 'Co(27)' ELSE metal_type END"] * 4), "metal_ratio": _some(21, "metal_ratio", "NULL", "metal_ratio * 1.05E0", "metal_ratio * 1.5E0"),
    "metal_valence": _some(22, "metal_valence", "NULL", "metal_valence + 1.0E0"), "shape": _some(23, "shape", *_texts("", "nanoparticle", "sphere", "nanosheet")), "size": _some(24, "size", "NULL", "size * 1.2E0", "size * 2.0E0"),
    "medium": _some(25, "medium", *_texts("", "acetate buffer", "Phosphate Buffer", "tris hcl")), "ph": _some(4, "ph", "NULL", "ph + 2.0E0"), "t": "t", "km": _some(2, "km", "NULL", "km * 1000.0E0", "km * 1.05E0"), "vmax": "vmax",
}
_RENAMED = "CASE WHEN substr(rec_id, 3, 1) IN ('0', '1', '2') THEN upper(nanozyme) || ' NPs' ELSE nanozyme END"


def _rows(spark: SparkSession, sf_dir: str, source: str = "human") -> DataFrame:
    own = rec(spark, sf_dir).where(F.col("provenance") == source)
    return own.select("rec_id", "nanozyme", N.doi("doi_raw").alias("doi"), "activity_raw", *[F.expr(x).alias(f) for f, x in _GOLD.items() if f != "act"], F.col("activity_raw").alias("act"))


def gold(spark: SparkSession, sf_dir: str, source: str = "human") -> DataFrame:
    return _rows(spark, sf_dir, source).select("rec_id", "doi", F.col("nanozyme").alias("material"), *_GOLD)


def system(spark: SparkSession, sf_dir: str, source: str = "human") -> DataFrame:
    """What the fixture's system extracts from the papers of a source: most rows, some renamed, some values missing or changed."""
    kept = _rows(spark, sf_dir, source).where("substr(rec_id, 1, 1) not in ('0', '1')")
    return kept.select("rec_id", "doi", F.expr(_RENAMED).alias("material"), *[F.expr(x).alias(f) for f, x in _SYSTEM.items()])


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outcomes(gold(spark, sf_dir), system(spark, sf_dir))


def eval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_records(gold(spark, sf_dir), system(spark, sf_dir))


def eval_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counts(_cells(spark, sf_dir), ["field"])


def eval_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counts(_cells(spark, sf_dir), ["field"], "strict")


def eval_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counts(_cells(spark, sf_dir).withColumn("part", N.lookup("field", {f: name for name, fields in E.GROUPS.items() for f in fields})), ["part"])


def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro scores, the share of groups without a miss, and the Wilson interval of F1 over groups.

    One pass: counts per field come from one aggregate, the groups and exact groups ride along with the first field."""
    cells = _cells(spark, sf_dir)
    per_group = cells.groupBy("doi", "key").agg(F.bool_and(F.col("outcome") == "tp").alias("exact"), F.collect_list(F.struct("field", "outcome")).alias("all"))
    rows = per_group.select("exact", F.posexplode("all").alias("i", "c"))
    n = lambda x: F.count_if(F.col("c.outcome") == x).alias(x)
    fields = rows.groupBy("c.field").agg(F.count_if(F.col("i") == 0).alias("groups"), F.count_if((F.col("i") == 0) & F.col("exact")).alias("exact"), n("tp"), n("fp"), n("fn"))
    sums = [F.sum("groups").alias("n_groups"), F.sum("exact").alias("n_exact"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]]
    total = fields.select("groups", "exact", "tp", "fp", "fn", *E.scores()).agg(*sums, F.round(F.avg("f1"), 5).alias("macro_f1"))
    scored = total.select("*", (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))
    f1, k, z = F.col("f1"), F.col("n_groups"), 1.96
    middle, half = (f1 + z * z / (2 * k)) / (1 + z * z / k), z * F.sqrt(f1 * (1 - f1) / k + z * z / (4 * k * k)) / (1 + z * z / k)
    return scored.select("n_groups", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "macro_f1", F.round(F.col("n_exact") / k, 6).alias("em"), F.round(middle - half, 6).alias("ci_low"), F.round(middle + half, 6).alias("ci_high"))


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = _cells(spark, sf_dir).where("outcome <> 'tp'")
    dev = F.when(F.col("field").isin(*E.NUMBERS), F.abs(F.col("system_value") - F.col("gold_value")) / F.greatest(F.abs("gold_value"), F.lit(1e-9)) * 100)
    kind = F.when(F.col("outcome") == "fn", "field_miss").otherwise("field_mismatch")
    subtype = F.when(F.col("outcome") == "fn", "missing").when(dev < 30, "small_error").when(dev.isNotNull(), "large_error").otherwise("value_mismatch")
    return bad.select("doi", "key", "field", kind.alias("kind"), "gold_value", "system_value", F.round(F.when(F.col("outcome") == "fp", dev), 4).alias("deviation"), subtype.alias("subtype"))


def eval_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = eval_errors(spark, sf_dir).where("field in ('km', 'vmax')")
    return e.groupBy("field").agg(F.count_if(F.col("kind") == "field_miss").alias("missing"), F.count_if(F.col("subtype") == "large_error").alias("large_error"), F.count_if(F.col("subtype") == "small_error").alias("small_error"), F.count("*").alias("total"))


def eval_dver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of papers with one error at most; by errors and by distinct fields in error. A paper's fields are few: one
    aggregate by paper and field comes before that by paper."""
    fields = _cells(spark, sf_dir).groupBy("doi", "field").agg(F.count_if(F.col("outcome") != "tp").alias("n"))
    papers = fields.groupBy("doi").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("k"))
    good = lambda c: F.count_if(F.col(c) <= 1)
    return papers.agg(F.count("*").alias("n_papers"), good("n").alias("n_valid"), good("k").alias("n_valid_fields"), F.round(good("n") / F.count("*"), 6).alias("dver"))


def eval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = (df.select("doi").distinct() for df in (gold(spark, sf_dir).where("doi <> ''"), system(spark, sf_dir)))
    zero = g.join(s, "doi", "left_anti")
    return g.agg(F.count("*").alias("gold_dois"), s.agg(F.count("*")).scalar().alias("system_dois"), zero.agg(F.count("*")).scalar().alias("zero_dois"))


def eval_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper: system rows, and those of them whose material matches no reference row of the paper."""
    g, s = E.normalised(gold(spark, sf_dir), "g").where("doi <> ''"), E.normalised(system(spark, sf_dir), "s")
    names = g.select("doi", "g_key", "g_elements").distinct()
    seen = s.select("doi", "s_id", "s_key", "s_elements").join(names, "doi", "left").groupBy("doi", "s_id").agg(F.bool_or(E.alike()).alias("known"))
    return seen.groupBy("doi").agg(F.count("*").alias("n_system"), F.count_if(~F.col("known")).alias("n_unknown"))


def agreement_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's scores under the agreement rule; groups of papers without system records are left out."""
    return E.counts(_cells(spark, sf_dir).where("s_id is not null"), ["field"], "agreed")


#: The sides that a system is held against, and whose rows they are.
SIDES = {"curated": "human", "database": "db:a"}


def agreement(source: DataFrame, found: DataFrame) -> DataFrame:
    """(field, ..., n_groups, n_matched): scores of each field under the agreement rule against one source's records, by groups of a paper's records of one
    name; groups without a system record count among n_groups alone. A source without a match has no rows."""
    cells = kept(E.outcomes(source, found).select("doi", "key", "field", "agreed", "s_id"), "agreement")
    both = cells.select("doi", "key", F.col("s_id").isNotNull().alias("met")).distinct().agg(F.struct(F.count("*").alias("n_groups"), F.count_if("met").alias("n_matched"))).scalar()
    return E.counts(cells.where("s_id is not null"), ["field"], "agreed").select("*", both.getField("n_groups").alias("n_groups"), both.getField("n_matched").alias("n_matched"))


def agreement_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system against the curated records and against a database's."""
    parts = [agreement(gold(spark, sf_dir, own), system(spark, sf_dir, own)).withColumn("side", F.lit(side)) for side, own in SIDES.items()]
    return reduce(DataFrame.unionByName, parts)


def rule_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all fields under the agreement rule and with values compared as they stand, over the same pairs."""
    both = _cells(spark, sf_dir).where("s_id is not null").select(F.explode(F.array(F.struct(F.lit("normalised").alias("rule"), F.col("agreed").alias("outcome")), F.struct(F.lit("verbatim").alias("rule"), F.col("own").alias("outcome")))).alias("r"))
    return E.counts(both.select("r.rule", "r.outcome"), ["rule"])


def at_places(values: DataFrame, by: str, places: dict[str, str]) -> DataFrame:
    """Values of a sorted list by index, not interpolated: by is a column of distinct values with their count n, places names
    SQL expressions for the index in terms of the list's length `all`. Distinct values are counted by coarse steps first, so
    that no task sees more of them than a step has."""
    steps = values.withColumn("step", F.floor(F.col(by) * 1000))
    total = steps.groupBy("step").agg(F.sum("n").alias("m"))
    # Steps are few (a thousand to the unit); only their counts go through one task.
    before = total.select("step", (F.sum("m").over(W.orderBy("step")) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy()).alias("all"))
    inside = F.sum("n").over(W.partitionBy("step").orderBy(by))
    placed = steps.join(before, "step").withColumn("end", F.col("before") + inside).withColumn("start", F.col("end") - F.col("n"))
    hit = lambda x: F.max(F.when(F.expr(f"start <= ({x}) and ({x}) < end"), F.col(by)))
    return placed.agg(F.max("all").alias("n"), *[hit(x).alias(name) for name, x in places.items()])


_AT = "least(`all` - 1, cast(floor({} * `all`) as bigint))"


def km_fold_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|Δ log10 Km| between each reference row and its group's best record; quantiles by index."""
    g, s = gold(spark, sf_dir), system(spark, sf_dir)
    best = E.best_records(g, s)
    rows = g.select("doi", N.evaluation_name("material").alias("key"), F.col("km").alias("g_km")).join(best, ["doi", "key"]).join(s.select(F.col("rec_id").alias("s_id"), F.col("km").alias("s_km")), "s_id").where("g_km > 0 and s_km > 0")
    d = rows.select(F.round(F.abs(F.log10("g_km") - F.log10("s_km")), 6).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return at_places(d, "d", {"median": _AT.format(0.5), "p75": _AT.format(0.75), "p90": _AT.format(0.9), "max": "`all` - 1"})


def paper_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doi, f1): the mean F1 over the fields that a paper gives, under the agreement rule, to four places."""
    fields = E.counts(_cells(spark, sf_dir).where("s_id is not null"), ["doi", "field"], "agreed")
    return fields.groupBy("doi").agg((F.floor(F.avg("f1") * 10000 + 0.5 + 1e-6) / 10000).alias("f1"))


def paper_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the papers' scores spread: mean, extremes, upper median, quartiles and deciles by index, and papers per band."""
    hist = paper_f1(spark, sf_dir).groupBy("f1").agg(F.count("*").alias("n"))
    places = {"lowest": "0", "median": "`all` div 2", "q1": "`all` div 4", "q3": "3 * `all` div 4", "highest": "`all` - 1"} | {f"d{k}": _AT.format(k / 10) for k in range(1, 10)}
    edges = (("b00", 0, 0.5), ("b05", 0.5, 0.6), ("b06", 0.6, 0.7), ("b07", 0.7, 0.8), ("b08", 0.8, 0.9), ("b09", 0.9, 2))
    bands = hist.agg(F.round(F.sum(F.col("f1") * F.col("n")) / F.sum("n"), 5).alias("mean"), *[F.sum(F.when((F.col("f1") >= lo) & (F.col("f1") < hi), F.col("n")).otherwise(0)).alias(b) for b, lo, hi in edges])
    return at_places(hist, "f1", places).crossJoin(bands)  # two single rows


def bundle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per paper, its kinetic reference rows and the largest one-to-one matching with system rows of equal values."""
    g = gold(spark, sf_dir)
    edges = E.bundle_edges(g, system(spark, sf_dir))

    def of(frames: pd.DataFrame) -> pd.DataFrame:
        a, b = pd.factorize(frames["g_id"], sort=True)[0], pd.factorize(frames["s_id"], sort=True)[0]
        return pd.DataFrame({"doi": [frames["doi"].iloc[0]], "n_matched": [E.matching(list(zip(a.tolist(), b.tolist(), strict=True)))]})

    made = edges.groupBy("doi").applyInPandas(of, "doi string, n_matched long")
    kinetic = g.where("doi <> '' and (km is not null or vmax is not null)").groupBy("doi").agg(F.count("*").alias("n_gold"))
    return kinetic.join(made, "doi", "left").na.fill(0, ["n_matched"]).withColumn("rate", F.round(F.col("n_matched") / F.col("n_gold"), 6))


def _key_sql(c: str) -> str:
    low = f"translate(lower(trim({c})), '‐‑‒–—−', '------')"
    bare = low
    for x in N.SUFFIXES:
        bare = f"regexp_replace({bare}, ' ?{x}$', '')"
    punct = "'[\\s,\\-_/@().]', '', 'g'"
    return f"CASE WHEN length(regexp_replace({bare}, {punct})) < 3 THEN regexp_replace({low}, {punct}) ELSE regexp_replace({bare}, {punct}) END"


def _elements_sql(c: str) -> str:
    bare = f"regexp_replace(regexp_replace({c}, '\\([^)]*\\)', '', 'g'), '(?i) ?({'|'.join(N.SUFFIXES)})$', '')"
    return f"list_sort(list_distinct(regexp_extract_all({bare}, '{'|'.join(N.ELEMENTS)}')))"


_DOI = "lower(regexp_replace(regexp_replace(regexp_replace(trim(doi_raw), '^(?i)https?://(dx\\.)?doi\\.org/', ''), '^(?i)doi:\\s*', ''), '\\.+$', ''))"
# What the fixture's spellings mean, said anew.
_MEANS = {
    "act": "CASE lower({0}) WHEN 'pod' THEN 'peroxidase' WHEN 'peroxidase-like' THEN 'peroxidase' WHEN 'catalase like' THEN 'catalase' WHEN 'sod' THEN 'superoxide dismutase' ELSE lower({0}) END",
    "shape": "CASE lower({0}) WHEN 'spherical' THEN 'sphere' WHEN 'rod' THEN 'nanorod' WHEN 'flake-like' THEN 'nanosheet' WHEN 'cubic' THEN 'nanocube' WHEN 'star' THEN 'nanostar' ELSE lower({0}) END",
    "medium": "CASE lower({0}) WHEN 'naac-hac buffer' THEN 'acetate buffer' WHEN 'acetate' THEN 'acetate buffer' WHEN 'pbs' THEN 'phosphate buffer' WHEN 'tris-hcl' THEN 'tris hcl' WHEN 'tris/hcl buffer' THEN 'tris hcl' ELSE lower({0}) END",
    "metal_type": "lower({0})",
}
_METAL = "CASE {0} WHEN 'Fe' THEN '26' WHEN 'Mn' THEN '25' WHEN 'Co' THEN '27' WHEN 'Co(27)' THEN '27' WHEN 'Pd' THEN '46' WHEN 'Ce(58)' THEN '58' WHEN 'Cu' THEN '29' ELSE {0} END"


def _side_sql(p: str, material: str, source: str) -> str:
    fields = [f"{_MEANS.get(f, '{0}').format(f)} AS {p}_{f}" for f in E.FIELDS if f != "material"]
    return f"SELECT doi, rec_id AS {p}_id, {_key_sql(material)} AS {p}_key, {_elements_sql(material)} AS {p}_elements, {_key_sql(material)} AS {p}_material, {', '.join(fields)}, {_METAL.format('metal_type')} AS {p}_metal, lower(shape) AS {p}_form FROM {source}"


def _same(f: str, rule: str = "standard") -> str:
    if rule == "agreed" and f == "metal_type":
        return "coalesce(g_metal = s_metal, false)"
    if rule == "agreed" and f == "shape":
        generic = "('nanoparticle', 'polyhedral', 'particle')"
        return f"coalesce(g_form IN {generic} OR s_form IN {generic} OR contains(g_form, s_form) OR contains(s_form, g_form), false) AND g_form IS NOT NULL AND s_form IS NOT NULL"
    if f in E.NUMBERS:
        return f"coalesce(abs(g_{f} - s_{f}) / greatest(abs(g_{f}), 1e-9) < {0.3 if rule == 'agreed' and f == 'size' else 0.1}, false)"
    if f in E.FLAGS:
        return f"coalesce(g_{f} = s_{f}, false)" + (f" OR (s_id IS NOT NULL AND s_{f} IS NULL AND coalesce(g_{f} = 0, false))" if rule == "single" else "")
    return f"coalesce(contains(g_{f}, s_{f}) OR contains(s_{f}, g_{f}), false)"


_ALIKE = "coalesce((g_key <> '' AND s_key <> '' AND (contains(g_key, s_key) OR contains(s_key, g_key))) OR (len(g_elements) >= 2 AND g_elements = s_elements), false)"
_SIDES = f""", n AS (SELECT rec_id, nanozyme, activity_raw, {_DOI} AS doi, {", ".join(f"{x} AS {f}" for f, x in _GOLD.items())} FROM rec WHERE provenance = 'human'),
g AS ({_side_sql("g", "nanozyme", "n")} WHERE doi <> ''),
sys0 AS (SELECT rec_id, doi, {_RENAMED} AS renamed, {", ".join(f"{x} AS {f}" for f, x in _SYSTEM.items())} FROM n WHERE substr(rec_id, 1, 1) NOT IN ('0', '1')),
s AS ({_side_sql("s", "renamed", "sys0")})"""
_SCORE = " + ".join(f"CAST({_same(f, 'single')} AS INTEGER)" for f in E.FIELDS)
_BEST = f""", head AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doi, g_key ORDER BY g_id) = 1),
pairs AS (SELECT head.*, s.* EXCLUDE (doi), CASE WHEN s_id IS NULL THEN NULL WHEN g_key = s_key THEN 1 WHEN g_key <> '' AND s_key <> '' AND (contains(g_key, s_key) OR contains(s_key, g_key)) THEN 2 ELSE 3 END AS tier FROM head LEFT JOIN s ON head.doi = s.doi),
ranked AS (SELECT *, {_SCORE} AS score FROM pairs),
first AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY doi, g_key ORDER BY tier, score DESC, s_id) = 1),
best AS (SELECT doi, g_key AS key, g_id, s_id, tier, score FROM first)"""


def _outcomes() -> str:
    aggs, cells = [], []
    for f in E.FIELDS:
        value = lambda c, f=f: f"CAST({c} AS DOUBLE)" if f in E.GIVEN else "CAST(NULL AS DOUBLE)"
        aggs.append(f"bool_or(alike AND {_same(f)}) AS any_{f}, bool_or(own AND {_same(f)}) AS own_{f}, bool_or(own AND ({_same(f, 'agreed')})) AS agreed_{f}, bool_or(own AND head AND ({_same(f, 'single')})) AS strict_{f}, count(g_{f}) AS n_{f}, coalesce(bool_or(own AND s_{f} IS NOT NULL), false) AS has_{f}, arg_min({value(f'g_{f}')}, g_id) FILTER (g_{f} IS NOT NULL) AS gold_{f}, max({value(f's_{f}')}) FILTER (own) AS sys_{f}")
        judged = lambda c, f=f: f"CASE WHEN coalesce({c}, false) THEN 'tp' WHEN has_{f} THEN 'fp' ELSE 'fn' END"
        cells.append(f"SELECT doi, key, '{f}' AS field, {judged(f'CASE WHEN any_alike THEN any_{f} ELSE own_{f} END')} AS outcome, {judged(f'strict_{f}')} AS strict, {judged(f'own_{f}')} AS own, {judged(f'agreed_{f}')} AS agreed, best_id AS s_id, gold_{f} AS gold_value, sys_{f} AS system_value FROM wide WHERE n_{f} > 0")
    return f""", met AS (SELECT g.*, s.* EXCLUDE (doi), best.s_id AS best_id, g.g_id = best.g_id AS head, coalesce(s.s_id = best.s_id, false) AS own,
  coalesce((g.g_key <> '' AND s_key <> '' AND (contains(g.g_key, s_key) OR contains(s_key, g.g_key))) OR (len(head.g_elements) >= 2 AND head.g_elements = s_elements), false) AS alike
  FROM g JOIN best ON g.doi = best.doi AND g.g_key = best.key JOIN head ON head.doi = g.doi AND head.g_key = g.g_key LEFT JOIN s ON g.doi = s.doi),
wide AS (SELECT doi, g_key AS key, max(best_id) AS best_id, bool_or(alike) AS any_alike, {", ".join(aggs)} FROM met GROUP BY 1, 2),
o AS ({" UNION ALL ".join(cells)})"""


def _sql(body: str, cells: bool = True) -> str:
    return f"WITH {REC}{_SIDES}{_BEST}{_outcomes() if cells else ''}\n{body}"


def _counts(by: str, source: str = "o", outcome: str = "outcome", where: str = "true", n: int = 1) -> str:
    tp, fp, fn = (f"count(*) FILTER ({outcome} = '{x}')" for x in ("tp", "fp", "fn"))
    return f"""SELECT {by}, {tp} AS tp, {fp} AS fp, {fn} AS fn, round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall,
      round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1, round(coalesce({tp} / nullif(count(*), 0), 0), 6) AS accuracy FROM {source} WHERE {where} GROUP BY {", ".join(map(str, range(1, n + 1)))}"""


_NUMBER = ", ".join(f"'{f}'" for f in E.NUMBERS)
_ERR = f""", er AS (SELECT doi, key, field, CASE outcome WHEN 'fn' THEN 'field_miss' ELSE 'field_mismatch' END AS kind, gold_value, system_value, outcome,
  CASE WHEN outcome = 'fp' AND field IN ({_NUMBER}) THEN abs(system_value - gold_value) / greatest(abs(gold_value), 1e-9) * 100 END AS dev FROM o WHERE outcome <> 'tp')"""
_ERRS = "CASE WHEN outcome = 'fn' THEN 'missing' WHEN dev < 30 THEN 'small_error' WHEN dev IS NOT NULL THEN 'large_error' ELSE 'value_mismatch' END"
_PARTS = " ".join(f"WHEN '{f}' THEN '{p}'" for p, fields in E.GROUPS.items() for f in fields)
_PLACE = "l[1 + least(n - 1, CAST(floor({} * n) AS BIGINT))]"

QUERIES = {f.__name__: f for f in (eval_match, eval_fields, eval_strict, eval_groups, eval_overall, eval_errors, eval_failure_modes, eval_dver, eval_coverage, eval_diagnostics, agreement_side, agreement_sides, rule_sensitivity, km_fold_quantiles, paper_dispersion, bundle_match)}
ORACLES = {
    "eval_match": _sql("SELECT * FROM best", cells=False),
    "eval_fields": _sql(_counts("field")),
    "eval_strict": _sql(_counts("field", outcome="strict")),
    "eval_groups": _sql(_counts(f"CASE field {_PARTS} END AS part")),
    "eval_overall": _sql(f""", t AS (SELECT count(DISTINCT (doi, key)) AS n, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o),
      u AS (SELECT *, 2 * tp / (2 * tp + fp + fn) AS f FROM t)
      SELECT n AS n_groups, tp, fp, fn, round(f, 6) AS f1, (SELECT round(avg(f1), 5) FROM ({_counts("field")})) AS macro_f1, round((SELECT count(*) FROM (SELECT bool_and(outcome = 'tp') AS e FROM o GROUP BY doi, key) WHERE e) / n, 6) AS em,
      round((f + 3.8416 / (2 * n) - 1.96 * sqrt(f * (1 - f) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS ci_low, round((f + 3.8416 / (2 * n) + 1.96 * sqrt(f * (1 - f) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS ci_high FROM u"""),
    "eval_errors": _sql(_ERR + f" SELECT doi, key, field, kind, gold_value, system_value, round(dev, 4) AS deviation, {_ERRS} AS subtype FROM er"),
    "eval_failure_modes": _sql(_ERR + f" SELECT field, count(*) FILTER (kind = 'field_miss') AS missing, count(*) FILTER ({_ERRS} = 'large_error') AS large_error, count(*) FILTER ({_ERRS} = 'small_error') AS small_error, count(*) AS total FROM er WHERE field IN ('km', 'vmax') GROUP BY 1"),
    "eval_dver": _sql(", bad AS (SELECT doi, count(*) AS n, count(DISTINCT field) AS k FROM o WHERE outcome <> 'tp' GROUP BY 1), p AS (SELECT d.doi, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM (SELECT DISTINCT doi FROM g) AS d LEFT JOIN bad ON d.doi = bad.doi) SELECT count(*) AS n_papers, count(*) FILTER (n <= 1) AS n_valid, count(*) FILTER (k <= 1) AS n_valid_fields, round(count(*) FILTER (n <= 1) / count(*), 6) AS dver FROM p"),
    "eval_coverage": _sql("SELECT (SELECT count(DISTINCT doi) FROM g) AS gold_dois, (SELECT count(DISTINCT doi) FROM s) AS system_dois, (SELECT count(DISTINCT doi) FROM g WHERE doi NOT IN (SELECT doi FROM s)) AS zero_dois", cells=False),
    "eval_diagnostics": _sql(f"SELECT doi, count(*) AS n_system, count(*) FILTER (NOT EXISTS (SELECT 1 FROM g WHERE g.doi = s.doi AND {_ALIKE})) AS n_unknown FROM s GROUP BY 1", cells=False),
    "agreement_side": _sql(_counts("field", outcome="agreed", where="s_id IS NOT NULL")),
    "agreement_sides": " UNION ALL ".join(
        "SELECT *, '" + side + "' AS side FROM (" + _sql(f", q AS ({_counts('field', outcome='agreed', where='s_id IS NOT NULL')}) SELECT q.*, (SELECT count(DISTINCT (doi, key)) FROM o) AS n_groups, (SELECT count(DISTINCT (doi, key)) FROM o WHERE s_id IS NOT NULL) AS n_matched FROM q").replace("provenance = 'human'", f"provenance = '{own}'") + ")"
        for side, own in SIDES.items()
    ),
    "rule_sensitivity": _sql(_counts("rule", "(SELECT 'normalised' AS rule, agreed AS v, s_id FROM o UNION ALL SELECT 'verbatim', own, s_id FROM o)", "v", "s_id IS NOT NULL")),
    "km_fold_quantiles": _sql(f""", d AS (SELECT round(abs(log10(g_km) - log10(s_km)), 6) AS d FROM g JOIN best ON g.doi = best.doi AND g.g_key = best.key JOIN s ON s.s_id = best.s_id WHERE g_km > 0 AND s_km > 0), l AS (SELECT list(d ORDER BY d) AS l, count(*) AS n FROM d)
      SELECT n, {_PLACE.format(0.5)} AS median, {_PLACE.format(0.75)} AS p75, {_PLACE.format(0.9)} AS p90, l[-1] AS max FROM l""", cells=False),
    "paper_dispersion": _sql(f""", f AS ({_counts("doi, field", outcome="agreed", where="s_id IS NOT NULL", n=2)}), p AS (SELECT doi, floor(avg(f1) * 10000 + 0.5 + 1e-6) / 10000 AS a FROM f GROUP BY 1),
      l AS (SELECT list(a ORDER BY a) AS l, count(*) AS n, round(avg(a), 5) AS mean, {", ".join(f"count(*) FILTER (a >= {lo} AND a < {hi}) AS {b}" for b, lo, hi in (("b00", 0, 0.5), ("b05", 0.5, 0.6), ("b06", 0.6, 0.7), ("b07", 0.7, 0.8), ("b08", 0.8, 0.9), ("b09", 0.9, 2)))} FROM p)
      SELECT n, mean, b00, b05, b06, b07, b08, b09, l[1] AS lowest, l[1 + n // 2] AS median, l[1 + n // 4] AS q1, l[1 + 3 * n // 4] AS q3, l[-1] AS highest, {", ".join(f"{_PLACE.format(k / 10)} AS d{k}" for k in range(1, 10))} FROM l"""),
}
