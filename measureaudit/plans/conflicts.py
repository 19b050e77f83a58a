"""Queries on same-condition conflicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import entries, sql
from ..functions import normalize as N
from ..operators import conflicts as C
from ..operators.cluster import condition_clusters
from ..store import kept

# On the fixture grid (0.5 in pH, 4 in T) the greedy clusters are the exact condition points.
LONG = """, v AS (
  SELECT rec_id, provenance, material, mat, act, sub, ph, t, doi, paper, 'km' AS metric, km_mm AS value FROM ent WHERE km_mm IS NOT NULL
  UNION ALL SELECT rec_id, provenance, material, mat, act, sub, ph, t, doi, paper, 'vmax', vmax_um_s FROM ent WHERE vmax_um_s IS NOT NULL
  UNION ALL SELECT rec_id, provenance, material, mat, act, sub, ph, t, doi, paper, 'kcat', kcat_s FROM ent WHERE kcat_s IS NOT NULL
)"""
CLUSTERS = (
    LONG
    + """, g AS (
  SELECT metric, mat, act, sub, ph, t, count(*) FILTER (value > 0) AS n_values, count(DISTINCT paper) AS n_papers, min(value) FILTER (value > 0) AS min_value,
         max(value) FILTER (value > 0) AS max_value, median(value) FILTER (value > 0) AS median_value, arg_min(material, rec_id) AS material, max(CASE WHEN doi = '' THEN 1 ELSE 0 END) AS has_no_doi
  FROM v WHERE ph IS NOT NULL AND t IS NOT NULL GROUP BY ALL HAVING count(DISTINCT paper) >= 2 AND count(*) FILTER (value > 0) >= 2
), c AS (
  SELECT *, max_value / min_value AS fold, (max_value - min_value) / median_value AS spread,
         CASE WHEN (max_value - min_value) / median_value > 1 THEN 'severe' WHEN (max_value - min_value) / median_value >= 0.3 THEN 'suspicious' ELSE 'consistent' END AS severity FROM g
)"""
)
LONG_SQL = sql("SELECT 1").rsplit("\nSELECT 1", 1)[0]


def _sql(body: str, ctes: str = CLUSTERS) -> str:
    return f"{LONG_SQL}{ctes}\n{body}"


def _values(spark: SparkSession, sf_dir: str, metrics: dict[str, str] = C.METRICS) -> DataFrame:
    """The long form of entries that are written once: clustering reads them for the points and again for the rows."""
    own = entries(spark, sf_dir).select("rec_id", "provenance", "material", "mat", "act", "sub", "ph", "t", "doi", *metrics.values()).where(F.coalesce(*metrics.values()).isNotNull())
    return C.long_form(kept(own, "values").withColumn("paper", F.when(F.col("doi") == "", F.concat(F.lit("na-"), "rec_id")).otherwise(F.col("doi"))), metrics)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflict_clusters(_values(spark, sf_dir))


def conflict_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select(*C.KEYS, "ph", "t", "material", "n_values", "n_papers", "min_value", "max_value", "median_value", "fold", F.round("spread", 9).alias("spread"), "severity")


def clusters_of_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condition_clusters(C.long_form(entries(spark, sf_dir)), C.KEYS)


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _clusters(spark, sf_dir).withColumn("tier", C.tier(F.col("severity")))
    return found.rollup("metric", "severity", "tier").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).where("g in (0, 1, 3, 7)").where("g <> 1").select(F.coalesce("metric", F.lit("all")).alias("metric"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


def audit_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cluster with its tier, reason tags, and its values as DOI=value, by DOI and value."""
    return register(_values(spark, sf_dir))


def register(values: DataFrame) -> DataFrame:
    """audit_register over long-form values, in the one pass that finds the clusters; a value is shown as the number it is."""
    # Equal items of a paper are one.
    items = F.sort_array(F.collect_set(F.when(F.col("value") > 0, F.struct("paper", "value")))).alias("items")
    found = C.conflict_clusters(values, items).withColumn("tier", C.tier(F.col("severity")))
    shown = lambda x: F.concat(x["paper"], F.lit("="), x["value"].cast("string"))
    tags = F.array_compact(F.array(F.when(N.magnitude_hint(F.col("fold")).isNotNull(), F.lit("magnitude")), F.when(F.col("n_papers") >= 2, F.lit("cross-paper")).otherwise(F.lit("same-paper"))))
    return found.select(
        *C.KEYS, "ph", "t", "severity", "tier", (F.col("tier") >= 2).alias("review"), "n_papers", "fold", F.coalesce(N.magnitude_hint(F.col("fold")), F.lit("")).alias("hint"), F.array_join(F.array_sort(tags), "/").alias("tags"), F.size("items").cast("long").alias("n_items"),
        F.array_join(F.transform("items", shown), " | ").alias("items"),
    )


def magnitude_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _clusters(spark, sf_dir).withColumn("hint", N.magnitude_hint(F.col("fold"))).where("hint is not null")
    return found.select(*C.KEYS, "ph", "t", "fold", "hint")


def severe_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).where("severity = 'severe'").orderBy(F.desc("fold"), *C.KEYS, "ph", "t").limit(20).select(*C.KEYS, "ph", "t", "fold", "n_papers")


def _robust(found: DataFrame) -> DataFrame:
    tag = N.magnitude_hint(F.col("fold")).isNotNull().cast("long")
    marked = found.withColumn("tag", tag).withColumn("m", F.explode(F.array("metric", F.lit("all"))))
    count = lambda c, name: F.sum(F.when(F.expr(c), 1).otherwise(0)).alias(name)
    return marked.groupBy(F.col("m").alias("metric")).agg(
        F.count("*").alias("n_clusters"), count("severity = 'consistent'", "n_consistent"), count("severity = 'suspicious'", "n_suspicious"), count("severity = 'severe'", "n_severe"),
        F.round(F.avg((F.col("severity") == "severe").cast("double")), 6).alias("severe_share"), F.max("fold").alias("max_fold"), F.sum("tag").alias("n_tagged"), count("fold >= 1e4", "n_1e4"), count("fold >= 1e6", "n_1e6"),
    )


def robustness_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(_clusters(spark, sf_dir))


def robustness_no_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _robust(_clusters(spark, sf_dir).where("has_no_doi = 0"))


def _atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atlas clusters: a missing or zero temperature counts as 25 for clustering, and two points suffice."""
    values = _values(spark, sf_dir).where("value > 0 and ph is not null").withColumn("t", F.coalesce(F.nullif("t", F.lit(0.0)), F.lit(25.0)))
    found = C.clustered(values).groupBy(*C.KEYS, "c_ph", "c_t").agg(F.count("*").alias("n_points"), F.count_distinct("paper").alias("n_papers"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.struct("ph", "doi")).alias("first"))
    return found.where("n_points >= 2").withColumn("fold", F.col("hi") / F.col("lo"))


def atlas_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the atlas, in long form: a cluster of any size is rows, not one array."""
    values = _values(spark, sf_dir).where("value > 0 and ph is not null").withColumn("t", F.coalesce(F.nullif("t", F.lit(0.0)), F.lit(25.0)))
    rows = C.dealt(C.clustered(values)).withColumn("n", F.count("*").over(W.partitionBy(*C.PLACE))).where("n >= 2")
    return rows.select(*C.KEYS, F.col("c_ph").alias("cluster_ph"), F.col("c_t").alias("cluster_t"), "ph", "t", "doi", "value", "rec_id")


def atlas_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atlas(spark, sf_dir).select(*C.KEYS, F.col("c_ph").alias("ph"), F.col("c_t").alias("t"), "n_points", "n_papers", "lo", "hi", "fold", F.col("first.doi").alias("first_doi"))


def atlas_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas_clusters(spark, sf_dir).orderBy(F.desc("n_points"), *C.KEYS, "ph", "t").limit(12).drop("first_doi")


def pooled_vs_conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of a system's Km over all conditions beside its widest range under one; pooled are all values, not only those
    of clusters."""
    mine = (F.col("metric") == "km") & F.col("mat").contains("al") & F.col("act").contains("oxidase") & (F.col("sub") == "TMB")
    values = C.long_form(entries(spark, sf_dir), {"km": "km_mm"}).where("value > 0 and ph is not null").where(mine)
    pooled = values.groupBy("mat", "act", "sub").agg((F.max("value") / F.min("value")).alias("pooled_fold"), F.count("*").alias("n_values"), F.count_distinct("paper").alias("n_papers"))
    widest = _atlas(spark, sf_dir).where(mine).groupBy("mat", "act", "sub").agg(F.max("fold").alias("widest_fold"), F.count("*").alias("n_clusters"), F.sum("n_points").alias("n_points"))
    return pooled.join(widest, ["mat", "act", "sub"])


_ATLAS = LONG + """, a AS (
  SELECT metric, mat, act, sub, ph, CASE WHEN t IS NULL OR t = 0 THEN 25.0 ELSE t END AS t, count(*) AS n_points, count(DISTINCT paper) AS n_papers, min(value) AS lo, max(value) AS hi,
         max(value) / min(value) AS fold, min(doi) AS first_doi
  FROM v WHERE value > 0 AND ph IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= 2)"""
_MINE = "metric = 'km' AND mat LIKE '%al%' AND act LIKE '%oxidase%' AND sub = 'TMB'"
_HINT = "CASE WHEN abs(fold - 10) / 10 <= 0.1 THEN '×10?' WHEN abs(fold - 100) / 100 <= 0.1 THEN '×100?' WHEN abs(fold - 1000) / 1000 <= 0.1 THEN '×1000?' END"
_ROBUST = f"""SELECT m AS metric, count(*) AS n_clusters, CAST(count(*) FILTER (severity = 'consistent') AS BIGINT) AS n_consistent, count(*) FILTER (severity = 'suspicious') AS n_suspicious,
  count(*) FILTER (severity = 'severe') AS n_severe, round(avg(CASE WHEN severity = 'severe' THEN 1.0 ELSE 0.0 END), 6) AS severe_share, max(fold) AS max_fold,
  count(*) FILTER ({_HINT} IS NOT NULL) AS n_tagged, count(*) FILTER (fold >= 1e4) AS n_1e4, count(*) FILTER (fold >= 1e6) AS n_1e6
  FROM (SELECT *, unnest([metric, 'all']) AS m FROM c WHERE WHICH) GROUP BY m"""

QUERIES = {
    "conflict_clusters": conflict_clusters, "condition_clusters": clusters_of_conditions, "severity_summary": severity_summary, "audit_register": audit_register, "magnitude_hint": magnitude_hint,
    "severe_cases": severe_cases, "robustness_by_metric": robustness_by_metric, "robustness_no_doi": robustness_no_doi, "atlas_clusters": atlas_clusters, "atlas_points": atlas_points, "atlas_top": atlas_top, "pooled_vs_conditioned": pooled_vs_conditioned,
}
ORACLES = {
    "conflict_clusters": _sql("SELECT metric, mat, act, sub, ph, t, material, n_values, n_papers, min_value, max_value, median_value, fold, round(spread, 9) AS spread, severity FROM c"),
    "condition_clusters": _sql("SELECT metric, mat, act, sub, ph, t, count(*) AS n, ph AS c_ph, t AS c_t FROM v WHERE ph IS NOT NULL AND t IS NOT NULL GROUP BY ALL", LONG),
    "severity_summary": _sql("SELECT metric, severity, count(*) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT metric, 'all', count(*) FROM c GROUP BY 1 UNION ALL SELECT 'all', 'all', count(*) FROM c"),
    "audit_register": _sql(f"""SELECT c.metric, c.mat, c.act, c.sub, c.ph, c.t, severity, CASE severity WHEN 'severe' THEN 3 WHEN 'suspicious' THEN 2 ELSE 1 END AS tier, severity <> 'consistent' AS review, n_papers, fold,
      coalesce({_HINT}, '') AS hint, CASE WHEN {_HINT} IS NULL THEN 'cross-paper' ELSE 'cross-paper/magnitude' END AS tags, n_items, items
      FROM c JOIN (SELECT metric, mat, act, sub, ph, t, count(*) AS n_items, string_agg(paper || '=' || CAST(value AS VARCHAR), ' | ' ORDER BY paper, value) AS items FROM (SELECT DISTINCT metric, mat, act, sub, ph, t, paper, value FROM v WHERE value > 0) GROUP BY 1, 2, 3, 4, 5, 6) AS i
      ON c.metric = i.metric AND c.mat = i.mat AND c.act = i.act AND c.sub = i.sub AND c.ph = i.ph AND c.t = i.t"""),
    "magnitude_hint": _sql(f"SELECT metric, mat, act, sub, ph, t, fold, {_HINT} AS hint FROM c WHERE {_HINT} IS NOT NULL"),
    "severe_cases": _sql("SELECT metric, mat, act, sub, ph, t, fold, n_papers FROM c WHERE severity = 'severe' ORDER BY fold DESC, metric, mat, act, sub, ph, t LIMIT 20"),
    "robustness_by_metric": _sql(_ROBUST.replace("WHICH", "true")),
    "robustness_no_doi": _sql(_ROBUST.replace("WHICH", "has_no_doi = 0")),
    "atlas_clusters": _sql("SELECT * FROM a", _ATLAS),
    "atlas_top": _sql("SELECT metric, mat, act, sub, ph, t, n_points, n_papers, lo, hi, fold FROM a ORDER BY n_points DESC, metric, mat, act, sub, ph, t LIMIT 12", _ATLAS),
    "atlas_points": _sql("SELECT v.metric, v.mat, v.act, v.sub, v.ph AS cluster_ph, CASE WHEN v.t IS NULL OR v.t = 0 THEN 25.0 ELSE v.t END AS cluster_t, v.ph, CASE WHEN v.t IS NULL OR v.t = 0 THEN 25.0 ELSE v.t END AS t, v.doi, value, rec_id FROM v JOIN a ON v.metric = a.metric AND v.mat = a.mat AND v.act = a.act AND v.sub = a.sub AND v.ph = a.ph AND CASE WHEN v.t IS NULL OR v.t = 0 THEN 25.0 ELSE v.t END = a.t WHERE value > 0", _ATLAS),
    "pooled_vs_conditioned": _sql(f"""SELECT p.mat, p.act, p.sub, pooled_fold, n_values, p.n_papers, widest_fold, n_clusters, n_points FROM
      (SELECT mat, act, sub, max(value) / min(value) AS pooled_fold, count(*) AS n_values, count(DISTINCT paper) AS n_papers FROM v WHERE value > 0 AND ph IS NOT NULL AND {_MINE} GROUP BY 1, 2, 3) AS p JOIN
      (SELECT mat, act, sub, max(fold) AS widest_fold, count(*) AS n_clusters, CAST(sum(n_points) AS BIGINT) AS n_points FROM a WHERE {_MINE} GROUP BY 1, 2, 3) AS w ON p.mat = w.mat AND p.act = w.act AND p.sub = w.sub""", _ATLAS),
}
