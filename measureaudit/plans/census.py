"""Queries on sources: cross-source folds, lineage, coverage, provenance, integration; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import entries, rec, sql
from ..functions import normalize as N
from ..sources import registry as R
from ..sources.papers import map_source
from ..store import kept


def cross_source(rows: DataFrame, keys: list[str], least_fold: float = 2.0) -> DataFrame:
    """Groups of keys that two sources or more report with positive Km, and their fold. One combinable shuffle; rows without
    DOI are left out, as they would all meet in one group."""
    usable = rows.where("km_mm is not null and ph is not null and doi <> ''")
    found = usable.groupBy(*keys).agg(F.min("km_mm").alias("min_km"), F.max("km_mm").alias("max_km"), F.count_distinct("provenance").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("sources"), F.bool_or("km_uncertain").alias("unit_uncertain"))
    return found.where("n_sources >= 2 and min_km > 0").withColumn("fold", F.col("max_km") / F.col("min_km")).where(F.col("fold") >= least_fold)


def cross_source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_source(entries(spark, sf_dir), ["doi", "material", "sub"])


def unit_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("fold")
    flag = F.when(F.abs(f - 10) / 10 <= 0.15, "~10×").when(F.abs(f - 100) / 100 <= 0.15, "~100×").when(F.abs(f - 1000) / 1000 <= 0.15, "~1000×").when(f >= 100, ">100×")
    return cross_source(entries(spark, sf_dir), ["doi", "material", "sub"]).withColumn("suspect_unit", flag).where("suspect_unit is not null").select("doi", "material", "sub", "fold", "suspect_unit")


def sameph_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).where("km_mm <> 0").withColumn("ph2", F.round("ph", 2))
    found = cross_source(rows, ["doi", "material", "sub", "ph2"], 0.0)
    # A system counts once, although it may own several pH buckets: by its widest fold.
    system = found.groupBy("doi", "material", "sub").agg(F.count("*").alias("n"), F.max("fold").alias("widest"), *[F.sum((F.col("fold") >= x).cast("long")).alias(f"b{x}") for x in (2, 5, 10, 100)])
    return system.agg(
        F.sum("n").alias("n_buckets"), F.count("*").alias("n_systems"), F.count_distinct("doi").alias("n_dois"), *[F.sum(f"b{x}").alias(f"buckets_{x}") for x in (2, 5, 10, 100)],
        *[F.sum((F.col("widest") >= x).cast("long")).alias(f"systems_{x}") for x in (10, 100)], F.max("widest").alias("widest_fold"),
    )


def lineage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = entries(spark, sf_dir).where("doi <> ''")
    return named.groupBy("doi").agg(F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("sources"), F.count_distinct("provenance").alias("n_sources"), F.count("*").alias("n_rows"), (F.count_distinct("provenance") >= 2).alias("multi"))


def lineage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineage_matrix(spark, sf_dir)
    one = lambda cond: F.sum(F.when(F.expr(cond), 1).otherwise(0)).alias
    return m.agg(F.count("*").alias("n_dois"), one("multi")("n_multi"), one("sources = 'human'")("n_human_only"), one("sources not like '%human%'")("n_db_only"), F.max("n_sources").cast("long").alias("max_sources"))


def gaps(e: DataFrame) -> DataFrame:
    """(kind, name, only_in): materials, activities and systems that only the curated (human) or only the other sources (db) have, in one
    pass over the rows."""
    system = F.concat_ws("|", "mat", "act", "sub", F.col("ph").cast("decimal(4,1)").cast("string"), F.col("t").cast("int").cast("string"))
    items = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("material", F.col("material")), ("activity", F.col("act")), ("system", system))])
    sides = e.select((F.col("provenance") == "human").alias("h"), F.explode(items).alias("i")).where("i.name <> ''").groupBy("i.kind", "i.name").agg(F.bool_or("h").alias("human"), F.bool_or(~F.col("h")).alias("db"))
    return sides.where("human <> db").select("kind", "name", F.when(F.col("human"), "human").otherwise("db").alias("only_in"))


def coverage_gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(entries(spark, sf_dir))


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many materials, activities and systems one side lacks, and the first of each."""
    return gaps(entries(spark, sf_dir)).groupBy("kind", "only_in").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("provenance").agg(F.count("*").alias("n"))


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    fields = ["material", "act", "sub", "ph", "t", "km_mm", "vmax_um_s", "kcat_s", "size_nm"]
    filled = sum((F.max(F.col(c).isNotNull().cast("int")) for c in fields), F.lit(0))
    return e.groupBy("provenance").agg(F.count("*").alias("n_rows"), filled.cast("long").alias("n_fields"), F.count_if(F.col("doi") == "").alias("n_no_doi"), F.count_if("km_uncertain").alias("n_uncertain"))


def identity_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = entries(spark, sf_dir).groupBy("paper", "material", "act", "sub", "ph", "t").agg(F.count("*").alias("n"))
    per = points.groupBy("paper", "material", "act", "sub").agg(F.count("*").alias("n_conditions"), F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"))
    return per.groupBy("n_conditions").agg(F.count("*").alias("n_identities"), F.sum("n_rows").alias("n_rows"), F.sum("n_duplicates").alias("n_duplicates"))


def dedupe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key (doi, name, activity, substrate, Km) is there before, by rec_id, are dropped; per source."""
    w = W.partitionBy("paper", "material", "act", "sub", "km_mm").orderBy("rec_id")
    marked = entries(spark, sf_dir).withColumn("first", F.row_number().over(w) == 1)
    return marked.groupBy("provenance").agg(F.count_if("first").alias("n_kept"), F.count_if(~F.col("first")).alias("n_dropped"))


def paper_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    named = e.withColumn("file", F.regexp_replace("paper", "[^a-z0-9_.\\-]", "_"))
    return named.groupBy("provenance").agg(F.count_distinct("file").alias("n_papers"), F.count("*").alias("n_records"), F.count_if(F.expr("km_mm is not null or vmax_um_s is not null")).alias("n_kinetic"))


def integrated_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source mapped by its own columns and units to the common keys, merged, kinetic rows kept."""
    r = rec(spark, sf_dir)
    human = r.where("provenance = 'human'").select("rec_id", "provenance", N.doi("doi_raw").alias("doi"), N.alnum_key("nanozyme").alias("mat"), N.activity("activity_raw").alias("act"), "km_mm", "vmax_um_s")
    # A source without an activity column gets the default; one that states Vmax in mM/s is rescaled; one without known unit has none.
    a = r.where("provenance = 'db:a'").select("rec_id", "provenance", N.doi("doi_raw").alias("doi"), N.alnum_key("nanozyme").alias("mat"), F.coalesce(N.activity(F.lit(None).cast("string")), F.lit("peroxidase")).alias("act"), "km_mm", "vmax_um_s")
    b = r.where("provenance = 'db:b'").select("rec_id", "provenance", N.doi("doi_raw").alias("doi"), N.alnum_key("nanozyme").alias("mat"), N.activity("activity_raw").alias("act"), "km_mm", N.rescale("vmax_um_s", unit=F.lit("mM/s")).alias("vmax_um_s"))
    c = r.where("provenance = 'db:c'").select("rec_id", "provenance", N.doi("doi_raw").alias("doi"), N.alnum_key("nanozyme").alias("mat"), N.activity("activity_raw").alias("act"), "km_mm", N.rescale("vmax_um_s", unit=F.lit("?")).alias("vmax_um_s"))
    k = r.where("provenance = 'db:k'").select("rec_id", "provenance", N.alnum_key("nanozyme").alias("mat"), N.activity("activity_raw").alias("act"), "km_mm", "vmax_um_s", "kcat_s")
    merged = human.unionByName(a).unionByName(b).unionByName(c).unionByName(k, allowMissingColumns=True)
    kept = merged.where("km_mm is not null or vmax_um_s is not null or (provenance <> 'human' and kcat_s is not null)")
    return kept.select("rec_id", "provenance", F.coalesce(F.when(F.col("doi") != "", F.col("doi")), F.concat(F.lit("na-"), "rec_id")).alias("paper"), "mat", "act", "km_mm", "vmax_um_s")


def _exported(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, R.Source]]:
    """The raw rows as each source exports them: text cells under the source's own headers."""
    r = rec(spark, sf_dir).withColumn("digit", F.conv(F.substr("rec_id", F.lit(1), F.lit(1)), 16, 10).cast("int"))
    text = lambda c: F.col(c).cast("string")
    power = F.when(F.col("digit") % 7 != 0, (F.col("digit") % 3 - 1).cast("string"))

    def table(where: str, **cells) -> DataFrame:
        return r.where(where).select("rec_id", *[(c if isinstance(c, Column) else text(c)).alias(h) for h, c in cells.items()])

    return [
        (table("provenance = 'human'", **{"Name": "nanozyme", "Mimic enzyme activity": F.when(F.col("digit") % 4 != 0, F.col("activity_raw")), "Size/nm": "size_nm", "Buffer pH value": "ph", "Temperature/℃": "temperature_c", "Substrate1 ": "substrate", "Km/mM": "km_mm", "Vmax/μM s-1": "vmax_um_s", "Kcat/s-1 ": "kcat_s", "data reference doi": "doi_raw", "Metal type": "metal_no"}), R.CURATED_ONE),
        (table("provenance = 'db:a'", name="nanozyme", mimic_enzyme_activity="activity_raw", buffer_ph_value="ph", temperature="temperature_c", km_per_mm="km_mm", vmax_micro_m_per_s="vmax_um_s", kcat_per_s="kcat_s", substrate1="substrate", data_reference_doi="doi_raw"), R.AI_ZYMES),
        (table("provenance = 'db:b'", **{"formula": "nanozyme", "activity": "activity_raw", "ph": "ph", "temp, °C": "temperature_c", "Km, mM": "km_mm", "Vmax, mM/s": "vmax_um_s", "ReactionType": F.concat("substrate", F.when(F.col("digit") % 2 == 0, " + OPD").otherwise("")), "link": "doi_raw"}), R.DIZYME),
        (table("provenance = 'db:c'", **{"Nanozyme Name/ Monomaterial": "nanozyme", "Enzyme Like Activity": "activity_raw", "pH": "ph", "Temp (℃)": "temperature_c", "Kₘ (mM)": "km_mm", "Vmax(nM s⁻¹)": "vmax_um_s", "kcat (s⁻¹)": "kcat_s", "Substrate/Activity": "substrate", "DOI": "doi_raw"}), R.NANOZYME_DB),
        (table("provenance = 'db:k'", **{"material": "nanozyme", "enzyme type": "activity_raw", "pH": "ph", "T": "temperature_c", "km": "km_mm", "km 10n": power, "vmax": "vmax_um_s", "vmax 10n": power, "kcat": "kcat_s", "kcat 10n": power, "substrate": "substrate"}), R.NANOZYME_NET_K),
    ]


def mapped_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's export, mapped by its own headers, units and defaults, coerced to typed fields, and merged; kinetic rows are kept."""
    parts = [map_source(df, source, ["rec_id"]) for df, source in _exported(spark, sf_dir)]
    # Written before it is filtered: else the filter would read the cells of each row once more.
    merged = kept(reduce(DataFrame.unionByName, parts), "mapped")
    kinetic = merged.where("Km_mM is not null or Vmax_uM_s_minus1 is not null or (provenance <> 'human' and Kcat_s_minus1 is not null)")
    return kinetic.select(
        "rec_id", "provenance", N.alnum_key("nanozyme").alias("mat"), N.activity("mimic_enzyme_activity").alias("act"), N.doi("doi").alias("doi"), F.col("buffer_ph_value").alias("ph"), F.col("temperature_c").alias("t"), F.col("Km_mM").alias("km_mm"), F.col("Vmax_uM_s_minus1").alias("vmax_um_s"),
        F.col("Kcat_s_minus1").alias("kcat_s"), "substrate1", "substrate2", "metal_type", "km_uncertain", F.size("warnings").alias("n_warnings"),
    )


def unit_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written as mantissa and exponent, one exponent missing in seven, and Vmax in three unit styles."""
    r = rec(spark, sf_dir).withColumn("digit", F.conv(F.substr("rec_id", F.lit(1), F.lit(1)), 16, 10).cast("int"))
    exponent = F.when(F.col("digit") % 7 != 0, F.col("digit") % 3 - 1)
    unit = F.when(F.col("digit") % 3 == 0, "mM/s").when(F.col("digit") % 3 == 1, "?").otherwise("uM/s")
    return r.select(
        "rec_id", N.rescale("size_nm", exponent.cast("double")).alias("value"), N.rescale("vmax_um_s", unit=unit).alias("vmax"), (F.col("size_nm").isNotNull() & exponent.isNull()).alias("uncertain")
    )


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 DOIs by a seeded hash, one record of each: a sample that stays the same when other rows come."""
    e = entries(spark, sf_dir).where("doi <> '' and km_mm is not null").withColumn("h", F.md5(F.concat(F.lit("7"), "rec_id")))
    one = e.groupBy("doi").agg(F.min_by(F.struct("rec_id", "material", "act", "sub"), "h").alias("r"))
    return one.withColumn("o", F.md5(F.concat(F.lit("7"), "doi"))).orderBy("o").limit(25).select("doi", "r.*")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row is held out if its DOI is in the test set or its family (material, origin) has a row there."""
    e = entries(spark, sf_dir).withColumn("origin", F.split("provenance", ":")[0]).withColumn("picked", (F.col("doi") != "") & F.substr(F.md5("doi"), F.lit(1), F.lit(2)).isin("00", "01", "02", "03"))
    families = e.where("picked").select("material", "origin").distinct().withColumn("hit", F.lit(True))
    marked = e.join(families, ["material", "origin"], "left")
    side = F.when(F.col("picked"), "test").when(F.col("hit"), "family").otherwise("train")
    return marked.groupBy("provenance", side.alias("side")).agg(F.count("*").alias("n"))


_X = """, x AS (SELECT doi, material, sub, min(km_mm) AS min_km, max(km_mm) AS max_km, count(DISTINCT provenance) AS n_sources, array_to_string(list_sort(list(DISTINCT provenance)), ',') AS sources,
  bool_or(km_uncertain) AS unit_uncertain, max(km_mm) / min(km_mm) AS fold FROM ent WHERE km_mm IS NOT NULL AND ph IS NOT NULL AND doi <> '' GROUP BY 1, 2, 3
  HAVING count(DISTINCT provenance) >= 2 AND min(km_mm) > 0)"""
_M = ", m AS (SELECT doi, array_to_string(list_sort(list(DISTINCT provenance)), ',') AS sources, count(DISTINCT provenance) AS n_sources, count(*) AS n_rows, count(DISTINCT provenance) >= 2 AS multi FROM ent WHERE doi <> '' GROUP BY 1)"


def _with(ctes: str, body: str) -> str:
    return sql("SELECT 1").rsplit("\nSELECT 1", 1)[0] + ctes + "\n" + body


_GAPS = """, i AS (SELECT provenance = 'human' AS h, 'material' AS kind, material AS name FROM ent UNION ALL SELECT provenance = 'human', 'activity', act FROM ent UNION ALL
  SELECT provenance = 'human', 'system', mat || '|' || act || '|' || sub || CASE WHEN ph IS NULL THEN '' ELSE '|' || CAST(CAST(ph AS DECIMAL(4, 1)) AS VARCHAR) END || CASE WHEN t IS NULL THEN '' ELSE '|' || CAST(CAST(t AS INT) AS VARCHAR) END FROM ent),
  gaps AS (SELECT kind, name, CASE WHEN bool_and(h) THEN 'human' ELSE 'db' END AS only_in FROM i GROUP BY 1, 2 HAVING bool_and(h) OR NOT bool_or(h))"""

QUERIES = {f.__name__: f for f in (cross_source_conflicts, unit_mismatch, sameph_census, lineage_matrix, lineage_summary, coverage_gaps, coverage_gap_lists, provenance_counts, source_profile, identity_conditions, dedupe_records, paper_stats, integrated_layer, mapped_layer, unit_rescale, review_sample, holdout_split)}
ORACLES = {
    "cross_source_conflicts": _with(_X, "SELECT * FROM x WHERE fold >= 2"),
    "unit_mismatch": _with(_X, "SELECT doi, material, sub, fold, CASE WHEN abs(fold - 10) / 10 <= 0.15 THEN '~10×' WHEN abs(fold - 100) / 100 <= 0.15 THEN '~100×' WHEN abs(fold - 1000) / 1000 <= 0.15 THEN '~1000×' ELSE '>100×' END AS suspect_unit FROM x WHERE fold >= 2 AND (abs(fold - 10) / 10 <= 0.15 OR fold >= 85 AND abs(fold - 100) / 100 <= 0.15 OR fold >= 100)"),
    "sameph_census": _with(""", p AS (SELECT doi, material, sub, round(ph, 2) AS ph2, max(km_mm) / min(km_mm) AS fold FROM ent WHERE km_mm <> 0 AND ph IS NOT NULL AND doi <> '' GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT provenance) >= 2),
      s AS (SELECT doi, material, sub, max(fold) AS widest FROM p GROUP BY 1, 2, 3)""", """SELECT count(*) AS n_buckets, (SELECT count(*) FROM s) AS n_systems, count(DISTINCT doi) AS n_dois, count(*) FILTER (fold >= 2) AS buckets_2, count(*) FILTER (fold >= 5) AS buckets_5,
      count(*) FILTER (fold >= 10) AS buckets_10, count(*) FILTER (fold >= 100) AS buckets_100, (SELECT count(*) FROM s WHERE widest >= 10) AS systems_10, (SELECT count(*) FROM s WHERE widest >= 100) AS systems_100, max(fold) AS widest_fold FROM p"""),
    "lineage_matrix": _with(_M, "SELECT * FROM m"),
    "lineage_summary": _with(_M, "SELECT count(*) AS n_dois, count(*) FILTER (multi) AS n_multi, count(*) FILTER (sources = 'human') AS n_human_only, count(*) FILTER (sources NOT LIKE '%human%') AS n_db_only, max(n_sources) AS max_sources FROM m"),
    "coverage_gaps": _with(_GAPS, "SELECT kind, only_in, count(*) AS n, min(name) AS first_name FROM gaps GROUP BY 1, 2"),
    "coverage_gap_lists": _with(_GAPS, "SELECT * FROM gaps"),
    "provenance_counts": sql("SELECT provenance, count(*) AS n FROM ent GROUP BY 1"),
    "source_profile": sql("SELECT provenance, count(*) AS n_rows, 3 + CAST(count(ph) > 0 AS BIGINT) + CAST(count(t) > 0 AS BIGINT) + CAST(count(km_mm) > 0 AS BIGINT) + CAST(count(vmax_um_s) > 0 AS BIGINT) + CAST(count(kcat_s) > 0 AS BIGINT) + CAST(count(size_nm) > 0 AS BIGINT) AS n_fields, count(*) FILTER (doi = '') AS n_no_doi, count(*) FILTER (km_uncertain) AS n_uncertain FROM ent GROUP BY 1"),
    "identity_conditions": sql("SELECT n_conditions, count(*) AS n_identities, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_rows - n_conditions) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n_conditions, sum(n) AS n_rows FROM (SELECT paper, material, act, sub, ph, t, count(*) AS n FROM ent GROUP BY ALL) GROUP BY paper, material, act, sub) GROUP BY 1"),
    "dedupe_records": sql("SELECT provenance, count(*) FILTER (k = 1) AS n_kept, count(*) FILTER (k > 1) AS n_dropped FROM (SELECT provenance, row_number() OVER (PARTITION BY paper, material, act, sub, km_mm ORDER BY rec_id) AS k FROM ent) GROUP BY 1"),
    "paper_stats": sql("SELECT provenance, count(DISTINCT paper) AS n_papers, count(*) AS n_records, count(*) FILTER (km_mm IS NOT NULL OR vmax_um_s IS NOT NULL) AS n_kinetic FROM ent GROUP BY 1"),
    "integrated_layer": sql("SELECT rec_id, provenance, paper, mat, CASE WHEN provenance = 'db:a' THEN 'peroxidase' ELSE act END AS act, km_mm, v AS vmax_um_s FROM (SELECT *, CASE provenance WHEN 'db:b' THEN vmax_um_s * 1000.0 WHEN 'db:c' THEN NULL ELSE vmax_um_s END AS v FROM ent) WHERE km_mm IS NOT NULL OR v IS NOT NULL OR (provenance = 'db:k' AND kcat_s IS NOT NULL)"),
    "mapped_layer": sql("""SELECT rec_id, provenance, mat, act, doi, ph, t, km_mm, vmax_um_s, kcat_s, substrate1, substrate2, metal_type, km_uncertain, 0 AS n_warnings FROM (
      SELECT r.rec_id, CASE r.provenance WHEN 'db:a' THEN 'db:ai-zymes' WHEN 'db:b' THEN 'db:dizyme' WHEN 'db:c' THEN 'db:nanozymedb' WHEN 'db:k' THEN 'db:nanozymenet-k' ELSE 'human' END AS provenance, e.mat,
        CASE WHEN r.provenance = 'human' AND d % 4 = 0 THEN 'peroxidase' ELSE e.act END AS act, CASE WHEN r.provenance = 'db:k' THEN '' ELSE e.doi END AS doi, e.ph, e.t, r.km_mm * CASE WHEN r.provenance = 'db:k' THEN p ELSE 1.0 END AS km_mm,
        CASE r.provenance WHEN 'db:b' THEN r.vmax_um_s * 1000.0 WHEN 'db:c' THEN NULL WHEN 'db:k' THEN r.vmax_um_s * p ELSE r.vmax_um_s END AS vmax_um_s, CASE r.provenance WHEN 'db:b' THEN NULL WHEN 'db:k' THEN r.kcat_s * p ELSE r.kcat_s END AS kcat_s,
        r.substrate AS substrate1, CASE WHEN r.provenance = 'db:b' AND d % 2 = 0 THEN 'OPD' END AS substrate2, CASE WHEN r.provenance = 'human' THEN metal_no END AS metal_type, r.provenance = 'db:k' AND d % 7 = 0 AS km_uncertain
      FROM (SELECT *, CASE WHEN d % 7 = 0 THEN 1.0 ELSE pow(10.0, d % 3 - 1) END AS p FROM (SELECT *, CAST('0x' || substr(rec_id, 1, 1) AS INTEGER) AS d FROM rec)) AS r JOIN ent AS e ON r.rec_id = e.rec_id)
      WHERE km_mm IS NOT NULL OR vmax_um_s IS NOT NULL OR (provenance <> 'human' AND kcat_s IS NOT NULL)"""),
    "unit_rescale": sql("SELECT rec_id, size_nm * CASE WHEN d % 7 = 0 THEN 1.0 ELSE pow(10.0, d % 3 - 1) END AS value, CASE d % 3 WHEN 0 THEN vmax_um_s * 1000.0 WHEN 1 THEN NULL ELSE vmax_um_s END AS vmax, d % 7 = 0 AS uncertain FROM (SELECT *, CAST('0x' || substr(rec_id, 1, 1) AS INTEGER) AS d FROM rec)"),
    "review_sample": sql("SELECT doi, rec_id, material, act, sub FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY md5('7' || rec_id)) AS k FROM ent WHERE doi <> '' AND km_mm IS NOT NULL) WHERE k = 1 ORDER BY md5('7' || doi) LIMIT 25"),
    "holdout_split": _with(", p AS (SELECT *, split_part(provenance, ':', 1) AS origin, doi <> '' AND substr(md5(doi), 1, 2) IN ('00', '01', '02', '03') AS picked FROM ent)", "SELECT provenance, CASE WHEN picked THEN 'test' WHEN (material, origin) IN (SELECT (material, origin) FROM p WHERE picked) THEN 'family' ELSE 'train' END AS side, count(*) AS n FROM p GROUP BY 1, 2"),
}
