"""Queries on hubs, materials, folds of the data and encodings; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import entries, sql
from ..functions import normalize as N
from ..store import kept

_FIELDS = {"km": "km_mm", "vmax": "vmax_um_s", "kcat": "kcat_s", "ph": "ph", "t": "t"}


def hub_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per activity and substrate: rows, papers, materials, and the range, quartiles and orders of magnitude of each field."""
    stack = ", ".join(f"'{m}', {c}" for m, c in _FIELDS.items())
    e = entries(spark, sf_dir)
    size = e.groupBy("act", "sub").agg(F.count("*").alias("n_rows"), F.count_distinct("paper").alias("n_papers"), F.count_distinct("mat").alias("n_materials"))
    values = e.select("act", "sub", F.expr(f"stack({len(_FIELDS)}, {stack}) AS (field, value)")).where("value is not null")
    positive = F.when(F.col("value") > 0, F.col("value"))
    stats = values.groupBy("act", "sub", "field").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.round(F.log10(F.max(positive) / F.min(positive)), 6).alias("orders")
    )
    q = [F.round(F.col("q")[i], 9).alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    return stats.join(size, ["act", "sub"]).select("act", "sub", "field", "n_rows", "n_papers", "n_materials", "n", "lo", "hi", *q, "orders")


def hub_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("act", "sub").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "act", "sub")


def hub_top_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = entries(spark, sf_dir).groupBy("act", "sub", "mat").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("act", "sub").orderBy(F.desc("n"), "mat"))
    return counts.withColumn("place", place).where("place <= 12")


def hub_top_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent methods of each hub; rows without a method don't count."""
    counts = entries(spark, sf_dir).where("method <> ''").groupBy("act", "sub", "method").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("act", "sub").orderBy(F.desc("n"), "method"))
    return counts.withColumn("place", place).where("place <= 5")


#: Rows that represent a hub.
SHOWN = 25


def representatives(e: DataFrame, most: int = SHOWN) -> DataFrame:
    """Up to `most` rows of each hub, those of its twelve most frequent materials first and in their order, then by name and id.

    Ranks are taken where the rows are before any are shuffled: Spark limits each task's rows of a hub to `most`, and a hub's last task ranks those."""
    counts = e.groupBy("act", "sub", "mat").agg(F.count("*").alias("n"))
    order = counts.withColumn("place", F.row_number().over(W.partitionBy("act", "sub").orderBy(F.desc("n"), "mat"))).where("place <= 12").drop("n")
    # Twelve rows for each pair of an activity and a substrate.
    met = e.join(F.broadcast(order) if order.limit(100_001).count() <= 100_000 else order, ["act", "sub", "mat"], "left").withColumn("place", F.coalesce("place", F.lit(999)))
    rank = F.row_number().over(W.partitionBy("act", "sub").orderBy("place", "mat", "rec_id"))
    return met.withColumn("shown", rank).where(F.col("shown") <= most).select("act", "sub", "shown", "place", "mat", "rec_id", "method", "ph", "t", "km_mm", "vmax_um_s", "kcat_s")


def hub_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representatives(entries(spark, sf_dir))


def entity_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).groupBy("mat").agg(F.count("*").alias("n"), F.count_distinct("paper").alias("n_papers"), F.array_join(F.slice(F.array_sort(F.collect_set("material")), 1, 8), " | ").alias("names"))


def taxonomies(e: DataFrame) -> DataFrame:
    """(kind, key, n, n_papers, names): materials, activities and substrates of rows with a kinetic value, in one pass: each row stands once for each kind.
    Names are the first eight, sorted; rows without DOI are papers of their own. Blank keys are left out."""
    kinetic = e.where("km_mm is not null or vmax_um_s is not null or kcat_s is not null")
    low = F.lower(F.trim("sub"))
    sides = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c) if isinstance(c, str) else c, F.col(raw).alias("name")) for k, c, raw in (("material", F.col("mat").alias("key"), "material"), ("activity", F.col("act").alias("key"), "act"), ("substrate", low.alias("key"), "sub"))])
    each = kinetic.select("paper", F.explode(sides).alias("x")).select("paper", "x.*").where("key <> ''")
    return each.groupBy("kind", "key").agg(F.count("*").alias("n"), F.count_distinct("paper").alias("n_papers"), F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 8), " | ").alias("names"))


def entity_taxonomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomies(entries(spark, sf_dir))


def in_categories(materials: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, place, key, n, n_papers): materials by category, most papers first, then most rows, then by key; those that `categories` (key,
    category) lacks are 'unknown'."""
    own = categories.groupBy("key").agg(F.min("category").alias("category"))
    met = materials.join(own, "key", "left").withColumn("category", F.coalesce("category", F.lit("unknown")))
    place = F.row_number().over(W.partitionBy("category").orderBy(F.desc("n_papers"), F.desc("n"), "key"))
    return met.select("category", place.cast("long").alias("place"), "key", "n", "n_papers")


def category_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials by the brand of the parts that are named like them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return in_categories(taxonomies(entries(spark, sf_dir)).where("kind = 'material'"), parts.select(N.alnum_key("p_name").alias("key"), F.col("p_brand").alias("category")))


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mat, n, n_papers, family): a key with trailing digits joins its base if the base is a key, has no digit and three
    letters or more."""
    keys = entries(spark, sf_dir).groupBy("mat").agg(F.count("*").alias("n"), F.count_distinct("paper").alias("n_papers"))
    base = keys.withColumn("base", F.regexp_extract("mat", "^([a-z]{3,})[0-9]+$", 1))
    known = keys.select(F.col("mat").alias("base"), F.col("mat").alias("known"))
    return base.join(known, "base", "left").select("mat", "n", "n_papers", F.coalesce("known", "mat").alias("family"))


def material_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = families(spark, sf_dir).groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("n_members"), F.sort_array(F.collect_list(F.struct((-F.col("n_papers")).alias("p"), (-F.col("n")).alias("c"), "mat"))).alias("m"))
    return grouped.select("family", "n", "n_members", F.array_join(F.transform("m", lambda x: x["mat"]), ",").alias("members"))


def usable(e: DataFrame) -> DataFrame:
    return e.where("km_mm > 0 and ph is not null and t is not null")


def fold_of(doi="paper", k: int = 5, seed: str = "7"):
    """The fold of a DOI group, from a seeded hash: no shuffle, and stable as rows come."""
    return (F.conv(F.substr(F.md5(F.concat(F.lit(seed), doi)), F.lit(1), F.lit(8)), 16, 10).cast("long") % k).cast("int")


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usable(entries(spark, sf_dir)).withColumn("fold", fold_of())
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("paper").alias("n_papers"))


def random_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label dealt round robin in the order of a hash. The rank of a row is its rank among the rows of its hash's
    first digits, which no task has more than a share of, plus the rows before them."""
    e = usable(entries(spark, sf_dir)).select("rec_id", N.activity_class("act").alias("label"), F.md5("rec_id").alias("h")).withColumn("part", F.substr("h", F.lit(1), F.lit(3)))
    parts = e.groupBy("label", "part").agg(F.count("*").alias("m"))
    before = parts.select("label", "part", (F.sum("m").over(W.partitionBy("label").orderBy("part")) - F.col("m")).alias("before"))  # 4,096 parts a label
    place = F.row_number().over(W.partitionBy("label", "part").orderBy("h")) - 1
    ranked = e.withColumn("place", place).join(before, ["label", "part"])
    return ranked.select("rec_id", "label", ((F.col("place") + F.col("before")) % 5).cast("int").alias("fold"))


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that stand on both sides of a split, for grouped and for random folds."""
    e = usable(entries(spark, sf_dir)).select("rec_id", "paper", fold_of().alias("grouped"))
    both = e.join(random_folds(spark, sf_dir).select("rec_id", F.col("fold").alias("random")), "rec_id")
    per = both.groupBy("paper").agg(F.count_distinct("grouped").alias("g"), F.count_distinct("random").alias("r"))
    return per.agg(F.count("*").alias("n_papers"), F.count_if(F.col("g") > 1).alias("leaked_grouped"), F.count_if(F.col("r") > 1).alias("leaked_random"))


def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per material: n / (n + 5) of its mean log10 Km and the rest of the global mean; per skeleton, the n-weighted mean."""
    e = usable(entries(spark, sf_dir)).withColumn("y", F.log10("km_mm"))
    per = e.groupBy("mat").agg(F.count("*").alias("n"), F.sum("y").alias("s")).withColumn("g", e.agg(F.avg("y")).scalar())
    coded = per.withColumn("code", (F.col("s") + 5 * F.col("g")) / (F.col("n") + 5)).withColumn("skeleton", F.regexp_replace("mat", "[0-9]", ""))
    skel = coded.groupBy("skeleton").agg((F.sum(F.col("code") * F.col("n")) / F.sum("n")).alias("skeleton_code"))
    return coded.join(skel, "skeleton").select("mat", "skeleton", "n", F.round("code", 6).alias("code"), F.round("skeleton_code", 6).alias("skeleton_code"))


#: Codes of materials and folds that are broadcast; they are counted first.
MAX_SHIPPED = 200_000


def oof(e: DataFrame) -> DataFrame:
    """rec_id, fold, y and the material's encoding from the other folds; an unseen material has their global mean."""
    rows = kept(usable(e).select("rec_id", "mat", F.log10("km_mm").alias("y"), fold_of().alias("fold")), "rows")
    cells = kept(rows.groupBy("mat", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "cells")
    m = W.partitionBy("mat")
    other = cells.select("mat", "fold", (F.sum("n").over(m) - F.col("n")).alias("n"), (F.sum("s").over(m) - F.col("s")).alias("s"))
    # Sums of folds and of all come from the cells, of which there are few, not from the rows again.
    folds, all_folds = cells.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs")), W.partitionBy()
    means = folds.select("fold", ((F.sum("fs").over(all_folds) - F.col("fs")) / (F.sum("fn").over(all_folds) - F.col("fn"))).alias("g"))
    codes = other.join(F.broadcast(means), "fold").withColumn("code", (F.col("s") + 5 * F.col("g")) / (F.col("n") + 5)).select("mat", "fold", "code")
    return rows.join(F.broadcast(codes) if cells.count() <= MAX_SHIPPED else codes, ["mat", "fold"])


def oof_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oof(entries(spark, sf_dir)).select("rec_id", "fold", F.round("code", 6).alias("code"))


def material_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = usable(entries(spark, sf_dir))
    return e.groupBy("paper", "mat").agg(F.round(F.median(F.log10("km_mm")), 9).alias("y"), F.median("ph").alias("ph"), F.median("t").alias("t"), F.count("*").alias("n"))


def external_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External rows against curated training rows: all, of papers that training lacks, and of materials that it lacks too."""
    e = usable(entries(spark, sf_dir))
    train, outer = e.where("provenance = 'human'"), e.where("provenance <> 'human'")
    isolated = outer.join(train.select("paper").distinct(), "paper", "left_anti")
    novel = isolated.join(train.select("material").distinct(), "material", "left_anti")
    sets = [df.select(F.lit(name).alias("part"), "rec_id", "paper") for name, df in (("train", train), ("external", outer), ("isolated", isolated), ("novel", novel))]
    out = sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])
    return out.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("paper").alias("n_papers"))


_U = "km_mm > 0 AND ph IS NOT NULL AND t IS NOT NULL"
_FOLD = "CAST(CAST('0x' || substr(md5('7' || paper), 1, 8) AS BIGINT) % 5 AS INTEGER)"
_LABEL = "CASE WHEN act LIKE '%superoxide%' THEN 'SOD' WHEN act LIKE '%catalase%' THEN 'CAT' WHEN act LIKE '%peroxidase%' THEN 'POD' WHEN act LIKE '%oxidase%' THEN 'OXD' ELSE 'OTHER' END"
_RANDOM = f"(SELECT rec_id, paper, {_LABEL} AS label, CAST((row_number() OVER (PARTITION BY {_LABEL} ORDER BY md5(rec_id)) - 1) % 5 AS INTEGER) AS fold, {_FOLD} AS g FROM ent WHERE {_U})"

_TAXONOMY = """(SELECT kind, key, count(*) AS n, count(DISTINCT paper) AS n_papers, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 8), ' | ') AS names FROM (
  SELECT paper, unnest([{'kind': 'material', 'key': mat, 'name': material}, {'kind': 'activity', 'key': act, 'name': act}, {'kind': 'substrate', 'key': lower(sub), 'name': sub}], recursive := true) FROM ent WHERE coalesce(km_mm, vmax_um_s, kcat_s) IS NOT NULL) GROUP BY 1, 2)"""

QUERIES = {f.__name__: f for f in (hub_digest, hub_sizes, hub_top_materials, hub_top_methods, hub_representatives, entity_materials, entity_taxonomies, category_groups, material_families, grouped_folds, random_folds, leakage_audit, target_encoding, oof_encoding, material_atoms, external_split)}
ORACLES = {
    "hub_digest": sql("""SELECT s.act, s.sub, field, n_rows, n_papers, n_materials, count(*) AS n, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median,
      round(quantile_cont(value, 0.75), 9) AS q3, round(log10(max(value) FILTER (value > 0) / min(value) FILTER (value > 0)), 6) AS orders
      FROM (SELECT act, sub, unnest(['km', 'vmax', 'kcat', 'ph', 't']) AS field, unnest([km_mm, vmax_um_s, kcat_s, ph, t]) AS value FROM ent) AS v
      JOIN (SELECT act, sub, count(*) AS n_rows, count(DISTINCT paper) AS n_papers, count(DISTINCT mat) AS n_materials FROM ent GROUP BY 1, 2) AS s ON v.act = s.act AND v.sub = s.sub WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6"""),
    "hub_sizes": sql("SELECT act, sub, count(*) AS n FROM ent GROUP BY 1, 2"),
    "hub_top_materials": sql("SELECT act, sub, mat, n, place FROM (SELECT *, row_number() OVER (PARTITION BY act, sub ORDER BY n DESC, mat) AS place FROM (SELECT act, sub, mat, count(*) AS n FROM ent GROUP BY 1, 2, 3)) WHERE place <= 12"),
    "hub_top_methods": sql("SELECT act, sub, method, n, place FROM (SELECT *, row_number() OVER (PARTITION BY act, sub ORDER BY n DESC, method) AS place FROM (SELECT act, sub, method, count(*) AS n FROM ent WHERE method <> '' GROUP BY 1, 2, 3)) WHERE place <= 5"),
    "hub_representatives": sql("""SELECT act, sub, shown, place, mat, rec_id, method, ph, t, km_mm, vmax_um_s, kcat_s FROM (SELECT e.*, coalesce(o.place, 999) AS place, row_number() OVER (PARTITION BY e.act, e.sub ORDER BY coalesce(o.place, 999), e.mat, e.rec_id) AS shown FROM ent AS e LEFT JOIN (
      SELECT * FROM (SELECT act, sub, mat, row_number() OVER (PARTITION BY act, sub ORDER BY count(*) DESC, mat) AS place FROM ent GROUP BY 1, 2, 3) WHERE place <= 12) AS o ON e.act = o.act AND e.sub = o.sub AND e.mat = o.mat) WHERE shown <= 25"""),
    "entity_taxonomies": sql(f"SELECT kind, key, n, n_papers, names FROM {_TAXONOMY}"),
    "category_groups": sql(f"""SELECT category, row_number() OVER (PARTITION BY category ORDER BY n_papers DESC, n DESC, key) AS place, key, n, n_papers FROM (SELECT t.*, coalesce(c.category, 'unknown') AS category FROM {_TAXONOMY} AS t
      LEFT JOIN (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, min(p_brand) AS category FROM part GROUP BY 1) AS c ON t.key = c.key WHERE kind = 'material')"""),
    "entity_materials": sql("SELECT mat, count(*) AS n, count(DISTINCT paper) AS n_papers, array_to_string(list_slice(list_sort(list(DISTINCT material)), 1, 8), ' | ') AS names FROM ent GROUP BY 1"),
    "material_families": sql("""SELECT family, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_members, string_agg(mat, ',' ORDER BY p DESC, n DESC, mat) AS members FROM (
      SELECT mat, n, p, CASE WHEN regexp_extract(mat, '^([a-z]{3,})[0-9]+$', 1) IN (SELECT mat FROM ent) THEN regexp_extract(mat, '^([a-z]{3,})[0-9]+$', 1) ELSE mat END AS family
      FROM (SELECT mat, count(*) AS n, count(DISTINCT paper) AS p FROM ent GROUP BY 1)) GROUP BY 1"""),
    "grouped_folds": sql(f"SELECT {_FOLD} AS fold, count(*) AS n, count(DISTINCT paper) AS n_papers FROM ent WHERE {_U} GROUP BY 1"),
    "random_folds": sql(f"SELECT rec_id, label, fold FROM {_RANDOM}"),
    "leakage_audit": sql(f"SELECT count(*) AS n_papers, count(*) FILTER (g > 1) AS leaked_grouped, count(*) FILTER (r > 1) AS leaked_random FROM (SELECT paper, count(DISTINCT g) AS g, count(DISTINCT fold) AS r FROM {_RANDOM} GROUP BY 1)"),
    "target_encoding": sql(f"""SELECT mat, skeleton, n, round(code, 6) AS code, round(sum(code * n) OVER (PARTITION BY skeleton) / sum(n) OVER (PARTITION BY skeleton), 6) AS skeleton_code FROM (
      SELECT mat, regexp_replace(mat, '[0-9]', '', 'g') AS skeleton, count(*) AS n, (sum(log10(km_mm)) + 5 * (SELECT avg(log10(km_mm)) FROM ent WHERE {_U})) / (count(*) + 5) AS code FROM ent WHERE {_U} GROUP BY 1, 2)"""),
    "oof_encoding": sql(f"""SELECT rec_id, u.fold, round((coalesce(m.s, 0) - coalesce(c.s, 0) + 5 * g) / (m.n - c.n + 5), 6) AS code
      FROM (SELECT rec_id, mat, {_FOLD} AS fold FROM ent WHERE {_U}) AS u
      JOIN (SELECT mat, count(*) AS n, sum(log10(km_mm)) AS s FROM ent WHERE {_U} GROUP BY 1) AS m ON u.mat = m.mat
      JOIN (SELECT mat, {_FOLD} AS fold, count(*) AS n, sum(log10(km_mm)) AS s FROM ent WHERE {_U} GROUP BY 1, 2) AS c ON u.mat = c.mat AND u.fold = c.fold
      JOIN (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS g FROM (SELECT {_FOLD} AS fold, count(*) AS n, sum(log10(km_mm)) AS s FROM ent WHERE {_U} GROUP BY 1)) AS f ON u.fold = f.fold"""),
    "material_atoms": sql(f"SELECT paper, mat, round(median(log10(km_mm)), 9) AS y, median(ph) AS ph, median(t) AS t, count(*) AS n FROM ent WHERE {_U} GROUP BY 1, 2"),
    "external_split": sql(f"""SELECT part, count(*) AS n, count(DISTINCT paper) AS n_papers FROM (
      SELECT paper, unnest(CASE WHEN provenance = 'human' THEN ['train'] WHEN paper IN (SELECT paper FROM ent WHERE {_U} AND provenance = 'human') THEN ['external']
        WHEN material IN (SELECT material FROM ent WHERE {_U} AND provenance = 'human') THEN ['external', 'isolated'] ELSE ['external', 'isolated', 'novel'] END) AS part FROM ent WHERE {_U}) GROUP BY 1"""),
}
