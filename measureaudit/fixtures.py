"""The measurement view that all audit queries read: one SQL text for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import normalize as N

#: Parts whose key 13 divides are materials that many papers measure closely alike; papers 7 and 9 of each 40 vary T or pH alone.
REC = """
b AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_linestatus,
         p.p_name, p.p_type, p.p_size,
         CAST(l.l_suppkey % 5 AS INT) AS src,
         CAST(floor(l.l_orderkey / 16) AS BIGINT) AS paper,
         CASE floor(l.l_orderkey / 16) % 40 WHEN 7 THEN 'T' WHEN 9 THEN 'P' ELSE '' END AS series,
         CAST(round(l.l_discount * 100) AS INT) AS d,
         CAST(round(l.l_tax * 100) AS INT) AS x,
         CAST(l.l_quantity AS INT) AS q,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
), rec AS (
  SELECT md5(CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING) || '|' || CAST(l_partkey AS STRING)
             || '|' || CAST(l_suppkey AS STRING) || '|' || CAST(q AS STRING) || '|' || CAST(cents AS STRING)) AS rec_id,
    CASE src WHEN 0 THEN 'human' WHEN 1 THEN 'db:a' WHEN 2 THEN 'db:b' WHEN 3 THEN 'db:c' ELSE 'db:k' END AS provenance,
    CASE WHEN src = 4 THEN '' ELSE
      CASE l_linenumber % 4 WHEN 0 THEN 'https://doi.org/10.1000/P' WHEN 1 THEN 'doi: 10.1000/p'
                            WHEN 2 THEN 'http://dx.doi.org/10.1000/P' ELSE '10.1000/p' END
      || CAST(paper AS STRING) || CASE l_linenumber % 4 WHEN 0 THEN '.' ELSE '' END END AS doi_raw,
    CASE WHEN series <> '' THEN 'Series ' || series || CAST(CAST(floor(paper / 40) AS BIGINT) % 20 AS STRING)
         WHEN l_partkey % 13 = 0 THEN upper(translate(substr(md5(CAST(CAST(floor(l_partkey / 52) AS BIGINT) AS STRING) || 'x' || CAST(l_partkey % 3 AS STRING)), 1, 7), '0123456789', 'ghijklmnop'))
                                      || CASE WHEN l_partkey % 39 = 0 THEN CAST(l_partkey % 10 AS STRING) ELSE '' END
         WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '-')
         ELSE p_name || ' ' || CAST(p_size % 4 AS STRING) END AS nanozyme,
    CASE WHEN series <> '' THEN 'POD' ELSE CASE p_type WHEN 'STANDARD' THEN 'POD' WHEN 'SMALL' THEN 'Peroxidase-like' WHEN 'LARGE' THEN 'oxidase'
                WHEN 'PROMO' THEN 'catalase like' WHEN 'ECONOMY' THEN 'SOD' ELSE 'GPx' END END AS activity_raw,
    CASE WHEN series <> '' OR l_returnflag = 'A' THEN 'TMB' WHEN l_returnflag = 'N' THEN 'H2O2' ELSE 'ABTS' END AS substrate,
    CASE WHEN series = 'T' THEN 4.0E0 WHEN x = 8 THEN NULL ELSE 3.0E0 + 0.5E0 * d END AS ph,
    CASE WHEN series = 'P' THEN 25.0E0 WHEN l_linestatus = 'O' AND q % 10 = 0 THEN NULL ELSE 25.0E0 + 4.0E0 * (q % 4) END AS temperature_c,
    CASE WHEN q = 1 THEN NULL WHEN q = 2 THEN 0.0E0
         WHEN series = '' AND l_partkey % 13 = 0 THEN (500 + 20 * (l_partkey % 7) + cents % 90) / 1000.0E0
         WHEN src = 2 AND l_partkey % 7 = 0 THEN cents / 1000.0E0
         WHEN src = 3 AND l_partkey % 11 = 0 THEN cents / 10000000.0E0
         ELSE cents / 1000000.0E0 END AS km_mm,
    CASE WHEN q % 3 = 0 THEN NULL ELSE (cents % 9973 + 1) / 1000.0E0 END AS vmax_um_s,
    CASE WHEN q % 7 <> 0 THEN NULL ELSE (cents % 997 + 1) / 10.0E0 END AS kcat_s,
    CAST(p_size AS DOUBLE) AS size_nm,
    CASE l_partkey % 7 WHEN 0 THEN 26 WHEN 1 THEN 58 WHEN 2 THEN 29 WHEN 3 THEN 79 WHEN 4 THEN 25 ELSE NULL END AS metal_no,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 90 AS DOUBLE) END AS metal_ratio,
    CASE q % 7 WHEN 0 THEN NULL WHEN 1 THEN 'hydrothermal' WHEN 2 THEN 'coprecipitation' WHEN 3 THEN 'sol-gel' WHEN 4 THEN 'calcination' WHEN 5 THEN 'pyrolysis' ELSE 'reduction ' || CAST(l_partkey % 3 AS STRING) END AS method,
    CAST(l_partkey % 4 AS INT) AS metal_valence, CAST(l_partkey % 8 AS INT) AS dopant,
    (src = 4 AND x < 7) AS km_uncertain
  FROM b
)"""

#: The same entries in SQL, as a chain of common table expressions for the checks.
ENTRIES = (
    REC
    + r""", ent AS (
  SELECT *, CASE WHEN doi = '' THEN 'na-' || rec_id ELSE doi END AS paper FROM (
    SELECT rec_id, provenance, nanozyme AS material, substrate AS sub, ph, temperature_c AS t, km_mm, vmax_um_s, kcat_s, size_nm, km_uncertain, method,
           lower(regexp_replace(regexp_replace(regexp_replace(trim(doi_raw), '^(?i)https?://(dx\.)?doi\.org/', ''), '^(?i)doi:\s*', ''), '\.+$', '')) AS doi,
           regexp_replace(lower(nanozyme), '[^a-z0-9]', '', 'g') AS mat,
           CASE activity_raw WHEN 'POD' THEN 'peroxidase' WHEN 'Peroxidase-like' THEN 'peroxidase' WHEN 'oxidase' THEN 'oxidase'
                WHEN 'catalase like' THEN 'catalase' WHEN 'SOD' THEN 'superoxide dismutase' ELSE 'glutathione peroxidase' END AS act
    FROM rec) AS n
)"""
)


#: Bytes of a generated method up to which HotSpot compiles it; a longer one is interpreted for good.
METHOD_BYTES = 8000


def short_methods(spark: SparkSession) -> None:
    """Let Spark fuse steps into one method only as far as HotSpot compiles it: the session's setting, lowered where it is higher."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_methods(spark)
    lineitem, part = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "part"))
    return spark.sql("WITH " + REC.replace("FROM lineitem l JOIN part p", "FROM {lineitem} l JOIN {part} p") + " SELECT * FROM rec", lineitem=lineitem, part=part)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat entries: keys, condition and values of every measurement. A row without DOI is a paper of its own."""
    doi = N.doi("doi_raw")
    return rec(spark, sf_dir).select(
        "rec_id", "provenance", F.col("nanozyme").alias("material"), F.col("substrate").alias("sub"), "ph", F.col("temperature_c").alias("t"), "km_mm", "vmax_um_s", "kcat_s", "size_nm", "km_uncertain", "method",
        N.symbol("metal_no").alias("metal_type"), "metal_ratio", "metal_valence", *[F.when(F.col("dopant") == k, 1).otherwise(0).alias(f"doped_{x}") for k, x in enumerate("npsbf", 1)],
        doi.alias("doi"), N.alnum_key("nanozyme").alias("mat"), N.activity("activity_raw").alias("act"), F.when(doi == "", F.concat(F.lit("na-"), "rec_id")).otherwise(doi).alias("paper"),
    )


def sql(body: str) -> str:
    """A check over the entries."""
    return f"WITH {ENTRIES}\n{body}"
