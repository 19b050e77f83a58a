"""Queries that run each normaliser over raw cells, made from the measurement rows in many spellings; with their SQL.

The SQL states what each cell means from the numbers that it was written from, without reading the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import entries, rec, sql
from ..functions import normalize as N


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec with a spelling (0-15) and two small numbers of each row."""
    digit = lambda a, n: F.conv(F.substr("rec_id", F.lit(a), F.lit(n)), 16, 10).cast("long")
    return rec(spark, sf_dir).withColumn("h", digit(1, 1)).withColumn("k", digit(2, 2)).withColumn("j", digit(4, 1))


_C = "(SELECT *, CAST('0x' || substr(rec_id, 1, 1) AS BIGINT) AS h, CAST('0x' || substr(rec_id, 2, 2) AS BIGINT) AS k, CAST('0x' || substr(rec_id, 4, 1) AS BIGINT) AS j FROM rec)"


def _spelt(*forms: str) -> Column:
    """One of the SQL text forms, by the row's spelling."""
    return F.expr("CASE h % " + str(len(forms)) + " " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")


def _meant(*values: str) -> str:
    return f"CASE h % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_K, _J = "cast(k as string)", "cast(j as string)"
#: name: (text forms, what they mean in SQL, the normaliser)
_SPECS = {
    "parse_numeric": ((f"{_K} || ',000'", f"'  ' || {_K} || ' '", "'nan'", f"'x' || {_K}", "cast(null as string)"), ("k * 1000.0", "CAST(k AS DOUBLE)", "NULL", "NULL", "NULL"), N.number),
    "parse_quantity": ((f"{_K} || ' mM'", f"{_K} || '.5 ± 0.1'", f"'about ' || {_K} || ' units'", "'none'", f"{_K} || 'e-2'", f"{_J} || '.5×10⁻³'"), ("CAST(k AS DOUBLE)", "k + 0.5", "CAST(k AS DOUBLE)", "NULL", "CAST(k || 'e-2' AS DOUBLE)", "CAST(j || '.5e-3' AS DOUBLE)"), N.quantity),
    "parse_size": ((f"{_K} || '-' || cast(k + 10 as string) || ' nm'", f"{_K} || 'nm'", f"{_K} || ' – ' || cast(k + 4 as string)", "''"), ("k + 5.0", "CAST(k AS DOUBLE)", "k + 2.0", "NULL"), N.size),
    "parse_condition": ((f"'pH ' || {_J} || '.5'", f"{_J} || '.5, 7.0'", "'room temperature'", "'Body Temperature'", f"{_J} || '-' || cast(j + 1 as string)", "'n/a'"), ("j + 0.5", "j + 0.5", "25.0", "37.0", "CAST(j AS DOUBLE)", "NULL"), N.condition),
    "parse_element": (("'Fe'", "'Co(27)'", "'25'", "'Xx'", "'V2O5'", "'mn'", "'V'"), ("26", "27", "25", "NULL", "NULL", "25", "23"), N.atomic_number),
    "parse_ratio": ((f"'Mn:Co=1:' || cast(j + 1 as string)", f"{_K} || '%'", _K, "'1:1:2'", "'mixed'"), ("round(1 / (j + 2.0) * 100, 2)", "CAST(k AS DOUBLE)", "CAST(k AS DOUBLE)", "25.0", "NULL"), N.ratio),
    "parse_valence": ((f"'+' || {_J}", f"'Mn2+/Mn' || cast(j as string) || '+'", "'none'"), ("j", "greatest(2, j)", "NULL"), N.valence),
    "parse_flag": (("'yes'", "'N'", "'0'", "''", "'false'", "'1.0'", "'maybe'"), ("1", "1", "0", "NULL", "0", "1", "NULL"), N.flag),
}


def _of(name: str):
    forms, _, read = _SPECS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cells(spark, sf_dir).withColumn("text", _spelt(*forms)).select("rec_id", read("text").alias("value"))

    return query


def parse_scinot(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _spelt(f"{_J} || '.25×10⁻⁷'", f"{_J} || '·10⁶ s⁻¹'", "'5 s⁻¹'")
    return _cells(spark, sf_dir).select("rec_id", N.scientific(text).alias("value"))


def norm_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).select("rec_id", N.doi("doi_raw").alias("doi"))


def norm_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).select("rec_id", N.alnum_key("nanozyme").alias("mat"), N.space_key("nanozyme").alias("spaced"))


def norm_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).groupBy(N.activity("activity_raw").alias("act")).agg(F.count("*").alias("n"))


def activity_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec(spark, sf_dir).groupBy(N.activity_class("activity_raw").alias("label"), N.activity_class(N.activity("activity_raw")).alias("full_label")).agg(F.count("*").alias("n"))


def substrate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).withColumn("a", _spelt("''", "'none'", "'opd mix'", "substrate"))
    return c.select("rec_id", N.substrate_class("a", "substrate").alias("code"))


def norm_eval_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).withColumn("name", _spelt("nanozyme || ' NPs'", "upper(nanozyme) || ' Nanoparticles'", "replace(nanozyme, ' ', '–')", "'AuNPs'"))
    return c.select("rec_id", N.evaluation_name("name").alias("key"))


def element_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cells(spark, sf_dir).withColumn("name", _spelt("'CuSe'", "'Cu3Se2 (GSH)'", "'Fe3O4 NPs'", "initcap(nanozyme)"))
    return c.select("rec_id", F.array_join(N.element_set("name"), ",").alias("elements"))


def validate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant validation: a bad optional cell is null with a warning, a row without a name is rejected."""
    c = _cells(spark, sf_dir).select(
        "provenance", _spelt("nanozyme", "nanozyme", "''", "nanozyme", "nanozyme", "nanozyme", "nanozyme").alias("nanozyme"), _spelt(_K, "'abc'", _K, "'n.d.'", _K).alias("km_mm"), _spelt(_K, "'?'", "''").alias("size_nm")
    )
    checked = validate(c, required=["nanozyme"], numbers=["km_mm", "size_nm"])
    return checked.select("provenance", "rejected", F.explode_outer("warnings").alias("warning")).groupBy("provenance", "rejected", F.coalesce("warning", F.lit("none")).alias("warning")).agg(F.count("*").alias("n"))


def validate(df: DataFrame, required: list[str], numbers: list[str]) -> DataFrame:
    """df with numbers read, warnings for unreadable cells and missing required fields, and whether a row is rejected."""
    given = {c: N.blank_to_null(c) for c in [*required, *numbers]}
    bad = [F.when(given[c].isNotNull() & N.number(given[c]).isNull(), F.lit(c)) for c in numbers]
    lost = [F.when(given[c].isNull(), F.lit(c)) for c in required]
    marked = df.withColumn("warnings", F.array_compact(F.array(*bad, *lost))).withColumn("rejected", F.coalesce(*lost).isNotNull())
    return marked.withColumns({c: N.number(given[c]) for c in numbers})


QUERIES = {name: _of(name) for name in _SPECS} | {f.__name__: f for f in (parse_scinot, norm_doi, norm_material, norm_activity, activity_class, substrate_class, norm_eval_name, element_set, validate_report)}
_BARE = "regexp_replace(lower({}), '[ ,/_@().–-]', '', 'g')"
ORACLES = {name: sql(f"SELECT rec_id, {_meant(*meant)} AS value FROM {_C}") for name, (_, meant, _) in _SPECS.items()} | {
    "parse_scinot": sql(f"SELECT rec_id, {_meant(chr(39).join(['j || ', '.25e-7', '']), chr(39).join(['j || ', 'e6 s⁻¹', '']), chr(39) + '5 s⁻¹' + chr(39))} AS value FROM {_C}"),
    "norm_doi": sql("SELECT rec_id, doi FROM ent"),
    "norm_material": sql("SELECT rec_id, regexp_replace(lower(nanozyme), '[^a-z0-9]', '', 'g') AS mat, lower(nanozyme) AS spaced FROM rec"),
    "norm_activity": sql("SELECT act, count(*) AS n FROM ent GROUP BY 1"),
    "activity_class": sql("SELECT CASE activity_raw WHEN 'POD' THEN 'POD' WHEN 'Peroxidase-like' THEN 'POD' WHEN 'oxidase' THEN 'OXD' WHEN 'catalase like' THEN 'CAT' WHEN 'SOD' THEN 'SOD' ELSE 'OTHER' END AS label, CASE activity_raw WHEN 'POD' THEN 'POD' WHEN 'Peroxidase-like' THEN 'POD' WHEN 'oxidase' THEN 'OXD' WHEN 'catalase like' THEN 'CAT' WHEN 'SOD' THEN 'SOD' ELSE 'POD' END AS full_label, count(*) AS n FROM rec GROUP BY 1, 2"),
    "substrate_class": sql(f"SELECT rec_id, CASE WHEN h % 4 = 2 THEN 'OPD' ELSE substrate END AS code FROM {_C}"),
    "norm_eval_name": sql(f"SELECT rec_id, {_meant(_BARE.format('nanozyme'), _BARE.format('nanozyme'), _BARE.format('nanozyme'), chr(39) + 'aunps' + chr(39))} AS key FROM {_C}"),
    "element_set": sql(f"SELECT rec_id, {_meant(chr(39) + 'Cu,Se' + chr(39), chr(39) + 'Cu,Se' + chr(39), chr(39) + 'Fe,O' + chr(39), 'array_to_string(list_sort(list_distinct(regexp_extract_all(t, ' + chr(39) + '|'.join(N.ELEMENTS) + chr(39) + '))), ' + chr(39) + ',' + chr(39) + ')')} AS elements FROM (SELECT *, array_to_string(list_transform(string_split(nanozyme, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS t FROM {_C})"),
    "validate_report": sql(f"""SELECT provenance, r AS rejected, w AS warning, count(*) AS n FROM (SELECT provenance, h % 7 = 2 AS r, unnest(CASE WHEN len(ws) = 0 THEN ['none'] ELSE ws END) AS w FROM (
      SELECT *, list_filter([CASE WHEN h % 5 IN (1, 3) THEN 'km_mm' END, CASE WHEN h % 3 = 1 THEN 'size_nm' END, CASE WHEN h % 7 = 2 THEN 'nanozyme' END], lambda x: x IS NOT NULL) AS ws FROM {_C})) GROUP BY 1, 2, 3"""),
}
