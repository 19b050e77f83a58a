"""Readers and writers: paper JSON, source CSV, curated lists, gold tables; papers, registers and graphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as N

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
# The columns of a flat record.
FIELDS = {
    "nanozyme": _S, "mimic_enzyme_activity": _S, "doi": _S, "doped_N": _I, "doped_P": _I, "doped_S": _I, "doped_B": _I, "doped_F": _I, "metal_ratio": _D, "metal_type": _I, "metal_valence": _I, "shape": _S, "size_nm": _D,
    "surface_modification": _S, "dispersion_medium": _S, "buffer_ph_value": _D, "temperature_c": _D, "substrate1": _S, "substrate2": _S, "Km_mM": _D, "Vmax_uM_s_minus1": _D, "Kcat_s_minus1": _D,
    "catalytic_efficiency_M_s_minus1": _D, "kinetic_substrate": _S, "kinetic_method": _S,
}
RECORD = T.StructType([T.StructField(k, t, k != "nanozyme") for k, t in FIELDS.items()])
#: As text, for reading: every cell is normalised afterwards.
RAW = T.StructType([T.StructField(k, _S) for k in FIELDS])


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a folder of paper files {doi, records: [...]}; names that start with _ or ~$ are skipped, and
    so are files that are no JSON."""
    schema = T.StructType([T.StructField("doi", _S), T.StructField("provenance", _S), T.StructField("records", T.ArrayType(RAW)), T.StructField("_bad", _S)])
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    kept = files.withColumn("file", name).where(~F.col("file").startswith("_") & ~F.col("file").startswith("~$"))
    rows = kept.select(F.col("doi").alias("paper_doi"), "provenance", "file", F.explode("records").alias("r"))
    return rows.select("paper_doi", "provenance", "file", "r.*")


def last_per_doi(records: DataFrame) -> DataFrame:
    """Of several files of one DOI, the records of the last by name."""
    last = records.groupBy("paper_doi").agg(F.max("file").alias("file"))
    return records.join(last, ["paper_doi", "file"], "left_semi")


def read_source_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A database export as text columns; blank cells are null. A source has one fixed encoding."""
    df = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).csv(path)
    return df.select([N.blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_curated_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file whose top level is an array of records; anything else is an error, found by the first character of each file."""
    first = spark.read.text(path, wholetext=True).select(F.substr(F.regexp_replace("value", "^[\\uFEFF\\s]+", ""), F.lit(1), F.lit(1)).alias("c"))
    if other := first.where("c <> '['").limit(1).collect():
        raise ValueError(f"not an array of records: the file begins with {other[0].c!r}")
    return spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)


def read_gold(df: DataFrame, explicit: dict[str, str], wanted: list[str]) -> DataFrame:
    """A reference table with its headers mapped: explicit names first, then by letters and digits only; rows without DOI
    are dropped."""
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    own = {explicit[c]: c for c in df.columns if c in explicit}
    for c in df.columns:
        for w in wanted:
            if key(w) == key(c):
                own.setdefault(w, c)
    picked = df.select([F.col(f"`{own[w]}`").alias(w) if w in own else F.lit(None).cast("string").alias(w) for w in wanted])
    return picked.withColumn("doi", N.doi("doi")).where("doi <> ''")


def coerce(raw: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Records of text cells as the typed fields, with warnings (the optional cells that can't be read, and a missing name) and
    whether the record is rejected. Blank cells are null without a warning."""
    by_name = {"metal_type": N.atomic_number, "metal_ratio": N.ratio, "metal_valence": N.valence, "size_nm": N.size, "buffer_ph_value": N.condition, "temperature_c": N.condition}
    own = {k: f"_cell_{k}" for k in FIELDS}
    read = {k: F.col(c) if FIELDS[k] == _S else (by_name.get(k) or (N.flag if k.startswith("doped_") else N.quantity))(F.col(c)).cast(FIELDS[k]) for k, c in own.items()}
    # One step after the other, so that each cell is cleaned once and read once; Spark keeps steps apart whose results are used more than once.
    cleaned = raw.select(*[N.blank_to_null(k).alias(c) for k, c in own.items()], *(carry or []))
    typed = cleaned.select(*own.values(), *[x.alias(k) for k, x in read.items()], *(carry or []))
    lost = F.when(F.col("nanozyme").isNull(), F.lit("nanozyme"))
    bad = [F.when(F.col(c).isNotNull() & F.col(k).isNull(), F.lit(k)) for k, c in own.items() if FIELDS[k] != _S]
    return typed.select(*FIELDS, *(carry or []), F.array_compact(F.array(lost, *bad)).alias("warnings"), F.col("nanozyme").isNull().alias("rejected"))


@dataclass(frozen=True)
class Source:
    """How a source's columns become fields: names to try in order for each field, exponent columns, the unit of Vmax (None: µM/s,
    "?": not known), the activity where a row has none, and whether the substrate is written "A + B"."""

    provenance: str
    columns: dict[str, tuple[str, ...]]
    exponents: dict[str, str] = field(default_factory=dict)
    vmax_unit: str | None = None
    activity: str | None = None
    paired: bool = False


def map_source(df: DataFrame, source: Source, carry: list[str] | None = None) -> DataFrame:
    """A source's rows as typed fields with provenance, warnings and rejected; the first non-blank of a field's columns counts. Columns of
    carry stay as they are. Km is uncertain where the source writes its exponent apart and a row has none."""
    own = {c.strip().lower(): c for c in df.columns}
    named = lambda names: [F.col(f"`{own[n.strip().lower()]}`").cast("string") for n in names if n.strip().lower() in own]
    found = {k: F.coalesce(*map(N.blank_to_null, cs)) if (cs := named(source.columns.get(k, ()))) else F.lit(None).cast("string") for k in FIELDS}
    powers = {k: N.number(cs[0]) if (cs := named([c])) else F.lit(None).cast("double") for k, c in source.exponents.items()}
    if source.paired:
        wide = df.withColumn("_pair", found["substrate1"])
        df, (found["substrate1"], found["substrate2"]) = wide, pair_substrates("_pair")
    if source.activity:
        found["mimic_enzyme_activity"] = F.coalesce(found["mimic_enzyme_activity"], F.lit(source.activity))
    made = coerce(df.select(*[c.alias(k) for k, c in found.items()], *[c.alias(f"_power_{k}") for k, c in powers.items()], *(carry or [])), [*(f"_power_{k}" for k in powers), *(carry or [])])
    for k in powers:
        made = made.withColumn(k, N.rescale(k, f"_power_{k}"))
    made = made.withColumn("km_uncertain", F.col("_power_Km_mM").isNull() if "Km_mM" in powers else F.lit(False))
    if source.vmax_unit:
        made = made.withColumn("Vmax_uM_s_minus1", N.rescale("Vmax_uM_s_minus1", unit=F.lit(source.vmax_unit)))
    return made.drop(*[f"_power_{k}" for k in powers]).withColumn("provenance", F.lit(source.provenance))


def pair_substrates(c: str) -> tuple:
    """The two substrates of "A + B"."""
    parts = F.split(c, "\\s*\\+\\s*")
    return F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))


def write_papers(entries: DataFrame, path: str, buckets: int = 64) -> None:
    """Records by paper, partitioned by a bucket of the paper's hash: never a file per paper."""
    laid = entries.withColumn("file", F.regexp_replace("paper", "[^a-z0-9_.\\-]", "_")).withColumn("bucket", F.pmod(F.xxhash64("paper"), F.lit(buckets)).cast("int"))
    laid.repartition("bucket").sortWithinPartitions("file").write.partitionBy("bucket").parquet(path)


def write_register(register: DataFrame, path: str) -> None:
    register.orderBy(F.desc("tier"), F.desc("fold"), "mat", "act", "sub").write.option("header", True).csv(path)


def write_lineage(matrix: DataFrame, gaps: DataFrame, conflicts: DataFrame, path: str) -> None:
    matrix.write.json(f"{path}/matrix")
    gaps.write.json(f"{path}/gaps")
    conflicts.write.option("header", True).csv(f"{path}/conflicts")


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges, and nodes with their degree."""
    edges.write.parquet(f"{path}/edges")
    edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")).write.parquet(f"{path}/nodes")
