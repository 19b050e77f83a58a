"""Scoring an extracted table against a reference table: records matched per DOI, fields judged, errors graded.

Both sides are normalised once per row and joined once on DOI. A pair's field agreements travel as bits of one long, so that
the best record, the wide and the strict outcome of every field come from two aggregations over that one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..store import kept

# The fields that are compared, and their groups in reports.
GROUPS = {
    "identity": ("material", "act"), "doping": ("doped_n", "doped_p", "doped_s", "doped_b", "doped_f"), "metal": ("metal_type", "metal_ratio", "metal_valence"), "physical": ("shape", "size"),
    "conditions": ("medium", "ph", "t"), "kinetics": ("km", "vmax"),
}
FIELDS = tuple(f for fields in GROUPS.values() for f in fields)
FLAGS = GROUPS["doping"]
NUMBERS = ("metal_ratio", "metal_valence", "size", "ph", "t", "km", "vmax")
#: Fields whose values are given in results, as numbers.
GIVEN = (*FLAGS, *NUMBERS)
# Shapes that agree with any other under the agreement rule, and that rule's tolerance of sizes.
GENERIC_SHAPES, SIZE_TOLERANCE = ("nanoparticle", "polyhedral", "particle"), 0.3
# Classes of activities that a reference may name in place of one of theirs.
CLASSES = {
    "hydrolase": ("phosphodiesterase", "esterase", "protease", "lipase", "nuclease", "glycosidase", "peptidase", "phosphatase", "dnase", "rnase"),
    "oxidoreductase": ("oxidase", "peroxidase", "catalase", "superoxide dismutase", "ferroxidase", "glucose oxidase"),
}


def _either_inside(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def _near(g: Column, s: Column, within: float) -> Column:
    return F.abs(g - s) / F.greatest(F.abs(g), F.lit(1e-9)) < within


def _value(side: str, f: str) -> Column:
    return F.get(F.col(f"{side}_values"), GIVEN.index(f))


def standard(f: str) -> Column:
    """Numbers agree within a tenth of the reference, flags if equal, names and texts if one holds the other once normalised."""
    if f in GIVEN:
        g, s = _value("g", f), _value("s", f)
        return F.coalesce(g == s if f in FLAGS else _near(g, s, 0.1), F.lit(False))
    return F.coalesce(_either_inside(F.col(f"g_{f}"), F.col(f"s_{f}")), F.lit(False))


#: What the agreement rule says otherwise: metals agree by element, shapes also with a generic word and without aliases, sizes
#: within 30 %.
def _agreement() -> dict[str, Column]:
    g, s = F.col("g_form"), F.col("s_form")
    return {
        "metal_type": F.coalesce(F.col("g_metal") == F.col("s_metal"), F.lit(False)),
        "shape": F.coalesce((g.isin(*GENERIC_SHAPES) & s.isNotNull()) | (s.isin(*GENERIC_SHAPES) & g.isNotNull()) | _either_inside(g, s), F.lit(False)),
        "size": F.coalesce(_near(_value("g", "size"), _value("s", "size"), SIZE_TOLERANCE), F.lit(False)),
    }


def _mask(fields) -> int:
    return sum(1 << FIELDS.index(f) for f in fields)


def _bits(said: dict[str, Column]) -> Column:
    total = F.lit(0).cast("long")
    for f, c in said.items():
        total = total + F.when(c, F.lit(_mask([f])).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def normalised(df: DataFrame, p: str) -> DataFrame:
    """One row per record: doi, and under the prefix p the id, name key, elements and every field in comparable form; values has
    the fields of GIVEN, has the bits of the fields that are given, zero those of flags that are 0."""
    low = lambda c: F.lower(N.blank_to_null(c))
    metal = F.trim("metal_type")
    forms = {
        "key": N.evaluation_name(F.coalesce("material", F.lit(""))), "elements": N.element_set(F.coalesce("material", F.lit(""))), "id": F.col("rec_id"),
        "act": N.activity_alias("act"), "metal_type": low("metal_type"), "shape": N.shape_alias("shape"), "medium": N.medium_alias("medium"), "metal": F.coalesce(N.atomic_number(metal).cast("string"), metal), "form": low("shape"),
        "values": F.array(*[F.col(f).cast("double") for f in GIVEN]), "zero": _bits({f: F.col(f) == 0 for f in FLAGS}), "has": _bits({f: F.col(f).isNotNull() if f in GIVEN else N.blank_to_null(f).isNotNull() for f in FIELDS}),
    }
    made = df.select("doi", N.blank_to_null("material").isNotNull().alias("named"), *[c.alias(f"{p}_{name}") for name, c in forms.items()])
    return made.withColumn(f"{p}_material", F.when(F.col("named"), F.col(f"{p}_key"))).drop("named")


def alike() -> Column:
    """Whether a pair's names are of one material: one key in the other, or equal sets of two elements or more."""
    k, s = F.col("g_key"), F.col("s_key")
    return F.coalesce(((k != "") & (s != "") & _either_inside(k, s)) | ((F.size("g_elements") >= 2) & (F.col("g_elements") == F.col("s_elements"))), F.lit(False))


def pairs(gold: DataFrame, system: DataFrame) -> DataFrame:
    """normalised() reference rows, each with the records of its DOI that bear on its group (nulls where there are none); first marks a group's first
    row, beside which stand the values given by the group."""
    g, s = normalised(gold, "g").where("doi <> ''").repartition("doi"), kept(normalised(system, "s").where("doi <> ''"), "system")
    group = W.partitionBy("doi", "g_key").orderBy("g_id")
    # The first value that a group gives of each field stands beside its first row; a group is one paper's rows of a material.
    rows = F.collect_list("g_values").over(group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    place = lambda i: lambda v: F.get(v, i)
    given = F.array(*[F.get(F.filter(F.transform("rows", place(i)), lambda x: x.isNotNull()), 0) for i in range(len(GIVEN))])
    own = g.withColumn("first", F.row_number().over(group) == 1).withColumn("rows", rows).withColumn("given", F.when(F.col("first"), given)).drop("rows")
    # A group's first row says which names are alike. Where a record has the group's very name, records of other names can be neither its best nor
    # of its material: such pairs are not made.
    names = s.groupBy("doi").agg(F.collect_set("s_key").alias("names")).withColumnRenamed("doi", "n_doi")
    own = own.withColumn("g_elements", F.first("g_elements").over(group)).join(names, F.col("doi") == F.col("n_doi"), "left")
    own = own.withColumn("named", F.coalesce((F.col("g_key") != "") & F.array_contains("names", F.col("g_key")), F.lit(False))).drop("names", "n_doi")
    return own.join(s.withColumnRenamed("doi", "s_doi"), (F.col("doi") == F.col("s_doi")) & (~F.col("named") | alike()), "left").drop("s_doi")


def groups(gold: DataFrame, system: DataFrame) -> DataFrame:
    """One row per reference group, by DOI and name key, with its best system record and field bits.

    The best record is chosen by the group's first row: equal name keys, then one key inside the other, then any record of the
    DOI; then the most equal fields, then the first by id. hit has the fields in which any row of the group agrees with any
    record of the same material (else with the best one); strict those in which the first row agrees with the best record;
    agreed those in which any row agrees with it under the agreement rule, own under the standard one; has the values that the
    best record gives; present those that the group gives. Rows without DOI are left out; groups of a DOI without system
    records have a null s_id."""
    both = pairs(gold, system)
    bits = both.select(
        "doi", F.col("g_key").alias("key"), "g_id", "s_id", "first", "given", alike().alias("alike"), _bits({f: standard(f) for f in FIELDS}).alias("bits"), _bits(_agreement()).alias("apart"), F.coalesce("s_has", F.lit(0).cast("long")).alias("has"),
        F.col("g_has").alias("present"), "g_zero", F.col("s_values").alias("said"),
        F.when(F.col("s_id").isNotNull(), F.when(F.col("g_key") == F.col("s_key"), 1).when((F.col("g_key") != "") & (F.col("s_key") != "") & _either_inside(F.col("g_key"), F.col("s_key")), 2).otherwise(3)).alias("tier"),
    )
    # A missing flag agrees with "not doped" where one record is compared with one.
    flags, apart = F.lit(_mask(FLAGS)).cast("long"), F.lit((1 << len(FIELDS)) - 1 - _mask(_agreement())).cast("long")
    absent = F.when(F.col("s_id").isNotNull(), F.col("g_zero").bitwiseAND(flags).bitwiseAND(F.bitwise_not("has"))).otherwise(F.lit(0).cast("long"))
    marked = bits.withColumn("single", F.col("bits").bitwiseOR(absent)).withColumn("agree", F.col("bits").bitwiseAND(apart).bitwiseOR(F.col("apart")))
    head = lambda c: F.max(F.when(F.col("first"), F.col(c)))
    each = marked.groupBy("doi", "key", "s_id").agg(
        F.bit_or("bits").alias("bits"), F.bit_or("agree").alias("agree"), head("alike").alias("alike"), head("tier").alias("tier"), F.bit_count(head("single")).alias("score"), head("single").alias("single"), F.max("has").alias("has"),
        F.bit_or("present").alias("present"), head("g_id").alias("g_id"), F.max("said").alias("said"), F.max("given").alias("given"),
    )
    best = F.min_by(F.struct("s_id", "tier", "score", "single", "bits", "agree", "has", "said"), F.struct("tier", -F.col("score"), "s_id"))
    whole = each.groupBy("doi", "key").agg(
        F.max("g_id").alias("g_id"), F.bool_or("alike").alias("any_alike"), F.bit_or(F.when(F.col("alike"), F.col("bits")).otherwise(F.lit(0).cast("long"))).alias("wide"), best.alias("b"), F.max("present").alias("present"), F.max("given").alias("given")
    )
    return whole.select(
        "doi", "key", "g_id", "b.s_id", "b.tier", F.col("b.score").cast("int").alias("score"), F.when(F.col("any_alike"), F.col("wide")).otherwise(F.col("b.bits")).alias("hit"), F.col("b.single").alias("strict"),
        F.col("b.bits").alias("own"), F.col("b.agree").alias("agreed"), "b.has", "present", "given", "b.said",
    )


def best_records(gold: DataFrame, system: DataFrame) -> DataFrame:
    """(doi, key, g_id, s_id, tier, score): per reference group the system record of its first row."""
    return groups(gold, system).select("doi", "key", "g_id", "s_id", "tier", "score")


def outcomes(gold: DataFrame, system: DataFrame) -> DataFrame:
    """(doi, key, field, outcome, strict, own, agreed, s_id, gold_value, system_value): one row per reference group and field
    that the group gives. An outcome is tp where the rule says that the values agree, fn if the best record lacks the value,
    else fp. Values are numbers, null for texts."""
    value = lambda side, f: F.get(side, GIVEN.index(f)) if f in GIVEN else F.lit(None).cast("double")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("i"), value("given", f).alias("gold_value"), value("said", f).alias("system_value")) for i, f in enumerate(FIELDS)])
    on = lambda c: F.expr(f"shiftright({c}, c.i) & 1 = 1")
    judged = lambda c: F.when(on(c), "tp").when(on("has"), "fp").otherwise("fn").alias({"hit": "outcome"}.get(c, c))
    each = groups(gold, system).withColumn("c", F.explode(cells)).where(on("present"))
    return each.select("doi", "key", "c.field", *map(judged, ("hit", "strict", "own", "agreed")), "s_id", "c.gold_value", "c.system_value")


def counts(cells: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """tp, fp, fn with precision, recall, F1 and accuracy, per `by`."""
    n = lambda x: F.count_if(F.col(outcome) == x).alias(x)
    c = cells.groupBy(*by).agg(n("tp"), n("fp"), n("fn"))
    return c.select(*by, "tp", "fp", "fn", *scores())


def scores() -> list[Column]:
    """precision, recall, F1 and accuracy of the columns tp, fp, fn; 0 where a share has no base."""
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    shares = {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "accuracy": F.try_divide(tp, tp + fp + fn)}
    return [F.round(F.coalesce(x, F.lit(0.0)), 6).alias(name) for name, x in shares.items()]


def bundle_edges(gold: DataFrame, system: DataFrame) -> DataFrame:
    """(doi, g_id, s_id): pairs of one material that agree in activity, pH, T, Km and Vmax as far as the reference, a kinetic
    row, gives them. A class of activities agrees with each of its members."""
    g = normalised(gold, "g").where("doi <> ''").where(F.col("g_has").bitwiseAND(F.lit(_mask(GROUPS["kinetics"]))) != 0)
    act = standard("act")
    for name, members in CLASSES.items():
        act = act | ((F.col("g_act") == name) & F.coalesce(F.col("s_act").isin(*members), F.lit(False)))
    ok = alike() & (F.col("g_act").isNull() | act)
    for f in ("ph", "t", "km", "vmax"):
        ok = ok & (_value("g", f).isNull() | standard(f))
    return g.join(normalised(system, "s"), "doi").where(ok).select("doi", "g_id", "s_id")


def matching(edges: list[tuple[int, int]]) -> int:
    """The size of a maximum matching of a bipartite graph, by augmenting paths without recursion."""
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    of_left: dict[int, int] = {}
    of_right: dict[int, int] = {}
    for start in near:
        came: dict[int, int] = {}
        stack, end = [start], None
        while stack and end is None:
            a = stack.pop()
            for b in near[a]:
                if b in came:
                    continue
                came[b] = a
                if b not in of_right:
                    end = b
                    break
                stack.append(of_right[b])
        while end is not None:
            a = came[end]
            of_right[end], of_left[a], end = a, end, of_left.get(a)
    return len(of_right)
