"""Scalar normalisers as column expressions: names, identifiers, quantities, units. All tolerate nulls and bad cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import ATTRIBUTES, NUMBERS

# Activity names and their short forms.
ACTIVITIES = {
    "peroxidase": "peroxidase", "pod": "peroxidase", "oxidase": "oxidase", "oxd": "oxidase", "catalase": "catalase", "cat": "catalase", "superoxide dismutase": "superoxide dismutase", "sod": "superoxide dismutase",
    "glutathione peroxidase": "glutathione peroxidase", "gpx": "glutathione peroxidase", "apx": "ascorbate peroxidase", "ascorbate peroxidase": "ascorbate peroxidase", "haloperoxidase": "haloperoxidase",
    "nadh oxidase": "nadh oxidase", "nox": "nadh oxidase", "glucose oxidase": "glucose oxidase", "nitric oxide synthase": "nitric oxide synthase", "nos": "nitric oxide synthase",
}
# Atomic numbers of the metals that the schema knows.
ATOMIC = {"Fe": 26, "Mn": 25, "Co": 27, "Au": 79, "Pt": 78, "Pd": 46, "Ag": 47, "Ce": 58, "Cu": 29, "Ni": 28, "Zn": 30, "Ti": 22, "V": 23, "Cr": 24, "Al": 13, "Mo": 42, "Ru": 44, "Rh": 45, "Ir": 77, "Os": 76, "Bi": 83, "La": 57, "Pr": 59, "Nd": 60}
# Elements recognised in a material name, two letters before one.
ELEMENTS = (
    "Se Cu Au Ag Fe Co Mn Pt Pd Ce Zn Ni Bi Sn Pb Sb In Ga Ge Mo Ru Rh Ir Os Re Hf Nb Ta Te Po As Cd Hg Tl Be Mg Ca Sr Ba Li Na Al Si Sc La Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Ti Cr S O N P C B F I K V W Y"
).split()
# Suffixes of material names, in order.
SUFFIXES = ("nps", "ncs", "nanoparticles", "nanozyme", "cds", "nanosheets", "nanorods", "nanotubes", "nanoflowers", "particles", "dots")
# Unit texts that a quantity may hold, in the order in which they are tried.
UNITS = ("mM", "nM", "μM", "uM", "μm", "µm", "Å", "pm", "umol/L", "mmol/L", "nm", "nmol/L", "℃", "°C", "s⁻¹", "min⁻¹", "M⁻¹", "L/mol", "mol/L")
# Short forms of activities, and names of media and shapes, that mean the same when two records are compared.
COMPARED_ACTIVITIES = {"sod": "superoxide dismutase", "pod": "peroxidase", "cat": "catalase", "gox": "glucose oxidase", "lope": "laccase-like", "oxd": "oxidase"}
MEDIA = {
    "acetate buffer": ("naac-hac buffer", "hac-naac buffer", "naac-hac", "hac-naac", "sodium acetate buffer", "na acetate buffer", "sodium acetate", "naac buffer", "naac", "acetate", "acetate buffer solution"),
    "tris hcl": ("tris-hcl", "tris/hcl buffer", "tris-hcl buffer"),
    "tris borate": ("tris-borate",),
    "phosphate buffer": ("pbs", "pbs buffer", "nah2po4 buffer"),
}
SHAPES = {
    "sphere": ("spherical", "spheroidal"), "nanorod": ("rod",), "nanowire": ("wire",), "nanotube": ("tube",), "nanosheet": ("sheet", "nanoflake", "flake", "flake-like"), "nanoplate": ("plate",),
    "nanoparticle": ("particle",), "nanodendrite": ("nanodendrities",), "nanocube": ("cubic", "cube-like", "cubelike"), "nanobean": ("bean-like", "beanlike"), "nanostar": ("star",), "nanobar": ("bar",),
}
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: Mapping) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _col(c))


def blank_to_null(c: Column | str) -> Column:
    s = F.trim(_col(c))
    return F.when(s != "", s)


def doi(c: Column | str) -> Column:
    """Without resolver prefix, "doi:" and trailing dots, lower case; empty for null."""
    s = F.regexp_replace(F.trim(_col(c)), "(?i)^https?://(dx\\.)?doi\\.org/", "")
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(s, "(?i)^doi:\\s*", ""), "\\.+$", "")), F.lit(""))


def alnum_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def space_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(c)), "(?U)\\s+", " "))


def activity(c: Column | str) -> Column:
    """The canonical activity: by alias, by alias without "-like" or " like", else the lower-case name."""
    low = F.lower(F.trim(_col(c)))
    stripped = F.trim(F.regexp_replace(low, "[- ]like$", ""))
    return F.when(low != "", F.coalesce(lookup(low, ACTIVITIES), lookup(stripped, ACTIVITIES), F.when(stripped != "", stripped)))


def _alias(c: Column | str, names: Mapping) -> Column:
    low = F.lower(blank_to_null(c))
    return F.coalesce(lookup(low, {a: name for name, others in names.items() for a in others}), low)


def medium_alias(c: Column | str) -> Column:
    return _alias(c, MEDIA)


def shape_alias(c: Column | str) -> Column:
    return _alias(c, SHAPES)


def activity_alias(c: Column | str) -> Column:
    """An activity for comparison: a short form in full, also where it opens a name with "like" in it; else without "-like"."""
    low = F.lower(blank_to_null(c))
    opened = [F.when(low.startswith(a) & low.contains("like"), F.lit(name)) for a, name in COMPARED_ACTIVITIES.items()]
    return F.coalesce(lookup(low, COMPARED_ACTIVITIES), *opened, F.when(low.endswith("-like"), F.trim(F.regexp_replace(low, "-like$", ""))), low)


def activity_class(c: Column | str) -> Column:
    s = F.lower(F.coalesce(_col(c), F.lit("")))
    return (
        F.when(s.contains("superoxide") | (s == "sod"), "SOD").when(s.contains("catalase") | (s == "cat"), "CAT").when(s.contains("peroxidase") | (s == "pod"), "POD").when(s.contains("oxidase") | (s == "oxd"), "OXD").otherwise("OTHER")
    )


def substrate_class(*cols: Column | str) -> Column:
    """A code for the first non-blank of the columns; OTHER_SUB if it is none of the known ones, NO_SUB if all are blank."""
    first = F.coalesce(*[F.when(~F.lower(F.trim(_col(c))).isin("", "nan", "none", "null"), F.lower(_col(c))) for c in cols])
    known = F.when(first.isNull(), "NO_SUB")
    for token, code in (("tmb", "TMB"), ("abts", "ABTS"), ("h2o2", "H2O2"), ("opd", "OPD"), ("dopamine", "DA"), ("ascorb", "AA")):
        known = known.when(first.contains(token), code)
    return known.otherwise("OTHER_SUB")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column | str) -> Column:
    """A numeric cell: trimmed, thousands commas dropped; null if it is no finite number."""
    return finite(F.regexp_replace(F.trim(_col(c)), ",", "").try_cast("double"))


def scientific(c: Column | str) -> Column:
    """``1.664×10⁻⁷`` as ``1.664e-7``; other superscripts stay."""
    s = _col(c)
    pattern = "(?s)^(.*?)([0-9.]+)\\s*[×x·]\\s*10([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)(.*)$"
    g = [F.regexp_extract(s, pattern, i) for i in range(1, 5)]
    return F.when(s.rlike(pattern), F.concat(g[0], g[1], F.lit("e"), F.translate(g[2], *SUPERSCRIPTS), g[3])).otherwise(s)


def quantity(c: Column | str) -> Column:
    """The value of "value unit" or "value ± error": parsed, else parsed without units, wherever they stand, else the first number that is then left."""
    s = F.trim(F.split(scientific(c), "±")[0])
    bare = F.regexp_replace(s, "(?iu)\\s*(" + "|".join(UNITS) + ")\\s*", "")
    first = F.regexp_extract(bare, "[-+]?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?", 0)
    return F.coalesce(finite(s.try_cast("double")), finite(bare.try_cast("double")), finite(first.try_cast("double")))


def size(c: Column | str) -> Column:
    """A quantity; a range such as "10-20 nm" gives its mean to two places."""
    s, span = _col(c), "^\\s*([0-9.]+)\\s*[-–]\\s*([0-9.]+)"
    a, b = (F.regexp_extract(s, span, i).try_cast("double") for i in (1, 2))
    return F.coalesce(F.round((a + b) / 2, 2), quantity(s))


def condition(c: Column | str) -> Column:
    """A pH or temperature: room and body temperature by name, a plain value, or the first part of a list that has one."""
    low = F.lower(F.trim(_col(c)))
    parts = F.split(low, "[,;~]|(?<=\\d)-")
    values = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, "[-+]?[0-9]*\\.?[0-9]+", 0).try_cast("double")), lambda v: v.isNotNull())
    return F.when(low.contains("room temp"), 25.0).when(low.contains("body temp"), 37.0).otherwise(F.coalesce(low.try_cast("double"), F.get(values, 0)))


def atomic_number(c: Column | str) -> Column:
    """27 for "Co(27)", "27" and "Co"; null for texts that are no symbol of ATOMIC in their first two characters."""
    s = F.trim(_col(c))
    own = F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.lower(F.substr(s, F.lit(2), F.lit(1))))
    return F.coalesce(F.regexp_extract(s, "\\((\\d+)\\)", 1).try_cast("int"), F.when(s.rlike("^\\d+$"), s.try_cast("int")), lookup(own, ATOMIC))


def symbol(c: Column | str) -> Column:
    """The element of that atomic number; null for others and for what is no number."""
    return lookup(_col(c).try_cast("int"), NUMBERS)


def ratio(c: Column | str) -> Column:
    """A plain number; the first share of "A:B[:C]" in per cent; the number of "50%"."""
    s = F.trim(_col(c))
    tail = F.regexp_replace(s, "^.*=", "")
    parts = F.transform(F.split(tail, ":"), lambda p: F.regexp_extract(p, "[0-9]*\\.?[0-9]+", 0).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    share = F.when(tail.contains(":") & (total > 0), F.round(F.get(parts, 0) / total * 100, 2))
    return F.coalesce(s.try_cast("double"), share, F.regexp_extract(s, "^([0-9.]+)\\s*%", 1).try_cast("double"))


def valence(c: Column | str) -> Column:
    return F.array_max(F.transform(F.regexp_extract_all(_col(c), F.lit("(\\d+)"), 1), lambda x: x.try_cast("int")))


def flag(c: Column | str) -> Column:
    """A doping cell as 1, 0 or null."""
    low = F.lower(F.trim(_col(c)))
    return F.when(low == "", None).when(low.isin("n", "p", "s", "b", "f", "yes", "true", "y", "1"), 1).when(low.isin("no", "false", "0"), 0).otherwise(low.try_cast("double").cast("int"))


def rescale(value: Column | str, exponent: Column | str | None = None, unit: Column | None = None) -> Column:
    """value × 10^exponent; mM/s to µM/s; null where the unit is unknown ("?")."""
    v = _col(value)
    if exponent is not None:
        v = v * F.pow(F.lit(10.0), F.coalesce(_col(exponent), F.lit(0.0)))
    return v if unit is None else F.when(unit == "?", None).when(unit == "mM/s", v * 1000.0).otherwise(v)


def evaluation_name(c: Column | str) -> Column:
    """A material name for matching: lower case, dashes unified, suffixes and punctuation dropped; with its suffix if under
    three characters are left."""
    low = F.translate(F.lower(F.trim(_col(c))), "‐‑‒–—−", "------")
    bare = low
    for s in SUFFIXES:
        bare = F.regexp_replace(bare, f" ?{s}$", "")
    plain = lambda x: F.translate(x, " \t\n\x0b\f\r,-_/@().", "")
    # Most names have no suffix: one test spares them the eleven replacements.
    short = plain(F.when(low.rlike("(" + "|".join(SUFFIXES) + ")$"), bare).otherwise(low))
    return F.when(F.length(short) < 3, plain(low)).otherwise(short)


def _by_initial() -> str:
    """A pattern for ELEMENTS that looks at a letter once: the initial, then what may follow it."""
    tails: dict[str, str] = {}
    for e in ELEMENTS:
        tails[e[0]] = tails.get(e[0], "") + e[1:]
    one = [f"{x}[{t}]{'?' if x in ELEMENTS else ''}" if t else x for x, t in tails.items()]
    return f"((?=[{''.join(tails)}])(?:{'|'.join(one)}))"


_ELEMENT = _by_initial()


def element_set(c: Column | str) -> Column:
    """The elements named in a material name, without brackets and one suffix, as a sorted array."""
    s = F.regexp_replace(_col(c), "\\([^)]*\\)", "")
    s = F.regexp_replace(s, "(?i) ?(" + "|".join(SUFFIXES) + ")$", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(_ELEMENT), 1)))


def metal(metal_type: Column | str, name: Column | str) -> Column:
    """The main metal's symbol: of the metal column up to a dash, else the leading known element of the name."""
    own = blank_to_null(metal_type)
    lead = F.regexp_extract(_col(name), "^([A-Z][a-z]?)", 1)
    return F.coalesce(F.when(~F.lower(own).isin("nan", "none", "null", "0"), F.trim(F.split(own, "-")[0])), F.when(lead.isin(*ATTRIBUTES), lead))


def clipped_log(c: Column | str) -> Column:
    return F.log10(F.greatest(_col(c), F.lit(1e-6)))


#: The words of a name that tell a variant's shape or size.
VARIANT_WORDS = ("nc", "nrs", "nus", "nps", "nws", "nds", "omc", "nfs", "ons", "mcs")


def family(c: Column | str) -> Column:
    """A name without percentages, zero-led numbers and size or shape words: the key of a material's variants."""
    s = F.regexp_replace(_col(c), "[0-9]+(\\.[0-9]+)?\\s*%", "")
    s = F.regexp_replace(s, "\\b0[0-9]+\\b", "")
    s = F.regexp_replace(s, "(?i)\\b(" + "|".join(VARIANT_WORDS) + ")\\b", "")
    return F.regexp_replace(F.lower(s), "[^a-z0-9]", "")


def severity(spread: Column) -> Column:
    return F.when(spread > 1.0, "severe").when(spread >= 0.3, "suspicious").otherwise("consistent")


def magnitude_hint(fold: Column, within: float = 0.1) -> Column:
    """×10?, ×100? or ×1000? where the fold is that close to it."""
    found = F.lit(None).cast("string")
    for step in (1000, 100, 10):
        found = F.when(F.abs(fold - step) / step <= within, f"×{step}?").otherwise(found)
    return found
