import pytest
from pyspark.sql import functions as F

from measureaudit.functions import normalize as N

CASES = [
    (N.scientific, {"1.664×10⁻⁷": "1.664e-7", "2.5·10⁶": "2.5e6", "s⁻¹": "s⁻¹", None: None}),
    (N.atomic_number, {"Mn": 25, "Co(27)": 27, "27": 27, "Xx": None, None: None}),
    (N.ratio, {"Mn:Co=1:2": 33.33, "1:2": 33.33, "50%": 50.0, "x": None}),
    (N.valence, {"+3": 3, "3+": 3, "+2,+3": 3, "Mn2+/Mn3+": 3, "none": None}),
    (N.flag, {"yes": 1, "N": 1, "0": 0, "": None}),
    (N.condition, {"4.5, 7.0": 4.5, "pH 7.0": 7.0, "room temperature": 25.0, "37": 37.0}),
    (N.quantity, {"1.2 ± 0.1": 1.2, "0.5 mM": 0.5, "1.2e-3": 0.0012, "50nm": 50.0, "0.1-0.5": 0.1, "": None}),
    (N.size, {"10-20 nm": 15.0, "50 nm": 50.0}),
    (N.evaluation_name, {"AuNP-1": "aunp1", "AuNPs": "aunps", "Au–APC": "auapc", "Au−APC": "auapc", "Au-APC": "auapc"}),
    (N.number, {"1,234.5": 1234.5, " 7 ": 7.0, "nan": None, "inf": None}),
    (N.activity, {"POD": "peroxidase", "Peroxidase-like": "peroxidase", "catalase like": "catalase", "Other": "other", "": None}),
    (N.activity_class, {"sod": "SOD", "catalase": "CAT", "glutathione peroxidase": "POD", "oxidase": "OXD", None: "OTHER"}),
]


@pytest.mark.parametrize("fn,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_literal_cases(spark, fn, cases):
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r[0]: r[1] for r in df.select("raw", fn("raw")).collect()}
    assert got == cases


def test_grades(spark):
    row = spark.range(1).select(*[N.severity(F.lit(x)) for x in (1.0, 1.01, 0.3, 0.29)], *[N.magnitude_hint(F.lit(x)) for x in (950.0, 94.87, 13.0)]).first()
    assert list(row) == ["suspicious", "severe", "suspicious", "consistent", "×1000?", "×100?", None]


def test_element_sets(spark):
    df = spark.createDataFrame([("CuSe",), ("Cu3Se2",), ("Fe3O4 (GSH) NPs",)], "n string")
    assert [r[0] for r in df.select(N.element_set("n")).collect()] == [["Cu", "Se"], ["Cu", "Se"], ["Fe", "O"]]
