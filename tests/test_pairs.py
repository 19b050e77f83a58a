"""Which records a reference group is held against."""

from measureaudit.operators import evaluate as E

SIDE = "rec_id string, doi string, material string, act string, " + ", ".join(f"{f} {'int' if f in E.FLAGS else 'double' if f in E.NUMBERS else 'string'}" for f in E.FIELDS if f not in ("material", "act"))


def side(spark, rows):
    return spark.createDataFrame([(i, "d", m, a, *[None] * (len(E.FIELDS) - 2)) for i, m, a in rows], SIDE)


def test_a_paper_of_many_named_materials_is_no_square(spark):
    names = [f"{chr(97 + k)}{chr(98 + k)}{chr(99 + k)}qqqq" for k in range(20)]
    g, s = side(spark, [(f"g{k}", m, "oxidase") for k, m in enumerate(names)]), side(spark, [(f"s{k}", m.upper() + " NPs", "oxidase") for k, m in enumerate(names)])
    assert E.pairs(g, s).count() == 20
    got = {r.g_id: (r.s_id, r.tier, r.score) for r in E.best_records(g, s).collect()}
    assert got == {f"g{k}": (f"s{k}", 1, 2) for k in range(20)}


def test_a_group_without_its_name_meets_all_records(spark):
    # "CeO2-Fe" has its elements in s1 alone, which is alike but of no nearer tier: the best is the one with the most equal fields.
    g = side(spark, [("g1", "CeO2-Fe", "oxidase"), ("g2", "ceo2 fe", "catalase"), ("g3", "zzz", "oxidase")])
    s = side(spark, [("s1", "FeCeO", "catalase"), ("s2", "other", "oxidase"), ("s3", "zzz x", "pod"), ("s4", "zzz", None)])
    got = {r.key: (r.g_id, r.s_id, r.tier, r.score) for r in E.best_records(g, s).collect()}
    assert got == {"ceo2fe": ("g1", "s2", 3, 1), "zzz": ("g3", "s4", 1, 1)}
    assert E.pairs(g, s).where("g_key = 'ceo2fe'").count() == 8 and E.pairs(g, s).where("g_key = 'zzz'").count() == 2
