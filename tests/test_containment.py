"""Names that hold asked texts, files of papers, and leave-one-out extremes, by brute force."""

import random
import re

from measureaudit.operators.containment import containing, paper_files
from measureaudit.plans import network


def test_containing_is_brute_force(spark):
    r = random.Random(4)
    names = ["".join(r.choice("abcé2 ") for _ in range(r.randrange(0, 12))) for _ in range(150)] + ["ceo2", "ceo2@c", "au", "a", None, ""]
    asked = [n[i : i + r.randrange(1, 6)] for n in names if n for i in [r.randrange(len(n))]] + ["zzz", "zzzz", "", None, "ceo2", "CeO2", "%", "a_"]
    a, b = spark.createDataFrame([(x,) for x in asked * 2], "asked string"), spark.createDataFrame([(x,) for x in names * 2], "name string")
    got = [tuple(x) for x in containing(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, n) for x in set(asked) if x for n in set(names) if n and x in n}
    assert containing(a.limit(0), b).count() == containing(a, b.limit(0)).count() == 0


def test_files_of_papers_are_brute_force(spark):
    dois = ["10.1/acs.6b05354", "10.1/C9CC00199A", "10.1/j.b.2020.1", "10.1/x-8b20942", "10.1/none", "10.1/ab.c"]
    files = [("a/1", "acs6b05354.pdf"), ("a/2", "ACS_6b-05354 si.pdf"), ("a/3", "c9cc00199a.pdf"), ("a/4", "paper 8B20942.pdf"), ("a/5", "abc_1.pdf"), ("a/6", "a.b.c.pdf"), ("a/7", "xabcx.pdf"), ("a/8", "Abc abc.pdf"), ("a/9", "jb20201.pdf")]
    want = []
    for d in dois:
        tail = d.split("/")[-1]
        found = [(p, 1) for p, n in files if tail.replace(".", "") in re.sub("[._ -]", "", n)]
        last = re.split(r"[.\-]", tail)[-1]
        if not found and len(last) >= 5:
            found = [(p, 2) for p, n in files if last.lower() in n.lower()]
        want += [(d, *x) for x in sorted(found)[:3]]
    got = paper_files(spark.createDataFrame([(d,) for d in dois * 2], "doi string"), spark.createDataFrame(files, "path string, name string")).collect()
    assert sorted(tuple(x) for x in got) == sorted(want) and {t for *_, t in want} == {1, 2} and len(want) == 7


def test_leave_one_paper_out_is_brute_force(spark):
    r = random.Random(9)
    rows = [("m" + r.choice("ab"), "x" + r.choice("12"), "s", 4 + 0.25 * r.randrange(8), 20.0 + 2 * r.randrange(8), f"p{r.randrange(4)}", 10 ** r.uniform(-2, 2)) for _ in range(120)]
    rows += [("lone", "x1", "s", 4.0, 20.0, "p0", 1.0), ("lone", "x1", "s", 4.0, 20.0, "p0", 5.0)]
    got = {x.act: x for x in network.coverage(spark.createDataFrame(rows, "mat string, act string, sub string, ph double, t double, paper string, km_mm double")).collect()}
    for act in ("x1", "x2"):
        own, folds = [x for x in rows if x[1] == act], []
        for m, _, _, ph, t, paper, _ in own:
            kms = [k for m2, _, _, p2, t2, q2, k in own if m2 == m and q2 != paper and abs(ph - p2) <= 0.5 and abs(t - t2) <= 5]
            if kms:
                folds.append(max(kms) / min(kms))
        folds.sort()
        at = lambda q: folds[int(q * (len(folds) - 1))] + (q * (len(folds) - 1) % 1) * (folds[min(len(folds) - 1, int(q * (len(folds) - 1)) + 1)] - folds[int(q * (len(folds) - 1))])
        x = got[act]
        assert (x.n_rows, x.n_hit) == (len(own), len(folds)) and abs(x.fold_median - at(0.5)) < 1e-5 * at(0.5) + 1e-5 and abs(x.fold_p90 - at(0.9)) < 1e-5 * at(0.9) + 1e-5
        assert abs(x.share_wide - sum(f > 3 for f in folds) / len(folds)) < 1e-5
