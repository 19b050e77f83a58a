import itertools
import random
import statistics

from measureaudit.operators.cluster import condition_clusters, greedy
from measureaudit.operators.evaluate import matching


def naive(rows, ph_tol=0.2, t_tol=2.0):
    """First fit over all rows in (pH, T) order, medians taken anew each time."""
    clusters = []
    for ph, t in sorted(rows):
        for c in clusters:
            if abs(ph - statistics.median(p for p, _ in c)) <= ph_tol and abs(t - statistics.median(x for _, x in c)) <= t_tol:
                c.append((ph, t))
                break
        else:
            clusters.append([(ph, t)])
    return {p: k for k, c in enumerate(clusters) for p in c}


def test_greedy_on_distinct_points_is_first_fit():
    rnd = random.Random(3)
    for _ in range(400):
        rows = [(rnd.randrange(30, 50) / 10, rnd.randrange(20, 30) / 1.0) for _ in range(rnd.randrange(1, 25))]
        want = naive(rows)
        points = sorted((p, t, rows.count((p, t))) for p, t in set(rows))
        got = dict(zip([(p, t) for p, t, _ in points], greedy(points), strict=True))
        assert len({(got[p], want[p]) for p in got}) == len(set(got.values())) == len(set(want.values()))


def test_islands_and_helper_agree_with_first_fit(spark):
    rnd = random.Random(5)
    rows = [(f"m{k}", rnd.randrange(30, 60) / 10, rnd.randrange(20, 34) / 1.0) for k in range(6) for _ in range(30)]
    out = condition_clusters(spark.createDataFrame(rows, "mat string, ph double, t double"), ["mat"]).collect()
    for m in {r[0] for r in rows}:
        want = naive([(p, t) for x, p, t in rows if x == m])
        got = {(r.ph, r.t): (r.c_ph, r.c_t) for r in out if r.mat == m}
        assert set(got) == set(want)
        assert len({(got[p], want[p]) for p in got}) == len(set(got.values())) == len(set(want.values()))


def test_clusters_skip_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, 25.0), ("a", 7.0, None), ("a", 7.0, 25.0), ("a", 7.0, 25.0)], "mat string, ph double, t double")
    assert [tuple(r) for r in condition_clusters(df, ["mat"]).collect()] == [("a", 7.0, 25.0, 2, 7.0, 25.0)]
    assert condition_clusters(df.where("false"), ["mat"]).count() == 0


def brute(edges):
    best = 0
    for k in range(len(edges), 0, -1):
        for some in itertools.combinations(edges, k):
            if len({a for a, _ in some}) == len({b for _, b in some}) == k:
                return k
    return best


def test_matching_is_maximum():
    rnd = random.Random(1)
    for _ in range(200):
        edges = sorted({(rnd.randrange(4), rnd.randrange(4)) for _ in range(rnd.randrange(0, 9))})
        assert matching(edges) == brute(edges)
