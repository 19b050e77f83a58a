"""Greedy clusters against the plain rule, and islands of many points."""

import random
import statistics
import time

import pytest

from measureaudit.operators import cluster


def plain(points, ph_tol, t_tol):
    clusters, out = [], []
    for ph, t, n in points:
        for k, (a, b) in enumerate(clusters):
            if abs(ph - statistics.median(a)) <= ph_tol and abs(t - statistics.median(b)) <= t_tol:
                break
        else:
            k = len(clusters)
            clusters.append(([], []))
        clusters[k][0].extend([ph] * n)
        clusters[k][1].extend([t] * n)
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_greedy_is_the_first_fit(seed):
    r = random.Random(seed)
    step = r.choice((0.01, 0.05, 0.1, 0.0137))
    points = {(round(4 + step * r.randrange(60), 6), round(25 + r.choice((0.5, 1.0, 0.3)) * r.randrange(25), 6)): r.choice((1, 1, 2, 7)) for _ in range(r.randrange(1, 160))}
    own = [(*p, n) for p, n in sorted(points.items())]
    assert cluster.greedy(own) == plain(own, 0.2, 2.0)
    assert cluster.greedy(own, 0.05, 6.0) == plain(own, 0.05, 6.0)


def test_an_island_of_many_points_with_large_counts():
    r = random.Random(1)
    own = sorted({(round(r.uniform(3, 9), 4), round(r.uniform(20, 80), 3)) for _ in range(100_000)})
    began = time.process_time()
    got = cluster.greedy([(*p, 10**6) for p in own])
    assert time.process_time() - began < 60 and len(got) == len(own)
    assert cluster.greedy([(*p, 1) for p in own[:2000]]) == cluster.greedy([(*p, 10**6 + 1) for p in own[:2000]])
