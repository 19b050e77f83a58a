"""Greedy condition clusters: points in (pH, T) order join the first cluster whose medians are within tolerance."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PH_TOL, T_TOL = 0.2, 2.0


class _Rising:
    """The median of counted values that come in ascending order: their running counts are all that is kept."""

    def __init__(self):
        self.values: list[float] = []
        self.upto: list[int] = []

    def add(self, value: float, n: int) -> None:
        self.values.append(value)
        self.upto.append(n + (self.upto[-1] if self.upto else 0))

    @property
    def now(self) -> float:
        n = self.upto[-1]
        low, high = (self.values[bisect.bisect_right(self.upto, k)] for k in ((n - 1) // 2, n // 2))
        return high if low == high else (low + high) / 2


class _Counted:
    """The median of counted values in any order, all of them among `places` (sorted): a binary indexed tree of counts, of the places between the
    smallest and the largest value so far at most."""

    def __init__(self, places: list[float]):
        self.places, self.tree, self.total = places, {}, 0
        self.top = 1 << (len(places).bit_length() - 1)

    def add(self, value: float, n: int) -> None:
        self.total += n
        k = bisect.bisect_left(self.places, value) + 1
        while k <= len(self.places):
            self.tree[k] = self.tree.get(k, 0) + n
            k += k & -k

    def _at(self, rank: int) -> float:
        k, step, left = 0, self.top, rank
        while step:
            if k + step <= len(self.places) and self.tree.get(k + step, 0) <= left:
                k += step
                left -= self.tree.get(k, 0)
            step >>= 1
        return self.places[k]

    @property
    def now(self) -> float:
        low, high = self._at((self.total - 1) // 2), self._at(self.total // 2)
        return high if low == high else (low + high) / 2


def greedy(points: list[tuple[float, float, int]], ph_tol: float = PH_TOL, t_tol: float = T_TOL) -> list[int]:
    """The cluster number of each (pH, T, count), given in (pH, T) order: the first cluster whose medians are within both tolerances, else a new
    one.

    pH only rises, so a cluster whose pH median has fallen behind is closed for good. Open ones are kept in the order of their T medians;
    a point looks among those within tolerance of its T."""
    places = sorted({t for _, t, _ in points})
    ph_of: list[_Rising] = []
    t_of: list[_Counted] = []
    open_: list[tuple[float, int]] = []  # (T median, cluster)
    out = []
    for ph, t, n in points:
        at, found, closed = bisect.bisect_left(open_, (t - t_tol * (1 + 1e-9) - 1e-9, -1)), -1, []
        for k in range(at, len(open_)):
            mid, c = open_[k]
            if mid > t + t_tol * (1 + 1e-9) + 1e-9:
                break
            behind = ph - ph_of[c].now
            if behind > ph_tol:
                closed.append(k)
            elif abs(behind) <= ph_tol and abs(t - mid) <= t_tol and (found < 0 or c < open_[found][1]):
                found = k
        c = open_[found][1] if found >= 0 else len(ph_of)
        if found < 0:
            ph_of.append(_Rising())
            t_of.append(_Counted(places))
        else:
            closed.append(found)
        for k in sorted(closed, reverse=True):
            del open_[k]
        ph_of[c].add(ph, n)
        t_of[c].add(t, n)
        bisect.insort(open_, (t_of[c].now, c))
        out.append(c)
    return out


def condition_clusters(rows: DataFrame, keys: list[str], ph: str = "ph", t: str = "t", ph_tol: float = PH_TOL, t_tol: float = T_TOL) -> DataFrame:
    """(keys, ph, t, n, c_ph, c_t): every distinct condition point of each key with its cluster, named by its first point.

    Rows with null pH or T are left out. Equal points always share a cluster, so only distinct points with counts are
    clustered. A gap over the tolerance, in pH or, within a pH island, in T, separates clusters for good; an island of one
    point is its own cluster, and only islands of several points go to the greedy helper.
    """
    points = rows.where(F.col(ph).isNotNull() & F.col(t).isNotNull()).groupBy(*keys, F.col(ph).alias("ph"), F.col(t).alias("t")).agg(F.count("*").alias("n"))

    def islands(df: DataFrame, by: list[str], col: str, tol: float, name: str) -> DataFrame:
        w = W.partitionBy(*by).orderBy(col)
        start = F.coalesce((F.col(col) - F.lag(col).over(w) > tol).cast("int"), F.lit(0))
        return df.withColumn("_s", start).withColumn(name, F.sum("_s").over(w.rangeBetween(W.unboundedPreceding, 0))).drop("_s")

    cut = islands(islands(points, keys, "ph", ph_tol, "_p"), [*keys, "_p"], "t", t_tol, "_q")
    sized = cut.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "_p", "_q")))
    alone = sized.where("_n = 1").select(*keys, "ph", "t", "n", F.col("ph").alias("c_ph"), F.col("t").alias("c_t"))
    several = sized.where("_n > 1").drop("_n")
    schema, names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in alone.schema), alone.columns

    def of(island: pd.DataFrame) -> pd.DataFrame:
        island = island.sort_values(["ph", "t"], ignore_index=True)
        k = greedy(list(zip(island["ph"], island["t"], island["n"], strict=True)), ph_tol, t_tol)
        first = pd.Series(range(len(k))).groupby(k).transform("min")
        island["c_ph"], island["c_t"] = island["ph"].iloc[first].to_numpy(), island["t"].iloc[first].to_numpy()
        return island[names]

    return alone.unionByName(several.groupBy(*keys, "_p", "_q").applyInPandas(of, schema))
