"""The live store: batches read what they touch, may be run again, and add up to one run over all rows."""

import random
import re

from pyspark.sql import functions as F

from measureaudit.operators import conflicts as C
from measureaudit.store import fresh_path
from measureaudit.streaming import live

SCHEMA = "rec_id string, provenance string, material string, mat string, act string, sub string, ph double, t double, doi string, paper string, metric string, value double"
PICK = [*C.KEYS, "ph", "t", "n_values", "n_papers", "fold", "severity"]


def rows(seed, n, mats):
    r = random.Random(seed)
    return [(f"{seed}-{k}", "h", m.upper(), m, "ox", "tmb", 4 + 0.1 * r.randrange(4), 25.0, f"d{r.randrange(5)}", f"d{r.randrange(5)}", "km", 10 ** r.uniform(-2, 2)) for k in range(n) for m in [r.choice(mats)]]


def test_batches_touch_their_buckets_and_add_up(spark):
    store = fresh_path(spark, "store")
    one, two = rows(1, 120, [f"m{k}" for k in range(20)]), rows(2, 30, ["m3", "new"])
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    live.add_batch(df(one), 0, store, 16)
    files = spark.read.parquet(f"{store}/clusters").inputFiles()
    live.add_batch(df(two), 1, store, 16)
    touched = {r.bucket for r in live.with_bucket(df(two), 16).select("bucket").distinct().collect()}
    read = live.values_of(spark, store, sorted(touched), 1)
    files_read = [r[0] for r in read.select(F.input_file_name()).distinct().collect()]
    assert len(touched) <= 2 and all(any(f"bucket={b}/" in f for b in touched) for f in files_read) and read.count() < 75
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", read._jdf.queryExecution().executedPlan().toString())
    # Clusters of other buckets are the files of before.
    after = spark.read.parquet(f"{store}/clusters").inputFiles()
    other = lambda fs: sorted(f for f in fs if not any(f"bucket={b}/" in f for b in touched))
    assert other(after) == other(files) and len(other(after)) >= 8
    want = sorted(tuple(r) for r in C.conflict_clusters(df(one + two)).select(*PICK).collect())
    got = lambda: sorted(tuple(r) for r in live.clusters(spark, store).select(*PICK).collect())
    assert got() == want and len(want) > 20
    live.add_batch(df(two), 1, store, 16)  # once more, as after a failure
    assert got() == want
    live.add_batch(df(two).limit(0), 2, store, 16)
    assert got() == want
