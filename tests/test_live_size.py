"""A large bucket of the live store is cut into several tasks; the clusters stay those of one run."""

from pyspark.sql import functions as F

from measureaudit.operators import conflicts as C
from measureaudit.store import fresh_path
from measureaudit.streaming import live

from .test_live import PICK, SCHEMA, rows


def test_a_large_bucket_is_several_files(spark):
    store, df = fresh_path(spark, "store"), spark.createDataFrame(rows(5, 3000, ["m1"]), SCHEMA)
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        live.add_batch(df.repartition(20), 0, store, 4)
    finally:
        for k in names:
            spark.conf.unset(k)
    read = spark.read.parquet(f"{store}/values")
    assert read.select("bucket").distinct().count() == 1 and read.select(F.input_file_name()).distinct().count() > 3
    want = sorted(tuple(r) for r in C.conflict_clusters(df).select(*PICK).collect())
    assert sorted(tuple(r) for r in live.clusters(spark, store).select(*PICK).collect()) == want and want
