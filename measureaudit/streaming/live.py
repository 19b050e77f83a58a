"""A live audit: as records arrive, only the buckets of systems that they touch are read and clustered anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts as C

#: A store deals its systems to so many buckets, by a hash; a store keeps the number that it was made with.
BUCKETS = 64
#: Ids are hexadecimal: half their bytes say nothing, and only a codec that counts bytes notices.
CODEC = "zstd"
_DYNAMIC = {"partitionOverwriteMode": "dynamic"}


def with_bucket(values: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return values.withColumn("bucket", F.pmod(F.xxhash64(*C.KEYS), F.lit(buckets)).cast("int"))


def values_of(spark: SparkSession, store: str, touched: list[int], number: int) -> DataFrame:
    """The values of some buckets as of a batch. Other buckets' files are not listed for reading: bucket is a partition of the table."""
    return spark.read.parquet(f"{store}/values").where(F.col("bucket").isin(touched) & (F.col("batch") <= number)).drop("batch")


def add_batch(rows: DataFrame, number: int, store: str, buckets: int = BUCKETS) -> None:
    """Put a batch's rows (long-form values) into the store and replace the clusters of the buckets that they touch.

    Both writes overwrite whole partitions, (bucket, batch) of the values and bucket of the clusters, so a batch that is run again after a
    failure leaves the same store. An empty batch changes nothing. A task writes one bucket's rows or a part of them: rebalancing cuts a
    bucket that is large, so that no task's rows grow with the store."""
    session = rows.sparkSession
    own = with_bucket(rows, buckets).withColumn("batch", F.lit(number))
    own.hint("rebalance", "bucket").write.mode("overwrite").options(**_DYNAMIC, compression=CODEC).partitionBy("bucket", "batch").parquet(f"{store}/values")
    # As many numbers at most as there are buckets.
    touched = [r.bucket for r in session.read.parquet(f"{store}/values").where(F.col("batch") == number).select("bucket").distinct().collect()]
    if not touched:
        return
    found = with_bucket(C.conflict_clusters(values_of(session, store, touched, number).drop("bucket")), buckets)
    # A bucket without clusters leaves a row too: it replaces what was said of it before.
    marks = session.range(1).select(F.explode(F.array(*map(F.lit, touched))).alias("bucket"))
    both = found.unionByName(marks, allowMissingColumns=True)
    both.hint("rebalance", "bucket").write.mode("overwrite").options(**_DYNAMIC, compression=CODEC).partitionBy("bucket").parquet(f"{store}/clusters")


def clusters(spark: SparkSession, store: str) -> DataFrame:
    """All conflict clusters as they stand."""
    return spark.read.parquet(f"{store}/clusters").where("severity is not null").drop("bucket")


def refresh(spark: SparkSession, arrivals: DataFrame, store: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """Run the stream `arrivals` (long-form values) to its end, and return the conflict clusters as they then stand: those of one run over all
    rows."""
    batch = lambda rows, number: add_batch(rows, number, store, buckets)
    arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return clusters(spark, store)
