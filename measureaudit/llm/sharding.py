"""Extendible hashing: a directory over hash-prefix bits; only oversized buckets split on another bit.

A record's hash is a string of 120 bits: 60 of its id's MD5, then 60 of its text's. A bucket is a prefix. It is split while it
holds over the byte limit and more than one record, so every shard is the shortest prefix that fits. Sizes are summed for
all prefixes of one depth at once, from a histogram by prefix, never per record; records in buckets that are still too
large at that depth (ids given many times) go on to the next depth alone. Records that agree in all 120 bits are copies;
they are dealt to numbered pages of one prefix. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import cut, table

BITS = 120
MAX_BYTES = 1 << 20
_STEP = 12
_SALTS = 64


def _bits(text):
    return F.lpad(F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 2), 60, "0")


def _directory(rest: DataFrame, above: int, depth: int, max_bytes: int) -> DataFrame:
    """(cell, at): for each prefix of depth bits, the length of the shortest prefix, over above bits, that fits; or null."""
    cells = rest.groupBy(F.substr("bits", F.lit(1), F.lit(depth)).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    ups = cells.select("cell", "n_bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("at")).withColumn("up", F.substr("cell", F.lit(1), F.col("at")))
    fits = ups.groupBy("at", "up").agg(F.sum("n_bytes").alias("b"), F.sum("n").alias("c")).where(f"b <= {max_bytes} or c = 1").select("at", "up")
    found = ups.select("cell", "at", "up").join(fits, ["at", "up"]).groupBy("cell").agg(F.min("at").alias("at"))
    return cells.select("cell").join(found, "cell", "left")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES, carry: bool = False) -> DataFrame:
    """(id_col, n_bytes, shard, depth, page): one row per input row; a shard is (shard, page), its prefix and page.

    n_bytes is the UTF-8 size of the text; a null text has 0 bytes and hashes like an empty one, a null id like an empty
    string. The sizes of a shard's records sum to max_bytes at most, unless it is one record alone. Page is 0 but for copies
    that agree in id and text and are too many for one shard. Shards depend on the records only, not on their order or
    partitions; which copy of a record is on which page may. An empty table gives an empty result; further columns are ignored. With
    carry, a column row holds the whole input row.
    """
    more = ["row"] if carry else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.concat(_bits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), _bits(text)).alias("bits"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    rest = cut(rows)
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    depth, above, done = min(BITS, max(0, math.ceil(math.log2(max(1, total) / max_bytes))) + 3), 0, []
    while True:
        table_ = cut(_directory(rest, above, depth, max_bytes))
        placed = rest.join(table_, F.substr("bits", F.lit(1), F.lit(depth)) == F.col("cell")).drop("cell")
        done.append(placed.where("at is not null").select("id", "n_bytes", F.substr("bits", F.lit(1), F.col("at")).alias("shard"), F.col("at").alias("depth"), F.lit(0).cast("long").alias("page"), *more))
        if table_.where("at is null").isEmpty():
            break
        left = placed.where("at is null").drop("at")
        if depth == BITS:
            salted = left.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)))
            per_page = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / F.greatest("n_bytes", F.lit(1))))
            place = F.row_number().over(W.partitionBy("bits", "salt").orderBy("n_bytes")) - 1
            done.append(salted.select("id", "n_bytes", F.col("bits").alias("shard"), F.lit(BITS).alias("depth"), (F.floor(place / per_page) * _SALTS + F.col("salt")).cast("long").alias("page"), *more))
            break
        rest, above, depth = cut(left), depth + 1, min(BITS, depth + _STEP)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> None:
    """Write docs as Parquet with columns _shard and _page added; a shard is one run of rows of one file. Nulls, copies and an
    empty table are as in shards()."""
    made = shards(docs, id_col, text_col, max_bytes, carry=True)
    rows = made.select("row.*", F.col("shard").alias("_shard"), F.col("page").alias("_page"))
    rows.repartition("_shard", "_page").sortWithinPartitions("_shard", "_page").write.parquet(path)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document. A null text has 0 bytes, copies share a shard while it has room, an empty table gives no rows,
    and further columns are ignored."""
    return shards(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)), 60, '0')
         || lpad(bin(CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT)), 60, '0') AS bits,
         row_number() OVER () AS k
  FROM documents
), p AS (SELECT d.*, t.lv, substr(bits, 1, t.lv) AS up FROM d, (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS lv) AS t),
s AS (SELECT *, sum(n_bytes) OVER w AS b, count(*) OVER w AS c FROM p WINDOW w AS (PARTITION BY lv, up)),
f AS (SELECT k, min(lv) AS lv FROM s WHERE b <= {MAX_BYTES} OR c = 1 GROUP BY k)
SELECT d.doc_id, d.n_bytes, substr(d.bits, 1, f.lv) AS shard, f.lv AS depth, CAST(0 AS BIGINT) AS page FROM d JOIN f ON d.k = f.k
"""
