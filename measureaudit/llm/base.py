"""Shared pieces of the training-data operators: the session's shared folder, checkpoints, small helpers."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (tests only) a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(place)
    return place


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage is cut, and later reads prune columns."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a small table that one task takes.
ROWS_A_TASK = 200_000


def fitted(df: DataFrame) -> DataFrame:
    """A checkpointed or written table in as many partitions as its number of rows calls for, and no more than it has: so a
    small table doesn't pay for the tasks and files of a large one. Costs one count."""
    return df.coalesce(max(1, math.ceil(df.count() / ROWS_A_TASK)))


def shipped(df: DataFrame, most: int) -> DataFrame:
    """The table marked for broadcast if a count shows no more than `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Arrow batches are no larger than this, and tasks turn no more bytes into Python objects at once.
ARROW_BYTES, PIECE_BYTES = 8 << 20, 2 << 20


def in_arrow(df: DataFrame, of, schema) -> DataFrame:
    """mapInArrow with Arrow batches of ARROW_BYTES at most, by the session's setting, which is lowered where it is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name, "64m")).lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:] in "kmg" else int(now)
    if not 0 < size <= ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(of, schema)


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes, a row at least."""
    for b in batches:
        step = max(1, b.num_rows * size // max(1, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))
