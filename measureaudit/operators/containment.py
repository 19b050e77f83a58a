"""Which names hold which asked texts, by an inverted index of three-letter grams; and papers' files found so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import kept

GRAM = 3
#: Files of one paper, and the shortest last piece of a DOI that is looked for by itself.
MOST_FILES, LEAST_PIECE = 3, 5


def _grams(c: str, n: int) -> Column:
    """The different pieces of n characters; an empty array for shorter texts."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(F.col(c), i, F.lit(n))))).otherwise(F.array())


def containing(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, name): every pair of different texts of asked.asked and names.name of which the name holds the asked one.

    An asked text meets only the names that have its rarest gram, and then those are read. Texts of one or two characters meet the
    names' pieces of that size. Nulls and empty asked texts are in no pair; repeated texts count once; case matters."""
    a = asked.select("asked").where("asked <> ''").distinct()
    b = names.select("name").where("name <> ''").distinct()
    index = b.select("name", F.explode(_grams("name", GRAM)).alias("gram"))
    n_names = index.groupBy("gram").agg(F.count("*").alias("n"))
    own = a.where(F.length("asked") >= GRAM).select("asked", F.explode(_grams("asked", GRAM)).alias("gram")).join(n_names, "gram", "left")
    rarest = own.groupBy("asked").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    long = rarest.join(index, "gram").where(F.col("name").contains(F.col("asked"))).select("asked", "name")
    small = b.select("name", F.explode(F.concat(*[_grams("name", n) for n in range(1, GRAM)])).alias("asked"))
    return long.unionByName(a.where(F.length("asked") < GRAM).join(small, "asked").select("asked", "name"))


def paper_files(dois: DataFrame, files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(doi, path, tier): up to `most` files of each doi, by path. files: (path, name).

    First by the DOI's tail without dots, held by the name without dots, lines, dashes and spaces; a DOI without such a file by the last piece of its
    tail, of LEAST_PIECE characters or more, in the name as it is, whatever the case. A DOI without a file has no row."""
    tail = F.substring_index("doi", "/", -1)
    # Both sides are asked several times: they are written once.
    own = kept(dois.select("doi").distinct().select("doi", F.translate(tail, ".", "").alias("key"), F.lower(F.element_at(F.split(tail, "[.-]"), -1)).alias("piece")), "dois")
    named = kept(files.select("path", F.translate("name", "._- ", "").alias("bare"), F.lower("name").alias("low")), "files")

    def found(keys: DataFrame, key: str, name: str, tier: int) -> DataFrame:
        pairs = containing(keys.select(F.col(key).alias("asked")), named.select(F.col(name).alias("name")))
        met = keys.select("doi", F.col(key).alias("asked")).join(pairs, "asked").join(named.select("path", F.col(name).alias("name")), "name")
        return met.select("doi", "path", F.lit(tier).alias("tier")).distinct()

    first = kept(found(own, "key", "bare", 1), "first")
    second = found(own.where(F.length("piece") >= LEAST_PIECE).join(first.select("doi").distinct(), "doi", "left_anti"), "piece", "low", 2)
    return first.unionByName(second).withColumn("r", F.row_number().over(W.partitionBy("doi").orderBy("path"))).where(F.col("r") <= most).drop("r")
