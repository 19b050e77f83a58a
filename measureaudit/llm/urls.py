"""URL filters: reversed-host keys turn host suffixes into intervals; a sorted sweep keeps a stack of active nested rules.

The key of a host writes its labels from the right, each ended by a dot: ``a.example.org`` is ``org.example.a.``. All hosts
at or under a rule's host share the rule's key as a prefix, so a rule covers one interval of keys, and two rules' intervals
are nested or apart. URLs are sorted by key within their partition and swept once together with the sorted rules: a rule is
pushed when the sweep enters its interval and popped when it leaves it. The rules of a host and its parents that are
active then are tried by path, the longest first: a level of the stack holds its paths by name and their distinct lengths, so
that a host with many rules costs a URL no more than its paths have lengths.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Up to so many rules travel to each task; larger rule tables are joined on the prefixes of the host key instead.
MAX_SHIPPED_RULES = 200_000
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    return lowered(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


class Sweep:
    """One pass over URLs sorted by key. rules: (key, path, rule, verdict), sorted by key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        self.rules, self.at, self.stack, self.last = rules, 0, [], ""

    def _enter(self, key: str) -> None:
        while self.at < len(self.rules) and self.rules[self.at][0] <= key:
            own = self.rules[self.at]
            while self.stack and not own[0].startswith(self.stack[-1][0]):
                self.stack.pop()
            if not self.stack or self.stack[-1][0] != own[0]:
                self.stack.append((own[0], {}, []))
            _, paths, sizes = self.stack[-1]
            paths[own[1]] = max(paths.get(own[1], own), own, key=lambda r: (r[3] == "block", r[2]))
            if len(own[1]) not in sizes:
                insort(sizes, len(own[1]))
            self.at += 1
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        if key < self.last:
            raise ValueError("the sweep needs URLs in order of their keys")
        if key != self.last:
            self._enter(key)
            self.last = key
        for _, paths, sizes in reversed(self.stack):
            for size in reversed(sizes):
                if size <= len(path) and (best := paths.get(path[:size])):
                    return best[2], best[3]
        return None, None


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id_col, host, path, rule, verdict): one row per input row.

    rules (rule, verdict): a rule is ``host/path``; it fits its host and all subdomains where the URL's path starts with the
    rule's. The longest fitting rule wins: first the longest host, then the longest path, then block before allow. Without
    a fitting rule the rule is null and the verdict is default. A null URL or one without :// has empty host and path and
    fits no rule. Null rules are ignored, repeated ones count once. An empty table gives an empty result; further columns
    are ignored. Tables of over MAX_SHIPPED_RULES rules are joined on the prefixes of the host key.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    cut_at = F.locate("/", F.col("rule"))
    host = lowered(F.when(cut_at > 0, F.substr("rule", F.lit(1), cut_at - 1)).otherwise(F.col("rule")))
    path = F.when(cut_at > 0, F.substr("rule", cut_at)).otherwise(F.lit("/"))
    laid = rules.where("rule is not null and verdict is not null").select(key_of(host).alias("key"), path.alias("rule_path"), "rule", F.col("verdict").alias("says")).distinct()
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("key", key_of(F.col("host")))
    few = laid.limit(MAX_SHIPPED_RULES + 1).count() <= MAX_SHIPPED_RULES
    if not few:
        return _joined(urls, laid, id_col, default)
    shipped = sorted(tuple(r) for r in laid.collect())

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Sweep(shipped)
        for f in frames:
            said = [one.judge(k, p) for k, p in zip(f["key"], f["path"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "host": f["host"], "path": f["path"], "rule": [x for x, _ in said], "verdict": [y or default for _, y in said]})

    swept = urls.sortWithinPartitions("key").mapInPandas(of, f"id {kind}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)


def _joined(urls: DataFrame, laid: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same for rule tables of any size: hosts meet rules on the prefixes of their keys, then paths are compared."""
    hosts = urls.select("key").distinct()
    n = F.size(F.split("key", "\\.")) - 1
    ups = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(F.split("key", "\\."), 1, i), "."), F.lit(".")))).alias("up"))
    # A URL's path meets rules by its own prefixes, as long as the paths of the host's rules are.
    own = laid.withColumnRenamed("key", "up")
    sizes = own.select("up", F.length("rule_path").alias("size")).distinct()
    tried = urls.select("key", "path").distinct().join(ups, "key").join(sizes, "up").where(F.length("path") >= F.col("size")).select("key", "path", "up", F.substr("path", F.lit(1), F.col("size")).alias("rule_path"))
    fit = tried.join(own, ["up", "rule_path"])
    best = fit.groupBy("key", "path").agg(
        F.max_by(F.struct("rule", "says"), F.struct(F.length("up").alias("a"), F.length("rule_path").alias("b"), (F.col("says") == "block").alias("c"), F.col("rule").alias("d"))).alias("best")
    )
    return urls.join(best, ["key", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict")
    )


#: The rules that op3 judges by.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict. A null URL, or one without ://, has empty host and path and no rule; repeats are judged like others; an
    empty table gives no rows; further columns are ignored."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN '.' || host LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN '.' || host LIKE '%.org' AND path LIKE '/%' THEN 'org/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') OR rule IS NULL THEN 'allow' ELSE 'block' END AS verdict FROM r
"""
