"""Quality rules as a bitmask ledger: every rule runs once, policies and ablations are bitwise afterwards.

``ledger`` measures each document and stores the failed rules as bits of one long. A policy is a named, versioned set of
rules; applying one, comparing two, or leaving a rule out reads the ledger only. Only DataFrame functions are used; a text's
own repeats are found inside its row, so that nothing is shuffled and a hot source makes no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE_CLASS, WORD_CLASS, table, text_or_empty

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Name and condition of each rule; a rule's bit is its place. Append only, so that stored bits keep their meaning.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_mean_word", "10 * word_chars < 15 * n_words"),
    ("long_mean_word", "word_chars > 25 * n_words"),
)
#: Policies by version: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_mean_word", "long_mean_word"),
}


def mask_of(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the MEASURES): one row per input row. A null text counts as empty, with all measures 0 but n_lines."""
    blank = "\\x20\\x09-\\x0D"
    a = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t"))
    b = a.select(id_col, "_t", F.array_remove(F.split("_t", f"[{blank}]+"), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_CLASS)).alias("_l"))
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    c = b.select(
        id_col,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n > 3, windows).alias("_h"),
    )
    # Most texts repeat no window: only the others are sorted. A window is repeated if its neighbour in the order is equal.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = c.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    e = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    return e.select(id_col, *MEASURES[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the MEASURES, failed): one row per input row; bit i of failed is set where rule i of RULES fails.

    Null and empty texts have no words and fail few_words. Repeated rows are measured like others, an empty table gives an
    empty result, further columns are ignored. Windows are compared by a 64-bit hash of their three words.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failed: Column = F.lit(0)
    for bit in bits:
        failed = failed.bitwiseOR(bit)
    # Catalyst would copy the measures' expressions, sorts and all, into a filter on failed; it never does that for a column
    # that it holds for nondeterministic.
    fixed = F.spark_partition_id().cast("long") * 0
    return measure(docs, id_col, text_col).withColumn("failed", failed.cast("long").bitwiseOR(fixed))


def kept(policy: str = "v1") -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only): per rule of a policy, the documents that fail it and those that only it rejects."""
    own = F.col("failed").bitwiseAND(F.lit(mask_of(policy)))
    marked = book.groupBy(own.alias("bits")).agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in POLICIES[policy]])
    each = marked.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document. Null and empty texts have no words and fail; repeats are measured like others; an empty table
    gives no rows; further columns are ignored."""
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", *(m for m in MEASURES if m != "n_lines"), (~kept("base")).alias("base_failed"), kept("v1").alias("kept"), "failed")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN 10 * word_chars < 15 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""
