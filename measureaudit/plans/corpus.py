"""Queries on texts and pages: keyword search, contexts, links, DOI suffixes; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixtures import entries, sql
from ..operators.containment import paper_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def search_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 documents that hold a word, with 60 characters on each side of its first place."""
    at = F.locate("license", F.lower("text"))
    hits = _documents(spark, sf_dir).withColumn("place", at).where("place > 0")
    start = F.greatest(F.lit(1), F.col("place") - 60)
    snippet = F.trim(F.regexp_replace(F.substr("text", start, F.col("place") - start + len("license") + 60), "[ \\t\\r\\n]+", " "))
    return hits.select("doc_id", F.col("place").cast("long").alias("place"), snippet.alias("snippet")).orderBy("doc_id").limit(20)


def contexts(docs: DataFrame, pattern: str, before: int, after: int, keep: tuple[str, ...], most: int, id_col: str = "doc_id") -> DataFrame:
    """(id_col, i, context): around every hit of a pattern (Java's syntax, without groups that capture), with up to `before` and `after` characters
    on its sides and white space made one space; kept with one of the words of `keep`, once per first 80 characters, `most` per
    document, numbered from 0.

    Nothing leaves its row: looking back and ahead takes a hit's sides without using them up, so that contexts may overlap. Null texts, and
    texts without a kept context, have no rows; rows with equal ids are searched one by one."""
    side = "[\\s\\S]"
    # A hit is found first, as looking back costs more. Looking back steps by halves of rare characters, so one more than asked is taken.
    back = f"(?<=({side}{{{before + 1},{2 * before + 2}}}?))|(?<=(\\A{side}{{0,{2 * before + 2}}}))"
    whole = f"(?={pattern})(?:{back})({pattern})(?=({side}{{0,{after}}}))"
    zipped = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(whole), k).alias(n) for k, n in enumerate("fshl", 1)])
    one = lambda x: F.concat(F.right(F.concat(x["f"], x["s"]), F.lit(before)), x["h"], x["l"])
    made = docs.where(F.col("text").rlike(pattern)).select(id_col, F.transform(zipped, lambda x: F.trim(F.regexp_replace(one(x), "\\s+", " "))).alias("c"))
    held = made.select(id_col, F.filter("c", lambda x: reduce(lambda a, b: a | b, [x.contains(k) for k in keep], F.lit(False))).alias("c"))
    heads = held.withColumn("h", F.transform("c", lambda x: F.substr(x, F.lit(1), F.lit(80))))
    first = F.transform(F.slice(F.array_distinct("h"), 1, most), lambda h: F.element_at("c", F.array_position("h", h).cast("int")))
    return heads.select(id_col, F.posexplode(first).alias("i", "context"))


def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(_documents(spark, sf_dir), "(?i:license)", 160, 220, ("MIT", "Apache"), 12)


#: A number with a short word, as of a quantity with its unit.
QUANTITY = "[0-9]+(?:[.,][0-9]+)?[ ]?[A-Za-z]{1,5}"


def pattern_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with what may be a unit, where the surroundings hold a common word."""
    return contexts(_documents(spark, sf_dir), QUANTITY, 160, 220, ("the", "der", "que", " de "), 12)


def link_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, way, other, n, known): the links of each page, out of it and back to it. A key is host and path in lower case, without scheme, query, fragment,
    a last slash or .html; links without a host are of their page's. known: the other side is a page of the table or a section that holds one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "[?#].*$", ""), "(/|\\.html)$", ""))
    own = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), bare(F.regexp_replace("url", "^[^:/]*://", "")).alias("key"), "html")
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    links = own.select("host", "key", href.alias("href")).select("key", bare(F.when(F.col("href").contains("://"), F.regexp_replace("href", "^[^:/]*://", "")).otherwise(F.concat("host", "href"))).alias("other"))
    counted = links.groupBy("key", "other").agg(F.count("*").alias("n"))
    sections = own.select(F.explode(F.array("key", F.regexp_replace("key", "/[^/]*$", ""))).alias("other")).distinct().withColumn("k", F.lit(True))
    both = counted.select("key", F.explode(F.array(F.struct(F.lit("out").alias("way"), F.col("key").alias("a"), F.col("other").alias("b")), F.struct(F.lit("back").alias("way"), F.col("other").alias("a"), F.col("key").alias("b")))).alias("x"), "n")
    return both.select(F.col("x.a").alias("key"), "x.way", F.col("x.b").alias("other"), "n").join(sections, "other", "left").select("key", "way", "other", "n", F.coalesce("k", F.lit(False)).alias("known"))


def link_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per link target: how often and from how many pages it is linked, and the first page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target"))
    return out.groupBy("target").agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each DOI, three at most. Files are named after the numbers of pages, in three spellings."""
    number = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "/([0-9]+)(\\.html|/)?$", 1)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", number.alias("number")).where("number <> ''")
    kind = F.col("page_id") % 3
    name = F.when(kind == 0, F.concat(F.lit("Scan_p"), "number", F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("si-"), F.lit("p-"), "number", F.lit(" x.pdf"))).otherwise(F.concat(F.lit("P"), "number", F.lit(".pdf")))
    return paper_files(entries(spark, sf_dir).where("doi <> ''").select("doi"), pages.select(F.lpad(F.col("page_id").cast("string"), 8, "0").alias("path"), name.alias("name")))


QUERIES = {f.__name__: f for f in (search_notes, keyword_context, pattern_context, link_neighbors, link_adjacency, suffix_match)}


def _contexts(pattern: str, kept: str) -> str:
    """SQL that cuts contexts by the running places of a pattern's hits."""
    return rf"""WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents WHERE regexp_matches(text, '{pattern}')),
      h AS (SELECT doc_id, text, i, length(p[i]) AS a, length(m[i]) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p)),
      l AS (SELECT doc_id, text, i, CAST(sum(a + b) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS till, b FROM h),
      c AS (SELECT doc_id, i, trim(regexp_replace(substr(text, greatest(0, till - b - 160) + 1, till + 220 - greatest(0, till - b - 160)), '\s+', ' ', 'g')) AS c FROM l),
      k AS (SELECT * FROM c WHERE {kept} QUALIFY row_number() OVER (PARTITION BY doc_id, substr(c, 1, 80) ORDER BY i) = 1)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS i, c AS context FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 12"""


ORACLES = {
    "search_notes": "SELECT doc_id, CAST(place AS BIGINT) AS place, trim(regexp_replace(substr(text, greatest(1, place - 60), place - greatest(1, place - 60) + 67), '[ \\t\\r\\n]+', ' ', 'g')) AS snippet FROM (SELECT doc_id, text, strpos(lower(text), 'license') AS place FROM documents) WHERE place > 0 ORDER BY doc_id LIMIT 20",
    "keyword_context": _contexts("(?i)license", "contains(c, 'MIT') OR contains(c, 'Apache')"),
    "pattern_context": _contexts("[0-9]+(?:[.,][0-9]+)?[ ]?[A-Za-z]{1,5}", "contains(c, 'the') OR contains(c, 'der') OR contains(c, 'que') OR contains(c, ' de ')"),
    "link_adjacency": r"""WITH p AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[^:/]*://', ''), '[?#].*$', ''), '(/|\.html)$', '')) AS key, html FROM pages),
      l AS (SELECT key, lower(regexp_replace(regexp_replace(CASE WHEN contains(h, '://') THEN regexp_replace(h, '^[^:/]*://', '') ELSE host || h END, '[?#].*$', ''), '(/|\.html)$', '')) AS other FROM (SELECT host, key, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM p)),
      c AS (SELECT key, other, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT key FROM p UNION SELECT regexp_replace(key, '/[^/]*$', '') FROM p)
      SELECT key, way, other, n, other IN (SELECT key FROM s) AS known FROM (SELECT key, 'out' AS way, other, n FROM c UNION ALL SELECT other, 'back', key, n FROM c)""",
    "link_neighbors": """SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages) GROUP BY 1""",
    "suffix_match": sql(r"""SELECT doi, path, tier FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY path) AS r FROM (
      WITH n AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([0-9]+)(\.html|/)?$', 1) AS number FROM pages),
      f AS (SELECT lpad(CAST(page_id AS VARCHAR), 8, '0') AS path, CASE page_id % 3 WHEN 0 THEN 'Scan_p' || number || '.pdf' WHEN 1 THEN 'si-p-' || number || ' x.pdf' ELSE 'P' || number || '.pdf' END AS name FROM n WHERE number <> ''),
      d AS (SELECT DISTINCT doi, replace(split_part(doi, '/', -1), '.', '') AS key, lower(list_extract(regexp_split_to_array(split_part(doi, '/', -1), '[.-]'), -1)) AS piece FROM ent WHERE doi <> ''),
      a AS (SELECT doi, path, 1 AS tier FROM d JOIN f ON contains(translate(name, '._- ', ''), key))
      SELECT * FROM a UNION ALL SELECT doi, path, 2 FROM d JOIN f ON contains(lower(name), piece) WHERE length(piece) >= 5 AND doi NOT IN (SELECT doi FROM a))) WHERE r <= 3"""),
}
