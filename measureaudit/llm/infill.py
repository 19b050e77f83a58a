"""Fill-in-middle transformation over an indexable skip list of a text's units.

A text is cut into units (lines, by default). The units stand in a skip list whose express lanes carry, for each link, how many
units and how many code points it passes. A cut after r units is found by descending from the top lane and adding widths: no
lane is walked from its start, and the code-point place comes out exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import in_arrow, pieces, table

#: Marks of prefix, suffix and middle; texts that hold one of them stay plain.
MARKS = ("<P>", "<S>", "<M>")
#: What ends a unit.
UNIT_END = "\n"
#: Of 100 texts so many are transformed, and so many of these take the suffix first.
RATE, SUFFIX_FIRST, SEED = 100, 50, 7
#: A link of a lane passes this many links of the lane below, on average and, here, always.
STRIDE = 4


class SkipList:
    """Units by rank. widths: code points of each unit, in order.

    Lane 0 links each unit to the next; a link of lane k passes STRIDE links of lane k - 1, the last one fewer. Each lane is a
    pair of arrays: units passed, code points passed."""

    def __init__(self, widths: np.ndarray):
        self.n = len(widths)
        units, points = np.ones(self.n, np.int64), np.asarray(widths, np.int64)
        self.lanes = [(units, points)]
        while len(units) > STRIDE:
            at = np.arange(0, len(units), STRIDE)
            units, points = np.add.reduceat(units, at), np.add.reduceat(points, at)
            self.lanes.append((units, points))

    def place(self, rank: int) -> int:
        """The code points before the unit of that rank; of all units, for rank n."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        link, left, total = 0, rank, 0
        for units, points in reversed(self.lanes):
            while link < len(units) and units[link] <= left:
                left -= int(units[link])
                total += int(points[link])
                link += 1
            link *= STRIDE  # the same place, one lane down
        return total


def unit_widths(text: str, end: str = UNIT_END) -> np.ndarray:
    """Code points of each unit: a unit is what runs to the next end mark, that included, or to the end of the text."""
    ends = [m.end() for m in re.finditer(re.escape(end), text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.diff(np.array([0, *ends], np.int64))


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on seed and id alone; a null id counts as no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def transform(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, end: str = UNIT_END) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix code points, middle code points, output) of one text."""
    widths = unit_widths(text, end)
    h1, h2, h3, h4 = draws(seed, doc_id)
    n = len(widths)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    units = SkipList(widths)
    a, b = (units.place(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    (p, s, m), prefix, middle, suffix = MARKS, text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, end: str = UNIT_END) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output): one row per input row, in one pass without a shuffle.

    Null and empty texts are plain and empty, of 0 units. A row without id is drawn like the others, all alike. Repeated rows
    give equal rows, an empty table gives no rows, further columns are ignored, whatever their names; a text of any length is
    one row. id_col must be integral."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, form, prefix, middle, output = zip(*(transform(t or "", i, seed, rate, suffix_first, end) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    made = in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of fill_in_middle was made from, read from output and form alone."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = MARKS
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it. Null and empty texts are plain; repeats are treated like
    others; an empty table gives no rows; further columns are ignored."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(ls) AS BIGINT) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""
