"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand and validate them.

Anchors are at-signs, scheme marks, plus signs, digits and identifier cues (token, password, iban, ...). At each anchor a
parser of its kind reads to the left or right over the text around it, decides the boundaries and validates the value.
Every parser starts where its last span or chain ended, so the work is linear in the text. For the base kinds (email, ip,
card, phone) the spans are those of a leftmost non-overlapping scan by the kind's pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import in_arrow, pieces, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("userinfo", "secret", "iban", "ssn")
KINDS = (*BASE, *ADDED)
#: Words after which a secret is given, as in: token = "...".
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+(?=@[A-Za-z0-9.-])")
_GIVES = re.compile(r"[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?=[A-Za-z0-9_+/.=~-])")
_VALUE = re.compile(r"[A-Za-z0-9_+/.=~-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, what in [("@", "at"), ("://", "scheme"), ("+", "plus"), *((str(d), "digit") for d in range(10))]:
        found.add_word(text, (what, len(text)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(form)))
    for form in ("IBAN", "iban", "Iban"):
        found.add_word(form, ("iban", len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of one text, in code points, by start, then kind as in KINDS, then end."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)  # where the search of a kind goes on
    chain = 0  # end of the last dotted chain of digits
    value_end = last_digit = -1  # of the last run of characters that a secret may have

    def add(kind: str, start: int, end: int) -> None:
        found.append((kind, start, end))
        done[kind] = end

    for last, (what, size) in _anchors().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= done["card"]:
                m = _DIGITS.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 12:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        add("card", at, m.end())
            if at >= chain:
                m = _DOTTED.match(text, at)
                chain = m.end()
                parts = m.group().split(".")
                start = at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = start + sum(map(len, four)) + 3
                    if all(map(_octet, four)):
                        add("ip", start, end)
                    start = end + 1
            if at >= done["ssn"] and text[at + 3 : at + 4] == "-" and (at == 0 or text[at - 1] not in "0123456789-") and (m := _SSN.match(text, at)):
                area, group, serial = m.group().split("-")
                if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                    add("ssn", at, m.end())
        elif what == "at":
            start, least = at, done["email"]
            while start > least and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif what == "plus":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    add("phone", at, m.end())
        elif what == "scheme":
            if last + 1 >= done["userinfo"] and (m := _USERINFO.match(text, last + 1)):
                add("userinfo", last + 1, m.end())
        elif what == "secret":
            # Cues may stand inside a run of value characters: the run's end and its last digit are looked for once.
            if at >= done["secret"] and (m := _GIVES.match(text, last + 1)):
                start = m.end()
                if start >= value_end:
                    value_end = _VALUE.match(text, start).end()
                    last_digit = max(text.rfind(d, start, value_end) for d in "0123456789")
                if value_end - start >= 8 and last_digit >= start:
                    add("secret", start, value_end)
        elif at >= done["iban"]:
            start = last + 1
            while start < len(text) and start - last <= 4 and text[start] in " :=#.":
                start += 1
            if m := _IBAN.match(text, start):
                flat = m.group().replace(" ", "")
                if 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
                    add("iban", start, m.end())
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): one row per input row; spans is an array of (kind, start, stop) in code points, stop exclusive.

    A null or empty text has no spans. Repeated rows are searched like others, an empty table gives an empty result, and
    further columns are ignored. The whole text is searched.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [[{"kind": k, "start": s, "stop": e} for k, s, e in spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], names=["id", "spans"])

    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_col)


def mask_text(text: str | None) -> str | None:
    """The text with every span (of spans that touch: their union) replaced by <KIND> of the first."""
    found = spans(text)
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        kind, start, end = found[i]
        while i + 1 < len(found) and found[i + 1][1] < end:
            i += 1
            end = max(end, found[i][2])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def masked(text: Column) -> Column:
    """mask_text over a column; null stays null."""

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(mask_text, na_action="ignore")

    return of(text)


def written(found: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document. Null and empty texts have none; repeats are searched like others; an empty table gives no rows;
    further columns are ignored."""
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(written(F.filter("spans", lambda s: s.kind.isin(*BASE))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )
