"""Benchmark decontamination: template canonicalisation, a hash join of template windows, and slot consistency.

Words of a text are made canonical: numbers, units after numbers and names become typed placeholders, other words lose case
and outer punctuation. Windows of canonical words of the benchmark are joined to those of the documents by hash, once typed
and once with the placeholders' words left as they are. For typed windows the values in the slots are compared: within one
document and item, or one place of it in the document, values must map one to one. So a question asked again with
other numbers or names is found, and text that only has the same shape is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import cut, free_name, in_arrow, pieces, table

#: Words in a window. Items with fewer words are one window. Under LEAST words it must match word by word, and an item of one
#: or two words only contaminates a document that says nothing else.
WINDOW, LEAST = 10, 5
#: Of a typed window's words, at least so many must not be placeholders.
PLAIN_WORDS = 4
#: A document is contaminated by an item when windows that match it cover this share of its words.
COVERAGE = 0.5
#: Up to so many benchmark windows travel to each task; larger sets are joined by a shuffle.
MAX_SHIPPED = 1_000_000
_CACHE = 100_000

# Unit words after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres mg g kg t lb lbs oz gram grams kilogram kilograms ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years kmh mph hz khz mhz ghz v kv w kw mw j kj cal kcal pa kpa bar c f k % percent usd eur gbp dollar dollars euro euros cent cents".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?[0-9](?:[0-9.,:/]*[0-9])?%?")
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_DIGITS = frozenset("0123456789$€£+-")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…–—¿¡€£"
_NUM, _NAME, _UNIT = (xxhash.xxh64_intdigest(x, 1) for x in ("<num>", "<name>", "<unit>"))
_GO = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Canonical forms of words, cached. A form: hash of the plain word, marks (kind: 0 word, 1 number, 2 titled, 3 unit; 4 where
    a sentence ends after it, 8 where it has a letter or digit), the plain word."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.plain: list[int] = []
        self.marks: list[int] = []
        self.word: list[str] = []
        self.filled = 0
        self.a_plain, self.a_marks = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def _add(self, raw: str) -> int:
        core = raw if raw.isalpha() else raw.strip(_MARKS)
        if core[:1].isdigit():
            core = _EDGE.sub("", raw)
        low = core.lower()
        kind = 1 if core[:1] in _DIGITS and _NUMBER.fullmatch(core) else 3 if low in UNITS else 2 if low != core and len(core) > 1 and core[0].isupper() and core[1:].islower() else 0
        if not low:
            kind = 4
        else:
            kind |= 12 if raw[-1] in ".!?:;" else 8
        k = self.slot[raw] = len(self.word)
        self.plain.append(xxhash.xxh64_intdigest(low, 0))
        self.marks.append(kind)
        self.word.append(low)
        return k

    def forms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(plain hashes, typed hashes, places in word, which text) of the words of some texts, in order; words without a letter
        or digit are left out."""
        if len(self.word) > _CACHE:
            self.__init__()
        find, add = self.slot.get, self._add
        split = [t.split() for t in texts]
        own = [k if (k := find(w)) is not None else add(w) for words in split for w in words]
        at, text = np.array(own, np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in split])
        self._catch_up()
        marks, plain = self.a_marks[at], self.a_plain[at]
        # Symbols between words don't count as words, but a stop among them ends the sentence; so does the end of a text.
        after_stop = np.ones(len(at), bool)
        after_stop[1:] = (marks[:-1] & 4 > 0) | (text[1:] != text[:-1])
        real = marks & 8 > 0
        at, kind, plain, first, text = at[real], marks[real] & 3, plain[real], after_stop[real], text[real]
        typed = plain.copy()
        number = kind == 1
        typed[number] = _NUM
        typed[(kind == 2) & ~first] = _NAME
        unit = kind == 3
        unit[:1] = False
        unit[1:] &= number[:-1] & (text[1:] == text[:-1])
        typed[unit] = _UNIT
        return plain, typed, at, text

    def _catch_up(self) -> None:
        """Copy the forms added since the last call into the arrays, which double when full."""
        old, new = self.filled, len(self.word)
        if new > len(self.a_marks):
            grow = lambda x: np.concatenate([x, np.zeros(max(1024, 2 * new) - len(x), x.dtype)])
            self.a_plain, self.a_marks = grow(self.a_plain), grow(self.a_marks)
        if new > old:
            self.a_plain[old:new] = np.array(self.plain[old:], np.uint64)
            self.a_marks[old:new] = self.marks[old:]
            self.filled = new


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n of the hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * _GO + (h[i : i + len(out)] ^ (h[i : i + len(out)] >> np.uint64(31)))
    return out ^ (out >> np.uint64(29))


def _windows(words: Words, text: str, n: int) -> Iterator[tuple[int, int, bool, str, list[str], int]]:
    """(hash, place, typed, template, slot values, number of words) of a text's windows of n words."""
    plain, typed, at, _ = words.forms([text])
    own = [words.word[k] for k in at.tolist()]
    mark = {int(_NUM): "<num>", int(_NAME): "<name>", int(_UNIT): "<unit>"}
    slots = [mark.get(int(t)) if t != p else None for t, p in zip(typed, plain, strict=True)]
    for kind, h in ((False, rolled(plain, n)), (True, rolled(typed, n))):
        for i, x in enumerate(h.view(np.int64).tolist()):
            inside = slots[i : i + n]
            held = [w for w, s in zip(own[i : i + n], inside, strict=True) if s]
            if kind and (not held or n - len(held) < PLAIN_WORDS or n < LEAST):
                continue
            shown = [s or w for w, s in zip(own[i : i + n], inside, strict=True)] if kind else own[i : i + n]
            yield x, i, kind, " ".join(shown), held if kind else [], len(own)


_OUT = "hash long, len int, pos int, typed boolean, template string, slots array<string>, n_words int"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, hash, len, pos, typed, template, slots, n_words): the windows of all items."""
    kind = items.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in pieces(batches):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = min(WINDOW, len(words.forms([t or ""])[2]))
                if n:
                    rows += [(i, h, n, p, ty, te, sl, nw) for h, p, ty, te, sl, nw in _windows(words, t, n)]
            yield _batch(rows, b.column(0).type, "item")

    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(of, f"item {kind}, {_OUT}")


def _batch(rows: list[tuple], kind: pa.DataType, first: str) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.int32()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[first, "hash", "len", "pos", "typed", "template", "slots", "n_words"])


class Wanted:
    """A set of hashes; most others are told by one look into a table of bits."""

    def __init__(self, hashes: np.ndarray):
        self.own = np.sort(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.own >> np.uint64(44)).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self.table[(h >> np.uint64(44)).astype(np.int64)]
        near = np.flatnonzero(out)
        if len(near):
            at = np.minimum(np.searchsorted(self.own, h[near]), len(self.own) - 1)
            out[near] = self.own[at] == h[near]
        return out


def _texts_with(forms: tuple, n: int, wanted: Wanted) -> list[int]:
    """The texts, by Words.forms of them, that have a window of n words whose hash is wanted."""
    plain, typed, _, text = forms
    inside = text[: max(0, len(text) - n + 1)] == text[n - 1 :]
    hit = np.zeros(len(inside), bool)
    for h in (plain, typed):
        hit |= wanted.has(rolled(h, n))
    return np.unique(text[: len(inside)][hit & inside]).tolist()


def document_windows(docs: DataFrame, lengths: list[int], wanted: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, hash, len, pos, typed, template, slots, n_words): the documents' windows of the given lengths; with wanted, an
    array of hashes, only those whose hash is in it. Windows of under LEAST words are for items of so many words: they match
    whole, and those of one or two words only a document that says nothing else."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = Words(), None if wanted is None else Wanted(wanted)
        for b in pieces(batches):
            rows = []
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            forms = words.forms(texts) if own is not None else None
            for n in lengths:
                for k in range(len(texts)) if own is None else _texts_with(forms, n, own):
                    made = [(ids[k], h, n, p, ty, te, sl, nw) for h, p, ty, te, sl, nw in _windows(words, texts[k], n) if n > 2 or nw == n]
                    if own is not None and made:
                        ok = own.has(np.array([r[1] for r in made], np.int64).view(np.uint64))
                        made = [r for r, y in zip(made, ok, strict=True) if y]
                    rows += made
                    if len(rows) > 20_000:
                        yield _batch(rows, b.column(0).type, "doc")
                        rows = []
            yield _batch(rows, b.column(0).type, "doc")

    return in_arrow(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), of, f"doc {kind}, {_OUT}")


def _met_by_hash(docs: DataFrame, own: DataFrame, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """The documents that share a window's hash with the items own, for item sets too large to travel: bare hashes meet by a
    shuffle, and only documents that share one are cut into windows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in pieces(batches):
            ids = b.column(0)
            plain, typed, _, text = words.forms([t or "" for t in b.column(1).to_pylist()])
            for n in lengths:
                inside = np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :])
                for h in (plain, typed):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[inside])), pa.array(rolled(h, n)[inside].view(np.int64))], names=["doc", "hash"])

    bare = in_arrow(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), of, f"doc {kind}, hash long")
    hit = bare.join(own.select("hash").distinct(), "hash", "left_semi").select(F.col("doc").alias(free_name(docs, "doc"))).distinct()
    return docs.join(hit, docs[id_col] == hit[hit.columns[0]], "left_semi")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id_col, item_col, n_windows, covered, reworded): one row per document and item whose windows match enough.

    covered is the share of the item's words inside matching windows; rows below `coverage` are left out. reworded is true
    where typed windows with other slot values were needed. Null and empty texts match nothing; rows without id, and items
    without id, are no evidence either. Repeated rows give the result once. Empty tables give an empty result; further columns
    are ignored.
    """
    own = item_windows(items, item_col, item_text)
    count = own.limit(MAX_SHIPPED + 1).count()
    lengths = sorted(r[0] for r in own.select("len").distinct().collect())  # WINDOW at most
    if count <= MAX_SHIPPED:
        wanted = np.array([r[0] for r in own.select("hash").distinct().collect()], np.int64).view(np.uint64)
        found = document_windows(docs, lengths, wanted, id_col, text_col)
    else:
        found = document_windows(_met_by_hash(docs, own, lengths, id_col, text_col), lengths, None, id_col, text_col)
    side = own.select("item", "hash", "len", F.col("pos").alias("at"), "typed", "template", F.col("slots").alias("item_slots"), F.col("n_words").alias("item_words"))
    met = found.drop("n_words").join(F.broadcast(side) if count <= MAX_SHIPPED // 20 else side, ["hash", "len", "typed", "template"])
    # Windows are judged together over the whole document, over each place where the item may stand (near alignments, as words
    # may be put in or left out) and over each alignment; the best coverage of these groups counts.
    pairs = met.select("doc", "item", "at", (F.col("pos") - F.col("at")).alias("line"), "len", "item_words", "typed", F.when(F.col("typed"), F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("z"))
    lines = W.partitionBy("doc", "item").orderBy("line")
    step = F.when(F.col("line") - F.lag("line").over(lines) > F.col("item_words") / 2, 1).otherwise(0)
    placed = cut(pairs.distinct().withColumn("step", step).withColumn("spot", F.sum("step").over(lines)))  # else documents are read twice
    groups = [F.struct(F.lit(k).alias("by"), g.cast("long").alias("id")) for k, g in enumerate((F.lit(0), F.col("spot"), F.col("line")))]
    one = placed.select("doc", "item", "at", "len", "item_words", "typed", "z", F.explode(F.array(*groups)).alias("g"))
    # A typed window with the item's own values says no more than the plain one; values must map one to one.
    values = one.where("typed").select("doc", "item", "g", F.explode("z").alias("v")).select("doc", "item", "g", F.col("v.i").alias("i"), F.col("v.d").alias("d")).distinct()
    broken = values.groupBy("doc", "item", "g").agg(((F.count("*") > F.count_distinct("i")) | (F.count("*") > F.count_distinct("d"))).alias("broken"))
    spots = one.groupBy("doc", "item", "g", "at", "len", "item_words").agg(F.min("typed").alias("only_typed"))
    judged = spots.join(broken, ["doc", "item", "g"], "left").where("not only_typed or not coalesce(broken, false)")
    # Words of the item that windows cover: a window adds what reaches beyond the one before it.
    w = W.partitionBy("doc", "item", "g").orderBy("at", "len")
    ends = judged.withColumn("end", F.col("at") + F.col("len"))
    before = F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = ends.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), before)))
    each = parts.groupBy("doc", "item", "g").agg(F.count("*").alias("n_windows"), (F.sum("new") / F.max("item_words")).alias("covered"), F.max("only_typed").alias("reworded"))
    best = F.max(F.struct("covered", (~F.col("reworded")).alias("plain"), "n_windows"))
    total = each.groupBy("doc", "item").agg(best.alias("b")).select("doc", "item", "b.n_windows", "b.covered", (~F.col("b.plain")).alias("reworded"))
    return total.where(F.col("covered") >= coverage).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", F.round("covered", 6).alias("covered"), "reworded")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs that no item contaminates."""
    name = free_name(docs, "bad")
    bad = contaminated(docs, items, id_col, text_col, **more).select(F.col(id_col).alias(name)).distinct()
    return docs.join(bad, docs[id_col] == bad[name], "left_anti")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, as contaminated() says. Null and empty texts hold none; repeats give a pair
    once; an empty table gives no rows; further columns are ignored."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
