"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words most frequent in the corpus are compiled into a minimal acyclic automaton whose equal suffixes are shared. Each
transition carries the number of words that precede it in order; summed along a word's path they give the word's rank, and
a table by rank gives its ids. The automaton is flat arrays in one file that each worker maps into memory, and many words
walk it at once in numpy. Words that it lacks are merged pair by pair, by the rank of the merges, exactly.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, in_arrow, pieces, table
from .bitpack import vocabulary_file

#: Words in the automaton, the most frequent of the corpus first.
WORDS = 100_000
#: Longer words are merged, not compiled.
LONGEST = 40
#: Cached chunks per worker, and their characters and bytes of ids; beyond either the cache starts anew.
CACHE, CACHE_BYTES = 150_000, 16 << 20

# The white space of the tokenizer's pattern language.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
_NEVER = np.int32(2**31 - 1)
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CHUNKS = re.compile(f"[^{_WHITE}]+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A BPE tokenizer file with word ends: vocabulary, merge ranks, special tokens; merges a word's bytes exactly."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model = own["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in own["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        letters = _byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.n = len(self.strings)
        pairs = np.array([a * self.n + b for a, b in self.merges] or [0], np.int64)
        order = np.argsort(pairs)
        self.pairs, own = pairs[order], np.array(list(self.merges.values()) or [(0, 0)], np.int64)[order]
        self.pair_rank, self.pair_to = own[:, 0].astype(np.int32), own[:, 1].astype(np.int32)
        self.first_of, self.last_of = np.array(self.first, np.int32), np.array(self.last, np.int32)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank is merged, the leftmost first, until none is left."""
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > 64:
            return self._merge_long(ids)
        find = self.merges.get
        pairs = [find(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, p in enumerate(pairs):
                if p is not None and (best is None or p[0] < best):
                    best, at = p[0], i
            if at < 0:
                return ids
            ids[at : at + 2] = [pairs[at][1]]
            del pairs[at]
            if at > 0:
                pairs[at - 1] = find((ids[at - 1], ids[at]))
            if at < len(pairs):
                pairs[at] = find((ids[at], ids[at + 1]))

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = a.astype(np.int64) * self.n + b
        at = np.searchsorted(self.pairs, want)
        at[at == len(self.pairs)] = 0
        hit = (self.pairs[at] == want) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], _NEVER), self.pair_to[at]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """merge() of many words at once, as little-endian unsigned 32-bit ids."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for low, high in ((1, 6), (7, 9), (10, 13), (14, 20), (21, 40)):
            own = np.flatnonzero((size >= low) & (size <= high))
            for i in range(0, len(own), 20_000):
                some = own[i : i + 20_000]
                for k, data in zip(some.tolist(), self._merge_table([words[k] for k in some], size[some]), strict=True):
                    out[k] = data
        for k in np.flatnonzero(size > 40):
            out[k] = np.array(self.merge(words[k]), "<u4").tobytes()
        return out

    def _merge_table(self, words: list[bytes], size: np.ndarray) -> list[bytes]:
        """One row per word; each round merges every row's best pair and closes the gap."""
        n, wide = len(words), int(size.max())
        places = np.arange(wide)
        filled = places < size[:, None]
        ids = np.full((n, wide), -1, np.int32)
        ids[filled] = self.first_of[np.frombuffer(b"".join(words), np.uint8)]
        lasts = np.array([w[-1] for w in words])
        ids[np.arange(n), size - 1] = self.last_of[lasts]
        rank, to = np.full((n, wide), _NEVER, np.int32), np.zeros((n, wide), np.int32)
        r, t = self._rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank[:, :-1], to[:, :-1] = r.reshape(n, -1), t.reshape(n, -1)
        done_ids, rows = np.full((n, wide), -1, np.int32), np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            live = rank[line, at] < _NEVER
            if not live.all():
                done_ids[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, rank, to, at = rows[live], ids[live], rank[live], to[live], at[live]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = to[line, at]
            # What stands after the pair moves one place to the left.
            source = np.minimum(places[: ids.shape[1]] + (places[: ids.shape[1]] > at[:, None]), ids.shape[1] - 1)
            ids, rank, to = (np.take_along_axis(x, source, 1) for x in (ids, rank, to))
            ids[:, -1], rank[:, -1] = -1, _NEVER
            if ids.shape[1] > 2:
                ids, rank, to = ids[:, :-1], rank[:, :-1], to[:, :-1]
            wide = ids.shape[1]
            for x in (at - 1, at):
                ok = np.flatnonzero((x >= 0) & (x + 1 < wide))
                r, t = self._rank_of(ids[ok, x[ok]], ids[ok, x[ok] + 1])
                rank[ok, x[ok]], to[ok, x[ok]] = r, t
            end = at + 1 >= wide
            rank[np.flatnonzero(end), at[end]] = _NEVER
        full = done_ids >= 0
        counts, flat = full.sum(1), done_ids[full].astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked symbols, for very long words."""
        import heapq

        n, find = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = find((a, b))[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := find((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def normal(text: str) -> str:
    """NFC, then lower case character by character. White space stays; it only separates."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def chunks(text: str) -> list[str]:
    return _CHUNKS.findall(text) if _SEPARATORS.search(text) else text.split()


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton of sorted distinct words and their ids, as one npz file."""
    # Incremental minimisation: states of the last word's path are open; closed states are registered by their transitions.
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...))
    path: list[list] = [[False, []]]  # open states of the last word: [final, [(byte, state) ...]]
    letters: list[int] = []

    def close(down_to: int) -> None:
        while len(letters) > down_to:
            final, moves = path.pop()
            key = (final, tuple(moves))
            if (s := register.get(key)) is None:
                s = register[key] = len(states)
                states.append(key)
            path[-1][1].append((letters.pop(), s))

    for w in words:
        k = 0
        while k < len(letters) and k < len(w) and letters[k] == w[k]:
            k += 1
        close(k)
        for b in w[k:]:
            letters.append(b)
            path.append([False, []])
        path[-1][0] = True
    close(0)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))
    # Every state comes after those it leads to, so counts are known in order.
    counts, keys, to, before = [], [], [], []
    for s, (final, moves) in enumerate(states):
        n = int(final)
        for b, t in moves:
            keys.append(s * 256 + b)
            to.append(t)
            before.append(n)
            n += counts[t]
        counts.append(n)
    out = io.BytesIO()
    np.savez(
        out, keys=np.array(keys, np.int64), to=np.array(to, np.int32), before=np.array(before, np.int32), final=np.array([f for f, _ in states], bool), root=np.int64(root),
        starts=np.cumsum([0, *map(len, ids)]).astype(np.int64), ids=np.array([i for x in ids for i in x], np.uint32),
    )
    return out.getvalue()


class Lexicon:
    """The automaton's arrays, mapped into memory. ranks() walks all words at once."""

    def __init__(self, data: bytes):
        # Each worker maps files of its own and takes their names away at once: they go with the worker, and nothing stays.
        with tempfile.TemporaryDirectory(prefix="lexicon-") as place:
            own = {}
            for name, x in np.load(io.BytesIO(data)).items():
                np.save(os.path.join(place, f"{name}.npy"), x)
                own[name] = np.load(os.path.join(place, f"{name}.npy"), mmap_mode="r" if x.size else None)
        self.keys, self.to, self.before, self.final, self.starts, self.ids = (own[k] for k in ("keys", "to", "before", "final", "starts", "ids"))
        self.root = int(own["root"][()])

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that the automaton lacks."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1, np.int64)
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        state, rank = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        dead = np.ones(n, bool)
        dead[live] = False
        for step in range(int(size[live].max()) if len(live) else 0):
            on = live[size[live] > step]
            if not len(on):
                break
            want = state[on] * 256 + flat[start[on] + step]
            at = np.searchsorted(self.keys, want)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == want
            dead[on[~hit]] = True
            on, at = on[hit], at[hit]
            rank[on] += self.before[at]
            state[on] = self.to[at]
            live = live[~dead[live]]
        ok = ~dead & self.final[state]
        return np.where(ok, rank, -1)

    def word_ids(self, ranks: np.ndarray) -> list[bytes]:
        data = self.ids[:].astype("<u4").tobytes() if len(ranks) > len(self.starts) // 8 else None
        own = zip((4 * self.starts[ranks]).tolist(), (4 * self.starts[ranks + 1]).tolist(), strict=True)
        return [data[a:b] if data is not None else self.ids[a // 4 : b // 4].tobytes() for a, b in own]


class Encoder:
    """Encodes texts with a tokenizer file and a lexicon; caches whole chunks between white space."""

    def __init__(self, path: str, data: bytes):
        self.bpe, self.lexicon, self.cache, self.held = word_bpe(path), Lexicon(data), {}, 0

    def _learn(self, new: list[str]) -> None:
        cut = [_PIECES.findall(c) for c in new]
        words = list(set().union(*cut))
        coded = [w.encode() for w in words]
        ranks = self.lexicon.ranks(coded)
        has = ranks >= 0
        known = dict(zip(np.array(words, object)[has].tolist(), self.lexicon.word_ids(ranks[has]), strict=True))
        unseen = np.flatnonzero(~has).tolist()
        known.update(zip([words[k] for k in unseen], self.bpe.merge_all([coded[k] for k in unseen]), strict=True))
        for c, ws in zip(new, cut, strict=True):
            self.cache[c] = ids = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])
            self.held += len(c) + len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = []  # per text: chunks, or the id of a special token
        for t in texts:
            if "<|" in t and self.bpe.cut.search(t):
                own = [[self.bpe.special[p]] if p in self.bpe.special else chunks(normal(p)) for p in self.bpe.cut.split(t)]
                parts.append([x for p in own for x in p])
            else:
                parts.append(chunks(normal(t)))
        if len(self.cache) > CACHE or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        new = {c for c in set().union(*parts) if isinstance(c, str)} - self.cache.keys()
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join([get(c) if isinstance(c, str) else np.array([c], "<u4").tobytes() for c in p] if "<|" in t else map(get, p)), "<u4") for t, p in zip(texts, parts, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes without a decoder: the tokens' own strings, joined by spaces."""
        return " ".join(map(self.bpe.strings.__getitem__, ids.tolist()))


_open: dict[str, Encoder] = {}


def _encoder(path: str, data: bytes) -> Encoder:
    name = hashlib.sha256(data).hexdigest() + path
    if name not in _open:
        _open.clear()
        _open[name] = Encoder(path, data)
    return _open[name]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts, after normalisation and the tokenizer's own word pattern."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            split: Counter = Counter()
            for c, n in held.items():
                for p in _PIECES.findall(c):
                    if len(p) <= LONGEST:
                        split[p] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(split.keys(), pa.string()), pa.array(split.values(), pa.int64())], names=["word", "n"])

        for b in pieces(batches):
            for t in b.column(0).to_pylist():
                held.update(chunks(normal(t or "")))
                if len(held) > CACHE:
                    yield out()
        if held:
            yield out()

    return in_arrow(docs.select(F.col(text_col).alias("text")), of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", words: int = WORDS) -> bytes:
    """The automaton of the most frequent words of docs, as bytes. It takes the words of the highest counts, as many counts
    as keep it within `words`; words seen once never enter. So what reaches the driver is bounded by `words` and LONGEST.
    Null and empty texts add nothing; a table without words gives an empty automaton, with which every word is merged."""
    counts = cut(word_counts(docs, text_col).where("n > 1"))
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    # How many words have a count of n or more, for the counts that matter: the running sum is over distinct counts only.
    ranked = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("n", "words")), asc=False).alias("c")).first()
    least, total = None, 0
    for n, k in ranked["c"] or []:
        total += k
        if total > words:
            break
        least = n
    top = counts.where(F.col("n") >= least).select("word").collect() if least else []
    own = sorted(w for r in top if 0 < len(w := r.word.encode()) <= LONGEST)
    bpe = word_bpe(tokenizer)
    return compile_words(own, [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_all(own)])


def encode(docs: DataFrame, tokenizer: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): one row per input row. Null and empty texts have no ids. Special tokens in a text are recognised, as
    the library does by default. An empty table gives an empty result; further columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, lexicon)
        for b in pieces(batches):
            ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["id", "ids"])

    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode, decode and digest in one pass, without shipping the ids. One row per
    input row, as encode() has them; a text without ids decodes to an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, lexicon)
        for b in pieces(batches):
            ids = enc.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return in_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), of, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding. Null and empty texts have no ids and decode to an empty text; repeats
    are encoded like others; an empty table gives no rows; further columns are ignored."""
    docs, own = table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json")
    return digests(docs, own, build_lexicon(docs, own))
