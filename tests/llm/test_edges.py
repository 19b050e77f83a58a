"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from measureaudit.llm import bitpack, chat, decontam, html, lexicon, pii, quality, sharding, simhash, urls
from measureaudit.llm.base import fresh_path

BYTE, WORD = bitpack.vocabulary_file("byte_bpe_50k.json"), bitpack.vocabulary_file("word_bpe_49k.json")
rnd = random.Random(4)
VOCAB = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(900)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(BASE.split()[50], "changed")), (4, None), (5, ""), (6, "   \n\t "), (7, prose(120, 2)), (8, prose(30_000, 3)), (9, "one"), (10, "Mail a.b@c.de or 10.0.0.1, card 4111 1111 1111 1111, tel +1 (017) 555-7713."),
    (None, prose(100, 5)), (None, None), (11, prose(100, 6) + " " + prose(60, 7)), (12, "x" * 5000), (13, "é ñ 日本語 🎉 a\u2028b\xa0c\x1cd"),
]
CLASH = ["id", "fp", "node", "root", "key", "n", "row", "shard", "page", "failed", "doc", "item", "hash", "pos", "spans", "ids", "start", "keys", "lead", "k"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASH}).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


ALL = sorted((i for i, _ in TEXTS), key=lambda x: (x is not None, x))


def brute_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_are_brute_force(spark, docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    assert got == {(i, f"{f:016x}"): least.get(find(k)) for k, (i, f) in enumerate(fps)}
    assert simhash.near_duplicates(docs).count() == len(TEXTS)


def test_grid_join_finds_all_links(spark):
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), k)) for f in fps[:40] for k in (1, 2, 3, 4)] + [0, 1, 7, 15, 2**64 - 1]
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(zip(fps, signed, strict=True), 2) if (x ^ y).bit_count() <= 3}


def test_one_of_each_keeps_one_per_group(spark, docs):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    # Row 3 has one word changed: over three bits away, but a near copy by shingles.
    assert (brute_fingerprint(TEXTS[0][1]) ^ brute_fingerprint(TEXTS[3][1])).bit_count() > 3
    assert ids(out) == [None, 1, 3, 4, 7, 8, 9, 10, 11, 12, 13]
    many = spark.createDataFrame([(k, BASE + f" tail{k}") for k in range(60)] + [(100 + k, prose(90, 100 + k)) for k in range(30)], "doc_id long, text string")
    assert ids(simhash.one_of_each(many, least=0.8)) == [0, *range(100, 130)]
    assert ids(simhash.one_of_each(docs, least=0.8)) == [None, 1, 4, 7, 8, 9, 10, 11, 12, 13]


def test_quality_ledger_is_brute_force(spark, docs):
    def brute(t):
        ws = re.findall("[^\x20\x09-\x0d]+", t or "")
        grams = list(zip(ws, ws[1:], ws[2:], strict=False))
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(covered)

    more = spark.createDataFrame([(20, "a b c a b c a"), (21, "a a a a a"), (22, "x | y\nx | y\n\n# z"), (23, "a b c d")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "failed").unionByName(more.withColumn("failed", F.lit("f")))
    got = sorted((tuple(r[m] for m in quality.MEASURES) for r in quality.ledger(both).collect()))
    assert got == sorted(brute(t) for t in [t for _, t in TEXTS] + [r.text for r in more.collect()])
    book = quality.ledger(both)
    for row in quality.ablation(book, "base").collect():
        bit = 1 << [n for n, _ in quality.RULES].index(row.rule)
        rows = [r.failed & 3 for r in book.collect()]
        assert (row.n_failed, row.n_only) == (sum(bool(x & bit) for x in rows), sum(x == bit for x in rows))


def brute_spans(t):
    found = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii._luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t or "") if ok(m.group())]
    return sorted(found, key=lambda s: (s[1], pii.BASE.index(s[0]), s[2]))


def test_base_spans_are_the_patterns_matches():
    r = random.Random(6)
    bits = ["a.b@", "c-d.e", "@", ".", "x@y.z", "1.2.3.4", "300.1.1.1", "5.6.7.8.9.10.11.12", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+", "(", ")", "-", " ", "  ", "12", "0", "é", "\n", "++12", "+4", "token = \"a1b2c3d4e5\"", "https://u:p1@h.com/"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(12)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == brute_spans(t), t


def test_find_and_mask(spark, docs):
    rows = pii.find(docs).collect()
    assert sorted(len(r.spans) for r in rows)[-1] == 4 and len(rows) == len(TEXTS)
    assert pii.mask_text("Mail a.b@c.de, token = \"a1b2c3d4e5\"!") == 'Mail <EMAIL>, token = "<SECRET>"!'
    assert pii.mask_text(None) is None and pii.mask_text("plain") == "plain"
    assert docs.select(pii.masked(F.col("text")).alias("m")).where("m like '%<CARD>%'").count() == 1


def test_chat_reads_back(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "### a \\ </turn>"), (1, 2, "assistant", "\\h \\e #### \\\\"), (2, 0, "assistant", "no"), (3, 0, "user", None), (3, 0, "user", None), (4, 1, None, "x: y"), (4, 1, "od:d\\r", "z"), (None, 0, "user", ""), (5, 0, "user", "q" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(df).withColumn("f", chat.formatted(F.col("segments"))).withColumn("back", chat.read_back(F.col("f"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for k in out:
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == k), key=lambda v: v)
        assert [(b.role, b.text) for b in out[k].back] == [(r, x) for _, r, x in want]
    assert {k: (r.valid, r.bad_turn) for k, r in out.items()} == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 0), None: (True, None), 5: (True, None)}
    assert out[1].loss == "\\h \\e #### \\\\" and out[3].loss == ""
    assert chat.format_chats(df.where("false")).count() == 0
    alone = chat.format_chats(spark.createDataFrame([(None, 1, "user", "a"), (None, 2, "assistant", "b"), (None, 1, "user", "a")], "conv_id long, turn long, role string, text string"))
    assert sorted(len(r.segments) for r in alone.collect()) == [3, 3, 3]


def test_urls_sweep_join_and_brute_force_agree(spark):
    r = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "xexample.org", "com", "b.com", "EXAMPLE.org", "", "a..b"]
    page = [(k, r.choice(["http://", "https://", "", "x://y://"]) + r.choice(hosts) + r.choice(["", "/", "/es/", "/en/1", "/en/12?x", "/fr/a#b", "/de/"])) for k in range(300)] + [(None, None), (1, ""), (1, "")]
    df = spark.createDataFrame(page, "page_id long, url string").withColumn("rule", F.lit("clash")).repartition(4)
    rules = spark.createDataFrame([*urls.RULES, ("example.org/", "block"), ("org/", "allow"), (None, "block")], "rule string, verdict string")
    swept = sorted(map(tuple, urls.judge(df, rules).collect()), key=str)

    def brute(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in ((x.split("/")[0], "/" + x.split("/", 1)[1], v) for x, v in [*urls.RULES, ("example.org/", "block")]) if ("." + host).endswith("." + h) and path.startswith(p)]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    assert swept == sorted(((k, *brute(u)) for k, u in page), key=str)
    old, urls.MAX_SHIPPED_RULES = urls.MAX_SHIPPED_RULES, 0
    try:
        assert sorted(map(tuple, urls.judge(df, rules).collect()), key=str) == swept
    finally:
        urls.MAX_SHIPPED_RULES = old


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = fresh_path(spark, "tokens-test")
    bitpack.write_tokens(docs, path, BYTE)
    rows = sorted(bitpack.read_tokens(spark, path, bitpack._crc, "ids_crc32 long").collect(), key=lambda r: r.start)
    own, at = Tokenizer.from_file(BYTE), 0
    want = {}
    for i, t in TEXTS:
        x = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    assert [r.doc_id for r in rows] == ALL
    for r in rows:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing_and_random_access(width):
    x = np.random.default_rng(width).integers(0, 2**width, 40_001).astype(np.uint32)
    f = bitpack.TokenFile(bitpack.write_file([3, None], [x[:17], x[17:]], width))
    assert f.doc_ids == [3, None] and (f.document(0) == x[:17]).all() and (f.document(1) == x[17:]).all()
    assert (f.ids(16_000, 33_000) == x[16_000:33_000]).all() and len(f.ids(5, 5)) == 0


def test_encoders_agree_with_the_library():
    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = ["".join(r.choice(" \n\t a b'sé1२½ΣİǅŒ\x1c\x85　—…don't we'll 'RE #$|<|endoftext|><|startoftext|>") for _ in range(r.randrange(60))) for _ in range(1500)]
    odd += ["", " ", "a ", " a", "a  b", "a\n b", "it's  don't", "x" * 300, "ab" * 5000, "é" * 200, "ΑΣ ΣΑΣ", "İstanbul", "a\u2003b\u2028c"] + [t or "" for _, t in TEXTS]
    own = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in bitpack.ByteEncoder(BYTE).encode(odd)] == [e.ids for e in own.encode_batch(odd, add_special_tokens=False)]
    word, bpe = Tokenizer.from_file(WORD), lexicon.word_bpe(WORD)
    some = sorted({w.encode() for w in VOCAB[:300]})
    enc = lexicon.Encoder(WORD, lexicon.compile_words(some, [bpe.merge(w) for w in some]))
    want = [e.ids for e in word.encode_batch(odd, add_special_tokens=False)]
    got = enc.encode(odd)
    assert [x.tolist() for x in got] == want
    assert [enc.decode(x) for x in got] == [word.decode(x, skip_special_tokens=False) for x in want]
    assert (enc.lexicon.ranks(some) == np.arange(len(some))).all() and (enc.lexicon.ranks([b"zzqq", b"", some[3] + b"\xff"]) == -1).all()
    empty = lexicon.Encoder(WORD, lexicon.compile_words([], []))
    assert empty.encode(["hello"])[0].tolist() == word.encode("hello", add_special_tokens=False).ids


def test_bpe_of_a_table(spark, docs):
    from tokenizers import Tokenizer

    data, own = lexicon.build_lexicon(docs, WORD), Tokenizer.from_file(WORD)
    want = sorted((len(x := own.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for _, t in TEXTS)
    assert sorted((r.n_tokens, r.ids_sha256) for r in lexicon.digests(docs, WORD, data).collect()) == want
    assert sorted(len(r.ids) for r in lexicon.encode(docs, WORD, data).collect()) == sorted(n for n, _ in want)
    assert lexicon.build_lexicon(docs.where("false"), WORD)


def test_shards_fit_and_hold_every_row(spark, docs):
    copies = spark.createDataFrame([(77, "copy " * 40)] * 300 + [(k, "t" * (k % 50)) for k in range(500)], "doc_id long, text string")
    for df, limit in ((copies, 2000), (docs.select("doc_id", "text", "shard", "page"), 1000)):
        out = sharding.shards(df, max_bytes=limit)
        assert out.count() == df.count()
        sizes = out.groupBy("shard", "page").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
        assert all(r.b <= limit or r.n == 1 for r in sizes)
        names = sorted({r.shard for r in sizes if len(r.shard) < 60})
        assert not any(b.startswith(a) and a != b for a, b in zip(names, names[1:], strict=False))
    path = fresh_path(spark, "shards-test")
    sharding.write_shards(docs, path, max_bytes=1000)
    assert spark.read.parquet(path).count() == docs.count()


def test_html_blocks_and_labels(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/x>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p>First\n  para<br>graph <b>bold<p>Second&nbsp;one"
        "<div class=comments><p>Nice!</p></div></article><aside>Side</aside><footer>&copy; F</footer>"
    )
    assert [b.text for b in html.blocks(page)] == ["Menu", "We use cookies", "A & B", "First para graph bold", "Second one", "Nice!", "Side", "© F"]
    assert html.blocks(None) == html.blocks("") == html.blocks("<!-- x") == []
    rng = np.random.default_rng(3)
    texts = [prose(12, k) + "." for k in range(80)]
    model = html.train([html.composed(texts, rng) for _ in range(80)])
    held = [b for _ in range(200) if (b := html.blocks(html.composed(texts, rng)))]
    said = model.scores([html.vectors(b) for b in held])
    wrong = sum(int(((s > 0.5) != html.labels(b)).sum()) for s, b in zip(said, held, strict=True))
    assert wrong <= 0.01 * sum(map(len, held))
    df = spark.createDataFrame([(1, page), (2, None), (2, ""), (None, "<p"), (3, "<p>" * 3000 + "deep"), (4, "plain & text"), (5, page)], "page_id long, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df, model)
    assert got.count() == 7 and got.where("page_id = 1").first().text == "A & B\nFirst para graph bold\nSecond one"
    assert html.extract(df.where("false"), model).count() == 0
    assert html.train_on(df.where("false")).p["V"].shape == (2 * html.HIDDEN, 1)


def test_decontamination_finds_reworded_items(spark, docs):
    item = "A train leaves Boston at 7 pm and runs 120 km before Alice gets off the train and walks home slowly"
    moved = item.replace("120", "365").replace("Alice", "Robert").replace("Boston", "Denver").replace("7", "9")
    broken = "A train with 5 km and 5 km of track costs 5 usd each and 5 km more than the old road did"
    items = spark.createDataFrame([(1, item), (2, broken), (3, None), (4, "too short"), (None, item), (5, "five words are just enough"), (1, item)], "item_id long, text string").withColumn("doc", F.lit("clash"))
    more = spark.createDataFrame(
        [(50, prose(40, 50) + " " + item.upper() + " " + prose(40, 51)), (51, prose(40, 52) + " " + moved + ". " + prose(30, 53)), (52, broken.replace("5 km and", "6 km and").replace("costs 5", "costs 7")), (53, "So five words are just enough, really"), (54, prose(300, 54)), (55, item), (55, item)],
        "doc_id long, text string",
    )
    both = docs.select("doc_id", "text", "item", "hash", "pos").unionByName(more.withColumns({c: F.lit("x") for c in ("item", "hash", "pos")}))
    got = sorted((r.doc_id, r.item_id, r.reworded) for r in decontam.contaminated(both, items).collect())
    assert got == [(50, 1, False), (51, 1, True), (53, 5, False), (55, 1, False)]
    old, decontam.MAX_SHIPPED = decontam.MAX_SHIPPED, 1
    try:
        assert sorted((r.doc_id, r.item_id, r.reworded) for r in decontam.contaminated(both, items).collect()) == got
    finally:
        decontam.MAX_SHIPPED = old
    assert ids(decontam.clean(both, items)) == sorted([*ALL, 52, 54], key=lambda x: (x is not None, x if x is not None else 0))
    assert decontam.contaminated(both.where("false"), items).count() == decontam.contaminated(both, items.where("false")).count() == 0


def test_pipeline_stages(spark, docs, sf_dir):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf_dir)
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
        if name != "bpe":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            path = fresh_path(spark, name)
            out.write.parquet(path)
            now = spark.read.parquet(path)
    # Row 3 is a near copy of row 1 by shingles, so it goes.
    assert ids(now) == [None, 1, 7, 8, 11]
    assert out.count() == 5


def test_pipeline_over_documents_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    book = {r.doc_id for r in quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.failed == 0}
    left = {r.doc_id: r.text for r in rows if r.doc_id in book}
    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    root = {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(left), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3 or simhash.similarity(left[a], left[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i for i in left if find(i) == i and not any(t in left[i] for t in items)}
    assert set(out) <= {i for i in left if find(i) == i}
    assert want - set(out) == set() or all(any(" ".join(t.split()[:10]) in " ".join(left[i].split()) for t in items) for i in want - set(out))
    assert not any(any(t in left[i] for t in items) for i in out)
