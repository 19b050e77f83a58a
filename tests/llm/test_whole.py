"""Cases in which an operator once did less than the whole job."""

import itertools
import random

import corpus_pipeline
from measureaudit.llm import decontam, html, simhash

from .test_edges import BASE, brute_fingerprint, docs, ids, prose  # noqa: F401


def test_near_dedup_stage_drops_near_copies_by_shingles(spark, docs):  # noqa: F811
    assert ids(corpus_pipeline.near_dedup(spark, docs, "")) == [None, 1, 4, 7, 8, 9, 10, 11, 12, 13]


def test_groups_of_near_copies_are_brute_force(spark):
    r, texts = random.Random(11), []
    for k in range(12):
        words = prose(60 + 5 * k, 900 + k).split()
        for _ in range(5):
            words = list(words)
            for _ in range(r.randrange(1, 3)):  # chains: each text is a changed copy of the one before
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [prose(80, 990 + k) + " " + prose(25, 989) for k in range(20)]  # texts that share a passage
    r.shuffle(texts)
    fps, root = [brute_fingerprint(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3 or simhash.similarity(texts[a], texts[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [i for i in range(len(texts)) if find(i) == i]
    assert 20 < len(want) < 70
    old = simhash.SAMPLE, simhash.FREQUENT
    assert ids(simhash.one_of_each(df, least=0.8)) == want
    simhash.SAMPLE, simhash.FREQUENT = 1, 2
    try:
        assert ids(simhash.one_of_each(df, least=0.8)) == want
    finally:
        simhash.SAMPLE, simhash.FREQUENT = old


def test_decontamination_judges_each_place_in_both_directions(spark):
    item = "A train leaves Boston at 7 pm and runs 120 km before Alice gets off the train and walks home slowly"
    one = item.replace("120", "365").replace("Alice", "Robert")
    two = item.replace("120", "48").replace("Alice", "Maria").replace("7", "9")
    put_in = one.replace("before Alice", "before").replace("gets off", "then gets off")
    items = spark.createDataFrame([(1, item), (2, "Every box of 5 pens and each pack of 7 pens is sent away today")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, one + ". " + two), (2, one + ". " + prose(300, 1) + " " + item[:60]), (3, put_in), (4, "Every box of 6 pens and each pack of 6 pens is sent away today"), (5, "Every box of 6 pens and each pack of 8 pens is sent away today")],
        "doc_id long, text string",
    )
    got = sorted((r.doc_id, r.item_id, r.reworded) for r in decontam.contaminated(docs, items).collect())
    assert got == [(1, 1, True), (2, 1, True), (3, 1, True), (5, 2, True)]


def test_html_elements_without_end_do_not_swallow_the_page():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts('<p>a <svg class="i"/> b</p><p>rest</p>') == ["a b", "rest"]
    assert texts("<p>a <math/> b</p><script src=x /><p>rest</p>") == ["a b", "rest"]
    assert texts("<p>a</p><select><option>x<p>rest</p>")[-1] == "rest" and texts("<title>T<p>rest</p>") == ["T", "rest"]
    assert texts("<object-card>a</object-card><select-box>b</select-box><p>rest</p>") == ["ab", "rest"]
    assert texts("<article><p>x <math><mi>y</mi></math> z</p><noscript>n</noscript><object>o</object></article>") == ["x y z", "no"]
    assert texts("<p>a <svg><text>no</text></svg>b</p><title>no</title><script>no") == ["a b"]
