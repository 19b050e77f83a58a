"""Main text of pages that were marked by hand, block by block; and work that must stay linear on hostile input."""

import random
import time

import pytest

from measureaudit.llm import decontam, html, pii, simhash

#: (page, its main text): written by hand in usual and unusual layouts; the labeller never sees them.
PAGES = [
    ("<html><body><div id=wrap><div class=top-links><a href=/>Home</a> <a href=/b>Blog</a></div><div class=entry-content><h1>How bread rises</h1><p>Yeast eats sugar and makes gas.</p><p>The dough keeps it.</p></div><div id=right><h3>Archives</h3><ul><li><a href=/1>May</a></li><li><a href=/2>June</a></li></ul></div><div class=footer>Copyright 2019 Bread Club</div></div></body></html>", ["How bread rises", "Yeast eats sugar and makes gas.", "The dough keeps it."]),
    ("<body><header><a href=/>The Daily</a></header><main><article><h1>Rain expected</h1><p class=byline>By A. Writer</p><p>Rain is expected in the north on Monday.</p><figure><figcaption>A wet street.</figcaption></figure><p>It will be dry on Tuesday.</p></article><section class=comments><p>First!</p></section></main><footer>About us</footer></body>", ["Rain expected", "By A. Writer", "Rain is expected in the north on Monday.", "A wet street.", "It will be dry on Tuesday."]),
    ("<body><nav><ul><li><a href=/a>A</a></li></ul></nav><div class=cookie-banner><p>We use cookies to improve the site.</p><button>Accept</button></div><div role=main><h2>Opening hours</h2><table><tr><td>Monday</td><td>9 to 5</td></tr></table><p>Closed on holidays.</p></div><div role=contentinfo>Imprint</div></body>", ["Opening hours", "Monday", "9 to 5", "Closed on holidays."]),
    ("<body><article><h1>Knots</h1><p>A bowline makes a loop.</p><aside class=ad>Buy rope now!</aside><p>A hitch ties to a post.</p><ol><li>Pass the end.</li><li>Pull it tight.</li></ol><form><label>Your mail</label><input></form></article></body>", ["Knots", "A bowline makes a loop.", "A hitch ties to a post.", "Pass the end.", "Pull it tight."]),
    ("<body><div class=masthead>Notes of a gardener</div><div class=post><h2>Tomatoes</h2><p>Plant them after the last frost.<p>Water them every day.<blockquote>Never too much!</blockquote></div><div class=related><a href=/x>Read next: Beans</a></div><div id=disqus><p>I like beans.</p></div></body>", ["Tomatoes", "Plant them after the last frost.", "Water them every day.", "Never too much!"]),
    ("<body><p>Just a page.</p><p>With two paragraphs &amp; nothing else.</p></body>", ["Just a page.", "With two paragraphs & nothing else."]),
    ("<body><div class=breadcrumbs><a href=/>Home</a> &gt; <a href=/t>Travel</a></div><section id=story><h1>By train to the sea</h1><p>The line follows the river.</p><div class=promo>Book a seat</div><p>At the end there is a beach.</p></section><div class=share><a href=#>Share</a></div><div class=newsletter><form>Subscribe <input></form></div></body>", ["By train to the sea", "The line follows the river.", "At the end there is a beach."]),
    ("<body><article class=post><header><h1>On maps</h1></header><p>A map is smaller than the land.</p><pre>scale 1 : 1000</pre><p>It shows what matters.</p></article><div class=sidebar><p>Popular posts</p></div><script>var x = '<p>no</p>';</script></body>", ["On maps", "A map is smaller than the land.", "scale 1 : 1000", "It shows what matters."]),
    ("<body><div class=alert>This site is under maintenance.</div><div id=content><h1>Clocks</h1><p>A pendulum keeps the time.</p><ul><li>weights</li><li>wheels</li></ul><p>Springs came later.</p></div><ul class=menu><li>Start</li><li>Contact</li></ul></body>", ["Clocks", "A pendulum keeps the time.", "weights", "wheels", "Springs came later."]),
    # Noise without any known mark: only place and shape tell.
    ("<body><div class=q1><a href=/>Start</a> <a href=/c>Contact</a></div><article><h1>Owls</h1><p>Owls hunt at night and hear very well.</p><p>They eat mice.</p></article><div class=q9><a href=/i>Imprint</a></div></body>", ["Owls", "Owls hunt at night and hear very well.", "They eat mice."]),
    ("<body><div class=z>Enjoying this? <a href=/j>Join our list</a></div><main><h1>Salt</h1><p>Salt comes from mines and from the sea.</p><p>It keeps food.</p></main><div class=z><a href=/k>Terms</a></div></body>", ["Salt", "Salt comes from mines and from the sea.", "It keeps food."]),
]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return html.train_on(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_blocks_of_marked_pages(model):
    right = wrong = whole = 0
    for page, want in PAGES:
        found = html.blocks(page)
        said = model.scores([html.vectors(found)])[0] > 0.5
        for b, y in zip(found, said, strict=True):
            ok = bool(y) == (b.text in want)
            right, wrong = right + ok, wrong + (not ok)
        whole += [b.text for b, y in zip(found, said, strict=True) if y] == want
    assert right / (right + wrong) >= 0.93 and whole >= 8, (right, wrong, whole)


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<a" * 300_000, '<a "<a ' * 50_000 + ">", "<a '> \"  " * 50_000, "<!" * 300_000, "<section>x</div>" * 30_000, "<p><h1>" * 30_000, "<svg>" * 50_000, '<a ="> "' * 50_000])
def test_hostile_pages_are_read_in_linear_time(page):
    start = time.process_time()
    html.vectors(html.blocks(page)[:1000])
    assert time.process_time() - start < 10


@pytest.mark.parametrize("text", ["token=" * 170_000, "token: " * 140_000, "@" * 500_000, "a@" * 300_000, "1." * 300_000, "+1" * 300_000, "://a:b" * 100_000, "IBAN " * 150_000, "x" * 10**6 + "@"])
def test_hostile_texts_are_searched_in_linear_time(text):
    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 15


def test_cues_inside_a_value_are_judged_alone():
    kinds = lambda t: [t[s:e] for k, s, e in pii.spans(t) if k == "secret"]
    assert kinds("token=mysecret: abc12345") == ["abc12345"]
    assert kinds('token=mysecret=  "abc12345"') == ["abc12345"]
    assert kinds("token=abcdefgh token=a1b2c3d4") == ["a1b2c3d4"]
    assert kinds("password = token=short1 secret=longenough1") == ["token=short1", "longenough1"]


def test_names_of_the_caller_stay(spark):
    names = ["node", "stays", "least", "row", "id", "bad", "doc", "item"]
    rows = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in names]) for k, t in enumerate(["one two three four five six", "one two three four five six", "another text of its own here", "what is 7 plus"])], f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}")
    got = simhash.one_of_each(rows, least=0.8)
    assert got.columns == rows.columns and sorted((r.doc_id, r.node, r.stays, r.least) for r in got.collect()) == [(k, f"node{k}", f"stays{k}", f"least{k}") for k in (0, 2, 3)]
    items = spark.createDataFrame([(9, "what is 7 plus")], "item_id long, text string")
    left = decontam.clean(rows, items)
    assert left.columns == rows.columns and sorted(r.bad for r in left.collect()) == ["bad0", "bad1", "bad2"]


def test_short_items_match_whole(spark):
    items = spark.createDataFrame([(1, "what is 7 plus"), (2, "Yes"), (3, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So, what is 7 plus 5?"), (2, "what is 8 plus 5"), (3, "yes!"), (4, "yes we can"), (5, "Two words."), (6, "here are two words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 1), (3, 2), (5, 3)]


def test_decontamination_is_brute_force(spark):
    """Items of numbered slots, copied none, one or two times with slots kept, changed one to one, or changed inconsistently."""
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    item = lambda k: [r.choice(vocab) if i % 4 else ("#", i % 3) for i in range(20)]
    shapes = [item(k) for k in range(6)]
    fill = lambda shape, v: " ".join(v[w[1]] if isinstance(w, tuple) else w for w in shape)
    base = [[str(100 + 10 * k + j) for j in range(3)] for k in range(6)]
    items = [(k, fill(s, base[k])) for k, s in enumerate(shapes)]
    docs, want = [], set()
    for d in range(60):
        parts = [" ".join(r.choice(vocab) for _ in range(30))]
        for _ in range(r.randrange(3)):
            k, kind = r.randrange(6), r.choice(["same", "changed", "merged"])
            values = base[k] if kind == "same" else [str(r.randrange(1000 + 300 * j, 1300 + 300 * j)) for j in range(3)]
            if kind == "merged":
                values = [values[0]] * 3  # three values of the item have become one: not one to one
            else:
                want.add((d, k))
            parts += [fill(shapes[k], values), " ".join(r.choice(vocab) for _ in range(30))]
        docs.append((d, " ".join(parts)))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and len(want) > 20
