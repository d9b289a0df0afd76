import pytest

from lexiframe.llm import html_extract as H
from lexiframe.llm.dom import TEXT, parse


def runs(source):
    return [t for t in parse(source).text if t]


def test_reader_blocks_and_references():
    assert runs("<p>a <b>b</b>c<br>d&amp;&lt;&#233;&nbsp; x</p>tail<div>e<p>f<p>g") == ["a bc d&<é x", "tail", "e", "f", "g"]
    assert runs("<script>var t='</p>';</script><style>p{}</style><title>t</title><!-- c --><p>x") == ["x"]
    assert runs("<script>never closed <p>x</p>") == []
    assert runs("<a title=\"x > y\">l</a> 1 < 2 <3") == ["l 1 < 2 <3"]
    assert runs("</div></p>a</b>b") == ["ab"] or runs("</div></p>a</b>b") == ["a", "b"]
    assert runs("") == [] and runs("plain") == ["plain"] and runs("<<<>>>") == ["<<<>>>"]


def test_reader_keeps_the_text_after_malformed_tags():
    assert runs("<a title=it's>Read</a><p>Main text don't stop</p>") == ["Read", "Main text don't stop"]
    assert runs('<img alt="5" monitor"><p>x "a <b>b</b>" y</p>') == ['x "a b" y']
    assert runs("<p class='a'b' c>x</p><p title = \"d > e\"f='>'>y") == ["x", "y"]
    assert runs("<p '>x</p><p =\">y</p><p title=>z</p><p title=\"w>v") == ["x", "y", "z", "v"]
    assert runs("<br/><a href='/x'/>l</a><div/>m") == ["l", "m"]
    assert runs("<script>a</script x>b<style>c</style/>d") == ["b", "d"]


def test_reader_ends_unclosed_unseen_elements():
    assert runs("<svg><path d='M0'><text>t</text><p>Main</p><svg><text>t</text></svg>") == ["Main"]
    assert runs("<div><svg><g><text>t</g></div>Main<math><mi>x</mi><h2>Head</h2>") == ["Main", "Head"]
    assert runs("<span><svg><a>t</a></span>Main") == ["Main"] and runs("<svg/>Main") == ["Main"]
    assert runs("<svg><foreignObject><p>t</p></foreignObject><title>t</title><svg><text>t</svg></svg>Main") == ["Main"]
    assert runs("<svg><title>t<p>Main</p>") == ["Main"] and runs("a<math><mtext><b>t</b></mtext></math>b") == ["ab"]
    assert runs("<video src=x><p>Main</p><canvas><p>Other</p>") == ["Main", "Other"]
    assert runs("<video src=x>t</video>Main<textarea>t <p>t</p>") == ["Main"]


def test_reader_closes_what_is_left_open():
    page = parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>")
    assert [t for t in page.text if t] == list("abcdefg")
    depth = {}
    for i, p in enumerate(page.parent):
        depth[i] = depth.get(p, -1) + 1
    d = {page.text[i]: depth[i] for i in depth if page.text[i]}
    assert d["a"] == d["b"] == d["d"] and d["c"] > d["b"] and d["e"] == d["f"] == d["g"]


def test_very_deep_and_very_long_pages(model):
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert runs(deep) == ["x"]
    body = "<article>" + "<p>Some words in a long paragraph, and a few more. And so on.</p>" * 20_000 + "</article>"
    long = "<html><body><nav><ul><li><a href=/>x</a></li></ul></nav>" + body + "<footer>&copy; y</footer>"
    assert model.texts([long])[0].count("paragraph") == 20_000


@pytest.fixture(scope="module")
def sample(spark):
    from conftest import SF001
    return sorted(r[0] for r in spark.read.parquet(f"{SF001}/pages.parquet").select("html").collect())


@pytest.fixture(scope="module")
def model(sample):
    return H.train(sample, drawn_pages=400)


def test_held_out_drawn_pages(model, sample):
    words = sorted({w for s in sample[:20] for t in runs(s) for w in t.split()})
    drawer, exact, kept, wanted, wrong = H.Drawer(words, seed=123), 0, 0, 0, 0
    for _ in range(200):
        page, y = H.drawn(drawer.page())
        truth = [page.text[i] for i, t in enumerate(page.tag) if t == TEXT and y[i]]
        got = H.decode(page, model.trees.log_odds(H.features(page, model.weights)))
        exact += got == " ".join(truth)
        wanted += sum(map(len, truth))
        kept += len(got)
    assert exact >= 190 and 0.97 < kept / wanted < 1.03


def test_decoding_keeps_parents_of_kept_nodes(model):
    page = parse("<div><nav>menu</nav><article><p>text</p></article></div>")
    import numpy as np
    odds = np.array([0, -1, -5, -5, 2.0, 2.0, 3.0])
    assert H.decode(page, odds) == "text"
    assert H.decode(page, np.array([0, -9, -5, 5.0, 1.0, 1.0, 1.0])) == ""  # a rejected ancestor outweighs all below


def test_articles_of_the_pages_table(spark):
    import html as h
    import re

    from conftest import SF001
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    rows = H.extract(pages, "page_id").collect()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(h.unescape(re.sub(r"</?[a-z][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "<nav><a href=x>y</a></nav>")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "page_id long, html string, text string, n_chars int")
    out = H.extract(df, "page_id").collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in out) == [("1", ""), ("1", ""), ("2", ""), ("None", "")]
    assert H.extract(df.limit(0), "page_id").collect() == []


def test_sample_is_the_same_whatever_the_order_of_rows(spark):
    rows = [(7, f"<article><p>copy {i}</p></article>") for i in range(300)] + [(i, f"<p>{i}</p>") for i in range(100, 140)]
    rows += [(None, "<p>no id</p>"), (8, None), (9, "<p>" + "long " * 20_000 + "</p>"), (100, "<p>100</p>")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    one, two = H.sampled(df.repartition(1), 30), H.sampled(spark.createDataFrame(rows[::-1], df.schema).repartition(7), 30)
    assert one == two and 0 < len(one) <= 30 and len(set(one)) == len(one)
    whole = H.sampled(df, 1000)
    assert len(whole) == 340 and max(map(len, whole)) <= H.SAMPLE_CHARS


def test_words_of_whole_texts_are_drawn_by_digest():
    texts = [" ".join(f"w{i}" for i in range(a, a + 700)) for a in range(0, 7000, 700)]
    assert H.sampled_words(texts) == sorted(f"w{i}" for i in range(7000))  # no prefix of a text is enough
    some = H.sampled_words(texts, 1000)
    assert len(some) == 1000 and some == H.sampled_words(texts[::-1], 1000)
    assert sum(w > "w5" for w in some) > 300  # spread over the alphabet


def test_boosting_learns_an_interaction():
    import numpy as np
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = H.boost(x[:1500], y[:1500], rounds=30)
    assert ((trees.log_odds(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
