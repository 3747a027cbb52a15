"""Quality classifier, nearest neighbours, HTML extraction and quotation linking."""

import os
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lithospark.llm import quality, queries, vamana
from lithospark.llm.html_extract import extract_main_text, main_text
from lithospark.llm.quotes import link_quotes, parse
from tests.llm.plain_html import plain_text


def prose(rng, junk):
    words = ["the", "of", "and", "plain", "text", "about", "rivers", "and", "houses", "in", "spring"]
    if junk:
        return rng.choice([" ".join(rng.choice(words).upper() + "!!" for _ in range(60)), ("spam " * 80), " | ".join(rng.choice(words) for _ in range(50)), " ".join(rng.choice(words) + "###" for _ in range(60))])
    return ". ".join(" ".join(rng.choice(words) + rng.choice(["", "ly", "s"]) for _ in range(9)).capitalize() for _ in range(8)) + "."


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, k % 4 == 0)) for k in range(600)] + [(900, None), (901, ""), (902, "x" * 200_000), (None, "null key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    held = queries.held_out()
    model = quality.fit_quality(docs, labels, held)
    out = quality.score_quality(docs.withColumn("score", F.lit("old")), model).withColumn("held", held).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    test = out[(out.held == True) & (out.doc_id < 600)]  # noqa: E712
    right = (test.score >= 0.3) == (test.doc_id % 4 != 0)
    assert len(test) > 80 and right.mean() > 0.98
    again = quality.fit_quality(docs.repartition(7), labels.repartition(3), held)
    assert (again.threshold == model.threshold).all() and (again.leaf == model.leaf).all()
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(docs, quality.fit_quality(docs, none, queries.held_out())).first().score == pytest.approx(0.5)
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, quality.fit_quality(docs, one, F.lit(False))).first().score > 0.99


def test_trees_beat_noise_and_bound_the_sample(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    docs = spark.createDataFrame([(k, "a") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    quality.fit_quality(docs, labels, F.lit(False), max_train=5)


def exact(x, ids, query, k):
    score = x @ x[query]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[query]]
    return [(int(ids[j]), float(score[j])) for j in order[:k]]


@pytest.mark.parametrize("norms", ["unit", "mixed", "outlier"])
def test_nearest_recall(spark, norms):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    if norms == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[7] *= 3000
    x[100:160] = x[100]  # a hot vector
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, [float("inf")] * 16), (5005, [1.0]), (None, x[0].tolist()), (5020, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    got = vamana.nearest(df, F.col("vec_id") % 20 == 0, neighbours=20, shard_rows=1200).toPandas()
    assert set(got.vec_id) <= set(range(3000)) and set(got.query_id) == set(range(0, 3000, 20))
    x = x.astype(float)
    hit, ids = 0, np.arange(3000)
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        best = exact(x, ids, q, 20)
        hit += len(set(part.vec_id) & {i for i, _ in best})
        assert np.allclose(part.score, x[part.vec_id.to_numpy()] @ x[q], rtol=0, atol=1e-12)
    assert hit / (150 * 20) >= 0.95
    if norms != "unit":
        return
    hot = got[got.query_id == 100].sort_values("rank")
    assert list(hot.vec_id) == [*range(101, 121)]  # ties go to the lesser id


def test_nearest_in_some_of_many_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = (centres[rng.integers(0, 60, 4000)] + 0.6 * rng.normal(size=(4000, 24))).astype(np.float32)
    x[1000:2400] = x[1000]  # a third of the rows are one vector
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9000 + 20 * k, [1.0, float(k)]) for k in range(6)], "vec_id long, embedding array<float>")
    a, b = (vamana.nearest(df.repartition(n), F.col("vec_id") % 20 == 0, shard_rows=60).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True) for n in (2, 7))
    assert a.equals(b)  # whatever the partitions are
    x, ids, hit = x.astype(float), np.arange(4000), 0
    for q in range(0, 4000, 20):
        hit += len(set(a.vec_id[a.query_id == q]) & {i for i, _ in exact(x, ids, q, 20)})
    assert hit / (200 * 20) >= 0.95
    # The other length is searched for itself.
    assert a[a.query_id == 9000].vec_id.tolist() == [9020, 9040, 9060, 9080, 9100]  # all alike: by id
    assert a[a.query_id == 9020].vec_id.tolist() == [9100, 9080, 9060, 9040, 9000]


def test_nearest_few_rows(spark):
    schema = "vec_id long, embedding array<float>, score double, shard int"
    df = spark.createDataFrame([(20, [1.0, 0.0], 1.0, 1), (21, [0.5, 0.5], 1.0, 1), (22, [0.0, 2.0], 1.0, 1)], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vamana.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 21, 0.5), (20, 2, 22, 0.0)]
    assert vamana.nearest(df.limit(0), F.lit(True)).count() == 0 and vamana.nearest(df, F.lit(False)).count() == 0
    assert vamana.nearest(df.where("vec_id = 20"), F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header class="top"><h1>Site name</h1></header>
<nav><a href=/>Home</a> <a href=/x>News</a></nav><!-- <p>hidden</p> --><div id="cookie-notice">We use cookies to serve you better and for the sake of everyone who is here with us today.</div>
<script>var a="</p>";</script><article><h1>A &amp; B</h1><p>The first part of the article is about the rivers and the houses that are in the valley, &eacute;t&eacute;.<p>Short one.</p>
<p>More <b>bold</b>ness and<br>a <a href=q>link</a> in the text of the article, which goes on for as long as it has to.</p><div class="ad">Buy now, it is the best of all the things that you can buy for the price of it and more.</div>
<ul><li>item one</li><li>item&nbsp;two</li></ul></article><section class="comments"><p>I think that this is the best article that I have ever read on the subject of rivers.</p></section>
<form><p>Subscribe to the letter that we send to all of our readers on the first of each month.</p></form><footer>&copy; us</footer></body></html>"""


def test_html_rules(spark):
    want = (
        "A & B The first part of the article is about the rivers and the houses that are in the valley, été. Short one. More boldness and a link in the text of the article, which goes on for as long as it has to. "
        "item one item two"
    )
    assert main_text(PAGE) == want
    cases = [PAGE, None, "", "<html><body></body></html>", "plain &lt;text&gt;", "<p>Only this.</p>", "<div class=x>" * 3000 + "deep", "<p" * 5000, "<nav><a>a</a></nav>", "<script>x", "a" * 100_000, PAGE]
    df = spark.createDataFrame([(k, c, "u") for k, c in enumerate(cases)], "page_id long, html string, main_text string")
    got = {r.page_id: (r.main_text, r.n_chars) for r in extract_main_text(df).collect()}
    assert got[0] == got[11] == (want, len(want)) and got[1] == got[2] == got[3] == got[8] == got[9] == ("", 0)
    assert got[4][0] == "plain <text>" and got[5][0] == "Only this." and got[6][0] == "deep" and got[10][1] == 100_000
    assert extract_main_text(df.limit(0)).count() == 0


def test_pages_without_article_use_the_blocks():
    good = "This is a long block of running words, and it is about the things that are of use to the reader of the page."
    links = " ".join(f"<a href={k}>link number {k}</a>" for k in range(20))
    page = f"<body><div>{links}</div><p>Near the links.</p><div>{links}</div><div>{links}</div><p>{good}</p><p>By it.</p><p>{good}</p><div>{links}</div></body>"
    assert main_text(page) == f"{good} By it. {good}"


def test_names_reject_whole_tokens_and_never_the_article():
    good = "This is a long block of running words, and it is about the things that are of use to the reader of the page."
    for opening in ('article class="post type-post tag-europe hentry"', 'article class="post category-football"', 'article class="tag"', 'div class="site has-sidebar"', 'div class="content no-sidebar"', 'div class="navy"'):
        assert main_text(f"<body><{opening}><p>{good}</p></{opening.split()[0]}></body>") == good
    assert main_text(f'<div class="related"><main><p>{good}</p></main></div>') == good
    assert main_text(f'<article><p>{good}</p><div class="x comments"><article>{good} No.</article></div></article><div class="related"><article>{good} No.</article></div>') == good
    assert main_text(f'<p>{good}</p><div class="x sidebar"><p>{good} No.</p></div>') == good


def test_long_quoted_values_stay_in_their_tags():
    for quote, other in (('"', "'"), ("'", '"')):
        value = f"{'x' * 3000}<p class={other}ad{other} id=ad >inner</p> a > b{other}"
        assert main_text(f"<div data-html={quote}{value}{quote}>after</div>") == "after"
        assert main_text(f"<p>It stays.</p><div data-html={quote}{value}{quote} class={quote}advert{quote}>goes</div>") == "It stays."


def test_damaged_tags_cost_no_more_than_whole():
    import time

    for part in ("<p", '<a b="<" c=', "<a \"<a '<a ", "<a x=\"<a y='<a ", "<a x=\"<b\" y='<c' <", "<a x='<a\"y=\"<b'z="):
        began = time.perf_counter()
        main_text(part * 60_000)
        assert time.perf_counter() - began < 30
    assert main_text("<p title=it's>One.</p> <p>Don't.</p>") == "One. Don't."


MAIL = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "a", "Hello there\nfriend of mine\n\nSecond para"),
        (1, 1, "b", "On Monday, A wrote:\n> Hello there\n> friend of mine\n\nI agree"),
        (1, 2, "c", "Unrelated"),
        (1, 3, "d", ">> Hello there   friend OF mine\n> I agree\nMe too"),
        (1, 4, "e", "> unrelated\nok"),
        (1, 5, "f", None),
        (None, 1, "g", "> Hello there"),
        (2, None, "g", "> x"),
        (2, 0, "h", "x"),
        (2, 0, "h", "x"),
        (2, 3, "i", "> x\n> y"),
        (3, 0, "j", "> later words\nmine"),
        (3, 1, "k", "later words"),
    ]
    got = {(r.conv_id, r.turn, r.role): r for r in link_quotes(spark.createDataFrame(rows, MAIL).repartition(3)).collect()}
    at = lambda *k: (got[k].parent_turn, got[k].root_turn, got[k].depth, got[k].position)
    assert at(1, 0, "a") == (None, 0, 0, 0) and at(1, 1, "b") == (0, 0, 1, 1) and at(1, 3, "d") == (1, 0, 2, 2) and at(1, 2, "c") == (None, 2, 0, 3) and at(1, 4, "e") == (2, 2, 1, 4)
    assert got[1, 1, "b"].own_text == "I agree" and got[1, 0, "a"].own_text.endswith("Second para") and got[1, 5, "f"].own_text == ""
    assert at(2, 3, "i")[:3] == (0, 0, 1) and got[2, 3, "i"].n_linked == 1 and got[2, 3, "i"].n_passages == 3
    assert at(3, 0, "j")[0] is None  # an original comes before what quotes it
    assert got[None, 1, "g"].parent_turn is None


def test_quotes_edges(spark):
    assert link_quotes(spark.createDataFrame([], MAIL)).count() == 0
    many = [(1, k, "u", "> " + f"line {k - 1}\nline {k}" if k else "line 0") for k in range(70)]
    out = link_quotes(spark.createDataFrame(many, MAIL)).orderBy("turn").collect()
    assert [r.depth for r in out] == list(range(70)) and {r.root_turn for r in out} == {0} and [r.position for r in out] == list(range(70))
    odd = spark.createDataFrame([(1, 0, "a", "x", 5, 6, "p"), (1, 1, "b", "> x", 7, 8, "q")], MAIL + ", c int, jump int, parent string")
    assert [(r.c, r.jump, r.parent, r.parent_turn) for r in link_quotes(odd).orderBy("turn").collect()] == [(5, 6, "p", None), (7, 8, "q", 0)]
    assert parse(">>> deep\n> shallow")[0] == "" and {p[0] for p in parse(">>> deep\n> shallow")[1]} == {1, 3}
    big = parse("> " + "word " * 20_000)
    assert big[1][0][2] == 20_000


RAIN = "The rain was on the hills and it did not stop for the whole of the day, so the people of the town went to the river."


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_html_against_a_plain_version():
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    assert len(pages) > 200
    made = [
        f'<nav><a href="/">Home</a></nav><div class="site has-sidebar"><main><h1>Title</h1><p>{RAIN}</p><div class="share">Share it</div><p>Short.</p><div class="comments"><p>{RAIN} No.</p></div></main><div class="related">More</div></div>',
        f"<header><h1>Site</h1></header><p>{RAIN}</p><p>Short.</p><ul><li><a>one</a></li><li><a>two</a></li></ul><p>Open</p><footer>us</footer>",
        "<div><p>Nothing long here.</p><p><a>link</a></p></div>",
    ]
    for page in pages + made:
        assert main_text(page or "") == plain_text(page or "")


def test_html_names_never_empty_an_article():
    nav = '<nav><a href="/">Home</a></nav>'
    for name in ("football-report", "navy-news", "post head", "related-work", "share-price", "social-policy", "recommended-reading", "header-image-article", "discussion", "search", "tags"):
        assert main_text(f'{nav}<article><div class="{name}"><p>{RAIN}</p><p>{RAIN}</p></div></article>') == f"{RAIN} {RAIN}"
    assert main_text(f'<article class="post-12 post type-post tag-python"><p>{RAIN}</p></article>') == RAIN
    assert main_text(f'<article id="discussion-of-rivers"><p>{RAIN}</p></article>') == RAIN
    # Where names leave no text at all, they are not believed; where they do, they are.
    assert main_text(f'{nav}<div class="notice"><p>{RAIN}</p></div>') == RAIN
    assert main_text(f'<p>{RAIN}</p><div class="notice"><p>{RAIN} No.</p></div><p class="ad">{RAIN} No.</p>') == RAIN
    assert main_text(f'<article><p>{RAIN}</p><div class="tags">red, blue</div><ol class="commentlist"><li>{RAIN} No.</li></ol></article>') == RAIN


def test_html_of_other_languages():
    ru = "Дождь шёл весь день, и люди города пошли к реке, чтобы посмотреть, как высоко поднялась вода у старого моста."
    pl = "Deszcz padał przez cały dzień i nie chciał przestać, a ludzie z miasta poszli nad rzekę, by na nią popatrzeć."
    nav = '<nav><a href="/">Home</a></nav>'
    for text in (ru, pl):
        for frame in ("{}", "<article>{}</article>", "<div>{}</div>"):
            body = f"<p>{text}</p>" * 5 + f"<p>{RAIN}</p>" + f"<p>{text}</p>" * 2
            assert main_text(nav + frame.format(body) + "<footer>us</footer>") == " ".join([text] * 5 + [RAIN] + [text] * 2)
    assert main_text(f"<article><p>{RAIN}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>") == f"{RAIN} So x=2 holds."


def test_html_damaged_pages_take_linear_time():
    for junk in ("<button>", "<head>", "<svg ", '<div class="x', "<a b='", "<!--", "<![CDATA["):
        began = time.monotonic()
        main_text(f"<p>{RAIN}</p>" + junk * 60_000)
        assert time.monotonic() - began < 5
