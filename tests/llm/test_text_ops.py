"""Operators 2 and 8, and the pipeline."""

import random
import time
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from arrears.llm import common, main_text, toxicity
from arrears.llm.html_tokens import parse
from tests.conftest import SF_SMALL
from tests.llm.cases import SCHEMA, awkward, empty, prose


def text_of(html, template=None):
    return "\n".join(main_text.main_blocks(parse(html), template))


@pytest.mark.parametrize(("html", "want"), [
    ("", ""),
    ("just text", "just text"),
    ("<article><h1>A &amp; B</h1><p>one\n  two&nbsp;<b>th</b>ree<br>four</p></article>", "A & B\none two three four"),
    ("<nav>x</nav><article><p>a<p>b<ul><li>c<li>d</ul></article><footer>y</footer>", "a\nb\nc\nd"),
    ("<article><header><h1>T</h1></header><aside>no</aside><form>no</form><p>t</p></article><header>no</header>", "T\nt"),
    ("<script>if (a<b) {x=\"</p>'\"}</script><article><p>t</p><style>p{}</style></article>", "t"),
    ("<div id=cookie-notice>no</div><main><div class='post'><p>t</p><div class=\"ad\">no</div></div></main>", "t"),
    ("<main><p>text</p><section class='comments'><article><p>longer than the text</p></article></section></main>", "text"),
    ("<div role='navigation'>no</div><div class=content><p>a &lt;b&gt;</p><p hidden>no</p></div>", "a <b>"),
    ("<article><p>a</p><!-- <p>no</p> --><p>b</article><p>no", "a\nb"),
    ("<p>plain</p><p><a href='/x'>links only</a></p><p>more &#233; <i>x</i></p>", "plain\nmore é x"),
    ("<title>no</title><article><table><tr><td>1<td>2</table></article", "1\n2"),
    ("<article><p>un<b>closed<p>next</b> one</article>", "unclosed\nnext one"),
])
def test_blocks_of_one_page(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<article><h1>T</h1><div class='entry-content'><p>a</p><p>b</p></div></article>", "T\na\nb"),
    ("<main><h1>T</h1><div class=content><p>a</p></div></main><div class=content><p>not in main, and longer</p></div>", "T\na"),
    ("<article><h1>T</h1><section class=story><p>a</p><div class=post><p>b</p></div></section></article><p>no</p>", "T\na\nb"),
    ("<article><div class=content><p>only nested</p></div></article><main><p>main</p></main>", "only nested"),
])
def test_containers_nested_in_the_article_belong_to_it(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(("html", "want"), [
    ("<div class='content has-sidebar'><p>a</p></div>", "a"),
    ("<article class='post tag-search category-menu'><p>a</p></article>", "a"),
    ("<main class='no-widget comments-open share-enabled'><p>a</p></main>", "a"),
    ("<main><article class='post share'><p>a</p></article></main>", "a"),
    ("<div class='page-topbar-layout'><p>most of the text of a page</p><p id=site-footer>no</p></div>", "most of the text of a page"),
    ("<div class='cookie-notice'>no</div><p>some text of the page</p>", "some text of the page"),
    ("<article><p>a</p><figure><img src=x><figcaption>caption</figcaption></figure><div class='related-posts'>no, though longer</div></article>", "a\ncaption"),
])
def test_a_class_word_does_not_take_the_article(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("own", [
    '<h2 id="social-policy">own</h2>', '<h2 id="search-results">own</h2>', '<p id="hidden-costs">own</p>',
    '<div class="share-price-table">own</div>', '<p class="signup">own</p>', "<p><math><mi>own</mi></math></p>",
    '<p><svg viewBox="0 0 1 1"><text>own</text></svg></p>'])
def test_an_article_keeps_its_own_text(own):
    assert text_of(f"<article><h1>T</h1>{own}<p>a</p></article>") == "T\nown\na"


@pytest.mark.parametrize("away", [
    '<div class="related-posts">no</div>', '<section id="comments"><p>no</p></section>', '<div class="newsletter-signup-box"><p>no</p></div>',
    '<p class="advertisement">no</p>', '<ul class="share-buttons"><li>no</li></ul>', "<div class=shareButtons>no</div>"])
def test_an_article_is_freed_of_what_is_not_its_own(away):
    assert text_of(f"<article><h1>T</h1>{away}<p>a</p></article>") == "T\na"


@pytest.mark.parametrize(("html", "want"), [
    ("<article><p>a <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> b</p><p>c</p></article>", "a x=1 b\nc"),
    ('<article><p title="a > b">x</p><p data-x=\'">\'>y</p></article>', "x\ny"),
    ('<article><p class="open>x</p><p>y</p></article>', "x\ny"),
    ("<article><p>1 < 2, 3<4</p></article>", "1 < 2, 3<4"),
    ("<article><p>a</p></article><p", "a"),
    ("<article><p>a</p><!-- no", "a"),
    ("<article><i>a<table><tr><td>b</i>c</table></article>", "a\nbc"),
])
def test_tags_are_read_as_browsers_do(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("piece", ["<a ", "<a b=\"", "<div>", "</span>", "<h1>", "<b>x", "<script>", "</script", "<!--", "<i><table></i>",
                                   "<p class='x'", "<a b='c' ", "<li><b>", "<?x "])
def test_bad_pages_take_time_by_length(piece):
    """A megabyte of what is never closed: seconds, where reading on to the
    end of the page at every tag would take hours."""
    begun = time.perf_counter()
    parse("<article><p>text</p>" + piece * ((1 << 20) // len(piece)))
    parse("<article><p>text</p>" + "<b>" * 50_000 + ("x<hr>" + piece) * 50_000)
    assert time.perf_counter() - begun < 20


def site(n, seed, page):
    r = random.Random(seed)
    return [page(" ".join(r.choice(["lamp", "stone", "river"]) + str(r.randrange(999)) for _ in range(60)), k, r) for k in range(n)]


def test_a_template_finds_notices_and_the_text_nothing_names(spark):
    """No element or class names the article: it is the gap with most text,
    and what all pages share is not text."""
    def page(text, k, r):
        items = "".join(f"<li><a href='/{r.randrange(99)}'>menu {r.randrange(99)}</a></li>" for _ in range(r.randint(2, 5)))
        return (f"<html><body><div class=a><ul>{items}</ul></div><div class=b>Welcome to this place</div><div class=c><h2>Head {k}</h2>"
                f"<p>{text}</p><p>Read our other pages too.</p></div><div class=d>Visitors so far: {r.randrange(9999)}</div></body></html>")

    rows = [(k, f"https://One.example/{k}", h) for k, h in enumerate(site(12, 3, page))]
    rows += [(100, "https://two.example/", "<body><p>alone</p></body>"), (101, None, None), (102, "no url", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", common.F.lit("clash"))
    got = {r.page_id: r for r in main_text.main_text(df).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows[:12]:
        want = f"Head {k}\n" + html.split("<p>")[1].split("</p>")[0]
        assert got[k].text == want and got[k].n_chars == len(want)
    assert (got[100].text, got[101].text, got[101].url, got[102].text) == ("alone", "", None, "x")


def test_near_equal_pages_keep_their_text(spark):
    """Variants of one article on a host, in an article and in nothing named."""
    body = "<h2>Summary</h2><p>one long paragraph</p><p>and another</p><p>and a third</p>"
    rows = [(k, "https://named/", f"<body><nav>menu</nav><article><h1>Number {k}</h1>{body}<p>{w}</p></article></body>")
            for k, w in enumerate(["red", "green", "blue", "grey", "pink", "black"])]
    rows += [(10 + k, "https://bare/", f"<body><div><a href='/?session={k}'>menu</a></div><div>{body}<p>Printed on {k}.1.</p></div></body>")
             for k in range(6)]
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Summary\none long paragraph\nand another\nand a third\n"
    assert got == {**{k: f"Number {k}\n{text}{w}" for k, w in enumerate(["red", "green", "blue", "grey", "pink", "black"])},
                   **{10 + k: f"{text}Printed on {k}.1." for k in range(6)}}


def test_templates_are_equivalence_classes(spark):
    pages = site(8, 4, lambda text, k, r: f"<body><h1>Same</h1><ul>{'<li><b>x</b></li>' * (k % 3 + 1)}</ul><p>{text}</p></body>")
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    rows = main_text.templates(df).collect()
    vectors = {}
    for r in rows:
        counts = tuple(Counter([t for _, t in parse(p).tags] + [b.token for b in parse(p).blocks])[r.token] for p in pages)
        vectors.setdefault(r.cls, set()).add(counts)
    assert len(vectors) == 2 and all(len(v) == 1 for v in vectors.values())
    assert {next(iter(v)) for v in vectors.values()} == {(1,) * 8, tuple(k % 3 + 1 for k in range(8))}
    assert main_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_corpus(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL).group(1)
        parts = [" ".join(unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in main_text.main_text(pages).collect()} == want


def labelled(n=500, seed=1):
    """A few toxic words in long texts; some of them are misspelt."""
    r = random.Random(seed)
    bad = ["wretchling", "gutterfool", "muckbrain", "slimewit"]
    rows = []
    for k in range(n):
        words = prose(r.randint(20, 300), k).split(" ")
        toxic = k % 4 == 0
        for _ in range(r.randint(2, 4) if toxic else 0):
            w = r.choice(bad)
            words.insert(r.randrange(len(words)), w + r.choice(["", "s", "er"]) if r.random() < 0.7 else w[:4] + "x" + w[4:])
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "", 2, "") for i, t, _ in rows] + [(None, None, None, None, None, None, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(~toxicity.learnable()).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and 100 < len(held) < 230
    wrong = [i for i, _, x in rows if i in held and (got[i] >= toxicity.THRESHOLD) != bool(x)]
    assert len(wrong) <= 0.05 * len(held)
    # a long clean text with one passage of abuse is found by its worst stretch
    long = prose(4000, 77) + " you wretchling muckbrain gutterfool " + prose(4000, 78)
    scored = toxicity.Scorer(model.odds, model.offset)
    high, low = toxicity.probability(np.array(list(scored.scores([long, prose(8000, 79)]))))
    assert high > 0.7 > low
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.score(awkward(spark), model).count() == awkward(spark).count()


def test_toxicity_learns_no_held_out_label(spark):
    rows = [(i, t, x) for i, t, x in labelled(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", common.F.when(toxicity.learnable(), common.F.col("toxic")).otherwise(1 - common.F.col("toxic")))
    one, two = (toxicity.fit(docs, x) for x in (labels, turned))
    assert (one.odds == two.odds).all() and one.offset == two.offset
    only = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.probability(np.array([only.offset]))[0] < 0.01


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    names = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.pin(stage(spark, docs, SF_SMALL), "test")
        ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sentencepiece":
            assert docs.columns == names
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - set(ids)
            assert gone and len(gone - toxic) <= 2
        elif name == "line_dedup":
            assert docs.count() == before.count()
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "near_dedup":
            assert set(ids) <= {r.doc_id for r in before.collect()} and max(ids.values()) == 1
        elif name == "mixing":
            assert max(ids.values()) == 2 and set(ids) <= {r.doc_id for r in before.collect()}
        else:
            assert docs.columns == ["doc_id", "ids"] and docs.count() == before.count()


def plain_odds(model, words):
    """What a stretch of words adds up to, n-gram by n-gram."""
    odds, n = 0.0, 0
    for w in words:
        rows, size = toxicity._rows_of([w])
        assert size.tolist() == [len(rows)] and len(rows) == 1 + sum(max(0, len(w) + 2 - g + 1) for g in toxicity.GRAMS)
        odds += sum(float(model.embedding[r] @ (model.weight[:, 1] - model.weight[:, 0])) for r in rows.tolist())
        n += len(rows)
    return odds / (n + toxicity.PAD) + model.offset if n else model.offset


def test_toxicity_scores_match_a_plain_version(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=(toxicity.ROWS, 3)), rng.normal(size=(3, 2)), rng.normal(size=2))
    texts = [r.text or "" for r in awkward(spark).where("doc_id is null or doc_id != 11").collect()] + ["### *** $$$", "Id!ot, id1ot___ IDIOT", "word " * 500 + " ".join(f"w{k}" for k in range(100))]
    for text, got in zip(texts, toxicity.Scorer(model.odds, model.offset).scores(texts), strict=True):
        clean = "".join(c for c in text.lower() if c.isalnum() or c.isspace())
        own = list(dict.fromkeys(clean.split()))
        want = max((plain_odds(model, own[lo:lo + toxicity.STRETCH]) for lo in range(0, len(own), toxicity.STRETCH)), default=model.offset)
        assert got == pytest.approx(want, abs=1e-9)


def test_signs_at_words_do_not_decide():
    """Words that end in signs are many and say nothing; few labels say little."""
    words = [f"lamp{k}" for k in range(60)]
    rng = np.random.default_rng(3)
    clean = [" ".join(rng.choice(words, 40)) for _ in range(40)]
    toxic = [" ".join([*rng.choice(words, 40), "vilewretch"]) + " ###" for _ in range(5)]
    model = toxicity.train(clean + toxic, np.array([0] * 40 + [1] * 5))
    noisy = [" ".join(w + "$$$" for w in rng.choice(words, 40)) for _ in range(20)]
    assert max(toxicity.probability(np.array(list(toxicity.Scorer(model.odds, model.offset).scores(noisy))))) < toxicity.THRESHOLD


def test_queries_are_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and "pipeline" in E.queries()
    assert [n for n in E.oracle_sql() if n in names] == ["op7_mixing", "op12_periodic_runs"] and all(isinstance(s, str) for s in E.oracle_sql().values())
