"""Pages whose boilerplate only the wrapper of the host can tell."""

import random
import time

from trendloom.llm import wrapper_html

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch".split()


def path_of(*tags):
    path = ""
    for t in tags:
        path = wrapper_html.step(path, wrapper_html.Node(t))
    return path


def body(i):
    return " ".join(WORDS[(i * 5 + j * (i + 1)) % 12] + str(i) for j in range(9))


def texts(spark, pages, host="h"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in wrapper_html.extract_pages(df).orderBy("page_id").collect()]


def test_wrapper_inside_article(spark):
    pages = [f"<html><body><article><p>Read more on our partner site</p><p>{body(i)}</p></article><main class=x><p>Second {i}</p></main></body></html>" for i in range(6)]
    assert texts(spark, pages) == [f"{body(i)}\n\nSecond {i}" for i in range(6)]


def test_empty_article_is_only_a_hint(spark):
    assert texts(spark, ["<article></article><p>words outside</p>"]) == ["words outside"]


def test_constant_own_text_keeps_varying_children(spark):
    pages = [f"<html><body>Skip to content<div>Published: <p>{body(i)}</p></div><p>All <b>rights</b></p><p>{body(i + 7)} see <b>note</b></p></body></html>" for i in range(6)]
    assert texts(spark, pages) == [f"{body(i)}\n\n{body(i + 7)} see note" for i in range(6)]


def test_all_pages_and_all_children_are_aligned(spark):
    notes = [f"Note {j} of the house" for j in range(70)]
    page = lambda i: "<body>" + "".join(f"<p>{body(i)} {j}</p>" for j in range(3 + 12 * (i % 3))) + "".join(f"<p>{t}</p>" for t in notes) + "<p>Follow us here</p></body>"
    got = texts(spark, [page(i) for i in range(60)])
    assert got == ["\n\n".join(f"{body(i)} {j}" for j in range(3 + 12 * (i % 3))) for i in range(60)]


def test_every_page_counts_and_copies_count_once(spark):
    pages = [f"<body><p>Common line</p><p>{body(i)}</p></body>" for i in range(40)] + ["<body><p>Copy of one page</p></body>"] * 100
    got = texts(spark, pages)
    assert got[:40] == [body(i) for i in range(40)] and set(got[40:]) == {"Copy of one page"}
    found = wrapper_html.wrappers(spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string"), per_group=2)
    assert [r.template for r in found.collect()] == [[wrapper_html.template_key(path_of("body", "p"), "Common line")]]


def test_depth_headers_and_plain_class_words():
    deep = "<article>" + "<div>" * 3000 + "deep text" + "</div>" * 3000 + "</article>"
    assert wrapper_html.extract(deep, set()) == "deep text"
    page = "<header>Site</header><article><header><h1>Title</h1></header><div class='market share'>a</div><div class='related work'>b</div><div class='related-posts'>no</div><div class=share>no</div></article>"
    assert wrapper_html.extract(page, set()) == "Title\n\na\n\nb"
    many = [f"<article>{'<div>' * 1500}words of page {i} here{'</div>' * 1500}<p>same line</p></article>" for i in range(3)]
    assert [wrapper_html.extract(p, set(wrapper_html.induce(many))) for p in many] == [f"words of page {i} here" for i in range(3)]


def _tree(rng, depth):
    tag = rng.choice(["div", "p", "ul", "span"])
    inner = "".join(_tree(rng, depth - 1) for _ in range(rng.choice([0, 2, 5, 7]) if depth else 0))
    return f"<{tag}>{rng.choice(['', 'a', 'b', 'c'])}{inner}</{tag}>"


def _best_match(a, b):
    """Simple tree matching, written out."""
    if (a.tag, a.kind) != (b.tag, b.kind):
        return 0
    w = [[0] * (len(b.sub) + 1) for _ in range(len(a.sub) + 1)]
    for i, x in enumerate(a.sub):
        for j, y in enumerate(b.sub):
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + _best_match(x, y))
    return 1 + (a.own == b.own != "") + w[-1][-1]


def test_alignment_is_the_best_tree_matching():
    rng = random.Random(4)
    for _ in range(80):
        seen: dict = {}
        a, b = (wrapper_html.parse(_tree(rng, 3)) for _ in range(2))
        for t in (a, b):
            wrapper_html.number(t, seen)
        score, _ = wrapper_html.align(a, b, {})
        assert score == _best_match(a, b)


def test_many_different_children_align():
    rng = random.Random(5)
    item = lambda: f"<li><a>{rng.random()}</a><p>{rng.choice(['Read more', rng.random()])}</p></li>"
    pages = [f"<ul><li>Latest</li>{''.join(item() for _ in range(400))}</ul>" for _ in range(2)]
    start = time.time()
    template = set(wrapper_html.induce(pages))
    assert time.time() - start < 20  # one alignment a pair of children took minutes
    text = wrapper_html.extract(pages[0], template)
    assert "Latest" not in text and "Read more" not in text and len(text.split("\n\n")) >= 400


def test_text_outside_main_stays_where_main_holds_little():
    body = "".join(f"<p>Paragraph {i} of the story that stands outside.</p>" for i in range(8))
    assert wrapper_html.extract(f"<main><p>By A. Writer</p></main>{body}", set()).startswith("By A. Writer\n\nParagraph 0")
    assert wrapper_html.extract(f"<main>{body}</main><p>Other pages</p>", set()).endswith("outside.")
