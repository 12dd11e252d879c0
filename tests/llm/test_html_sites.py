"""Sites whose pages are copies, and pages whose marks mislead."""

from tracewright.llm import html_extraction

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, pages, url="http://h.com/x", most=100):
    df = spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], SCHEMA).repartition(3)
    return {r["page_id"]: r["text"] for r in html_extraction.extract_pages(df, most).collect()}


def test_copies_keep_their_text(spark):
    page = "<html><body><nav>n</nav><div class='y'>the whole text</div></body></html>"
    for url in ("http://h.com/x", None):
        for most in (100, 0):
            assert set(texts(spark, [page] * 10, url, most).values()) == {"the whole text"}
    few = [page] * 90 + [f"<html><body><nav>{i}</nav><div class='y'>text {i}</div></body></html>" for i in range(10)]
    got = texts(spark, few)
    assert got[0] == "the whole text" and [got[90 + i] for i in range(10)] == [f"text {i}" for i in range(10)]
    split = [f"<html><body><div class='x'>same on all pages</div><div class='y'>text {i % 12}</div></body></html>" for i in range(60)]
    assert [*texts(spark, split).values()].count("text 3") == 5


def test_tree_judges_pages_with_marks(spark):
    card = "<body><div class='x'>same on all pages, outside</div><div class='y'>long main text {0} in neutral markup</div><article>card {0}<div class='z'>same on all pages, inside</div></article></body>"
    for most in (100, 0):
        got = texts(spark, [card.format(i) for i in range(12)], most=most)
        assert all(got[i] == f"long main text {i} in neutral markup\n\ncard {i}" for i in range(12))
    got = texts(spark, [f"<body><div class='y'>main text {i}</div><div class='entry'>quote</div></body>" for i in range(3)])
    assert got[2] == "main text 2\n\nquote"
    half = [f"<body><p class='k'>{'rare' if i == 0 else 'often'}</p><article><p class='k'>{'rare' if i == 0 else 'often'}</p><p>{i}</p></article></body>" for i in range(20)]
    got = texts(spark, half)
    assert got[0] == "rare\n\n0" and got[7] == "often\n\n7"  # importance 0.07: noise outside the mark only


def test_words_of_wrappers_are_not_noise():
    main = "<article><header><h1>Head</h1></header><p>the main text of the page</p></article>"
    side = "<div class='sidebar'><article>card</article></div><div id='comments'><p>nice, but not as long</p></div>"
    for wrapper in ('div class="layout has-sidebar"', 'div id="content" class="no-sidebar"', 'section class="post with-comments"', 'div class="layout-sidebar"', 'div class="share header"'):
        tag = wrapper.split()[0]
        assert html_extraction.extract(f"<body><{wrapper}>{main}{side}</{tag}></body>") == "Head\n\nthe main text of the page"
        nodes = html_extraction.style_nodes(f"<body><{wrapper}>{main}{side}</{tag}></body>")
        assert any(n.endswith("article/p") for n in nodes)
    assert html_extraction.extract("<body><div class='widget-area'><p>most of the text of this page</div><div class='ad'>buy</div></body>") == "most of the text of this page"
    assert html_extraction.extract("<body><aside><article>x</article></aside><div class='share'>y</div>" + main + "</body>") == "Head\n\nthe main text of the page"


def test_names_inside_articles():
    page = "<body><article><h1>T</h1><div class='related-work'><p>Prior work.</p></div><section id='comments-on-method'><p>On it.</p></section><div class='related-posts'>x</div><ul class='comment-list'><li>nice</li></ul></article></body>"
    assert html_extraction.extract(page) == "T\n\nPrior work.\n\nOn it."
    assert html_extraction.extract("<body><p>Text <a href=x>link only</a></p><div><a>Home</a> | <a>About</a></div><p><a>Next page</a></p></body>") == "Text link only"


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>deep text {0}</p>" + "</div>" * 3000
    long = "".join(f"<p>block {k} &amp; more</p>" for k in range(20_000))
    pages = [f"<body><div class='x'><span>same</span></div>{deep.format(i)}</body>" for i in range(9)] + [f"<body><article>{long}</article></body>"] * 2
    got = texts(spark, pages)
    assert got[3] == "deep text 3" and got[9] == got[10] == "\n\n".join(f"block {k} & more" for k in range(20_000))
    nodes = [n for n in html_extraction.style_nodes("<body>" + "<div>" * 300 + "<i>x</i></body>")]
    assert len(set(nodes)) == 301 and max(map(len, nodes)) < 500


def test_clashing_and_repeated(spark):
    page = "<body><nav>n</nav><article><p>a  b</p></article></body>"
    df = spark.createDataFrame([(1, "http://h.com/1", page, "t", 9, "h")] * 3 + [(None, None, page, None, None, None)], "page_id bigint, url string, html string, text string, n_chars int, __host string")
    got = html_extraction.extract_pages(df).collect()
    assert [tuple(r) for r in got].count((1, "http://h.com/1", "a b", 3)) == 3 and len(got) == 4
