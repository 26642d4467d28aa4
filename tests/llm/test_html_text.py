import pytest
from hypothesis import given
from hypothesis import strategies as st
from palimpsest.llm.html_text import Page, extract, host_of, templates
from pyspark.sql import functions as F

SHELL = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a href='/x'>menu</a></nav>{notice}<article><header><h1>{title}</h1></header>{body}</article><div class='comments'><p>a reader</p></div><footer>&copy; us</footer></body></html>"


def page(title, *paragraphs, notice=""):
    return SHELL.format(title=title, body="".join(f"<p>{p}</p>" for p in paragraphs), notice=notice)


CASES = [
    (page("A &amp; B", "one  <b>two</b>\n three", "four&nbsp;five"), "A & B\n\none two three\n\nfour five"),
    ("<article><h1>T</h1><p><b>one<br><p>two<p>three</article><footer>f</footer>", "T\n\none\n\ntwo\n\nthree"),
    ("<article><p>a<!-- <p>no --> b<script>if (a</script>x</p><form><p>send</p></form><aside>side</aside>", "a bx"),
    ("<body><div class='cookie-notice'>ok?</div><div id=sidebar>s</div><header>h</header><p>text &lt;i&gt; &#233;", "text <i> é"),
    ('<div class="a>Hello</div><p>next "quoted" text</p>', 'Hello\n\nnext "quoted" text'), ('<p title="a > b">kept</p>', "kept"),
    ("<article><section id='comment-analysis'><p>one</p></section><div class='related-story'><p>two</p></div><div class='social-science'>three</div><p class='lead notice'>four</p><div class='comment-list'><p>reader</p></div></article>", "one\n\ntwo\n\nthree\n\nfour"),
    ("<p>text that goes on for a while</p><div class='adBanner'>buy</div><div id='sidebar-2'>side</div><div class='site-header'>top</div>", "text that goes on for a while"),
    ("plain text\nonly", "plain text only"), ("<p>cut <a href='x", "cut"), (None, ""), ("", ""), ("<nav>only</nav>", ""), ("<p>" + "w " * 50_000 + "</p>", ("w " * 50_000).strip()),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_pages(spark, source, want):
    rows = extract(spark.createDataFrame([(1, None, source)], "page_id long, url string, html string")).collect()
    assert [r.text for r in rows] == [want]


def test_fixed_text_of_a_host_is_left_out(spark):
    rows = [(i, "https://a.example/x", page(f"Title {i}", f"body {i} goes on " + "and on " * 20 + ".", *(["shared tail"] if i % 2 else []), notice="<div class=top><p>We moved to a new address</p></div>")) for i in range(8)]
    rows += [(i, "http://b.example/", page("Same", "same body")) for i in range(20, 26)]
    rows += [(30, "http://c.example", page("Once", "only page"))] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    clashing = frame.withColumns({"text": F.lit("t"), "host": F.lit(1), "fixed": F.lit(2), "kept": F.lit(3), "n_chars": F.lit(4)})
    got = sorted((r.page_id, r.text) for r in extract(clashing).collect())
    want = [(i, "\n\n".join([f"Title {i}", f"body {i} goes on " + "and on " * 20 + "."] + ["shared tail"] * (i % 2))) for i in range(8)]
    want += [(i, "Same\n\nsame body") for i in range(20, 26)] + [(30, "Once\n\nonly page")] * 2
    assert got == want
    shape = {r.pages: r for r in templates(frame).collect()}[8]
    assert "/html/body/article" in shape.skeleton and shape.content.endswith("/article") and shape.fixed


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@given(st.text(st.sampled_from(list("<>/!-pab='\" &;#x1")), max_size=60))
def test_any_markup_is_read(source):
    Page(source)


def test_hosts():
    assert [host_of(u) for u in ("HTTPS://A.b:80/x", "//u@h?q", "odd", None)] == ["a.b", "h", "odd", ""]


PARTS = "<h1>Title</h1><div class=lead><p>lead {0}</p></div><div class=body><p>" + "body {0} goes on " * 30 + "</p></div>"


def texts_of(spark, *sources):
    rows = [(i, "http://a.example/", s) for i, s in enumerate(sources)]
    return [r.text for r in sorted(extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_title_and_lead_beside_the_largest_container_stay(spark):
    want = lambda i: f"Title {i}\n\nlead {i}\n\n" + " ".join([f"body {i} goes on"] * 30)
    made = lambda i: f"<body><article>{PARTS.format(i).replace('Title', f'Title {i}')}</article></body>"
    assert texts_of(spark, *[made(i) for i in range(6)]) == [want(i) for i in range(6)]
    assert texts_of(spark, made(0)) == [want(0)]
    empty = "<body><article><h1>Only this</h1><div class=lead></div><div class=body></div></article></body>"
    assert texts_of(spark, *[made(i) for i in range(6)], empty) == [*[want(i) for i in range(6)], "Only this"]


SHELLS = ["<body class='has-sidebar header-fixed'>{}</body>", "<body><form>{}</form></body>", "<body><div class='content with-sidebar'>{}</div></body>", "<body><div id=search-page><form>{}</form></div></body>", "<article class=notice><form>{}</form></article>"]


@pytest.mark.parametrize("shell", SHELLS)
def test_names_of_a_page_wide_element_hide_nothing(spark, shell):
    inner = "<nav>menu</nav><h1>Title {0}</h1><p>" + "text {0} runs on " * 9 + "</p><div class=sidebar><p>beside {0}</p></div>"
    want = lambda i: f"Title {i}\n\n" + " ".join([f"text {i} runs on"] * 9)
    for n in (1, 6):
        assert texts_of(spark, *[shell.format(inner.format(i)) for i in range(n)]) == [want(i) for i in range(n)]


def test_long_comments_of_one_page_stay_left_out(spark):
    made = lambda i: f"<article><p>{f'text {i} runs on ' * 9}</p></article><div class=comments><p>{'a reader ' * (100 if i == 3 else 1)}</p></div>"
    assert texts_of(spark, *[made(i) for i in range(40)]) == [" ".join([f"text {i} runs on"] * 9) for i in range(40)]
