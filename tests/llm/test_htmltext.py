import pytest

from textloom.llm import htmltext


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p><b>One.<br><p>Two &lt;x&gt;</p>\n<p> \t </p>Three", "One.\nTwo <x>\nThree"),
        ("<nav><ul><li><a href='/x'>M</a></ul></nav><article><h1>T</h1><p>a<i>b</i>c</p></article><footer>F</footer>", "T\nabc"),
        ("<script>var t='</p>';if(a<b){}</script><style>p{}</style><p>x</p>", "x"),
        ("<div class='ad'>A</div><div id='cookie-notice'>C</div><div class='shadow adapted'>keep</div>", "keep"),
        ("<header>H</header><article><header><h1>T</h1></header><p>x</p><section class='comments'><p>no</p></section><aside>s</aside></article>", "T\nx"),
        ("<main><p>m</p></main><p>out</p>", "m"),
        ("<article><p>a</p></article><div class=comments><article class='comment'><p>c</p></article></div>", "a"),
        ("<!-- <p>no</p> --><p>1 < 2 & 3</p><!doctype x><?php x ?>", "1 < 2 & 3"),
        ('<p title="a>b">x</p><p title="unclosed>y</p>', "x\ny"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul>", "a\nb\nc\nd\ne"),
        ("<form><p>f</p></form><div role='navigation'>n</div><p hidden>h</p><p style='display: none'>s</p><p>&#233;&eacute;&nbsp;x</p>", "éé x"),
        ("<div id='content' class='has-sidebar'><p>Body.</p></div><div class='site-footer'>F</div>", "Body."),
        ("<div class='post no-sidebar entry-content related-works'><p>Body.</p></div><ul class='main-nav'><li>x</ul>", "Body."),
        ("<main><p>Long body of text</p><article>teaser</article></main>", "Long body of text"),
        ("<article><p>The story itself</p><article><p>a reader</p></article></article><article>no</article>", "The story itself"),
        ("<P>UP</P><DIV>down</dIv></p></b>", "UP\ndown"),
        ("<p>a" * 3 + "<", "a\na\na<"),
    ],
)
def test_parse(source, want):
    assert htmltext.parse(source).text() == want


def test_long_pages():
    assert htmltext.parse("<p>" + "x " * 300_000 + "<b>" * 20_000).text() == "x " * 299_999 + "x"
    assert htmltext.parse("<div>" * 3000 + "t").text() == "t"


def page(host, k, extra="", article=None):
    return f"http://{host}/{k}", f"<body><div><p>Welcome to {host}</p></div><article><p>{article or f'story {k}'}</p>{extra}</article><div>{k}</div></body>"


def test_templates_go_and_copies_stay(spark):
    rows = [page("a.com", k, "<div><p>Follow us</p></div>" if k % 5 else "") for k in range(20)]
    rows += [page("b.com", k, article="the same story") for k in range(20)]
    rows += [page("c.com", k, "<p>Follow us</p>") for k in range(5)]
    rows += [(None, "<p>x</p>"), ("nothing", None), ("http://A.com/x", "<article><p>Follow us</p><div><p>Follow us</p></div></article>")]
    frame = spark.createDataFrame([(i, u, h, "t") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r.id: (r.url, r.text) for r in htmltext.main_text(frame).collect()}
    assert len(got) == len(rows)
    for k in range(20):
        assert got[k] == (rows[k][0], f"story {k}")
        assert got[20 + k][1] == "the same story"
    for k in range(5):
        assert got[40 + k][1] == f"story {k}\nFollow us"
    assert got[45] == (None, "x") and got[46] == ("nothing", "")
    assert htmltext.main_text(frame.limit(0)).count() == 0


def test_unmarked_templates_of_a_host_with_two_layouts(spark):
    """Each layout stands in less than half of the pages; the menus have no mark."""
    rows = []
    for k in range(40):
        menu = "<div><p>Home</p><p>Contact us</p></div>" if k % 2 else "<table><tr><td>Start<td>All stories</table>"
        rows.append((k, f"http://two.org/{k}", f"<body>{menu}<div><p>story {k}</p><p>of {k * k} words</p></div></body>"))
    rows += [(100 + k, f"http://few.org/{k}", f"<div>Our site</div><p>text {k}</p>") for k in range(3)]
    rows += [(200 + k, f"http://two.only/{k}", f"<div>Our site</div><p>text {k}</p>") for k in range(2)]
    got = {r.id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"story {k}\nof {k * k} words" for k in range(40))
    assert all(got[100 + k] == f"text {k}" for k in range(3)) and all(got[200 + k] == f"Our site\ntext {k}" for k in range(2))
