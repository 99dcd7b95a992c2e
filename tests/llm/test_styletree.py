"""Main-text extraction: markup cases, importances, the whole operator."""

import pytest

from duoclass.llm import queries as Q
from duoclass.llm import styletree as S
from tests.conftest import SF001


def text(source, low=frozenset()):
    return S.main_text(S.Page(source), low)


@pytest.mark.parametrize("source, expected", [
    ("", ""),
    ("plain", "plain"),
    ("<p>a</p><p>b", "a b"),
    ("<article><p>a  b\n c<b>d</b><i> e</i><br>f</p></article>", "a b cd e f"),
    ("<nav><a>menu</a></nav><article>text</article><footer>foot</footer>", "text"),
    ("<article><h1>t</h1><aside>x</aside><form>y</form><div class='share'>z</div><p>u</p></article>", "t u"),
    ("<article>a<script>var x='</p><p>no';</script><style>p{}</style><!-- no <p> -->b</article>", "ab"),
    ("<article>&lt;b&gt; &amp;amp; &eacute;&#233;&#x1F600; &nbsp;x &am</article>", "<b> &amp; éé😀 x &am"),
    ("<body><div>one</div>two<ul><li>three<li>four</ul></body>", "one two three four"),
    ("<div class='cookie-notice'>no</div><div id=comments>no</div><p>yes</p>", "yes"),
    ("<body class='has-sidebar'><article>yes</article></body>", "yes"),
    ("<div class='sidebar-layout'><article>yes</article></div>", "yes"),
    ("<article>body<article class='comment'>no</article></article>", "body"),
    ("<article>body</article><section id='comments'><article>no</article></section>", "body"),
    ("<article class='post share-on has-comments'>yes</article>", "yes"),
    ("<main><p>x</p></main><p>outside</p>", "x"),
    ("<header><h1>site</h1></header><article><header><h1>title</h1></header>x</article>", "title x"),
    ("<p>1 < 2 and a<3</p>", "1 < 2 and a<3"),
    ("<p title=\"a > b\">x</p><p title='unclosed>y</p>", "x y"),
    ("<article><p>cut of", "cut of"),
    ("<article><p>x</p><scrip", "x"),
    ("<p hidden>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
    ("<TABLE><TR><TD>a<TD>b</TABLE>", "a b"),
    ("</p></div>x</article>", "x"),
    ("<title>no</title><p>yes", "yes"),
    ("<article>a<textarea>no</textarea><select><option>no</select>b</article>", "ab"),
])
def test_markup(source, expected):
    assert text(source) == expected


@pytest.mark.parametrize("source, expected", [
    ("<article><h2 id='social-structure'>a</h2><section id='related-work'>b</section><div id='notice-of-appeal'>c</div></article>", "a b c"),
    ("<article><section id=comments>a</section><h3 id='share'>b</h3></article>", "a b"),
    ("<article><p>a <span class='share'>b</span> c</p><p class='related-work'>d</p></article>", "a b c d"),
    ("<article>a<div class='social-share'>x</div><div id='comments'>x</div><p class='wide ad'>x</p><h2 class='related'>x</h2>b</article>", "a b"),
    ("<div id='notice-of-appeal'>x</div><article>a</article>", "a"),
    ("<div class='social-links'>x</div><p>a</p>", "a"),
])
def test_names_inside_an_article(source, expected):
    assert text(source) == expected


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + "x") == "x"
    assert text("<article><p>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    assert text("<" * 3000) == "<" * 3000
    assert text('<p "' * 2000) == ""


def page(i, body):
    return (i, f"http://site.example/{i}", f"<html><body><div class='top'><p>Welcome to the site</p></div>"
               f"<div class='text'>{body}</div><div class='end'><p>Same end</p><p>everywhere</p></div></body></html>", "x", "y")


SCHEMA = "page_id long, url string, html string, host string, main_text string"


def test_repeated_branches_go(spark):
    """No element, class or role says so: only the site's pages together show the frame."""
    rows = [page(i, "".join(f"<p>story {i} part {j}</p>" for j in range(1 + i % 4))) for i in range(12)]
    rows += [(100, "http://lonely.example/", "<div><p>Welcome to the site</p></div>", "", ""), (101, None, None, "", ""), (102, None, "", "", "")]
    df = spark.createDataFrame(rows + [rows[0]], SCHEMA).repartition(3)
    out = S.extract_main_text(df)
    assert out.columns == ["page_id", "url", "html", "host", "main_text"]
    got = {r["page_id"]: r["main_text"] for r in out.collect()}
    assert got[5] == "story 5 part 0 story 5 part 1"
    assert got[0] == "story 0 part 0"
    assert got[100] == "Welcome to the site" and got[101] == got[102] == ""
    assert out.count() == len(rows) + 1


def test_importances(spark):
    rows = [page(i, "".join(f"<p>story {i} part {j}</p>" for j in range(1 + i % 4))) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("'s' AS host", "html")
    p = S.Page(rows[0][2])
    at = dict(zip(p.sig, p.paths()))
    imp = {r["node"]: (r["m"], r["importance"]) for r in S.importances(df).collect()}
    assert imp[at["div.top"]][0] == 12
    assert abs(imp[at["div.top"]][1]) < 1e-9 and abs(imp[at["div.end"]][1]) < 1e-9
    assert imp[at["div.text"]][1] > 0.5


@pytest.mark.parametrize("n", [16, 50, 500])
@pytest.mark.parametrize("around", ["<div class='text'>%s</div>", "<article><h1>t</h1><table>%s</table></article>", "<article><ul>%s</ul></article>"])
def test_equal_numbers_of_children(spark, n, around):
    """Text that is different on every page stays, however many children hold it."""
    cell = "<tr><td>{}</td></tr>" if "table" in around else "<li>{}" if "ul" in around else "<p>{}"
    rows = [(i, f"http://site.example/{i}", "<html><body>" + around % "".join(cell.format(f"story {i} part {j}") for j in range(n)), "", "")
            for i in range(3)]
    for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r["main_text"].removeprefix("t ") == " ".join(f"story {r['page_id']} part {j}" for j in range(n))


def test_one_style_on_nearly_all_pages(spark):
    """Forty styles with little entropy don't outweigh texts of which none is repeated."""
    rows = [page(i, "".join(f"<p>story {i} part {j}</p>" for j in range(max(5, i - 955)))) for i in range(1000)]
    got = {r["page_id"]: r["main_text"] for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == " ".join(f"story {i} part {j}" for j in range(max(5, i - 955))) for i in range(1000))


@pytest.mark.parametrize("n", [3, 1000])
def test_copies_are_one_page(spark, n):
    """Copies keep their text, with an article or without, and other pages of the host keep theirs."""
    story = "<html><body><div class='text'><p>one</p><p>two</p></div><div class='more'><p>three</p></div>"
    article = "<article><h1>t</h1><div class='text'><p>one</p></div><table><tr><td>two</td></tr></table></article>"
    rows = [(i, f"http://a.example/{i}", story, "", "") for i in range(n)]
    rows += [(n + i, f"http://b.example/{i}", article, "", "") for i in range(n)]
    rows += [(2 * n + i, f"http://c.example/{i}", page(7, "<p>copied</p>")[2] if i < n else page(i, f"<p>story {i}</p>")[2], "", "")
             for i in range(n + 3)]
    got = {r["page_id"]: r["main_text"] for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert {got[i] for i in range(n)} == {"one two three"} and {got[n + i] for i in range(n)} == {"t one two"}
    assert {got[2 * n + i] for i in range(n)} == {"copied"}
    assert [got[3 * n + i] for i in range(3)] == [f"story {n + i}" for i in range(3)]


def test_pages_of_equal_text_keep_it(spark):
    """The pages differ in a comment only, so the tree finds nothing on them important."""
    rows = [(i, f"http://a.example/{i}", f"<body><!-- {i} --><div class='a'><p>one</p></div><div class='b'><p>two</p></div>", "", "")
            for i in range(5)]
    assert {r["main_text"] for r in S.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"one two"}


def test_branch_of_all_text_is_not_judged():
    p = S.Page("<body><div class='a'><p>one</p></div><div class='b'><p>two</p></div>")
    at = dict(zip(p.sig, p.paths()))
    assert S.main_text(p, {at["body"], at["div.a"]}) == "two"
    assert S.main_text(p, {at["body"], at["div.a"], at["div.b"]}) == "one two"


def test_given_pages(spark):
    """Every page of the table has one article; all of its text and nothing else stays."""
    import html as h
    import re

    src = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = Q.op8_html_extract(spark, SF001).collect()
    assert len(rows) == len(src)
    for r in rows:
        a = re.search(r"<article>(.*?)(?:</article>|\Z)", src[r["page_id"]], re.S)[1]
        a = re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", "\n", a))
        assert r["text"] == " ".join(h.unescape(a).split()) and r["n_chars"] == len(r["text"])


def test_empty_table(spark):
    assert S.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_that_only_contain_a_noise_word():
    """Such an element is no noise; names of noise words, with words of place, are."""
    for name in ("modal-verbs", "ad-hoc", "social-structure", "notice-of-appeal", "menu-theory"):
        assert S.main_text(S.Page(f'<body><div class="{name}"><p>lesson'), set()) == "lesson", name
        assert S.main_text(S.Page(f'<body><div id="{name}"><p>lesson</div><p>more'), set()) == "lesson more", name
    for name in ("cookie-banner", "site-footer", "main-menu", "sidebar left", "page_header", "ad-box"):
        assert S.main_text(S.Page(f'<body><div class="{name}"><p>x</div><p>lesson'), set()) == "lesson", name


def test_text_of_formulas_and_fallbacks_is_text():
    page = S.Page("<article><p>a <math><mi>x</mi><mo>=</mo>1</math> b</p><noscript><p>shown</p></noscript><object>old</object><svg><text>no</text></svg></article>")
    assert S.main_text(page, set()) == "a x=1 b shown old"


def test_importance_does_not_depend_on_depth(spark):
    """The same text, different on every page, is content of its container however deep it lies."""
    def page(i, depth):
        return "<body><div class=c>" + "<div>" * depth + f"<p>text {i} of its own</p>" + "</div>" * depth + "</div></body>"

    got = []
    for depth in (1, 20, 60):
        rows = [(f"http://h{depth}.org/{i}", page(i, depth)) for i in range(6)]
        out = S.importances(spark.createDataFrame(rows, "u string, html string").selectExpr("'h' AS host", "html")).collect()
        path = S.Page(page(0, depth)).paths()
        got.append({r["node"]: r["content"] for r in out}[path[2]])
    assert got[0] == got[1] == got[2] == 1.0
    assert S.main_text(S.Page("<div>" * 5000 + "deep" + "</div>" * 5000), set()) == "deep"


def test_clashing_names_are_kept(spark):
    df = spark.createDataFrame([(1, "http://h.org/", "<p>a", "x", "y", "z")], "page_id long, url string, html string, _host string, _site string, _low string")
    r = S.extract_main_text(df).first()
    assert (r["_host"], r["_site"], r["_low"], r["main_text"]) == ("x", "y", "z", "a")
