import pytest

from logmill.llm.html_text import render, tree_events, visible_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>One <b>two</b>three<p>four", "One twothree\n\nfour"),
        ("a<br>b<br/>c", "a\nb\nc"),
        ("<h1>T &amp; U</h1>x<div>y</div>z", "T & U\n\nx\ny\nz"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol><li>d</ul>e", "- a\n- b\n  3. c\n- d\n\ne"),
        (
            "<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>1<tr><td>x<td>22</table>",
            "Name       Qty\nApple pie  1\nx          22",
        ),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>", "wide  z\n1  2  3"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
        ("<pre>\n a  b\n\nc</pre>", " a  b\n\nc"),
        ("<head><title>t</title></head><script>var a='</p>'</script><style>p{}</style>x", "x"),
        ("<div hidden>no</div><p style='display: none'>no</p><i hidden=until>no</i>yes", "yes"),
        ("<!-- no <b> -->a<![CDATA[no]]>b", "ab"),
        ("<select><option>no</select><textarea>no</textarea>a", "a"),
        ("<dl><dt>T<dd>D</dl>", "T\n    D"),
        ("a<hr>b", "a\n\n---\n\nb"),
        ("</p></div>x<b>y", "xy"),
        ("1 < 2 & 3 <unknown>z</unknown>", "1 < 2 & 3 z"),
        ("<a title='x > y'>q</a>", "q"),
        ("a &copy; b", "a © b"),
        ("<p>never <a href=\"closed", "never"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(page, text):
    assert render(page) == text


def test_events_balance():
    page = "<ul><li><p>a<div>b<li>c</ul></ul><table><tr><td><p>d</table><p>e"
    open_ = []
    for kind, tag, _ in tree_events(page):
        if kind == "open":
            open_.append(tag)
        elif kind == "close":
            assert open_.pop() == tag
    assert not open_


def test_deep_and_long_pages():
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<b " * 50_000) == ""
    assert render("<p>" + "w " * 100_000).count("w") == 100_000


def test_long_cells_do_not_widen_columns():
    page = "<table>" + "".join(f"<tr><td>{'c' * (5000 if i == 0 else 2)}<td>d" for i in range(300)) + "</table>"
    assert len(render(page)) < 5000 + 300 * 10


def test_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "")], "page_id long, url string, html string"
    ).selectExpr("*", "'x' AS text")
    found = visible_text(pages).collect()
    assert sorted(((r["page_id"], r["text"]) for r in found), key=str) == [(1, "a"), (1, "a"), (2, ""), (None, "")]
    assert visible_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p title="The hidden costs of x">a', "a"),
        ('<p class="nav hidden md:flex">a', "a"),
        ('<p style="overflow: hidden !important">a', "a"),
        ('<p data-css="display:none" data-hidden=1>a', "a"),
        ("<p style=\"background:url('display:none;visibility:hidden')\">a", "a"),
        ("<p style='display:none;display:block'>a", "a"),
        ("<p style='display:none!important;display:block'>a</p>b", "b"),
        ("<p STYLE='color:red; Display : NONE'>a</p><p HIDDEN=''>b</p><p style=visibility:hidden>c</p>d", "d"),
        ("so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>TeX</annotation></math> holds", "so x=1 holds"),
        ("a<svg><title>no</title><defs><text>no</text></defs>no<g><text x=1>Q1</text><text>Q<tspan>2</tspan></text></g></svg>b", "a\nQ1\nQ2\nb"),
        ("<select><option>no<option selected>yes<option>no</select>", "yes"),
        ("<p>Pick <select><option>no<option selected>yes</select> now <svg><text>Q</text></svg><text>r</text> s", "Pick yes now\nQ\nr s"),
        ("<select multiple><option>one<option>two</select>", "one\ntwo"),
    ],
)
def test_only_what_is_hidden_is_left_out(page, text):
    assert render(page) == text
