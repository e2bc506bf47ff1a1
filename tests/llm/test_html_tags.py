import time

import pytest

from tallyspark.llm.html_text import NESTED, extract

MAX_DEPTH = 150
DEEP = "<div>" * (MAX_DEPTH + 50)


@pytest.mark.parametrize("source,want", [
    ('<a href="x"">text</a> more "quoted" end', 'text more "quoted" end'), ("<p title=Bob's>one</p><p>it's two", "one\n\nit's two"), ('<p">kept</p\'> on', "kept on"),
    ('<b title="a>b">x</b title="c>d"> y', "x y"), ("<b title = 'a>b'>x</b>", "x"), ("<b title=>x</b>", "x"), ('<b a="1"b="2" hidden>x</b>y', "y"), ("<b =hidden>x", "x"), ("<p/hidden>x</p>y", "y"),
    ('<b title=a"b>c</b> "d', 'c "d'), ("<script>x</script a='>'>y", "y"),
])
def test_quotes_only_open_values(source, want):
    assert extract(source) == want


def test_beyond_the_depth():
    assert extract(f"{DEEP}a<b hidden>no<i>no</i></b>z") == "az"
    assert extract(f"{DEEP}a<b style='visibility:hidden'>no<i style='visibility:visible'>yes</i>no</b>z") == "ayesz"
    assert extract(f"<div hidden>{DEEP}no{'</div>' * (MAX_DEPTH + 50)}no</div>after") == "after"
    # an end tag closes the element it belongs to, not an ancestor that is rendered
    assert extract(f"<div style='visibility:hidden'>{DEEP}<div>no</div>{'</div>' * (MAX_DEPTH + 50)}no</div>after") == "after"
    assert extract(f"{DEEP}<b style='visibility:hidden'><input value=no><textarea>no</textarea></b>z") == "z"
    assert extract(f"{DEEP}<p>a<p>b</p>c").split() == ["a", "b", "c"]


def test_odd_tags_stay_linear():
    began = time.time()
    for piece in ("<a \"", "<a b='", "<a =", "<p><table>", "<p>" + "<b>" * 9, "</a b=\"", "<a b = ", "<i hidden>"):
        extract(piece * 5_000)
    assert time.time() - began < 20


def test_any_depth():
    for depth in (10, 200, 3000):
        div = "<div>" * depth
        assert extract(f"{div}<p hidden>secret</p>seen") == "seen"
        assert extract(f"{div}<ul><li>x<li>ok</ul>") == "* x\n* ok"
        assert extract(f"{div}<table><tr><td>a<td>b<tr><td>ccc<td>d</table>") == "a    b\nccc  d"
    lists = extract("<ol><li>x" * (NESTED + 20)).split("\n")
    assert [x.strip() for x in lists] == ["1. x"] * (NESTED + 20) and lists[1].startswith("   1.")
    flat = extract("<blockquote>" * (NESTED + 5) + "<ol start=3><li>a<li></li><li value=9>b<li>c</ol><ul><li>d</ul>end").split("\n")
    assert [x.strip() for x in flat if x.strip()] == ["3. a", "9. b", "10. c", "* d", "end"]
    began = time.time()
    for piece in ("<b>", "<div>x", "<blockquote>x", "<ul><li>x", "<table><tr><td>x", "<q>", "<thead>"):
        assert extract(piece * 30_000).count("x") == 30_000 * piece.count("x")
    assert time.time() - began < 30
