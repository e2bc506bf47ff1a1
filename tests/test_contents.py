import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import markup, text
from tallyspark.operators import library
from tallyspark.sources.contents import page_contents

CASES = [
    ("codeforces", '<div class="x problem-statement"><div class="header"><div class="title">A. Two <b>Sum</b></div><div class="time-limit">1 s</div></div><div><p>Find &lt;two&gt; <div>inner</div> numbers</p></div><div class="input-specification">no</div></div><div>outside</div>', "A. Two Sum Find <two> inner numbers"),
    ("codeforces", "<div>nothing</div>", ""),
    ("leetcode", '<a class="t" href="/problems/two-sum/">1. Two Sum</a><div data-track-load="description_content"><div>Given <code>nums</code></div> and <div><div>more</div></div></div><div>not this</div>', "1. Two Sum Given nums and more"),
    ("leetcode", '<meta content="From &amp; meta" name="description">', "From & meta"),
    ("codechef", '<section id="problem-statement"><h3>Sum</h3><section>deep &#65;</section> end</section> rest', "Sumdeep A end"),
    ("codechef", '<title>Only a title</title>', "Only a title"), ("codechef", '<div id="my-problem-statement-1">loose</div>', "loose"),
    ("code360", '<title>Pair</title><div class="left problem-pane"><div>x</div>y</div>z', "Pair xy"), ("code360", "<pre>code</pre>", "code"),
    ("atcoder", '<div id="task-statement"><span class="lang-ja"><section><h3>Input</h3>ja</section></span><span class="lang-en"><section><h3> Problem Statement </h3><p>Count.</p></section><section><h3>Sample</h3>no</section><section><h3>Output</h3>n</section></span></div>', "Problem Statement Count. Outputn"),
    ("atcoder", '<div id="task-statement"><h3>Problem Statement</h3>old <div>task</div></div>', "Problem Statementold task"), ("atcoder", '<div id="task-statement">no heading</div>', ""),
    ("geeksforgeeks", '<script id="__NEXT_DATA__" type="application/json">{"a":[{"problem_name":"x"},{"b":{"problem_name":"Pair","problem_question":"<p>Find &lt;it&gt;</p>"}}]}</script>', "Pair Find <it>"),
    ("geeksforgeeks", '<meta property="og:title" content="Open title"><title>T | site</title>', "Open title"), ("geeksforgeeks", "<title>T - site | more</title><script id='__NEXT_DATA__'>{broken</script>", "T"),
    ("tuf", '<h1>Sum</h1><main><p>One <b>two</b></p><ul><li>three</li></ul></main><div class="tuf-dark-content-box"><ul><li>n &lt; 5</li><li></li></ul></div><p>outside</p>', "Sum One two three n < 5"),
    (None, '<article><p>a</p><article><p>b</p></article><p>c</p></article><p>d</p>', "a b c"), ("leetcode", None, ""), ("tuf", None, ""), ("geeksforgeeks", None, ""),
]


def test_contents_by_platform(spark):
    df = spark.createDataFrame([(i, p, h) for i, (p, h, _) in enumerate(CASES)], "id long, platform string, html string")
    got = {r.id: r.content for r in page_contents(df).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: want for i, (_, _, want) in enumerate(CASES)}


@pytest.mark.parametrize("html,want", [
    ("<div id=a>x<div>y</div>z</div>w", "x<div>y</div>z"), ("<p><div id='a'><div><div></div></div>k</div>", "<div><div></div></div>k"), ("<div id=a>open <div>x", "open <div>x"), ("<div id=ab>no</div>", None), ("<DIV class=c ID=\"a\">x</DIV >y", "x"),
    ("<divider id=a>no</divider>", None), ("<div id=a></div>x", ""), ("<div id=a><divider></div></divider>", "<divider>"),
])
def test_elements_nest(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(markup.element(F.col("h"), "div", markup.attribute("id", "a")).alias("x")).first().x == want


def test_settled_texts_stay_in_the_jvm(spark):
    texts = ["plain", "ÄÖÜ ñç", "ﬁ", "é", "½", "“x” – …", "Ǆ", "한", None, "", "a b", "K", "²"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(text.nfkc(F.col("t")).alias("x")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    sent = [r.x for r in df.select(F.col("t").rlike(text.UNSETTLED).alias("x")).collect()]
    assert sent[:2] == [False, False] and sent[2:5] == [True, True, True] and sent[9] is False
    every = [chr(p) for p in range(0x3000) if not 0xD800 <= p < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "t string").select("t", text.nfkc(F.col("t")).alias("x")).collect()
    assert all(r.x == unicodedata.normalize("NFKC", r.t) for r in rows)
    assert [r.x for r in spark.createDataFrame([("&#65;&lt;&amp;lt;",), ("&lt;&bogus;",), ("x",)], "t string").select(text.decoded(F.col("t")).alias("x")).collect()] == ["A<&lt;", "<&bogus;", "x"]


def test_numbers_of_any_length_in_titles(spark):
    titles = ["a 2", "a 10", "a 010", "a", "a 99999999999999999999", "a 100000000000000000000", "b1", "a 2b", "10", "9"]
    got = [r.t for r in spark.createDataFrame([(t, i) for i, t in enumerate(titles)], "t string, i int").orderBy(library.natural_key(F.col("t")), "i").collect()]
    assert got == ["9", "10", "a", "a 2", "a 2b", "a 10", "a 010", "a 99999999999999999999", "a 100000000000000000000", "b1"]
