"""Pages to Markdown: elements, the main region, malformed nesting, and that no word of the main region is lost or moved."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.markdown import to_markdown
from ledgerlark.plans import text_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<h1>A <b>b</b></h1><p>c</p>", "# A **b**\n\nc"), ("<p>a<br>b</p>", "a  \nb"), ("<p>one<p>two<div>three</div>", "one\n\ntwo\n\nthree"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), ("<a href='/x'> go </a>on", "[go](/x) on"), ("<em>x</em>*y*", "_x_\\*y\\*"), ("<img src=a.png alt='an  image'>", "![an image](a.png)"),
        ("<pre>  a\n*b*</pre>", "```\n  a\n*b*\n```"), ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"), ("<hr>", "* * *"), ("a<!-- no --><script>var t='</p>';</script><style>p{}</style>b", "ab"),
        ("<table><tr><th>H<th>I<tr><td>1|2<td>3</table>", "| H | I |\n| --- | --- |\n| 1\\|2 | 3 |"), ("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>", "|  |  |\n| --- | --- |\n| a |  |\n| b | c |"),
        ("<head><title>t</title></head><body><nav>menu</nav><main><p>x</p></main></body>", "x"), ("<div role=main>y</div><main> </main>", "y"), ("<article>first</article><article>second</article>", "first"),
        ("<div class='a content b'>z</div><p>out</p>", "z"), ("<body><p>all</p>of it</body>", "all\n\nof it"), ("</p></b>a</i><b>open <i>both</b> after", "a**open _both_** after"), ("<b><p>block</p></b>", "block"),
        ("&lt;b&gt; &amp; &eacute;", "<b> & é"), ("<h2></h2><p> </p><ul><li></li></ul>x", "- \n\nx"),
    ],
)
def test_elements(html, expected):
    assert to_markdown(html) == expected


def test_deep_and_long_pages():
    assert to_markdown("<b>" * 50_000 + "x") .strip("*") == "x"
    assert to_markdown("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert to_markdown("<ul><li>" * 300 + "x").split()[-1] == "x"
    assert len(to_markdown("<p>word</p>" * 100_000)) == 600_000 - 2


def words(text):
    return re.findall(r"\w+", text)


def test_no_word_of_a_page_is_lost(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r["page_id"]: r["markdown_sha256"] for r in text_queries.QUERIES["page_markdown"](spark, SF).collect()}
    assert len(found) == len(rows)
    import hashlib

    for r in rows:
        text = to_markdown(r["html"])
        assert found[r["page_id"]] == hashlib.sha256(text.encode()).hexdigest()
        region = re.search(r"(?s)<article>(.*?)(</article>|\Z)", r["html"] or "")
        if region:
            bare = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", "", region[1])
            import html

            expected = words(html.unescape(re.sub(r"<[^>]*>", " ", bare)))
            assert words(re.sub(r"\]\([^)]*\)|!\[", " ", text).replace("\\", "").replace("_", " ")) == words(" ".join(expected).replace("_", " ")), r["page_id"]


def test_nulls_stay_empty(spark):
    from ledgerlark.functions.markdown import markdown

    rows = spark.createDataFrame([(1, None), (2, "<p>a</p>")], "id long, html string").select("id", markdown("html").alias("m"))
    assert {r["id"]: r["m"] for r in rows.collect()} == {1: "", 2: "a"}
    assert rows.where(F.col("id") < 0).count() == 0
