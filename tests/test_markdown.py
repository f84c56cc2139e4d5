"""Markdown of literal pages."""

import pytest
from pyspark.sql import functions as F

from tallyrook.functions import markdown, text

PAGES = [
    ("<h1>A <b>b</b></h1><p>one<p>two &amp; <i> three </i>.<br>four", "# A **b**\n\none\n\ntwo & *three* .  \nfour"),
    ("<ul><li>a<li>b<ol start=3><li>c</li><li><p>d</p><p>e</p></ol></ul>", "- a\n- b\n  3. c\n  4. d\n\n     e"),
    ("<ul>x<li></li><li>y</li></ul>", "- x\n- y"),
    ("<table><caption>t</caption><tr><th>a<th>b|c<tr><td colspan=2>d</table>", "t\n\n| a | b\\|c |\n| --- | --- |\n| d |  |"),
    ("<table><tr><td><p>a</p><ul><li>b</ul><td><table><tr><td>in</table></table>after", "| a - b | \\| in \\| \\| --- \\| |\n| --- | --- |\n\nafter"),
    ('<p>see <a href="/x y">the <b>x</b></a>, <a>no</a> <a href="/(q)">q</a> <img src=i.png alt="a  b"></p>', "see [the **x**](/x%20y), no [q](</(q)>) ![a b](i.png)"),
    ("<pre><code class='language-py'>\na  = 1\n```\n</code></pre><p>use <code>a`b</code>", "````py\na  = 1\n```\n````\n\nuse ``a`b``"),
    ("<blockquote><p>a</p><p>b</p></blockquote><hr>", "> a\n>\n> b\n\n---"),
    ("<a href=u><div>block</div></a><b><p>in</p></b>", "block\n\nin"),
    ("<head><title>t</title><script>if (a<b) '<p>x</p>'</script><style>p{}</style><p>body<!-- c --> text<noscript>n</noscript>", "body text"),
    ("<p><b>open<br><p>next</div></b> end", "**open**  \n\nnext end"),
    ("<dl><dt>t<dd>d</dl><h2></h2><p> </p>", "t\n\nd"),
    ("", ""), ("plain  text\n", "plain text"), ("<p>a\0b", "ab"), ("<b>  </b>x<b> y</b>", "x **y**"), ("<h2>a<h3>b", "## a\n\n### b"),
]


@pytest.mark.parametrize(("html", "shown"), PAGES)
def test_page(html, shown):
    assert [x.rstrip() for x in markdown.page(html).split("\n")] == [x.rstrip() for x in shown.split("\n")]


def test_deep_and_long_pages():
    assert markdown.page("<div>" * 50_000 + "x") == "x"
    assert markdown.page("<ul><li>" * 3000 + "x").endswith("x")
    assert markdown.page("<b>" * 3000 + "x" + "</b>" * 3000).count("x") == 1
    assert len(markdown.page("<p>word</p>" * 100_000).split("\n\n")) == 100_000


def test_columns(spark):
    rows = [(0, PAGES[1][0]), (1, None), (2, "<p>" + "x" * 30), (3, "<h1>a</h1><pre># no\n- no\n</pre><p><a href=/t>l</a>" + "".join(f"<p>{'y' * 50}" for _ in range(5)))]
    d = spark.createDataFrame(rows, "i int, html string").withColumn("m", markdown.html_markdown(F.col("html")))
    found = d.select("i", markdown.outline(F.col("m")).alias("o"), markdown.extraction_reject(F.col("m"), 20).alias("r"), text.chunks(F.col("m"), 120).alias("chunks")).orderBy("i").collect()
    assert [r.r for r in found] == ["too_long", "empty", "too_long", "too_long"]
    assert (found[0].o["items"], found[3].o["items"]) == (4, 0)
    assert (found[3].o["headings"], [tuple(x) for x in found[3].o["links"]]) == (["# a"], [("l", "/t")])
    assert found[3].chunks[0].startswith("# a\n\n```\n# no\n- no\n```\n\n[l](/t)") and all(len(x) <= 120 for x in found[3].chunks)
