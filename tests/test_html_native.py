"""Column expressions on pages against the parser and the standard library."""

import html
import random
import re
from urllib.parse import urljoin

from pyspark.sql import functions as F

from filings_engine.operators import html as hx
from filings_engine.operators import html_native as nat
from filings_engine.operators.html_nodes import html_nodes
from filings_engine.sources import adapters as ad

HARD = ["<p>a</p>", "", None, "plain", "<p>a<!-- <b>x</b> -->b<br>c", "<script>if (a < b) { '</p>' }</script>t", "<STYLE type='x>y'>p{}</STYLE >u<script src='a' />v",
        "a &lt;b&gt; &amp;amp; &copy &copyright &notit; &#65;&#x42;&#0;&#128;&#x110000;&#xD800;&#1;&#99999999999; &nope; &", "x < y <3 > z",
        "<a href='a&amp;b' href=c>1</a><A HREF=x y>2</A><a href>3</a><a title='href=no'>4</a><a  href = \"q'r\" >5</a>", "<!DOCTYPE html><?pi x?>t<![CDATA[ <b> ]]>u<![if x]>v",
        "<ruby>k<rt>hid</rt><rp>(</rp></ruby>see<template>a<template>b</template>c</template>d<template>", "<p title='a>b' class=x>in</p><p title=\"it's\">q</p>",
        "<img src=a.png><img src=''><img><img src='b.png' src='../c.png'><IMG SRC=//h/x><img src='http://[bad/x'><img src='http://[::1]:80/y'>",
        "  \xa0<b>   s \t</b>\x1c<i>\n</i>", "<p>un<b>closed<p>tags", "<td/>x<br/>y", "é<p>日本</p>&eacute;&#26085;"]


def same(native, parsed, keys):
    a, b = (sorted(map(tuple, x.select(*keys).collect()), key=str) for x in (native, parsed))
    assert a == b


def numbered(df, value):
    from pyspark.sql import Window
    return df.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).alias("n"), value)


def compare(pages):
    nodes = html_nodes(pages).cache()
    same(nat.page_text(pages), hx.page_text(nodes, pages), ["doc_id", "text"])
    same(numbered(nat.page_links(pages), "href"), numbered(hx.page_links(nodes), "href"), ["doc_id", "n", "href"])
    same(numbered(nat.page_images(pages), "url"), numbered(hx.page_images(nodes), "url"), ["doc_id", "n", "url"])
    nodes.unpersist()


def test_hard_pages(spark):
    rows = [(i, f"http://h.org/x/{i}.htm", t) for i, t in enumerate(HARD)]
    compare(spark.createDataFrame(rows, "doc_id int, url string, html string"))


def test_all_given_and_rendered_pages(spark):
    d = "/root/testdata/sf0.01"
    compare(ad.table(spark, d, "pages").withColumnRenamed("page_id", "doc_id").repartition(4))
    compare(ad.filing_pages(spark, "/root/testdata/sf0.001"))


def test_random_markup(spark):
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<b class='x'>", "</b>", "text ", "&amp;", "&lt", "<br/>", "<!-- c -->", "<img src=i.png>", "<a href='#x'>", "</a>", " < ", "é", "\n", "<script>x<y</script>", "&#8364;"]
    rows = [(i, "https://e.org/a/b?q#f", "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    compare(spark.createDataFrame(rows, "doc_id int, url string, html string").repartition(4))


def test_character_references(spark):
    texts = ["&" + n for n in ("amp", "amp;", "AMP", "ampx", "notin;", "notinx", "eacute", "Eacute;", "ngE;", "bne;", "zzz;", "#", "#;", "#x;", "#38", "#x26;x", "#00065;", "#150;", "#x9F", "#11;", "#xFFFE;", "#x1F600;", "")]
    texts += ["a&b&&c;", "&amp;lt;", "&lt;&gt;&quot;&nbsp;"] + [f"&#{n};" for n in (0, 9, 10, 13, 31, 127, 129, 159, 160, 64976, 65535, 1114111, 1114112, 9 * 10 ** 7, 10 ** 30)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.u for r in df.select(nat.unescape("t").alias("u")).collect()] == [html.unescape(t) for t in texts]


BASES = ["http://h.org/a/b/c.htm?q=1#f", "https://h.org", "http://h.org/", "ftp://h/x/y/", "", None, "/local/path/file", "mailto:x@y.z", "http://u@h:80/p;x/q"]
LINKS = ["", "x.png", "./x", "../x", "../../../x", "/r/./s/../t", "//other/z", "?n=2", "#g", "http:x", "http://k.org/y?z#w", "https://k.org", "mailto:a@b", "data:image/png;base64,AA=", ".", "..", "a/", "a//b", ";p", "x;y",
         " sp", "a\nb", "http://[bad", "http://[::1]/q", "http://bad]/", "javascript:void(0)", "a:b", "/", "x?y#", "///p"]


def test_addresses(spark):
    rows = [(b, u) for b in BASES for u in LINKS]

    def expected(b, u):
        try:
            return urljoin(b or "", u)
        except ValueError:
            return None
    df = spark.createDataFrame(rows, "b string, u string")
    got = [r.j for r in nat.join_urls(df, "b", "u", "j").collect()]
    wrong = [(b, u, g, expected(b, u)) for (b, u), g in zip(rows, got) if g != expected(b, u)]
    assert not wrong


def test_no_python_worker(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "doc_id int, url string, html string")
    for df in (nat.page_text(pages), nat.page_links(pages), nat.page_images(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"EvalPython|MapIn(Arrow|Pandas)|Exchange \w", plan)


def test_images_between_odd_tokens(spark):
    rng = random.Random(9)
    bits = ["<img src=i.png>", "<IMG\tSRC='a/b.png'/>", "<img src='a>b.png'>", "<imgs src=x>", "<img", "<img src=\"../c.png\" >", "<!-- <img src=no.png> -->", "<script>'<img src=no.png>'</script>", "<style><img src=no>",
            "</style>", "<!-- <img src=late>", "<p title='<img src=in>'>", "<![if x]>", "<", ">", "text", "\n", "<a href=q>", "<img src='p\n'>", "<img src=.h/x>", "<img src=a/./b>", "<img src=a//b>"]
    bases = ["https://e.org/a/b?q#f", "http://h.org/x/y.htm", "http://h.org", "http://h.org/a/../b", "http://h.org/a//b", "HTTP://h.org/a/b", None, "http://h.org/a/\n", "http://u@h/x"]
    pages = spark.createDataFrame([(i, rng.choice(bases), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(400)], "doc_id int, url string, html string").repartition(4)
    rows = nat.page_images(pages).collect()
    # the tokens of a page, cut one by one
    tokens = pages.select("doc_id", F.posexplode(nat.page_tokens("html")).alias("pos", "t")).where(F.col("t").rlike(r"^(?i:<img)(?:[\t\n\r\f />\x00])"))
    alone = tokens.join(pages.select("doc_id", "url"), "doc_id").select((F.col("doc_id") * 1000 + F.col("pos")).alias("doc_id"), "url", F.col("t").alias("html"))
    one = {r.doc_id: r.url for r in nat.page_images(alone).collect()}
    assert [(r.doc_id, r.url) for r in sorted(rows)] == [(k // 1000, u) for k, u in sorted(one.items())]
    # addresses by the rules of the standard library
    sources = {k: html.unescape(m[1] or m[2] or m[3] or "") for k, t in alone.select("doc_id", "html").collect()
               if "title" not in t for m in [re.search(r"""(?is)src=(?:"([^"]*)"|'([^']*)'|([^\s>]*))""", t)] if m}
    base = {r.doc_id: r.url for r in pages.collect()}
    assert sources and {k: one.get(k) for k in sources} == {k: urljoin(base[k // 1000] or "", v) if v else None for k, v in sources.items()}


def test_tokens_of_other_tags_are_not_listed(spark):
    pages = spark.createDataFrame([(1, "http://h/a/b", "<p>x" * 200000 + "<img src=c.png>")], "doc_id int, url string, html string")
    images = nat.page_images(pages)
    assert [(r.pos, r.url) for r in images.collect()] == [(0, "http://h/a/c.png")]
