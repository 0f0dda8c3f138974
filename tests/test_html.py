from filings_engine.operators import html as hx
from filings_engine.operators.html_nodes import html_nodes, parse_nodes

PAGE = ("<!DOCTYPE html><html><head><title>T &amp; Co</title><script>var t=\"</p>\";</script>"
        "<style>p{}</style></head><body><p><b>one<br>two<p>three</b> four"
        "<img src=\"a/i.png\"><img src=\"\"><!-- c -->"
        "<table><tr><td>1</td><td><table><tr><td>in</td></tr></table></td></tr></table>"
        "<template>hidden</template></body></html>")


def test_tokenizer_rules():
    rows = parse_nodes(PAGE, "http://h.org/x/y.htm")
    kinds = {(r.kind, r.text) for r in rows if r.kind != "element"}
    assert ("script", 'var t="</p>";') in kinds and ("text", "T & Co") in kinds
    assert ("template", "hidden") in kinds and ("comment", " c ") in kinds
    imgs = [r.link for r in rows if r.tag == "img"]
    assert imgs == ["http://h.org/x/a/i.png", None]


def test_page_text_tables_images(spark):
    pages = spark.createDataFrame([(1, "http://h.org/x/y.htm", PAGE)], "doc_id long, url string, html string")
    nodes = html_nodes(pages)
    assert hx.page_text(nodes).first().text == "T & Co\none\ntwo\nthree\nfour\n1\nin"
    tabs = [r.text for r in hx.page_tables(nodes).orderBy("table_pos").collect()]
    assert tabs == ["1 in", "in"]                                  # nested text in both tables
    assert [r.url for r in hx.page_images(nodes).collect()] == ["http://h.org/x/a/i.png"]
    doc = hx.extract_documents(pages, nodes).first().document
    assert doc.tables == tabs and doc.images == ["http://h.org/x/a/i.png"]


def test_contents_and_sections(spark):
    html = ("<body><div>TABLE OF <b>CONTENTS</b></div>"
            "<table><tr><td>Part I</td><td>skip</td></tr>"
            "<tr><td>1</td><td><a href=\"#a\">A</a></td></tr>"
            "<tr><td>2</td><td><a href=\"#b\">B</a></td></tr>"
            "<tr><td>3</td><td><a href=\"#zz\">missing</a></td></tr>"
            "<tr><td>4</td><td><a href=\"#a\">A again</a></td></tr>"
            "<tr><td>only one cell</td></tr></table>"
            "<h2 id=\"a\">A</h2><p>alpha</p>loose<p>beta</p>"
            "<h2 id=\"b\">B</h2><p>gamma</p><div><span id=\"c\">deep</span></div><p>delta</p></body>")
    pages = spark.createDataFrame([(1, "u", html)], "doc_id long, url string, html string")
    nodes = html_nodes(pages)
    entries = hx.toc_entries(nodes).orderBy("row_pos").collect()
    assert [(e.value, e.title) for e in entries] == [("1", "A"), ("2", "B"), ("3", "missing"), ("4", "A again")]
    ids = hx.toc_ids(hx.toc_entries(nodes))
    assert [r.id for r in ids.orderBy("k").collect()] == ["a", "b", "zz", "a"]
    sec = {r.id: r.text for r in hx.toc_sections(nodes, ids).collect()}
    # 'b' -> next id 'zz' is missing: skipped; last 'a' runs to the last sibling
    assert sec == {"a": "alpha beta B gamma deep delta"}


def test_bad_markup_keeps_the_page(spark):
    pages = spark.createDataFrame([(1, '<p>a<img src="http://[bad">b<![foo[ x ]]>c</p>', "http://h.org/"), (2, None, None), (3, "<p> </p>", None)], "doc_id int, html string, url string")
    nodes = html_nodes(pages)
    text = {r.doc_id: r.text for r in hx.page_text(nodes, pages).collect()}
    assert set(text) == {1, 2, 3} and text[1].split("\n")[:2] == ["a", "b"] and text[2] == text[3] == ""
    assert hx.page_images(nodes).count() == 0


def test_adjacent_anchors_give_an_empty_section(spark):
    pages = spark.createDataFrame([(1, '<div><a id="a"></a><a id="b"></a><p>text</p></div>')], "doc_id int, html string")
    nodes = html_nodes(pages, url=None)
    ids = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id int, k int, id string")
    assert {r.id: r.text for r in hx.toc_sections(nodes, ids).collect()} == {"a": "", "b": "text"}


def test_unclosed_cells_cost_linear_space():
    page = "<table>" + "<tr><td>x" * 3000
    for implied in (False, True):
        rows = parse_nodes(page, None, implied)
        assert len(rows) == 9001
        assert sum(len(v) for r in rows for v in (r.table_path, r.row_path, r.cell_path, r.cells) if v) < 10 * len(rows)
    cells = [r for r in parse_nodes(page, None, True) if r.tag == "td"]
    assert {c.text for c in cells} == {"x"} and cells[0].end_pos == cells[0].pos + 1


def test_pages_the_tokenizer_rejects_give_an_error_row(spark, monkeypatch):
    from filings_engine.operators import html_nodes as hn

    def fail(self, data):
        raise AssertionError("bad page")
    monkeypatch.setattr(hn._NodeRecorder, "feed", fail)
    only = hn.parse_nodes("<p>x")
    assert [(n.kind, n.text) for n in only] == [("error", "AssertionError: bad page")]


def test_heading_split_over_elements_and_descendants(spark):
    html = "<div>x</div><div><span>TABLE OF </span><b>CON</b>TENTS</div><table><tr><td>1<td>Title <a href='#q'>t</a></table>"
    nodes = html_nodes(spark.createDataFrame([("p", html)], "doc_id string, html string"), url=None)
    e = hx.toc_entries(nodes).first()
    assert (e.doc_id, e.ids) == ("p", ["q"])
    divs = nodes.filter("tag = 'div'").selectExpr("doc_id", "pos AS outer_pos", "end_pos AS outer_end")
    assert [r.text for r in hx.element_texts(nodes, divs).orderBy("outer_pos").collect()] == ["x", "TABLE OF CONTENTS"]
