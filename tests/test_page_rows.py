"""Pages read as one row each (``PageParts``) give what their node table gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from filings_engine.operators import html as hx
from filings_engine.operators import statements as stm
from filings_engine.operators.html_nodes import html_nodes
from filings_engine.plans import catalog
from filings_engine.session import checkpoint_dir


def _tokens(rng):
    some = ["<div>", "</div>", "<span>", "</span>", "TABLE OF ", "CONTENTS", "TABLE OF CONTENTS", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "x", " ", "Part", "1",
            '<h2 id="a">', "</h2>", '<p id="b">', "</p>", '<a id="c" href="#a">', '<a href=" #b#">', '<a href="#c">', "</a>", '<img src="i.png">', "<script>s</script>", "<!-- c -->", "&amp;", " "]
    contents = "<div>TABLE OF <b>CONTENTS</b></div><table>" + "".join(f'<tr><td>{i}</td><td><a href="#{x}">t{i}</a></td></tr>' for i, x in enumerate("abcab")) + "</table>"
    return (contents if rng.random() < 0.7 else "") + "".join(rng.choice(some) for _ in range(rng.randrange(60)))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, "http://h.org/d/x.htm", 404 if i % 11 == 0 else 200, None if i % 13 == 0 else _tokens(rng)) for i in range(150)]
    rows += [r for r in rows if r[0] % 9 == 0]                    # pages that come twice
    rows += [(None, "http://h.org/", 200, "<p>no id</p>")]
    return spark.createDataFrame(rows, "doc_id long, url string, status int, html string").repartition(5).cache()


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_sections_of_page_rows(pages):
    nodes, rows = html_nodes(pages), html_nodes(pages, **hx.CONTENTS_NODES)
    whole = hx.toc_sections(nodes, hx.toc_ids(hx.toc_entries(nodes)))
    assert _rows(hx.toc_sections(rows, hx.toc_ids(hx.toc_entries(rows))).select(whole.columns)) == _rows(whole) and whole.count() > 100
    entries = hx.toc_entries(rows).select("doc_id", F.inline("entries"))
    assert _rows(entries.select(hx.toc_entries(nodes).columns)) == _rows(hx.toc_entries(nodes))


def test_documents_of_page_rows(pages):
    whole = hx.extract_documents(pages, html_nodes(pages))
    assert _rows(hx.extract_documents(pages, html_nodes(pages, **hx.DOCUMENT_NODES, carry=["status"]))) == _rows(whole)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A customer, orders and lineitem table of some rows."""
    d = str(tmp_path_factory.mktemp("tables"))
    n = F.col("id")
    spark.range(20).select(n.alias("c_custkey"), F.concat(F.lit("Name "), n).alias("c_name")).write.parquet(f"{d}/customer.parquet")
    spark.range(300).select(
        n.alias("o_orderkey"), (n % 20).alias("o_custkey"), F.when(n % 3 == 0, "F").otherwise("P").alias("o_orderstatus"),
        F.date_add(F.lit(dt.date(1996, 1, 5)), (n * 4).cast("int")).cast("timestamp_ntz").alias("o_orderdate"),
        F.concat((n % 5 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    spark.range(700).select(
        (n * 3 % 290).alias("l_orderkey"), (n % 50).alias("l_partkey"), (n % 7).alias("l_suppkey"), (n / 290 + 1).cast("int").alias("l_linenumber"),
        (n % 40 + 1).cast("double").alias("l_quantity"), (n * 1.5 + 1).alias("l_extendedprice"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.lit(dt.datetime(1997, 3, 1)).cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    return d


def _planned(spark, name, d):
    """The exchanges a query plans without broadcasts, and the tables it lands before it runs."""
    from pathlib import Path
    folder = Path(checkpoint_dir(spark), "tables")
    before = set(folder.glob("*"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return plan.count("Exchange hash"), len(set(folder.glob("*")) - before)


def test_sections_plan(spark, tables):
    # line items and orders, each by the order: the pages are neither shuffled nor landed
    assert _planned(spark, "toc_sections", tables) == (2, 0)
    assert catalog.QUERIES["toc_sections"](spark, tables).count() == 700


def test_documents_plan(spark, tables):
    assert _planned(spark, "filing_documents", tables) == (2, 0)
    assert catalog.QUERIES["filing_documents"](spark, tables).count() == 290


STATEMENT = ('<table><tr><th class="tl">in Millions</th><th class="th"><div>Dec. 31, 2023</div></th><th class="th x"><div>May 1, 2020</div></th></tr>'
             "<tr><td class=\"pl\"><a onclick=\"f( 'defref_A', w );\">a</a></td><td class=\"nump\">$ 1.5</td>{}</tr></table>")


def test_statement_pages_of_one_id(spark):
    rows = [(1, STATEMENT.format('<td class="num">(2)</td>'))] * 2 + [(2, STATEMENT.format(""))] * 2 + [(3, STATEMENT.format('<td class="num">1.1.1</td>')), (None, STATEMENT), (4, None), (5, "<p>x</p>")]
    df = spark.createDataFrame(rows, "doc_id long, html string").repartition(3)
    values, errors = stm.statement_frame(html_nodes(df, url=None, **stm.STATEMENT_NODES), df)
    # the cells of a page that comes twice are all listed
    assert sorted((r.doc_id, r.period, r.value) for r in values.collect()) == [(2, 0, 1500.0), (2, 1, 1500.0)]
    assert {r.doc_id: r.reason for r in errors.collect()} == {1: "more cells than dates", 3: "bad number", 4: "empty", 5: "empty", None: "empty"}
    _, seen = stm.statement_frame(html_nodes(df, url=None, **stm.STATEMENT_NODES))
    assert {r.doc_id for r in seen.collect()} == {1, 3}


def test_statement_plans(spark, tables):
    for name in ("statement_errors", "statement_values"):
        # line items and orders once for the pages, once for the ids of the orders, which meet the pages
        assert _planned(spark, name, tables)[1] == 0, name
    assert catalog.QUERIES["statement_errors"](spark, tables).count() + catalog.QUERIES["statement_values"](spark, tables).select("doc_id").distinct().count() == 290


def test_dedupe_deals_out_once(spark):
    values = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, None), (1, 1, 0, 2.0), (1, 1, 1, None), (1, 2, 0, 2.0), (2, 0, 0, 2.0)], "doc_id int, row int, period int, value double")
    got = stm.dedupe_statement_rows(values)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted((r.doc_id, r.row) for r in got.collect()) == [(1, 0), (1, 0), (1, 2), (2, 0)]


def test_company_statements_land_no_pages(spark, tables):
    from pathlib import Path
    folder = Path(checkpoint_dir(spark), "tables")
    before = set(folder.glob("*"))
    values = catalog.QUERIES["company_statements"](spark, tables)
    landed = [set(spark.read.parquet(str(p)).columns) for p in set(folder.glob("*")) - before]
    assert landed and not any("html" in c for c in landed)
    errors = catalog.QUERIES["company_statement_errors"](spark, tables)
    # the latest 10-K of these companies: three statements each, with values or with one error
    told = [tuple(r) for df in (values.select("cik", "statement").distinct(), errors.select("cik", "statement")) for r in df.collect()]
    assert len(told) == len(set(told)) == 12
    counts = {(r.cik, r.part): r.n for r in catalog.QUERIES["company_profile"](spark, tables).collect()}
    assert sum(n for (_, part), n in counts.items() if part == "statements") == values.count()


def test_pages_of_wanted_addresses(spark, tables):
    from filings_engine.sources import adapters as ad
    whole = ad.all_statement_pages(spark, tables)
    some = whole.select("url").where("abs(hash(url)) % 5 = 0").distinct()
    got = ad.all_statement_pages(spark, tables, some)
    assert _rows(got) == _rows(whole.join(some, "url", "left_semi").select("doc_id", "url", "html")) and got.count() > 50


def test_summary_names_are_dealt_out_once(spark, tables):
    files = catalog.QUERIES["statement_files"](spark, tables)
    assert files._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(accession") == 1
