"""EDGAR-shaped views derived from the driver's star-schema tables.

The test data has no filing files, so each filing-side input is defined as a
pure column mapping of a test table (no sampling, no id subsets): work grows
with the tables.  The same mappings are restated independently in SQL by the
oracle (``filings_engine.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filings_engine.functions import pad_cik

# --- fixed values of the mapping (see FIXTURES.md, part B) -----------------
# o_orderpriority first character -> form
FORM_OF_PRIORITY = {"1": "DEF 14A", "2": "PREC14A", "3": "10-K", "4": "10-Q", "5": "DEFA14A"}
# o_orderstatus -> primary document description (P -> null)
DESCRIPTION_OF_STATUS = {"F": "FORM DEF 14A", "O": "DEFINITIVE PROXY STATEMENT"}
BAD_DATE_MODULUS = 97          # o_orderkey % 97 == 0 -> empty filing date
# ---------------------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 ``(ordinal, cik_str, ticker, title)`` from ``customer``."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("ordinal"),
        pad_cik("c_custkey").alias("cik_str"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("title"))


def filing_ordinal(order_date, order_key):
    """Position in the company's newest-first submission array, as one
    sortable long: later dates first, then the order key."""
    return (-F.unix_date(order_date)).cast("long") * F.lit(1_000_000_000_000) + order_key.cast("long")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` in enough parts for documents made of every row."""
    from filings_engine.session import spread
    return spread(table(spark, sf_dir, "orders"), "o_orderkey")


def filings(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """D3 filing rows (all companies) from ``orders``."""
    o = table(spark, sf_dir, "orders") if orders is None else orders
    d = F.col("o_orderdate").cast("date")
    iso = d.cast("string")
    key = F.col("o_orderkey")
    return o.select(
        pad_cik("o_custkey").alias("cik"),
        filing_ordinal(d, key).alias("ordinal"),
        accession_number(key, d).alias("accessionNumber"),
        F.when(key % BAD_DATE_MODULUS == 0, F.lit("")).otherwise(iso).alias("filingDate"),
        iso.alias("reportDate"),
        _case(F.substring("o_orderpriority", 1, 1), FORM_OF_PRIORITY).alias("form"),
        F.concat(F.lit("001-"), pad_cik(F.col("o_custkey") % 100_000, 5)).alias("fileNumber"),
        key.cast("string").alias("filmNumber"),
        F.concat(F.lit("d"), key.cast("string"), F.lit(".htm")).alias("primaryDocument"),
        _case(F.col("o_orderstatus"), DESCRIPTION_OF_STATUS).alias("primaryDocDescription"))


def accession_number(order_key, order_date):
    """``pad10(key)-yy-pad6(key mod 10^6)``."""
    return F.concat(pad_cik(order_key), F.lit("-"), F.lpad((F.year(order_date) % 100).cast("string"), 2, "0"), F.lit("-"),
                    pad_cik(order_key % 1_000_000, 6))


def _fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact item per line item: fact = return flag + line status, end =
    order date on even lines else ship date, start = order date on odd
    lines (a duration) else absent (an instant), val = quantity."""
    from filings_engine.session import spread
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    o = table(spark, sf_dir, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    od = F.col("o_orderdate").cast("date")
    even = F.col("l_linenumber") % 2 == 0
    return j.select(
        F.col("o_custkey"), F.col("o_orderkey"),
        F.concat("l_returnflag", "l_linestatus").alias("fact"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("line"),
        F.struct(
            F.when(~even, od.cast("string")).alias("start"),
            F.when(even, od).otherwise(F.col("l_shipdate").cast("date")).cast("string").alias("end"),
            F.col("l_quantity").alias("val"),
            accession_number(F.col("o_orderkey"), od).alias("accn"),
            F.year(od).cast("long").alias("fy"), F.lit("FY").alias("fp"),
            _case(F.substring("o_orderpriority", 1, 1), FORM_OF_PRIORITY).alias("form"),
            od.cast("string").alias("filed")).alias("item"))


def company_facts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-facts JSON documents ``(doc_order, value)``, one per
    (company, accession): a filing's lines are a bounded group (<= 7 in
    TPC-H), so no document grows with a company's size.  Items of a fact are
    in line order."""
    lines = _fact_lines(spark, sf_dir)
    per_doc = (lines.groupBy("o_custkey", "o_orderkey")
               .agg(F.array_sort(F.collect_list(F.struct("fact", "line", "item"))).alias("rows")))
    facts = F.transform(
        F.array_distinct(F.transform("rows", lambda r: r["fact"])),
        lambda f: F.struct(
            f.alias("key"),
            F.struct(F.concat(F.lit("Label "), f).alias("label"),
                     F.create_map(F.lit("USD"), F.transform(F.filter("rows", lambda r: r["fact"] == f),
                                                            lambda r: r["item"])).alias("units")).alias("value")))
    doc = F.struct(F.col("o_custkey").alias("cik"), F.lit(None).cast("string").alias("entityName"),
                   F.create_map(F.lit("us-gaap"), F.map_from_entries(facts)).alias("facts"))
    return per_doc.select(F.col("o_orderkey").alias("doc_order"), F.to_json(doc).alias("value"))


def company_concept_documents(spark: SparkSession, sf_dir: str, concept: str = "NO") -> DataFrame:
    """Company-concept JSON documents for one fact, one per (company,
    accession), items in line order."""
    lines = _fact_lines(spark, sf_dir).filter(F.col("fact") == concept)
    per_doc = (lines.groupBy("o_custkey", "o_orderkey")
               .agg(F.array_sort(F.collect_list(F.struct("line", "item"))).alias("rows")))
    doc = F.struct(F.col("o_custkey").alias("cik"), F.lit("us-gaap").alias("taxonomy"),
                   F.lit(concept).alias("tag"), F.concat(F.lit("Label "), F.lit(concept)).alias("label"),
                   F.create_map(F.lit("USD"), F.transform("rows", lambda r: r["item"])).alias("units"))
    return per_doc.select(F.col("o_orderkey").alias("doc_order"), F.to_json(doc).alias("value"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9 answers ``(doc_id, attempt, content)`` from ``customer``: the first
    attempt is a JSON object (padded with blanks); every 7th customer's first
    attempt is junk and the re-format gives the JSON; every 49th never gives
    JSON (five junk re-formats, then a plain-text fallback)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    valid = F.to_json(F.struct(
        F.col("c_name").alias("CEO name"),
        (F.lit(1990) + F.col("c_nationkey")).alias("Year covered"),
        F.array("c_mktsegment", F.lit("Revenue")).alias("Names of metrics used to evaluate performance"),
        F.format_string("$%.2f", "c_acctbal").alias("Total CEO Compensation $")))
    bad7, bad49 = k % 7 == 0, k % 49 == 0

    def att(n, content, keep):
        return F.struct(F.lit(n).alias("attempt"), content.alias("content"), keep.alias("keep"))
    tries = F.array(
        att(0, F.when(bad7, F.concat(F.lit("json\n"), valid)).otherwise(F.concat(F.lit("  "), valid, F.lit("\n"))),
            F.lit(True)),
        att(1, F.when(bad49, F.concat(F.lit("Sorry, "), F.col("c_name"))).otherwise(valid), bad7),
        *[att(n, F.concat(F.lit(f"no data {n}")), bad49) for n in range(2, 6)],
        att(6, F.concat(F.lit("CEO: "), F.col("c_name")), bad49))
    return (c.select(k.alias("doc_id"), F.inline(tries))
            .filter("keep").drop("keep"))


def answers_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers ``(doc_id, attempt, content)`` from ``supplier`` whose values are text
    that looks like a list, no number, nested lists, null, a truth value and an object."""
    k = F.col("s_suppkey").cast("string")
    content = F.concat(F.lit('{"CEO name": "['), k, F.lit(',2]", "Year covered": NaN, "Metrics": [["EPS", '), k,
                       F.lit('], "TSR", null, true], "Total": {"cash": 1.5, "note": "it\'s '), F.col("s_name"), F.lit('"}, "Checked": false}'))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("attempt"), content.alias("content"))


#: Bytes of rendered pages per byte of the line items' files, about.
RENDERED_BYTES = 24


def page_slices(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the rendered pages: of about 64 MB, a few per slot, and no fewer than
    a shuffle has (else a join would deal the rows out anew)."""
    from filings_engine.session import SPREAD_BYTES
    size = int(table(spark, sf_dir, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(4 * spark.sparkContext.defaultParallelism, -(-size * RENDERED_BYTES // SPREAD_BYTES),
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """Rendered pages by ``doc_id``; no further exchange where they were rendered by that key."""
    return pages.repartition(page_slices(spark, sf_dir), "doc_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order key its line items in line order (a bounded group: TPC-H orders have at
    most 7 lines).  The line items are dealt out here, where they are small, so that the
    pages made of them need not be."""
    li = table(spark, sf_dir, "lineitem").repartition(page_slices(spark, sf_dir), "l_orderkey")
    return (li.groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                F.col("l_shipdate").cast("date").alias("ship")))).alias("lines")))


def _order_lines(spark: SparkSession, sf_dir: str, names: DataFrame | None = None) -> DataFrame:
    """Per order (of ``names``, else all): its filing identity and its line items in line order."""
    names = _order_names(spark, sf_dir) if names is None else names
    return names.join(_lines(spark, sf_dir), F.col("doc_id") == F.col("l_orderkey")).drop("l_orderkey")


def _order_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: its filing identity."""
    od = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderpriority", od.alias("odate"),
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), pad_cik("o_custkey"), F.lit("/"),
                 F.replace(accession_number(F.col("o_orderkey"), od), F.lit("-"), F.lit("")),
                 F.lit("/d"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("url"))


def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 filing pages ``(doc_id, url, status, html)`` rendered per order: a
    contents heading split over two elements, a contents table linking one
    anchor per line item, then per line an anchored heading, a paragraph, an
    image and a table with a nested table, and a closing paragraph.  Every 83rd
    page ends in an image without a valid address and an unknown section."""
    base = _order_lines(spark, sf_dir)

    def s(c):
        return c.cast("string")

    # items are numbered by their position in line order (line numbers repeat)
    toc_rows = F.array_join(F.transform("lines", lambda l, i: F.concat(
        F.lit("<tr><td>"), s(i + 1), F.lit(".</td><td><a href=\"#s"), s(i + 1),
        F.lit("\">Item "), s(i + 1), F.lit("</a></td></tr>"))), "")
    sections = F.array_join(F.transform("lines", lambda l, i: F.concat(
        F.lit("<h2 id=\"s"), s(i + 1), F.lit("\">Item "), s(i + 1), F.lit("</h2>"),
        F.lit("<p>Part "), s(l["l_partkey"]), F.lit(" ships "), l["ship"].cast("string"),
        F.lit("</p><img src=\"img/"), s(l["l_partkey"]), F.lit(".png\"><table><tr><td>Qty</td><td>"),
        s(l["l_quantity"].cast("int")), F.lit("</td></tr><tr><td>Supplier</td><td><table><tr><td>S"),
        s(l["l_suppkey"]), F.lit("</td></tr></table></td></tr></table>"))), "\n")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Filing "), s(F.col("doc_id")),
        F.lit("</title><style>td{padding:0}</style></head><body>\n<div>TABLE OF <b>CONTENTS</b></div>\n"
              "<table><tr><td>Part I</td><td>Summary</td></tr>"), toc_rows, F.lit("</table>\n"),
        sections, F.lit("\n<p>End of filing "), s(F.col("doc_id")), F.lit("</p>"),
        F.when(F.col("doc_id") % 83 == 0, F.lit("<img src=\"http://[bad\"><![odd[ section ]]>")).otherwise(F.lit("")),
        F.lit("</body></html>"))
    return base.select("doc_id", "url", F.lit(200).alias("status"), html.alias("html"))


def _pick(names: list[str], idx):
    """``names[idx]`` as a column (idx a column)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (idx + 1).cast("int"))


def filing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 ``FilingSummary.xml`` documents ``(accession, value)`` per order:
    a cover report (not a statement), one balance-sheet, income and
    cash-flow report named by a synonym picked from the order key (upper
    case, to exercise lower-casing), the income report as an XML file on
    every 5th order, the cash-flow report filed as a disclosure (no
    ``Statement`` in its long name) on every 7th, and a second balance-sheet
    synonym (three places down the list) as R5."""
    from filings_engine.sources.keys import STATEMENT_KEYS
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    bs, inc, cf = (STATEMENT_KEYS[x] for x in ("balance_sheet", "income_statement", "cash_flow_statement"))

    def report(short, long, html=None, xml=None):
        parts = [F.lit("<Report><ShortName>"), short, F.lit("</ShortName><LongName>"), long, F.lit("</LongName>")]
        if html is not None:
            parts += [F.lit("<HtmlFileName>"), html, F.lit("</HtmlFileName>")]
        if xml is not None:
            parts += [F.lit("<XmlFileName>"), xml, F.lit("</XmlFileName>")]
        return F.concat(*parts, F.lit("</Report>"))

    b1 = F.upper(_pick(bs, k % len(bs)))
    i1 = F.upper(_pick(inc, k % len(inc)))
    c1 = F.upper(_pick(cf, k % len(cf)))
    b2 = F.upper(_pick(bs, (k + 3) % len(bs)))
    inc_report = F.when(k % 5 == 0, report(i1, F.concat(F.lit("0003 - Statement - "), i1), xml=F.lit("R3.xml"))) \
        .otherwise(report(i1, F.concat(F.lit("0003 - Statement - "), i1), html=F.lit("R3.htm")))
    cf_kind = F.when(k % 7 == 0, F.lit("0004 - Disclosure - ")).otherwise(F.lit("0004 - Statement - "))
    xml = F.concat(
        F.lit("<?xml version=\"1.0\" encoding=\"utf-8\"?><FilingSummary><Version>3.23</Version><MyReports>"),
        report(F.lit("Cover"), F.lit("0001 - Document - Cover"), html=F.lit("R1.htm")),
        report(b1, F.concat(F.lit("0002 - Statement - "), b1), html=F.lit("R2.htm")),
        inc_report,
        report(c1, F.concat(cf_kind, c1), html=F.lit("R4.htm")),
        report(b2, F.concat(F.lit("0005 - Statement - "), b2), html=F.lit("R5.htm")),
        F.lit("</MyReports></FilingSummary>"))
    od = F.col("o_orderdate").cast("date")
    return o.select(F.replace(accession_number(k, od), F.lit("-"), F.lit("")).alias("accession"),
                    xml.alias("value"))


def _statement_html(base: DataFrame) -> DataFrame:
    """X6 statement page of each order ``(doc_id, url, html)`` of ``_order_lines``: two period
    columns (order date, one year earlier), one row per line item with the
    part as concept, quantity as a positive and price as a negative amount.
    Units: ``in Millions`` for priority 1, ``unless otherwise specified``
    for priority 2, else ``in Thousands``.  The third line's first amount is
    a text cell.  Every 101st order has an unreadable date, every 103rd one
    row with an extra amount cell, every 97th leaves its cells and rows unclosed
    and every 89th has no markup at all (a failed fetch)."""
    k = F.col("doc_id")
    p1 = F.substring("o_orderpriority", 1, 1)
    unit = (F.when(p1 == "1", F.lit("$ in Millions")).when(p1 == "2", F.lit("Share data unless otherwise specified"))
            .otherwise(F.lit("$ in Thousands")))
    d0 = F.date_format("odate", "MMM. d, yyyy")
    d1 = F.when(k % 101 == 0, F.lit("Foo. 31, 1999")).otherwise(F.date_format(F.date_sub("odate", 365), "MMM. d, yyyy"))

    def row(l, i):
        first = F.when(i == 2, F.lit("<td class=\"text\">&#160;<span></span></td>")).otherwise(
            F.concat(F.lit("<td class=\"nump\">$ "), l["l_quantity"].cast("int").cast("string"),
                     F.lit("<span></span></td>")))
        extra = F.when((k % 103 == 0) & (i == 0), F.lit("<td class=\"num\">(1)</td>")).otherwise(F.lit(""))
        return F.concat(
            F.lit("<tr class=\"re\"><td class=\"pl \" style=\"border-bottom: 0px;\" valign=\"top\">"
                  "<a class=\"a\" href=\"javascript:void(0);\" onclick=\"top.Show.showAR( this, "
                  "'defref_us-gaap_P"), l["l_partkey"].cast("string"),
            F.lit("', window );\">Part "), l["l_partkey"].cast("string"), F.lit("</a></td>"), first,
            F.lit("<td class=\"num\">("), F.format_number(l["l_extendedprice"], 2), F.lit(")<span></span></td>"),
            extra, F.lit("</tr>"))
    html = F.concat(
        F.lit("<html><head><title></title></head><body><table class=\"report\" border=\"0\" cellspacing=\"2\">"
              "<tr><th class=\"tl\" colspan=\"1\" rowspan=\"2\"><div style=\"width: 200px;\"><strong>"
              "CONSOLIDATED BALANCE SHEETS - USD ($)<br> "), unit,
        F.lit("</strong></div></th><th class=\"th\"><div>"), d0, F.lit("</div></th><th class=\"th\"><div>"), d1,
        F.lit("</div></th></tr>"), F.array_join(F.transform("lines", row), ""), F.lit("</table></body></html>"))
    html = (F.when(k % 89 == 0, F.lit(None))
            .when(k % 97 == 0, F.regexp_replace(html, "</t[dr]>", "")).otherwise(html))
    return base.select("doc_id", "url", html.alias("html"))


def _folder(url: str = "url"):
    return F.regexp_replace(url, r"/[^/]*$", "")


def order_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id)`` of the orders that have line items, hence a rendered page."""
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(keys, "doc_id", "left_semi")


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance sheets ``(doc_id, url, html)``: a filing's summary page R2.htm."""
    return _statement_html(_order_lines(spark, sf_dir)).select("doc_id", F.concat(_folder(), F.lit("/R2.htm")).alias("url"), "html")


def all_statement_pages(spark: SparkSession, sf_dir: str, urls: DataFrame | None = None) -> DataFrame:
    """Balance sheet, income and cash-flow page of each order ``(doc_id, url,
    html)``, named as in its filing summary and identified by the address; the
    second balance sheet (R5) was not fetched.

    ``urls`` (url): the pages of these addresses.  The semi-join reads the orders' addresses
    alone and the rows are dealt out by address, both before a page is rendered."""
    income = F.when(F.col("doc_id") % 5 == 0, F.lit("/R3.xml")).otherwise(F.lit("/R3.htm"))
    files = F.explode(F.array(F.lit("/R2.htm"), income, F.lit("/R4.htm"))).alias("file")
    names = _order_names(spark, sf_dir).select("*", files).withColumn("url", F.concat(_folder(), "file"))
    base = _order_lines(spark, sf_dir, names if urls is None else names.join(urls, "url", "left_semi"))
    if urls is not None:
        base = base.repartition(page_slices(spark, sf_dir), "url")
    return _statement_html(base).select(F.col("url").alias("doc_id"), "url", "html")


def identifier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 documents ``(value)``: one ``{"<key>": {cik_str, ticker, title}}``
    object per customer (the file format, one record per document)."""
    c = table(spark, sf_dir, "customer")
    rec = F.struct(F.col("c_custkey").alias("cik_str"),
                   F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
                   F.col("c_name").alias("title"))
    return c.select(F.col("c_custkey").alias("doc_order"),
                    F.to_json(F.create_map(F.col("c_custkey").cast("string"), rec)).alias("value"))


def submission_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 documents ``(value)``: a submission index per filing (parallel
    arrays of length one under ``filings.recent``), built from the filing
    view, so every filing row must come back through the parser."""
    f = filings(spark, sf_dir, _orders(spark, sf_dir))
    from filings_engine.schemas import FILING_FIELDS
    recent = F.struct(*[F.array(F.col(c)).alias(c) for c in FILING_FIELDS])
    doc = F.struct(F.col("cik"), F.struct(recent.alias("recent")).alias("filings"))
    return f.select("ordinal", F.col("filmNumber").cast("long").alias("doc_order"), F.to_json(doc).alias("value"))


# --- fixed values of the broken documents: key modulo -> what is wrong ------
CUT_OFF, EMPTY, WRONG_TYPE, TEXT_BEHIND, NO_PART, UNEQUAL = 53, 59, 61, 67, 71, 73
# ---------------------------------------------------------------------------


def broken_documents(docs: DataFrame, kind: str, key: str = "doc_order") -> DataFrame:
    """``docs`` with some documents spoilt by key: cut off, empty, with a value of
    another type, with text behind the object, without the records, and (submission
    indexes) with arrays of different length."""
    k, v = F.col(key), F.col("value")
    wrong = {"identifiers": F.regexp_replace(v, '"cik_str":[0-9]+', '"cik_str":[1]'),
             "submissions": F.replace(v, F.lit('"recent":{'), F.lit('"recent":"x","other":{')),
             "summary": F.regexp_replace(v, "(?s)<MyReports>.*</MyReports>", "<MyReports>none</MyReports>")}
    wrong = wrong.get(kind, F.regexp_replace(v, '"val":[0-9.]+', '"val":"n/a"'))
    json = kind != "summary"
    value = (F.when(k % CUT_OFF == 0, F.expr("left(value, length(value) - 9)")).when(k % EMPTY == 0, F.when(k % 2 == 0, F.lit(" \n")))
             .when(k % WRONG_TYPE == 0, wrong).when((k % TEXT_BEHIND == 0) & json, F.concat(v, F.lit(" {}")))
             .when(k % NO_PART == 0, F.lit("{}" if json else "<FilingSummary/>"))
             .when((k % UNEQUAL == 0) & (kind == "submissions"), F.replace(v, F.lit('"form":['), F.lit('"form":["x",'))).otherwise(v))
    return docs.withColumn("value", value)
