import datetime as dt

import pytest
from pyspark.sql import functions as F

from filings_engine.functions import pad_cik, summary_url
from filings_engine.operators import coverage as cov
from filings_engine.operators import filters as flt
from filings_engine.plans import proxy_links as pl
from filings_engine.schemas import LINK_COLUMNS

IDS = [(0, "0000000001", "AAA", "Alpha"), (1, "0000000002", "BBB", "Beta"), (2, "0000000003", "CCC", "Gamma")]
FILINGS = [
    # cik, ordinal, accession, filingDate, reportDate, form, fileNumber, filmNumber, primaryDocument, description
    ("0000000001", 0, "0000000001-20-000001", "2020-04-01", "2020-03-31", "DEF 14A", "f", "1", "a.htm", "FORM DEF 14A"),
    ("0000000001", 1, "0000000001-19-000002", "2019-04-01", "2019-03-31", "DEF 14A", "f", "2", "b.htm", "DEF 14A"),
    ("0000000001", 2, "0000000001-19-000003", "2019-02-01", "2019-01-31", "PREC14A", "f", "3", "c.htm", "PREC14A"),
    ("0000000001", 3, "0000000001-18-000004", "", "2018-03-31", "DEF 14A", "f", "4", "d.htm", "DEF 14A"),
    ("0000000001", 4, "0000000001-18-000005", "2018-03-01", "2018-03-01", "DEF 14A", "f", "5", "e.htm", None),
    ("0000000001", 5, "0000000001-18-000006", "2018-03-02", "2018-03-01", "DEF 14A", "f", "6", "f.htm", "def 14a"),
    ("0000000002", 0, "0000000002-20-000007", "2020-05-05", "2020-05-01", "10-K", "f", "7", "g.htm", "DEF 14A"),
]
FCOLS = ("cik string, ordinal long, accessionNumber string, filingDate string, reportDate string, form string, "
         "fileNumber string, filmNumber string, primaryDocument string, primaryDocDescription string")


@pytest.fixture
def ids(spark):
    return spark.createDataFrame(IDS, "ordinal long, cik_str string, ticker string, title string")


@pytest.fixture
def filings(spark):
    return spark.createDataFrame(FILINGS, FCOLS)


def test_links_filters_and_order(ids, filings):
    out = pl.find_proxy_filings(ids, filings, " aaa , zzz", 2019, 2020)
    rows = out.collect()
    assert out.columns == LINK_COLUMNS
    # null and lower-case descriptions, empty dates and other forms drop out; unknown ticker ignored
    assert [r.accessionNumber for r in rows] == ["0000000001-20-000001", "0000000001-19-000002",
                                                 "0000000001-19-000003"]
    assert rows[0].doc_url == ("https://www.sec.gov/Archives/edgar/data/0000000001/000000000120000001/a.htm")
    assert rows[0].filingDate == dt.date(2020, 4, 1) and rows[0].cik == "0000000001"


def test_no_match_gives_empty_with_schema(ids, filings):
    out = pl.find_proxy_filings(ids, filings, ["CCC"], 2019, 2020)
    assert out.count() == 0 and out.columns == LINK_COLUMNS


def test_pad_and_summary_url(spark):
    df = spark.createDataFrame([("12345678901", "a/b/c.htm"), ("42", "nodir")], "c string, u string")
    r = df.select(pad_cik("c").alias("p"), summary_url("u").alias("s")).collect()
    assert r[0].p == "12345678901" and r[1].p == "0000000042"
    assert r[0].s == "a/b/R2.htm" and r[1].s == "nodir/R2.htm"


def test_coverage_and_alerts(spark):
    links = spark.createDataFrame(
        [("A", dt.date(2019, 1, 1)), ("A", dt.date(2019, 5, 1)), ("A", dt.date(2021, 1, 1)),
         ("B", dt.date(2020, 1, 1))], "ticker string, filingDate date")
    c = cov.filing_coverage(links, 2019, 2021)
    got = sorted((r.ticker, r.year, r.n) for r in c.collect())
    assert got == [("A", 2019, 2), ("A", 2020, 0), ("B", 2019, 0), ("B", 2021, 0)]
    al = {r.ticker: (r.missing_alert, r.duplicate_alert) for r in cov.coverage_alerts(c).collect()}
    assert al["A"] == ("* A: 2020", "* A: 2019 (2 files found)")
    assert al["B"] == ("* B: 2019, 2021", None)
    req = spark.createDataFrame([("A",), ("Z",)], "ticker string")
    z = cov.filing_coverage(links, 2019, 2019, include=req).filter("ticker = 'Z'").collect()
    assert [(r.year, r.n) for r in z] == [(2019, 0)]


def test_pivot_duplicates(spark):
    v = spark.createDataFrame(
        [("u1", "A", dt.date(2019, 1, 1)), ("u2", "A", dt.date(2019, 6, 1)), ("u3", "B", dt.date(2020, 1, 1))],
        "File string, Ticker string, `Filing Date` date")
    with pytest.raises(Exception):
        cov.pivot_links(v, [2019, 2020]).collect()
    latest = {r.Ticker: (r["2019"], r["2020"]) for r in cov.pivot_links(v, [2019, 2020], "latest").collect()}
    assert latest == {"A": ("u2", None), "B": (None, "u3")}
    lists = {r.Ticker: r["2019"] for r in cov.pivot_links(v, [2019, 2020], "list").collect()}
    assert lists["A"] == ["u1", "u2"]


def test_lookup_cik_first_match(spark, ids):
    ids2 = ids.unionByName(ids.limit(1).withColumns({"ordinal": F.lit(9), "cik_str": F.lit("0000000099")}))
    req = spark.createDataFrame([("AAA",), ("NOPE",)], "ticker string")
    got = {r.ticker: r.cik for r in flt.lookup_cik(ids2, req).collect()}
    assert got == {"AAA": "0000000001", "NOPE": None}


def test_links_view_columns(ids, filings):
    v = flt.links_view(pl.find_proxy_filings(ids, filings, None, 2019, 2020))
    assert v.columns == ["File", "Summary", "Ticker", "Form", "Filing Date"]
    assert v.first().Summary.endswith("/000000000120000001/R2.htm")


def test_year_options(spark):
    r = spark.range(1).select(cov.year_options(2019, 2022).alias("y")).first().y
    assert r == [2022, 2021, 2020, 2019]


def test_text_bundle_keeps_images_tables_and_failed_pages(spark):
    from filings_engine.plans.proxy_links import proxy_texts
    links = spark.createDataFrame([("A", "u1", dt.date(2020, 1, 1), 0), ("A", "u2", dt.date(2021, 1, 1), 1), ("B", "u3", dt.date(2020, 1, 1), 2)],
                                  "ticker string, doc_url string, filingDate date, ordinal long")
    docs = spark.createDataFrame([("u1", ("x MARK y", ["i"], ["t"])), ("u3", None)],
                                 "doc_url string, document struct<text: string, images: array<string>, tables: array<string>>")
    got = {r.ticker: (r.text, r.images, r.tables) for r in proxy_texts(links, docs, "MARK").collect()}
    assert got == {"A": (" y", ["i"], ["t"]), "B": (None, None, None)}
