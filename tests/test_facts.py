import json
import random

from pyspark.sql import functions as F

from filings_engine.operators import facts as fx
from filings_engine.sources import edgar_files as ef


def _doc(cik, facts):
    return json.dumps({"cik": cik, "entityName": "X", "facts": {"us-gaap": facts}})


def test_flatten_and_dedupe(spark):
    facts = {
        "Assets": {"label": "Assets", "units": {"USD": [
            {"end": "2020-12-31", "val": 5.0, "accn": "a1", "form": "10-K"},            # instant: no start
            {"start": "2020-01-01", "end": "2020-12-31", "val": 5.0, "accn": "a2"},     # duplicate (end, val)
            {"start": "2020-07-01", "end": "2020-12-31", "val": 7.0, "accn": "a1"}]}},
        "Shares": {"label": "Shares", "units": {"shares": [{"end": "bad", "val": 1.0, "accn": "a1"}]}},
    }
    df = spark.createDataFrame([(0, _doc(42, facts))], "doc_order long, value string")
    flat = ef.parse_company_facts(df, doc_order="doc_order")
    rows = flat.orderBy("ordinal").collect()
    assert [r.cik for r in rows][0] == "0000000042"
    assert rows[0].start is None and rows[0].unit == "USD" and rows[3].unit == "shares"
    assert rows[3].end is None                                   # unreadable date -> null
    dd = fx.dedupe_facts(flat).filter("fact = 'Assets'").orderBy("val").collect()
    assert [(r.val, r.accn) for r in dd] == [(5.0, "a1"), (7.0, "a1")]   # first met wins


def test_periodic_facts_mean_of_durations(spark):
    import datetime as dt
    facts = spark.createDataFrame(
        [("0000000042", "Rev", "Revenue", dt.date(2020, 12, 31), 10.0, "a1"),
         ("0000000042", "Rev", "Revenue", dt.date(2020, 12, 31), 20.0, "a1"),
         ("0000000042", "Rev", "Revenue", dt.date(2019, 12, 31), 99.0, "zz"),      # not a 10-K accession
         ("0000000042", "Rev", "Revenue", dt.date(2018, 6, 30), 50.0, "a1")],      # no 10-K report date
        "cik string, fact string, label string, end date, val double, accn string")
    filings = spark.createDataFrame(
        [("0000000042", 0, "a1", "2020-12-31", "10-K", "k.htm"), ("0000000042", 1, "zz", "2019-12-31", "10-Q", "q.htm")],
        "cik string, ordinal long, accessionNumber string, reportDate string, form string, primaryDocument string")
    got = fx.annual_facts(facts, filings).collect()
    assert [(r.end.isoformat(), r.value) for r in got] == [("2020-12-31", 15.0)]
    latest = fx.latest_filing_of_form(filings, "10-K").collect()
    assert latest[0].accessionNumber == "a1"


def test_periodic_facts_within_a_duration(spark):
    import datetime as dt
    end = dt.date(2020, 12, 31)
    rows = [("c", "Rev", "R", s, end, v, "a1") for s, v in [(dt.date(2020, 1, 1), 10.0), (dt.date(2020, 10, 1), 3.0), (None, 7.0)]]
    facts = spark.createDataFrame(rows, "cik string, fact string, label string, start date, end date, val double, accn string")
    filings = spark.createDataFrame([("c", "a1", "2020-12-31", "10-K")], "cik string, accessionNumber string, reportDate string, form string")
    assert fx.periodic_facts(facts, filings, "10-K", min_days=300).first().value == 8.5
    assert fx.periodic_facts(facts, filings, "10-K", max_days=100).first().value == 5.0


def test_display_amounts(spark):
    from filings_engine.functions.strings import display_amount
    df = spark.createDataFrame([(1234567.0,), (-1234.5,), (0.0,), (None,)], "v double")
    assert [r.s for r in df.select(display_amount("v").alias("s")).collect()] == ["1,234,567", "-1,234.50", "0", None]


def test_pages_of_other_charsets(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(b'<meta charset="ISO-8859-1"><p>caf\xe9 \xa3</p>')
    (tmp_path / "b.htm").write_bytes("<p>café £</p>".encode())
    (tmp_path / "c.htm").write_bytes(b"<p>caf\xe9</p>")
    (tmp_path / "d.htm").write_bytes(b"")
    (tmp_path / "e.htm").write_bytes("<meta charset=windows-1252>“it’s” – 5 €".encode("cp1252") + b"\x81")
    pages = ef.fetched_pages(ef.read_filing_html(spark, str(tmp_path)))
    got = {r.url[-5]: r.html for r in pages.collect()}
    assert got["a"].endswith("<p>café £</p>") and got["e"].endswith("“it’s” – 5 €\x81") and got["b"] == "<p>café £</p>" and got["c"] == "<p>caf\ufffd</p>" and "d" not in got


def test_file_sources(spark, tmp_path):
    sub = {"cik": "42", "filings": {"recent": {
        "accessionNumber": ["a2", "a1"], "filingDate": ["2021-01-01", "2020-01-01"],
        "reportDate": ["", "2019-12-31"], "form": ["DEF 14A", "10-K"], "fileNumber": ["f", "f"],
        "filmNumber": ["1", "2"], "primaryDocument": ["x.htm", "y.htm"],
        "primaryDocDescription": ["DEF 14A", None]}}}
    (tmp_path / "CIK0000000042.json").write_text(json.dumps(sub))
    rows = ef.read_submissions(spark, str(tmp_path / "CIK*.json")).orderBy("ordinal").collect()
    assert [(r.cik, r.ordinal, r.accessionNumber) for r in rows] == [("0000000042", 0, "a2"), ("0000000042", 1, "a1")]
    ids = {"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"},
           "1": {"cik_str": 12345678901, "ticker": "BIG", "title": "Big"}}
    (tmp_path / "tickers.json").write_text(json.dumps(ids))
    r = ef.read_company_identifiers(spark, str(tmp_path / "tickers.json")).orderBy("ordinal").collect()
    assert [(x.cik_str, x.ticker) for x in r] == [("0000320193", "AAPL"), ("12345678901", "BIG")]


def test_filing_summary(spark):
    xml = ("<FilingSummary><MyReports>"
           "<Report><ShortName>Balance Sheets</ShortName><LongName>2 - Statement - BS</LongName>"
           "<HtmlFileName>R2.htm</HtmlFileName></Report>"
           "<Report><ShortName>BALANCE SHEETS</ShortName><LongName>9 - Statement - BS</LongName>"
           "<XmlFileName>R9.xml</XmlFileName></Report>"
           "<Report><ShortName>Cover</ShortName><LongName>1 - Document - Cover</LongName>"
           "<HtmlFileName>R1.htm</HtmlFileName></Report>"
           "<Report><ShortName>Empty</ShortName><LongName>3 - Statement - E</LongName>"
           "<HtmlFileName></HtmlFileName><XmlFileName>R3.xml</XmlFileName></Report>"
           "</MyReports></FilingSummary>")
    df = spark.createDataFrame([("acc", xml)], "accession string, value string")
    got = {r.short_name: r.file_name for r in ef.parse_filing_summary(df, key_cols=["accession"]).collect()}
    assert got == {"balance sheets": "R9.xml"}      # last wins; no 'Statement' / empty file name dropped


def test_two_values_of_one_matrix_cell(spark):
    import pytest
    long = spark.createDataFrame([("a", "x", 1.0, 2), ("a", "x", 5.0, 1), ("a", "y", 3.0, 1), ("b", "other", 9.0, 1)], "r string, c string, v double, at int")
    with pytest.raises(Exception, match="two values"):
        fx.to_wide(long, "r", "c", "v", ["x", "y"]).collect()
    got = {r.r: (r.x, r.y) for r in fx.to_wide(long, "r", "c", "v", ["x", "y"], "latest", "at").collect()}
    assert got == {"a": (1.0, 3.0), "b": (None, None)}
    assert fx.to_wide(long, "r", "c", "v", ["x"], "list").where("r = 'a'").first().x == [1.0, 5.0]


def test_facts_of_a_report_are_deduplicated_after_the_date_join(spark):
    rng = random.Random(3)
    days = [f"2020-0{m}-01" for m in range(1, 7)] + [None]
    rows = [(rng.choice(["a", "b", None]), "x", rng.choice("FG"), rng.choice("LM"), rng.choice(days), rng.choice(days), float(rng.randint(0, 2)), rng.choice("pqr"), i) for i in range(600)]
    facts = spark.createDataFrame(rows, "cik string, taxonomy string, fact string, label string, start string, end string, val double, accn string, ordinal long").withColumns(
        {c: F.to_date(c) for c in ("start", "end")})
    filings = spark.createDataFrame([(rng.choice("ab"), rng.choice("pqr"), rng.choice(days) or "", rng.choice(["10-Q", "10-K"])) for _ in range(12)],
                                    "cik string, accessionNumber string, reportDate string, form string")
    for bounds in ({}, {"min_days": 10, "max_days": 100}):
        got, want = (sorted(map(tuple, x.collect())) for x in (fx.periodic_facts(facts, filings, "10-Q", **bounds, dedupe=True), fx.periodic_facts(fx.dedupe_facts(facts), filings, "10-Q", **bounds)))
        assert got and got == want
