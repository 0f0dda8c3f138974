"""Accounts of landed files (S1-S5) and the links sink."""

import json

import pytest

from filings_engine.sources import edgar_files as ef
from filings_engine.sources import file_checks as fc

RECENT = {f: ["a", "b"] for f in ["accessionNumber", "filingDate", "reportDate", "form", "fileNumber", "filmNumber", "primaryDocument", "primaryDocDescription"]}


def accounts(checked):
    return {r.path.rsplit("/", 1)[1]: (r.n_rows, r.reason) for r in checked.files.collect()}


def land(folder, files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_every_submission_file_is_accounted_for(spark, tmp_path):
    good = json.dumps({"cik": "7", "filings": {"recent": RECENT}})
    land(tmp_path / "s", {
        "CIK1.json": good, "CIK2.json": good[:-5], "CIK3.json": b"", "CIK4.json": " \n", "CIK5.json": "[" + good + "]", "CIK6.json": good + good,
        "CIK7.json": good + " // end", "CIK8.json": json.dumps({"cik": "7", "filings": {"recent": "none"}}), "CIK9.json": "{}",
        "CIK10.json": json.dumps({"filings": {"recent": RECENT | {"form": ["x"]}}}), "CIK11.json": json.dumps({"filings": {"recent": {f: [] for f in RECENT}}}),
        "CIK12.json": json.dumps({"filings": {"recent": RECENT}}), "CIK13.json": "null", "CIK 14.json": b"\xff\xfe{"})
    checked = fc.read_checked(spark, str(tmp_path / "s"), "submissions")
    assert accounts(checked) == {
        "CIK1.json": (2, None), "CIK2.json": (0, "malformed"), "CIK3.json": (0, "empty"), "CIK4.json": (0, "empty"), "CIK5.json": (0, "malformed"),
        "CIK6.json": (0, "malformed"), "CIK7.json": (0, "malformed"), "CIK8.json": (0, "wrong type"), "CIK9.json": (0, "missing part"),
        "CIK10.json": (0, "unequal arrays"), "CIK11.json": (0, "no rows"), "CIK12.json": (2, None), "CIK13.json": (0, "malformed"), "CIK%2014.json": (0, "malformed")}
    assert sorted(r.cik for r in checked.rows.collect()) == ["0000000007"] * 2 + ["0000000012"] * 2
    wrong = {r.path.rsplit("/", 1)[1]: (r.bytes, r.text) for r in checked.errors.collect()}
    assert len(wrong) == 12 and wrong["CIK2.json"] == (len(good) - 5, good[:-5]) and wrong["CIK3.json"] == (0, None)


def test_a_wrong_value_costs_only_itself(spark):
    def doc(items):
        return json.dumps({"cik": 42, "facts": {"us-gaap": {"A": {"label": "A", "units": {"USD": items}}}}})
    rows = [(0, doc([{"end": "2020-12-31", "val": 1}])), (1, doc([{"end": "2020-12-31", "val": "?"}, {"end": "2021-12-31", "val": 2}])),
            (2, '{"cik": 42, "facts": {"dei": {}}}'), (3, None)]
    checked = fc.check_documents(spark.createDataFrame(rows, "k int, value string"), "facts", ["k"])
    assert {r.k: (r.n_rows, r.reason) for r in checked.files.collect()} == {0: (1, None), 1: (2, "wrong type"), 2: (0, "missing part"), 3: (0, "empty")}
    assert sorted((r.ordinal.doc, str(r.end), r.val) for r in checked.rows.collect()) == [
        (0, "2020-12-31", 1.0), (1, "2020-12-31", None), (1, "2021-12-31", 2.0)]


def test_identifier_records(spark):
    rows = [(0, json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple"}, "1": {"cik_str": "12", "ticker": "B", "title": "B"},
                            "2": {"cik_str": "x", "ticker": "C", "title": "C"}, "3": 5, "4": {"ticker": "D"}})), (1, "{}")]
    checked = fc.check_documents(spark.createDataFrame(rows, "k int, value string"), "identifiers", ["k"])
    assert {r.k: (r.n_rows, r.reason) for r in checked.files.collect()} == {0: (2, "wrong type"), 1: (0, "no rows")}
    assert sorted((r.ordinal, r.cik_str, r.ticker) for r in checked.rows.collect()) == [(0, "0000320193", "AAPL"), (1, "0000000012", "B")]


def test_concepts_and_summaries(spark):
    concept = [(0, '{"cik": 1, "tag": "Assets", "units": {"USD": [{"end": "2020-12-31", "val": 1}]}}'), (1, '{"cik": 1, "units": {"EUR": []}}'), (2, '{"cik": 1}')]
    checked = fc.check_documents(spark.createDataFrame(concept, "k int, value string"), "concept", ["k"])
    assert {r.k: (r.n_rows, r.reason) for r in checked.files.collect()} == {0: (1, None), 1: (0, "no rows"), 2: (0, "missing part")}
    report = "<Report><ShortName>{}</ShortName><LongName>{}</LongName><HtmlFileName>R2.htm</HtmlFileName></Report>"
    xml = "<FilingSummary><MyReports>" + report.format("BS", "2 - Statement - BS") + report.format("bs", "3 - Statement - BS") + "</MyReports></FilingSummary>"
    rows = [("a", xml), ("b", xml[:60]), ("c", "<FilingSummary/>"), ("d", "no xml"), ("e", "<FilingSummary><MyReports>" + report.format("x", "Cover") + "</MyReports></FilingSummary>")]
    checked = fc.check_documents(spark.createDataFrame(rows, "k string, value string"), "summary", ["k"])
    assert {r.k: (r.n_rows, r.reason) for r in checked.files.collect()} == {
        "a": (1, None), "b": (0, "malformed"), "c": (0, "missing part"), "d": (0, "malformed"), "e": (0, "no rows")}
    assert [tuple(r) for r in checked.rows.collect()] == [("a", "bs", "R2.htm")]


def test_empty_table_of_documents(spark):
    for kind in fc.KINDS:
        checked = fc.check_documents(spark.createDataFrame([], "k string, value string"), kind, ["k"])
        assert checked.files.count() == checked.errors.count() == checked.rows.count() == 0


LINKS = "ticker string, cik string, n long"


def test_rewriting_a_company_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "links")
    first = spark.createDataFrame([("A", "0000000001", 1), ("A", "0000000001", 2), ("B", "0000000002", 3), ("c/d", "0000000003", 4), (None, None, 5)], LINKS)
    ef.write_links(first.repartition(4), path, partition_by="ticker")
    ef.write_links(first.where("n = 2"), path, partition_by="ticker")
    back = ef.read_links(spark, path, first)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("A", "0000000001", 2), ("B", "0000000002", 3), ("c/d", "0000000003", 4), (None, None, 5)], key=str)
    assert [len(list(f.glob("part-*"))) for f in sorted((tmp_path / "links").glob("ticker=*"))] == [1, 1, 1, 1]
    # its own rows, written back
    ef.write_links(ef.read_links(spark, path, first).where("ticker = 'B'"), path, partition_by="ticker")
    assert ef.read_links(spark, path, first).count() == 4


def test_one_file_a_company_from_many_tasks(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('T', id % 7) AS ticker", "lpad(id % 7, 10, '0') AS cik", "id AS n").repartition(9)
    ef.write_links(df, str(tmp_path / "l"), fmt="parquet", partition_by="ticker")
    assert [len(list(f.glob("part-*"))) for f in (tmp_path / "l").glob("ticker=*")] == [1] * 7
    assert ef.read_links(spark, str(tmp_path / "l"), df, "parquet").count() == 3000


def test_an_existing_table_is_not_replaced_unasked(spark, tmp_path):
    df = spark.createDataFrame([("A", "1", 1)], LINKS)
    ef.write_links(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        ef.write_links(df, str(tmp_path / "t"))
    ef.write_links(df, str(tmp_path / "t"), mode="overwrite")
    assert ef.read_links(spark, str(tmp_path / "t"), df).count() == 1


def test_lost_rows_are_found(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("A", "1", 1), ("A", "1", 2)], LINKS)
    monkeypatch.setattr(ef, "read_links", lambda spark, path, like, fmt="csv": like.limit(1))
    with pytest.raises(RuntimeError, match="2 rows of 'A' became 1"):
        ef.write_links(df, str(tmp_path / "t"), partition_by="ticker")


def test_checked_documents_are_read_once(spark):
    docs = spark.createDataFrame([(1, "{}")], "k int, value string")
    for kind, reads in (("identifiers", 2), ("submissions", 2), ("facts", 2), ("concept", 2), ("summary", 1)):
        checked = fc.check_documents(docs, kind, ["k"])
        for df in (checked.rows, checked.errors, checked.files):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("from_json(") + plan.count("from_xml(") + plan.count("JsonToStructs") + plan.count("XmlToStructs") <= reads, plan


def test_documents_of_orders_use_all_slots(spark):
    from filings_engine.sources import adapters as ad
    slots = spark.sparkContext.defaultParallelism
    for df in (ad.submission_documents(spark, "/root/testdata/sf0.01"), ad.filing_summaries(spark, "/root/testdata/sf0.01")):
        assert df.rdd.getNumPartitions() >= slots
