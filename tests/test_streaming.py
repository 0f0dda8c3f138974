import json

from filings_engine.plans.proxy_links import find_proxy_filings
from filings_engine.sources.edgar_files import read_submissions
from filings_engine.operators.coverage import filing_coverage
from filings_engine.streaming.links_stream import (current_coverage, distinct_links_stream, proxy_links_stream, write_counts_stream,
                                                   write_links_stream)


def _sub(acc, dates, forms, descs):
    n = len(acc)
    return {"filings": {"recent": {
        "accessionNumber": acc, "filingDate": dates, "reportDate": dates, "form": forms,
        "fileNumber": ["f"] * n, "filmNumber": ["1"] * n, "primaryDocument": [f"d{i}.htm" for i in range(n)],
        "primaryDocDescription": descs}}}


def test_stream_equals_batch(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    (land / "CIK0000000001.json").write_text(json.dumps(_sub(
        ["0000000001-20-000001", "0000000001-19-000002"], ["2020-04-01", "2019-04-01"],
        ["DEF 14A", "10-K"], ["DEF 14A", "DEF 14A"])))
    (land / "CIK0000000002.json").write_text(json.dumps(_sub(
        ["0000000002-21-000003"], ["2021-03-01"], ["PREC14A"], ["PREC14A"])))
    ids = spark.createDataFrame([(0, "0000000001", "AAA", "A"), (1, "0000000002", "BBB", "B")],
                                "ordinal long, cik_str string, ticker string, title string")
    q = write_links_stream(proxy_links_stream(spark, str(land), ids, 2019, 2021), str(tmp_path / "out"),
                           str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted(r.accessionNumber for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = find_proxy_filings(ids, read_submissions(spark, str(land / "*.json")), None, 2019, 2021)
    assert got == sorted(r.accessionNumber for r in batch.collect()) == ["0000000001-20-000001",
                                                                        "0000000002-21-000003"]


def test_coverage_of_files_that_land_twice(spark, tmp_path):
    ids = spark.createDataFrame([(0, "0000000001", "AAA", "A"), (1, "0000000002", "BBB", "B"), (2, "0000000002", "B2", "B")], "ordinal long, cik_str string, ticker string, title string")
    land = tmp_path / "landing"
    first = _sub(["0000000001-20-000001", "0000000001-20-000002"], ["2020-04-01", "2020-05-01"], ["DEF 14A"] * 2, ["DEF 14A"] * 2)
    grown = _sub(["0000000001-21-000009", "0000000001-20-000001", "0000000001-20-000002"], ["2021-02-01", "2020-04-01", "2020-05-01"], ["DEF 14A"] * 3, ["DEF 14A"] * 3)
    second = _sub(["0000000002-21-000003"], ["2021-03-01"], ["PREC14A"], ["PREC14A"])
    for batch, files in enumerate([{"CIK0000000001": first}, {"CIK0000000002": second}, {"CIK0000000001": grown}, {"CIK0000000001": first}]):
        (land / str(batch)).mkdir(parents=True)
        for name, doc in files.items():
            (land / str(batch) / f"{name}.json").write_text(json.dumps(doc))
        links = distinct_links_stream(spark, str(land), ids, 2019, 2021)
        write_links_stream(links, str(tmp_path / "links"), str(tmp_path / "s1")).awaitTermination(120)
        write_counts_stream(spark, str(tmp_path / "links"), str(tmp_path / "counts"), str(tmp_path / "s2")).awaitTermination(120)
        seen = find_proxy_filings(ids, read_submissions(spark, str(land / "*" / "*.json")), None, 2019, 2021).dropDuplicates(["ticker", "accessionNumber"])
        want = sorted(map(tuple, filing_coverage(seen, 2019, 2021).collect()))
        assert sorted(map(tuple, current_coverage(spark, str(tmp_path / "counts"), 2019, 2021).collect())) == want and want
