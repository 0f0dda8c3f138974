import datetime as dt


from filings_engine.functions import standardize_statement_date
from filings_engine.operators import statements as stm
from filings_engine.operators.html_nodes import html_nodes
from filings_engine.sources.keys import statement_keys


def _page(unit, dates, rows):
    head = "".join(f"<th class=\"th\"><div>{d}</div></th>" for d in dates)
    body = ""
    for concept, cells in rows:
        link = (f"<a onclick=\"top.Show.showAR( this, 'defref_{concept}', window );\">x</a>" if concept
                else "<a>x</a>")
        body += f"<tr><td class=\"pl \">{link}</td>{cells}</tr>"
    return (f"<table><tr><th class=\"tl\"><div><strong>BS<br>{unit}</strong></div></th>{head}</tr>"
            f"{body}</table>")




def test_statement_values_and_errors(spark):
    two = ["Dec. 31, 2023", "Sept. 30, 2022"]
    pages = [
        (1, _page("$ in Millions", two, [("us-gaap_A", "<td class=\"nump\">$ 1,2</td><td class=\"num\">(3)</td>"),
                                         ("us-gaap_B", "<td class=\"text\">x</td><td class=\"num\">(3)</td>"),
                                         ("us-gaap_C", "<td class=\"nump\">$ 12</td><td class=\"num\">(3)</td>")])),
        (2, _page("$ in Thousands", two, [("us-gaap_A", "<td class=\"nump\">1</td><td class=\"num\">2</td>"
                                                        "<td class=\"num\">3</td>")])),
        (3, _page("$ in Thousands", two, [("us-gaap_A", "<td class=\"nump\">1.2.3</td>")])),
        (4, _page("$ in Thousands", ["Foo 1, 2020"], [("us-gaap_A", "<td class=\"nump\">1</td>")])),
        (5, _page("$ in Thousands", two, [(None, "<td class=\"nump\">1</td>")])),
        (6, _page("unless otherwise specified", two, [("us-gaap_A", "<td class=\"nump\">1</td><td class=\"num\">2</td>"
                                                                    "<td class=\"num\">3</td>")])),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages] + [(7, "u", None)], "doc_id long, url string, html string")
    values, errors = stm.statement_frame(html_nodes(df, **stm.STATEMENT_NODES), df)
    err = {r.doc_id: r.reason for r in errors.collect()}
    assert err == {2: "more cells than dates", 3: "bad number", 4: "unparsable date", 5: "link without onclick", 7: "empty"}
    v1 = sorted((r.row, r.concept, r.period, r.period_end, r.value) for r in values.filter("doc_id = 1").collect())
    assert v1 == [(0, "us-gaap_A", 0, dt.date(2023, 12, 31), 12000.0), (0, "us-gaap_A", 1, dt.date(2022, 9, 30), -3000.0),
                  (1, "us-gaap_B", 0, dt.date(2023, 12, 31), None), (1, "us-gaap_B", 1, dt.date(2022, 9, 30), -3000.0),
                  (2, "us-gaap_C", 0, dt.date(2023, 12, 31), 12000.0), (2, "us-gaap_C", 1, dt.date(2022, 9, 30), -3000.0)]
    # special-case table: extra cells tolerated, all values null
    assert {r.value for r in values.filter("doc_id = 6").collect()} == {None}
    dd = stm.dedupe_statement_rows(values.filter("doc_id = 1"))
    assert sorted({r.concept for r in dd.collect()}) == ["us-gaap_A", "us-gaap_B"]   # C equals A: dropped


def test_date_standardization(spark):
    df = spark.createDataFrame([("Dec. 31, 2023",), ("Sept. 30, 2022",), ("March 31, 2021",), ("May 1, 2020",),
                                ("bad",)], "t string")
    got = [r.d for r in df.select(standardize_statement_date("t").alias("d")).collect()]
    assert got == [dt.date(2023, 12, 31), dt.date(2022, 9, 30), dt.date(2021, 3, 31), dt.date(2020, 5, 1), None]


def test_match_lowest_priority(spark):
    summary = spark.createDataFrame([("a", "consolidated balance sheets", "R5.htm"), ("a", "balance sheets", "R2.htm"),
                                     ("a", "cover", "R1.htm")], "accession string, short_name string, file_name string")
    got = stm.match_statement_files(summary, statement_keys(spark), ["accession"]).collect()
    assert [(r.statement, r.file_name) for r in got] == [("balance_sheet", "R2.htm")]
    assert statement_keys(spark).count() == 48


def test_unclosed_cells_and_nested_tables(spark):
    page = _page("$ in Millions", ["Dec. 31, 2023", "2022-12-31"],
                 [("us-gaap_A", "<td class=\"nump\">1</td><td class=\"num\">2<table><tr><td>n</td></tr></table></td>")])
    open_page = page.replace("</td>", "").replace("</tr>", "")
    df = spark.createDataFrame([(1, page), (2, open_page)], "doc_id int, html string")
    values, errors = stm.statement_frame(html_nodes(df, url=None, **stm.STATEMENT_NODES), df)
    assert errors.count() == 0
    for i in (1, 2):
        got = sorted((r.concept, r.period, r.value, r.special) for r in values.filter(f"doc_id = {i}").collect())
        assert got == [("us-gaap_A", 0, 1000.0, False), ("us-gaap_A", 1, -2000.0, False)]
