"""Composed jobs that are not registered queries: sink, statement URLs,
multi-step prompts, company fundamentals."""

from pyspark.sql import functions as F

from filings_engine.operators import filters as flt
from filings_engine.operators import prompts as pr
from filings_engine.operators import statements as stm
from filings_engine.operators.html_nodes import html_nodes
from filings_engine.plans import fundamentals as fu
from filings_engine.session import materialize
from filings_engine.plans import summaries as sm
from filings_engine.sources import adapters as ad
from filings_engine.sources import edgar_files as ef
from filings_engine.sources.keys import statement_keys

SF = "/root/testdata/sf0.001"


def test_write_links_keeps_zeros(spark, tmp_path):
    df = spark.createDataFrame([("AAA", "0000000042"), ("BBB", "0000000007")], "ticker string, cik string")
    ef.write_links(df, str(tmp_path / "links"), partition_by="ticker")
    back = spark.read.option("header", True).csv(str(tmp_path / "links" / "ticker=AAA"))
    assert back.first().cik == "0000000042"


def test_statement_urls(spark):
    df = spark.createDataFrame([("0000000042", "0000000042-20-000001", "R2.xml")],
                               "cik string, accessionNumber string, file_name string")
    r = flt.with_statement_url(df).first()
    assert r.statement_url.endswith("/0000000042/000000004220000001/R2.xml")
    assert r.summary_file_url.endswith("/data/42/000000004220000001/FilingSummary.xml") and r.parser == "xml"


def test_multi_step_prompts(spark):
    docs = spark.createDataFrame([(1, "Revenue 10\nno digit", ["EBITDA 5"])], "doc_id long, text string, tables array<string>")
    ctx, first = sm.multi_step_prompts(docs, ["doc_id"])
    assert ctx.first().context == "Revenue 10 EBITDA 5"
    assert first.first().messages[0].content == pr.METRICS_SYSTEM
    answers = spark.createDataFrame([(1, "Revenue, EBITDA")], "doc_id long, content string")
    second = pr.metric_targets_prompts(answers, ctx, ["doc_id"]).first().messages[1].content
    assert second.startswith("Query: For each of these metrics Revenue, EBITDA, please give")
    third = sm.third_step_prompts(ctx, ["doc_id"]).first().messages[1].content
    assert third.startswith("Query Looking at") and third.endswith(" Relevant texts:Revenue 10 EBITDA 5")


def test_company_statements(spark):
    filings = ad.filings(spark, SF)
    summary = ef.parse_filing_summary(ad.filing_summaries(spark, SF), key_cols=["accession"])
    pages = ad.all_statement_pages(spark, SF)
    nodes = materialize(html_nodes(pages, **stm.STATEMENT_NODES), as_table=True)
    values, errors = fu.company_statements(filings, summary, nodes, pages.select("doc_id", "url"),
                                           statement_keys(spark))
    # every statement kind of every latest 10-K has values or one error
    wanted = fu.wanted_statements(filings, summary, statement_keys(spark)).select("cik", "statement")
    got = values.select("cik", "statement").distinct()
    bad = errors.select("cik", "statement")
    assert wanted.exceptAll(got.union(bad)).count() == 0 and got.union(bad).exceptAll(wanted).count() == 0
    assert {r.statement for r in got.select("statement").distinct().collect()} == set(fu.STATEMENTS)
    assert {fu.NO_FILE, fu.NO_PAGE} <= {r.reason for r in errors.collect()}
    v, _ = stm.statement_frame(nodes)
    assert values.count() <= v.count()


def test_company_profile_agrees_with_registered_queries(spark):
    import __spark_entry__ as E
    filings = ad.filings(spark, SF)
    facts = ef.parse_company_facts(ad.company_facts_documents(spark, SF), doc_order="doc_order")
    concept = ef.parse_company_concept(ad.company_concept_documents(spark, SF, "NO"), doc_order="doc_order")
    summary = ef.parse_filing_summary(ad.filing_summaries(spark, SF), key_cols=["accession"])
    pages = ad.all_statement_pages(spark, SF)
    nodes = materialize(html_nodes(pages, **stm.STATEMENT_NODES), as_table=True)
    prof = fu.company_profile(filings, facts, concept, summary, nodes, pages.select("doc_id", "url"),
                              statement_keys(spark))
    annual = prof.annual.withColumn("value", F.round("value", 6))
    expected = E.queries()["annual_facts"](spark, SF)
    assert annual.exceptAll(expected).count() == 0 and expected.exceptAll(annual).count() == 0
    stmts = prof.statements.withColumn("value", F.round("value", 6))
    expected = E.queries()["company_statements"](spark, SF)
    assert stmts.exceptAll(expected).count() == 0 and expected.exceptAll(stmts).count() == 0
    assert prof.facts.count() == E.queries()["facts_dedup"](spark, SF).count()


def test_lite_prompts_keep_line_breaks_of_tables(spark):
    docs = spark.createDataFrame([(1, "a 1\nb 2\nno", ["x 3\ny"])], "doc_id int, text string, tables array<string>")
    content = sm.lite_answer_prompts(docs, ["doc_id"]).first().messages[1].content
    assert content.endswith(" Relevant texts:a 1 b 2 x 3\ny")


def test_reformat_prompts_ask_for_unread_answers(spark):
    parsed = spark.createDataFrame([(1, True, "{}"), (2, False, "raw"), (3, False, None)], "doc_id int, is_json boolean, answer string")
    got = {r.doc_id: r.messages[1].content for r in pr.reformat_prompts(parsed, ["doc_id"]).collect()}
    assert got == {2: "Data:raw", 3: "Data:"}
