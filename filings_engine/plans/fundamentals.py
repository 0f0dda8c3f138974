"""company fundamentals for every company at once.

The reference fetches, per ticker, the latest filing of a form, its filing
summary, three statement pages, the company facts (three times) and one
concept series.  Here each input is a table of landed documents and every
step is a join, so all companies are processed in one plan; the fact table
is materialised once and shared by the three fact outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from filings_engine.functions import archive_url
from filings_engine.operators import facts as fx
from filings_engine.operators import statements as stm
from filings_engine.session import materialize


#: Statement kinds of the bundle, and the reasons a kind has no page.
STATEMENTS = ["balance_sheet", "income_statement", "cash_flow_statement"]
NO_FILE, NO_PAGE = "no statement file", "no page"


def wanted_statements(filings: DataFrame, summary_files: DataFrame, keys: DataFrame, form: str = "10-K") -> DataFrame:
    """``(cik, statement, url)``: every statement kind of each company's latest
    filing of ``form``; the address is null when the filing summary names no
    file for it."""
    latest = fx.latest_filing_of_form(filings, form).withColumn(
        "accession", F.replace(F.col("accessionNumber"), F.lit("-"), F.lit("")))
    files = stm.match_statement_files(summary_files, keys, ["accession"])
    kinds = latest.select("cik", "accessionNumber", "accession", F.explode(F.array(*[F.lit(s) for s in STATEMENTS])).alias("statement"))
    return kinds.join(files, ["accession", "statement"], "left").select(
        "cik", "statement", archive_url(F.col("cik"), F.col("accessionNumber"), F.col("file_name")).alias("url"))


def company_statements(filings: DataFrame, summary_files: DataFrame, statement_nodes: DataFrame,
                       statement_pages: DataFrame, keys: DataFrame, form: str = "10-K",
                       wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """statements of each company's latest filing of ``form``.  Pass the
    nodes of the pages of interest (pages of other filings only cost work).

    ``summary_files``: S5 output ``(accession, short_name, file_name)``
    (accession without dashes); ``statement_nodes``: H1 nodes of the
    statement pages; ``statement_pages``: ``(doc_id, url)`` of those pages.
    Returns ``(values, errors)`` keyed by ``(cik, statement)``; every wanted
    statement is in one of the two, also one without a file or a page.
    ``wanted``: the result of ``wanted_statements`` where the caller has it."""
    wanted = wanted_statements(filings, summary_files, keys, form) if wanted is None else wanted
    docs = wanted.join(statement_pages.select("url", "doc_id"), "url", "left")
    # the page -> (company, statement) mapping is applied to the outputs, so
    # the statement branches do not each re-derive it
    values, errors = stm.statement_frame(statement_nodes, statement_pages)
    values = stm.dedupe_statement_rows(values)
    unread = docs.join(errors, "doc_id", "left").select(
        "cik", "statement", F.when(F.col("url").isNull(), NO_FILE).when(F.col("doc_id").isNull(), NO_PAGE)
        .otherwise(F.col("reason")).alias("reason"))
    return (docs.select("cik", "statement", "doc_id").join(values, "doc_id").drop("doc_id"),
            unread.filter(F.col("reason").isNotNull()))


@dataclass
class CompanyProfile:
    """the bundle, as DataFrames sharing ``cik`` (no nested frames)."""
    facts: DataFrame
    annual: DataFrame
    quarterly: DataFrame
    statements: DataFrame
    statement_errors: DataFrame
    assets: DataFrame


def company_profile(filings: DataFrame, facts: DataFrame, concept: DataFrame, summary_files: DataFrame,
                    statement_nodes: DataFrame, statement_pages: DataFrame, keys: DataFrame,
                    form: str = "10-K", wanted: DataFrame | None = None) -> CompanyProfile:
    """F6 for all companies.  The de-duplicated facts are written once to
    the shared checkpoint folder and read by the three fact outputs."""
    deduped = materialize(fx.dedupe_facts(facts), as_table=True)
    values, errors = company_statements(filings, summary_files, statement_nodes, statement_pages, keys, form, wanted)
    return CompanyProfile(deduped, fx.annual_facts(deduped, filings), fx.quarterly_facts(deduped, filings),
                          values, errors, concept)
