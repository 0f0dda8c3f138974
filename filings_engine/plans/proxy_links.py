"""Q1 (flagship) and Q5: proxy-statement links for every company and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filings_engine.operators.coverage import first_filing
from filings_engine.operators.filters import (coerce_dates, conform, filter_by_tickers,
                                              filter_filing_years, filter_proxy_forms,
                                              links_view, with_document_url)
from filings_engine.schemas import LINK


def proxy_filings(identifiers: DataFrame, filings: DataFrame, tickers=None,
                  start_year: int = 2019, end_year: int = 2100) -> DataFrame:
    """Q1 before projection: D4 columns plus the identifier ordinal and the
    filing ordinal (kept for ordering and first-row picks).

    Plan: both filters run on the filing scan (pushed below the join), then
    one equi-join on the padded CIK.  The identifier side is not hinted: it
    grows with the number of companies, so Spark/AQE broadcast it only when
    its measured size is under the threshold and fall back to a sort-merge
    join (with skew splitting) otherwise."""
    ids = filter_by_tickers(identifiers, tickers).select(
        F.col("ordinal").alias("id_ordinal"), "cik_str", "ticker", "title")
    f = filter_proxy_forms(filings)
    f = coerce_dates(f, ["filingDate", "reportDate"])
    f = filter_filing_years(f, start_year, end_year)
    j = f.join(ids, f["cik"] == ids["cik_str"]).drop("cik").withColumnRenamed("cik_str", "cik")
    return with_document_url(j)


def find_proxy_filings(identifiers: DataFrame, filings: DataFrame, tickers=None,
                       start_year: int = 2019, end_year: int = 2100,
                       sort: bool = True) -> DataFrame:
    """Q1: the fixed 11-column links table (D4).  Rows are grouped by company
    in identifier order, newest filing first, ties by submission order."""
    rich = proxy_filings(identifiers, filings, tickers, start_year, end_year)
    if sort:
        rich = rich.orderBy("id_ordinal", F.col("filingDate").desc_nulls_last(), "ordinal")
    return conform(rich, LINK)


def single_year_first_filing(identifiers: DataFrame, filings: DataFrame, year: int,
                             tickers=None) -> DataFrame:
    """Q5: per company the newest proxy filing of one year, shown as the
    links view (File, Summary, Ticker, Form, Filing Date)."""
    rich = proxy_filings(identifiers, filings, tickers, year, year)
    return links_view(conform(first_filing(rich), LINK))


def latest_text_per_ticker(rich_links: DataFrame, keep: str = "oldest") -> DataFrame:
    """One link per ticker.  The reference overwrites a per-ticker entry
    while walking the newest-first links, so the oldest filing wins
    (``keep='oldest'``, ties: the later in submission order); ``'newest'``
    keeps the first."""
    if keep == "oldest":
        key = F.struct(F.col("filingDate"), -F.col("ordinal"))
        pick = F.min_by
    elif keep == "newest":
        key = F.struct(F.col("filingDate"), -F.col("ordinal"))
        pick = F.max_by
    else:
        raise ValueError("keep must be 'oldest' or 'newest'")
    cols = [c for c in rich_links.columns]
    return rich_links.groupBy("ticker").agg(pick(F.struct(*cols), key).alias("_l")).select("_l.*")


def proxy_texts(links: DataFrame, documents: DataFrame, marker: str, keep: str = "oldest") -> DataFrame:
    """H6: ``(ticker, doc_url, text, images, tables)``: per ticker one filing
    (A8), the text of its document (``documents``: ``(doc_url, document)`` of
    H5) cut after the marker (P15), its image addresses and table texts; null
    when the page is missing or its fetch failed."""
    from filings_engine.functions.strings import after_marker
    return (latest_text_per_ticker(links, keep).join(documents, "doc_url", "left")
            .select("ticker", "doc_url", after_marker(F.col("document.text"), marker).alias("text"),
                    "document.images", "document.tables"))
