"""Projections, filters and predicates over filing tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from filings_engine.functions import (archive_url, parse_iso_date, split_csv,  # noqa: F401
                                      strip_leading_zeros, summary_url)
from filings_engine.functions.strings import after_marker as _after_marker

# --- fixed values: proxy-statement description alternation -----------------
PROXY_DESCRIPTIONS = ["DEF 14A", "PREC14A", "FORM DEF 14A", "FORM PREC14A",
                      "DEFINITIVE PROXY STATEMENT"]
PROXY_FORM_MARKER = "14A"
# display names of the links table
DISPLAY_NAMES = {"doc_url": "File", "ticker": "Ticker", "title": "Company Name",
                 "filingDate": "Filing Date", "form": "Form",
                 "primaryDocDescription": "Document Description", "cik": "CIK",
                 "accessionNumber": "Accession Number", "fileNumber": "File Number",
                 "filmNumber": "Film Number", "reportDate": "Report Date"}
# ---------------------------------------------------------------------------


def normalize_tickers(tickers) -> list[str]:
    """P1 for a driver-side request: ``"aapl, msft"`` or a list -> upper-case,
    trimmed tickers (a request is user input, not data)."""
    if isinstance(tickers, str):
        tickers = tickers.split(",")
    return [t.strip().upper() for t in tickers]


def explode_tickers(df: DataFrame, col: str = "tickers", out: str = "ticker") -> DataFrame:
    """P1 over a column of comma-separated requests: one row per ticker."""
    return df.withColumn(out, F.explode(split_csv(col)))


def filter_by_tickers(identifiers: DataFrame, tickers) -> DataFrame:
    """Identifier rows whose ticker was requested; unknown tickers vanish.

    ``tickers`` is None (all companies), a string/list (a request), or a
    DataFrame with a ``ticker`` column (semi-join; Spark sizes the join)."""
    if tickers is None:
        return identifiers
    if isinstance(tickers, DataFrame):
        req = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
        return identifiers.join(req, "ticker", "left_semi")
    return identifiers.filter(F.col("ticker").isin(normalize_tickers(tickers)))


def lookup_cik(identifiers: DataFrame, requests: DataFrame) -> DataFrame:
    """First CIK (identifier order) of each requested exact ticker, null
    when unknown.  ``requests`` has a ``ticker`` column."""
    first = (identifiers.groupBy("ticker")
             .agg(F.min_by("cik_str", "ordinal").alias("cik")))
    return requests.select("ticker").join(first, "ticker", "left")


def filter_proxy_forms(filings: DataFrame) -> DataFrame:
    """Form contains 14A and the description matches a proxy
    description (case-sensitive; null never matches)."""
    pattern = "|".join(PROXY_DESCRIPTIONS)
    return filings.filter(
        F.col("form").contains(PROXY_FORM_MARKER)
        & F.coalesce(F.col("primaryDocDescription").rlike(pattern), F.lit(False)))


def coerce_dates(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P5: unparsable dates become null."""
    return df.withColumns({c: parse_iso_date(c) for c in cols})


def filter_filing_years(df: DataFrame, start: int, end: int, col: str = "filingDate") -> DataFrame:
    """Date present and its year within [start, end]."""
    return df.filter(F.col(col).isNotNull() & F.year(col).between(start, end))


def with_document_url(df: DataFrame, cik: str = "cik", out: str = "doc_url") -> DataFrame:
    """Archive URL of the primary document; the CIK keeps its zeros."""
    return df.withColumn(out, archive_url(F.col(cik), F.col("accessionNumber"), F.col("primaryDocument")))


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns, absent ones as typed nulls."""
    have = set(df.columns)
    return df.select([(F.col(f.name).cast(f.dataType) if f.name in have
                       else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def links_view(links: DataFrame) -> DataFrame:
    """P9 + P10: display table ``File, Summary, Ticker, Form, Filing Date``."""
    v = links.drop("filmNumber").withColumnsRenamed(DISPLAY_NAMES)
    return v.select("File", summary_url("File").alias("Summary"), "Ticker", "Form", "Filing Date")


def with_summary_url(df: DataFrame, col: str = "File", out: str = "Summary") -> DataFrame:
    """P10."""
    return df.withColumn(out, summary_url(col))


def accessions_of_form(filings: DataFrame, form: str) -> DataFrame:
    """``(cik, reportDate, accessionNumber)`` of one exact form."""
    return filings.filter(F.col("form") == form).select("cik", "reportDate", "accessionNumber")


def company_slices(links: DataFrame, tickers, col: str = "ticker") -> DataFrame:
    """The rows of the requested (normalised) tickers; write with
    ``partitionBy(col)`` for one folder per company."""
    return links.filter(F.col(col).isin(normalize_tickers(tickers)))


def digit_lines(df: DataFrame, col: str = "text", out: str = "digit_text") -> DataFrame:
    """P13."""
    from filings_engine.functions import digit_lines as _dl
    return df.withColumn(out, _dl(col))


def after_marker(df: DataFrame, marker: str, col: str = "text", out: str = "after", n: int = 1) -> DataFrame:
    """Text between the n-th and (n+1)-th marker; null when absent."""
    return df.withColumn(out, _after_marker(col, marker, n))


def with_statement_url(df: DataFrame, cik: str = "cik", accession: str = "accessionNumber",
                       file_name: str = "file_name") -> DataFrame:
    """Statement URL (padded CIK), summary-file URL (CIK without
    leading zeros) and the parser kind chosen by the file suffix."""
    return df.withColumns({
        "statement_url": archive_url(F.col(cik), F.col(accession), F.col(file_name)),
        "summary_file_url": archive_url(strip_leading_zeros(cik), F.col(accession), F.lit("FilingSummary.xml")),
        "parser": F.when(F.col(file_name).endswith(".xml"), "xml").otherwise("html"),
    })
