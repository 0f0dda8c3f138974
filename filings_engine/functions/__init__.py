"""Column-level helpers (built-in Spark expressions only, no Python UDFs)."""

from filings_engine.functions.strings import (  # noqa: F401
    ARCHIVE_BASE, pad_cik, strip_leading_zeros, drop_dashes, archive_url,
    summary_url, after_marker, has_digit, digit_lines, year_pattern, numbers_only,
    display_amount, split_csv,
)
from filings_engine.functions.dates import standardize_statement_date, parse_iso_date  # noqa: F401
from filings_engine.functions.vectors import dot, norm, cosine_relatedness, relatedness_of_cosine  # noqa: F401
