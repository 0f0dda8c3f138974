"""String expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values (must equal the filing archive's public layout) ---------
ARCHIVE_BASE = "https://www.sec.gov/Archives/edgar/data/"
SUMMARY_PAGE = "R2.htm"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_cik(c, width: int = 10) -> Column:
    """Left-pad with zeros to ``width``; longer values are kept whole
    (plain ``lpad`` would truncate them)."""
    c = _c(c).cast("string")
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), "0")


def strip_leading_zeros(c) -> Column:
    return F.regexp_replace(_c(c), r"^0+", "")


def drop_dashes(c) -> Column:
    return F.replace(_c(c), F.lit("-"), F.lit(""))


def archive_url(cik, accession, file_name) -> Column:
    """``<archive>/<cik>/<accession without dashes>/<file>``."""
    return F.concat(F.lit(ARCHIVE_BASE), _c(cik), F.lit("/"), drop_dashes(accession),
                    F.lit("/"), _c(file_name))


def summary_url(url) -> Column:
    """Replace the text after the last ``/`` by the summary page name; a URL
    without ``/`` gets ``/<page>`` appended."""
    return F.concat(F.regexp_replace(_c(url), r"/[^/]*$", ""), F.lit("/" + SUMMARY_PAGE))


def after_marker(text, marker: str, n: int = 1) -> Column:
    """Piece ``n`` of ``text`` split on the literal ``marker`` (null when the
    marker occurs fewer than ``n`` times)."""
    return F.get(F.split(_c(text), r"\Q" + marker + r"\E", -1), n)


def has_digit(c) -> Column:
    """Unicode-aware digit test (Arabic-Indic digits count, as in Python)."""
    return _c(c).rlike(r"(?U)\d")


def digit_lines(text) -> Column:
    """Keep only the lines (split on newline) that contain a digit."""
    return F.array_join(F.filter(F.split(_c(text), "\n", -1), lambda x: x.rlike(r"(?U)\d")), "\n")


def year_pattern(year: int = 2024) -> str:
    """Whole-word year, or its two halves separated by one whitespace."""
    y = str(year)
    return rf"(?U)\b{y}\b|\b{y[:2]}\s{y[2:]}\b"


def numbers_only(c) -> Column:
    """Keep ASCII digits and the decimal point."""
    return F.regexp_replace(_c(c), r"[^0-9.]", "")


def display_amount(c) -> Column:
    """Thousands separators; no decimals for integral values, else two."""
    c = _c(c)
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def split_csv(c) -> Column:
    """``' a, b ,c'`` -> ``['A','B','C']`` (split on comma, trim, upper-case)."""
    return F.transform(F.split(_c(c), ",", -1), lambda x: F.upper(F.trim(x)))
