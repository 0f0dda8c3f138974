"""Date parsing helpers (ANSI-safe: unparsable input becomes null)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: English month abbreviations and names -------------------
MONTHS = [("Jan", "January"), ("Feb", "February"), ("Mar", "March"), ("Apr", "April"),
          ("May", "May"), ("Jun", "June"), ("Jul", "July"), ("Aug", "August"),
          ("Sep", "September"), ("Oct", "October"), ("Nov", "November"), ("Dec", "December")]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Heading layouts in the order they are tried.
HEADING_LAYOUTS = ["MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd", "MM/dd/yyyy"]


def parse_iso_date(c) -> Column:
    """Text or timestamp -> DATE; anything unparsable -> null."""
    return F.try_to_date(_c(c).cast("string"))


def standardize_statement_date(c) -> Column:
    """Statement column heading (``Dec. 31, 2023``, ``Sept. 30, 2022``,
    ``March 31, 2021``) -> DATE.  Whole-word month abbreviations are expanded,
    dots dropped, then the text is parsed by the first layout that fits."""
    s = F.regexp_replace(F.trim(_c(c)), r"\.", "")
    s = F.regexp_replace(s, r"\bSept\b", "Sep")
    for abbr, full in MONTHS:
        if abbr != full:
            s = F.regexp_replace(s, rf"\b{abbr}\b", full)
    return F.coalesce(*[F.try_to_date(s, f) for f in HEADING_LAYOUTS])
