"""XBRL fact jobs: de-duplication, annual/quarterly tables, latest filing
(J3-J5, A4, A5, W1, W2, U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filings_engine.functions import parse_iso_date


def dedupe_facts(facts: DataFrame, keys=("cik", "fact", "end", "val")) -> DataFrame:
    """A5: one row per (cik, fact, end, val): the first met (``ordinal``).

    An aggregation (``min_by`` over the ordinal) instead of a window, so the
    work is combined map-side and a company holding a large share of the
    facts is not sorted in one task."""
    keys = list(keys)
    rest = [c for c in facts.columns if c not in keys]
    return (facts.groupBy(*keys)
            .agg(F.min_by(F.struct(*rest), "ordinal").alias("_r"))
            .select(*keys, "_r.*")
            .select(*facts.columns))


def periodic_facts(facts: DataFrame, filings: DataFrame, form: str, min_days: int | None = None,
                   max_days: int | None = None, dedupe: bool = False) -> DataFrame:
    """A4: mean value per (cik, fact, label, end) over the facts that belong
    to an accession of ``form`` (J3) and whose end date equals a report date
    of such a filing of the same company (J4, independent of J3).
    ``min_days``/``max_days`` bound the days from start to end of facts with a
    duration (a year's and a quarter's value may end on one day); facts
    without a start date, such as balances, stay.

    Both are left-semi joins: the filing side is reduced to distinct keys
    first; Spark sizes them (broadcast when small, else sort-merge).

    ``dedupe`` takes the facts of ``dedupe_facts(facts)``.  The report date join is on
    keys of that, so it goes first and only facts of a report are gathered."""
    f = filings.filter(F.col("form") == form)
    acc = f.select("cik", F.col("accessionNumber").alias("accn")).distinct()
    rep = f.select("cik", parse_iso_date("reportDate").alias("end")).where(F.col("end").isNotNull()).distinct()
    days = F.datediff("end", "start")
    if dedupe:
        read = ["cik", "fact", "label", *(["start"] if (min_days, max_days) != (None, None) else []), "end", "val", "accn", "ordinal"]
        facts = dedupe_facts(facts.select(*read).join(rep, ["cik", "end"], "left_semi"))
    if min_days is not None:
        facts = facts.filter(F.coalesce(days >= min_days, F.lit(True)))
    if max_days is not None:
        facts = facts.filter(F.coalesce(days <= max_days, F.lit(True)))
    sel = facts.join(acc, ["cik", "accn"], "left_semi")
    if not dedupe:
        sel = sel.join(rep, ["cik", "end"], "left_semi")
    return (sel.groupBy("cik", "fact", "label", "end")
            .agg(F.avg("val").alias("value")))


def annual_facts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    return periodic_facts(facts, filings, "10-K")


def quarterly_facts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    return periodic_facts(facts, filings, "10-Q")


def latest_filing_of_form(filings: DataFrame, form: str) -> DataFrame:
    """W1 + W2: per company the first filing of ``form`` in submission order
    (newest): ``(cik, accessionNumber, primaryDocument, reportDate)``.  A
    company without such a filing has no row."""
    f = filings.filter(F.col("form") == form)
    best = F.min_by(F.struct("accessionNumber", "primaryDocument", "reportDate"), "ordinal")
    return f.groupBy("cik").agg(best.alias("_b")).select("cik", "_b.*")


def latest_accession(filings: DataFrame, form: str) -> DataFrame:
    """W1."""
    return latest_filing_of_form(filings, form).select("cik", "accessionNumber")


def latest_document(filings: DataFrame, form: str) -> DataFrame:
    """W2."""
    return latest_filing_of_form(filings, form).select("cik", "primaryDocument")


def to_wide(long: DataFrame, row: str, col: str, value: str, values: list, on_duplicate: str = "error", order: str | None = None) -> DataFrame:
    """Long -> wide (one column per listed ``col`` value).  The list is
    required so the schema never depends on data.

    Two values of one cell: ``'error'`` raises, ``'latest'`` keeps the value of the
    greatest ``order`` (ties: the greatest value), ``'list'`` keeps all, sorted."""
    cells = long.where(F.col(col).isin(values)).groupBy(row, col)
    if on_duplicate == "error":
        one = F.assert_true(F.col("_n") == 1, "two values for one cell of the matrix").isNull()
        cell = cells.agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v")).withColumn("_v", F.when(one, F.col("_v")))
    elif on_duplicate == "latest":
        cell = cells.agg(F.max_by(value, F.struct(*([order] if order else []), value)).alias("_v"))
    elif on_duplicate == "list":
        cell = cells.agg(F.array_sort(F.collect_list(value)).alias("_v"))
    else:
        raise ValueError(f"on_duplicate must be error|latest|list, not {on_duplicate!r}")
    wide = cell.groupBy(row).pivot(col, values).agg(F.first("_v"))
    return long.select(row).distinct().join(wide, row, "left")


def to_long(wide: DataFrame, row: str, name: str = "column", value: str = "value") -> DataFrame:
    """Wide -> long."""
    cols = [c for c in wide.columns if c != row]
    return wide.unpivot(row, cols, name, value)
