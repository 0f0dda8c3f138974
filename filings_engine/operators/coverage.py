"""Coverage and layout of the links table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def filing_coverage(links: DataFrame, start: int, end: int, ticker: str = "ticker",
                    date: str = "filingDate", include: DataFrame | None = None) -> DataFrame:
    """A1: ``(ticker, year, n)`` for every ticker present in ``links`` (or in
    ``include``, a table of requested tickers) and every year of
    [start, end] whose filing count is not exactly one.

    One aggregation per ticker with one conditional count per year: partial
    aggregation runs map-side, so a ticker holding a large share of the rows
    never travels as raw rows."""
    years = list(range(start, end + 1))
    y = F.year(date)
    counts = (links.groupBy(ticker)
              .agg(*[F.count_if(y == yr).alias(f"n{yr}") for yr in years]))
    if include is not None:
        counts = (include.select(ticker).distinct()
                  .join(counts, ticker, "left")
                  .fillna(0, [f"n{yr}" for yr in years]))
    grid = F.array(*[F.struct(F.lit(yr).alias("year"), F.col(f"n{yr}").alias("n")) for yr in years])
    return (counts.select(ticker, F.inline(grid))
            .filter(F.col("n") != 1))


def coverage_alerts(coverage: DataFrame, ticker: str = "ticker") -> DataFrame:
    """A2: per ticker the two alert texts (null when none):
    ``* T: y1, y2`` for missing years and ``* T: y (n files found), ...`` for
    duplicated years, years ascending.  Groups are bounded by the year
    range."""
    missing = F.expr("listagg(CASE WHEN n = 0 THEN CAST(year AS STRING) END, ', ') "
                     "WITHIN GROUP (ORDER BY year)")
    dup = F.expr("listagg(CASE WHEN n > 1 THEN concat(CAST(year AS STRING), ' (', CAST(n AS STRING), "
                 "' files found)') END, ', ') WITHIN GROUP (ORDER BY year)")
    prefix = F.concat(F.lit("* "), F.col(ticker), F.lit(": "))
    return (coverage.groupBy(ticker).agg(missing.alias("_m"), dup.alias("_d"))
            .select(ticker,
                    F.when(F.col("_m") != "", F.concat(prefix, "_m")).alias("missing_alert"),
                    F.when(F.col("_d") != "", F.concat(prefix, "_d")).alias("duplicate_alert")))


def pivot_links(view: DataFrame, years: list[int], on_duplicate: str = "error",
                ticker: str = "Ticker", date: str = "Filing Date", value: str = "File") -> DataFrame:
    """A3: one row per ticker, one column per filing year holding the link.

    ``on_duplicate``: ``'error'`` raises when a (ticker, year) has two
    filings (as a strict pivot does), ``'latest'`` keeps the link of the
    newest filing (ties: greatest link), ``'list'`` keeps all links sorted.
    Cells are pre-aggregated per (ticker, year) with map-side partial
    aggregation before the pivot; the year list is passed explicitly so the
    schema never depends on data."""
    df = view.withColumn("_year", F.year(date)).filter(F.col("_year").isin(years))
    if on_duplicate == "error":
        cell = (df.groupBy(ticker, "_year")
                .agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_v"))
                .withColumn("_v", F.when(F.assert_true(F.col("_n") == 1,
                                                      "two filings for one (ticker, year) in pivot").isNull(),
                                         F.col("_v"))))
    elif on_duplicate == "latest":
        cell = df.groupBy(ticker, "_year").agg(F.max_by(value, F.struct(F.col(date), F.col(value))).alias("_v"))
    elif on_duplicate == "list":
        cell = df.groupBy(ticker, "_year").agg(F.array_sort(F.collect_list(value)).alias("_v"))
    else:
        raise ValueError(f"on_duplicate must be error|latest|list, not {on_duplicate!r}")
    return cell.groupBy(ticker).pivot("_year", years).agg(F.first("_v"))


def first_filing(rich_links: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Per ticker the newest filing (ties by submission order), as the
    first row of each company's block in the links table."""
    cols = [c for c in rich_links.columns if c not in ("ordinal", "id_ordinal")]
    best = F.max_by(F.struct(*cols), F.struct(F.col("filingDate"), -F.col("ordinal")))
    return rich_links.groupBy(ticker).agg(best.alias("_b")).select("_b.*")


def year_options(start: int, end=None) -> "F.Column":
    """O2: the selectable filing years, newest first (``end`` defaults to
    the current year)."""
    last = F.year(F.current_date()) if end is None else F.lit(end)
    return F.reverse(F.sequence(F.lit(start), last))
