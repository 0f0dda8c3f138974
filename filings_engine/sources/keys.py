"""Statement-name dictionary as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: statement kinds and their report short names, in
# priority order (lower priority wins when a filing has several) -----------
STATEMENT_KEYS = {
    "balance_sheet": [
        "balance sheet",
        "balance sheets",
        "statement of financial position",
        "consolidated balance sheets",
        "consolidated balance sheet",
        "consolidated financial position",
        "consolidated balance sheets - southern",
        "consolidated statements of financial position",
        "consolidated statement of financial position",
        "consolidated statements of financial condition",
        "combined and consolidated balance sheet",
        "condensed consolidated balance sheets",
        "consolidated balance sheets, as of december 31",
        "dow consolidated balance sheets",
        "consolidated balance sheets (unaudited)",
        "balance sheets (parenthetical)",
    ],
    "income_statement": [
        "income statement",
        "income statements",
        "statement of earnings (loss)",
        "statements of consolidated income",
        "consolidated statements of operations",
        "consolidated statement of operations",
        "consolidated statements of earnings",
        "consolidated statement of earnings",
        "consolidated statements of income",
        "consolidated statement of income",
        "consolidated income statements",
        "consolidated income statement",
        "condensed consolidated statements of earnings",
        "consolidated results of operations",
        "consolidated statements of income (loss)",
        "consolidated statements of income - southern",
        "consolidated statements of operations and comprehensive income",
        "consolidated statements of comprehensive income",
        "statements of operations",
    ],
    "cash_flow_statement": [
        "cash flows statement",
        "cash flows statements",
        "statement of cash flows",
        "statements of cash flows",
        "statements of consolidated cash flows",
        "consolidated statements of cash flows",
        "consolidated statement of cash flows",
        "consolidated statement of cash flow",
        "consolidated cash flows statements",
        "consolidated cash flow statements",
        "condensed consolidated statements of cash flows",
        "consolidated statements of cash flows (unaudited)",
        "consolidated statements of cash flows - southern",
    ],
}
# ---------------------------------------------------------------------------


def statement_key_rows() -> list[tuple[str, int, str]]:
    return [(k, i, name.lower()) for k, names in STATEMENT_KEYS.items() for i, name in enumerate(names)]


def statement_keys(spark: SparkSession) -> DataFrame:
    """``(statement, priority, short_name)``: 48 rows, a fixed-size table
    that is always safe to broadcast."""
    return spark.createDataFrame(statement_key_rows(), "statement string, priority int, short_name string")
