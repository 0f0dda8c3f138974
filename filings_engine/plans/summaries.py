"""Q2-Q4: prompt tables for the filing summaries (the model call itself is
outside Spark: these jobs write one conversation per document, and read the
answers back)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from filings_engine.operators import prompts as pr
from filings_engine.operators import retrieval as rt

# --- fixed values: the lite path's question and system text -------------------
LITE_QUESTION = """What were the bonus targets for the company? This is often reported in some financial metric for the company like EBITDA, Revenue, FCF, but can include other company-specific metrics.

    I would like you to return the following data from the proxy statement above.

    CEO name:
    Year covered:

    Names of metrics used to evaluate performance.

    Total CEO Compensation $:

    Refrain from making any calculations. Only report what is found in the report; if something is not in the report, write NA."""
LITE_SYSTEM = """You are an expert financial analyst. Your task is to help me analyze Schedule 14A files and piece together executive compensation. Return your answer in JSON format return it as a JSON object:
        
        **CEO name**
        **Year covered**
        **Names of metrics used to evaluate performance**
        **Total CEO Compensation $**

        If any information is not found in the provided text, mark it as "NA". Please do not start your response with "json", and instead just return the dictionary. Please only return the data for the CEO."""
METRICS_QUESTION = """What were the metrics used for the bonus targets for the company? This is often reported in some financial metric for the company like EBITDA, Revenue, FCF, but can include other company-specific metrics.

        The metrics are usually reported in the following sections:

        CEO name:
        Year covered:

        Bonus Weight from Financial Metrics:
        Bonus Weight Non-Financial:

        Proxy Target for each metric (single value, in dollars).
        Proxy Actual for each metric (single value, in dollars).

        Financial-Metric Achievement % (one value):
        Non-Financial Achievement % (one value):

        Bonus Payout $:
        Total Compensation $:

        Please only return the names of the metrics used. You should also consolidate them (i.e. FCF and Adjusted FCF should be in one category). Your response should be one sentence with comma separated metrics."""
# -------------------------------------------------------------------------------


def lite_answer_prompts(docs: DataFrame, keys: Sequence[str], text: str = "text", tables: str = "tables",
                        exclude_year: int = 2024) -> DataFrame:
    """Q2: summary page (H5 output: text + tables) -> numeric context
    -> one lite conversation per document, no chunking or ranking."""
    ctx = rt.numeric_context(docs, text, tables, exclude_year, flatten_tables=False)
    return pr.prompt_rows(ctx, keys, "context", LITE_QUESTION, LITE_SYSTEM)


def summary_prompts(docs: DataFrame, keys: Sequence[str], question: str = pr.SUMMARY_QUESTION,
                    text: str = "text", tables: str | None = "tables", top: int = rt.TOP_N_SINGLE, fit: Callable | None = None) -> DataFrame:
    """Q3: numeric context -> chunks -> vectors -> top-n -> context -> one
    conversation per document.  ``fit`` as for ``retrieve_context``."""
    ctx = rt.retrieve_context(rt.numeric_context(docs, text, tables), question, keys, top=top, fit=fit)
    return pr.prompt_rows(ctx, keys, "context", question)


def multi_step_prompts(docs: DataFrame, keys: Sequence[str], text: str = "text",
                       tables: str | None = "tables", fit: Callable | None = None, land: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Q4, first job: the shared context (top 50 for the metrics question)
    and the first conversation.  The second conversation needs the first
    answer: ``pr.metric_targets_prompts(answers, contexts, keys)``; the third
    is ``third_step_prompts``.  ``fit`` as for ``retrieve_context``; ``land`` writes
    the contexts, which all three conversations read."""
    keys = list(keys)
    ctx = rt.retrieve_context(rt.numeric_context(docs, text, tables), METRICS_QUESTION, keys,
                              top=rt.TOP_N_MULTI, fit=fit)
    ctx = land(ctx) if land else ctx
    first = pr.prompt_rows(ctx, keys, "context", METRICS_QUESTION, pr.METRICS_SYSTEM)
    return ctx, first


def third_step_prompts(contexts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q4, third conversation over the same context (no answer needed)."""
    q = F.lit("Query " + THIRD_QUESTION)
    user = F.concat(q, F.lit(pr.CONTEXT_PREFIX), F.col("context"))
    return contexts.select(*keys, pr.conversation(pr.EXTRACT_SYSTEM, user).alias("messages"))


# --- fixed values -------------------------------------------------------------
THIRD_QUESTION = """Looking at the executive compensation data, please fill out the data below:

        CEO name:
        Year covered:

        Bonus Weight from Financial Metrics:
        Bonus Weight Non-Financial:

        Achievement percentage of financial metrics in bonus calculation:
        Achievement percentage of non-financial metrics in bonus calculation:

        Bonus Payout $:
        Total Compensation $:

        Refrain from making any calculations. Only report what is found in the report; if something is not in the report, write NA."""
# -------------------------------------------------------------------------------
