"""Prompt tables and model-answer parsing (L1-L3).

The model call itself happens outside Spark: L1 writes one conversation per
document, the answers come back as a table, L2/L3 read it."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from filings_engine.operators.html import strip

# --- fixed values: default prompt texts ---------------------------------------
ANALYST_SYSTEM = ("You are an expert financial analyst. Your task is to help me analyze Schedule 14A "
                  "files and piece together executive compensation.")
SUMMARY_QUESTION = """What were the bonus targets for the company? This is often reported in some financial metric for the company like EBITDA, Revenue, FCF, but can include other company-specific metrics.

I would like you to return the following data from the proxy statement above.

CEO name:
Year covered:

Bonus Weight from Financial Metrics (total, with a breakdown with each metric):
Bonus Weight Non-Financial:

Proxy Target for each metric (single value, in dollars).
Proxy Actual for each metric (single value, in dollars).
Financial Achievement Percentage for each metric.

Financial-Metric Achievement % (one value):
Non-Financial Achievement % (one value):

Bonus Payout $:
Total Compensation $:

Refrain from making any calculations. Only report what is found in the report; if something is not in the report, write NA. Please only return the data for the CEO."""
METRICS_SYSTEM = (ANALYST_SYSTEM + " Your goal is to return the metrics used for determining the bonus "
                  "of the CEO. There should be 2-4 of them.")
EXTRACT_SYSTEM = ANALYST_SYSTEM + " Your goal is to extract data."
TARGETS_QUESTION = ("For each of these metrics {metrics}, please give me the proxy target and actual "
                    "values. Keep your response as short as possible.")
REFORMAT_SYSTEM = """You are an expert computer scientiest. Your task is to help me extract the following data in JSON format. Return your answer in JSON format return it as a JSON object:
        
        **CEO name**
        **Year covered**
        **Names of metrics used to evaluate performance**
        **Total CEO Compensation $**

        If any information is not found in the provided text, mark it as "NA". Please do not start your response with "json", and instead just return the dictionary."""
DATA_PREFIX = "Data:"
QUERY_PREFIX, CONTEXT_PREFIX = "Query: ", "\n Relevant texts:"
# answer routing: (substring of the lower-cased key, output field); first hit wins
ANSWER_ROUTES = [("ceo name", "CEO"), ("year", "Year Covered"), ("metric", "Metrics"),
                 ("compensation", "Total Compensation"), ("total", "Total Compensation")]
ANSWER_FIELDS = ["CEO", "Year Covered", "Metrics", "Total Compensation"]
MISSING = "NA"
MAX_REFORMAT_ATTEMPTS = 5
# -------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def user_message(query, context, query_prefix: str = QUERY_PREFIX) -> Column:
    """``Query: <query>\\n Relevant texts:<context>``."""
    q = F.lit(query) if isinstance(query, str) else query
    return F.concat(F.lit(query_prefix), q, F.lit(CONTEXT_PREFIX), _c(context))


def conversation(system, user) -> Column:
    """``array<struct<role, content>>``."""
    s = F.lit(system) if isinstance(system, str) else system
    return F.array(F.struct(F.lit("system").alias("role"), s.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def prompt_rows(contexts: DataFrame, keys: Sequence[str], context: str = "context",
                question: str = SUMMARY_QUESTION, system: str = ANALYST_SYSTEM,
                out: str = "messages") -> DataFrame:
    """L1 (single step / lite): one conversation per document."""
    return contexts.select(*keys, conversation(system, user_message(question, context)).alias(out))


def metric_targets_prompts(metric_answers: DataFrame, contexts: DataFrame, keys: Sequence[str],
                           answer: str = "content", context: str = "context",
                           out: str = "messages") -> DataFrame:
    """L1, second step of the multi-step chain: embeds the first answer (the
    metric names) of each document into the question."""
    keys = list(keys)
    j = metric_answers.select(*keys, F.col(answer).alias("_metrics")).join(contexts, keys)
    q = F.replace(F.lit(TARGETS_QUESTION), F.lit("{metrics}"), F.col("_metrics"))
    return j.select(*keys, conversation(EXTRACT_SYSTEM, user_message(q, context)).alias(out))


def reformat_prompts(parsed: DataFrame, keys: Sequence[str], answer: str = "answer", out: str = "messages") -> DataFrame:
    """L1 for answers that are no JSON object (L2 output of the first
    attempts with ``is_json`` false): one conversation that asks for the data of the raw answer."""
    user = F.concat(F.lit(DATA_PREFIX), F.coalesce(_c(answer), F.lit("")))
    return parsed.filter(~F.col("is_json")).select(*keys, conversation(REFORMAT_SYSTEM, user).alias(out))


def flatten_messages(df: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    """``(*keys, turn, role, content)`` rows of a conversation column."""
    return (df.select(*keys, F.posexplode(messages).alias("turn", "m"))
            .select(*keys, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("content")))


STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE"}


def json_object(c) -> Column:
    """The text as ``map<string,variant>`` when it is one JSON object (keys in
    document order, a repeated key is there twice, each value keeps its kind), else
    null.  ``NaN`` and the infinities are numbers, as in Python."""
    c = _c(c)
    # one value and nothing behind it: a list around it holds one element
    one = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<map<string,variant>>", STRICT_JSON)
    return F.when(c.startswith("{") & c.endswith("}") & (F.size(one) == 1), one[0])


#: How Python prints numbers that JSON writes in letters.
LETTER_NUMBERS = {"NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}


def python_repr(json: Column) -> Column:
    """A JSON list or object as Python prints it, at any depth."""
    def token(t: Column) -> Column:
        s = F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
        s = functools.reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")], s)
        double = F.concat(F.lit('"'), s, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))
        words = [(",", ", "), (":", ": "), ("null", "None"), ("true", "True"), ("false", "False")]
        plain = functools.reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), words, t)
        return F.when(t.startswith('"'), F.when(s.contains("'") & ~s.contains('"'), double).otherwise(single)).otherwise(plain)
    return F.array_join(F.transform(F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), F.lit(0)), token), "")


def python_text(text: Column, kind: Column) -> Column:
    """A JSON value (its text, its kind) as Python's ``str`` prints it."""
    out = F.when(kind == "STRING", text).when(text.isNull() | (kind == "VOID"), "None").when(kind == "BOOLEAN", F.initcap(text))
    for written, shown in LETTER_NUMBERS.items():
        out = out.when((kind == "DOUBLE") & (F.btrim(text, F.lit('"')) == written), shown)
    return out.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), python_repr(text)).otherwise(text)


def list_text(text: Column, value: Column) -> Column:
    """The elements of a JSON list, each as Python prints it, joined by ``, ``."""
    items = F.arrays_zip(F.from_json(text, "array<string>", STRICT_JSON).alias("t"),
                         F.try_variant_get(value, "$", "array<variant>").alias("v"))
    return F.array_join(F.transform(items, lambda i: python_text(i["t"], F.coalesce(F.schema_of_variant(i["v"]), F.lit("VOID")))), ", ")


def parse_answers(answers: DataFrame, keys: Sequence[str], attempt: str = "attempt",
                  content: str = "content", json_attempts: int = MAX_REFORMAT_ATTEMPTS) -> DataFrame:
    """L2: per document the first attempt (in attempt order) of the first
    ``json_attempts`` whose stripped text parses as JSON; when none does, the
    raw text of the last attempt (later attempts are plain-text fallbacks and
    never read as JSON).  Every document keeps its row.  Returns
    ``(*keys, is_json, answer)``."""
    keys = list(keys)
    a = answers.select(*keys, attempt, strip(content).alias("_t"))
    ok = json_object("_t").isNotNull() & (F.col(attempt) <= json_attempts)
    first_json = F.min_by(F.when(ok, F.col("_t")), F.when(ok, F.col(attempt)))
    last_raw = F.max_by("_t", attempt)
    return (a.groupBy(*keys).agg(first_json.alias("_j"), last_raw.alias("_r"))
            .select(*keys, F.col("_j").isNotNull().alias("is_json"),
                    F.coalesce("_j", "_r").alias("answer")))


def answer_fields(parsed: DataFrame, keys: Sequence[str], answer: str = "answer") -> DataFrame:
    """L3: each key of the JSON answer as ``key: value.``, printed as Python
    prints the value (elements of a list joined by ``, ``; text that looks like a list
    stays text), all lines joined by newline + space; plus the four routed
    fields (first matching route per key, last key wins per field, ``NA``
    when none).  JSON object keys keep document order."""
    keys = list(keys)
    m = json_object(answer)
    texts = F.from_json(F.when(m.isNotNull(), F.col(answer)), "map<string,string>", STRICT_JSON)
    entries = F.arrays_zip(F.map_keys(m).alias("k"), F.map_values(texts).alias("v"), F.map_values(m).alias("x"))
    kv = parsed.filter("is_json").select(*keys, F.posexplode(entries).alias("pos", "e")).select(*keys, "pos", "e.k", "e.v", "e.x")
    kind = F.coalesce(F.schema_of_variant("x"), F.lit("VOID"))
    is_list = kind.startswith("ARRAY")
    kv = kv.select(*keys, "k", "pos", F.when(is_list, F.col("v")).otherwise(python_text(F.col("v"), kind)).alias("v"),
                   F.when(is_list, list_text(F.col("v"), F.col("x"))).otherwise(python_text(F.col("v"), kind)).alias("text"))
    # a repeated key keeps its first position and its last value (dict semantics)
    kv = kv.groupBy(*keys, "k").agg(F.min("pos").alias("pos"), F.max_by("v", "pos").alias("v"), F.max_by("text", "pos").alias("text"))
    text = F.col("text")
    lk = F.lower("k")
    route = None
    for needle, field in ANSWER_ROUTES:
        route = (F.when(lk.contains(needle), field) if route is None
                 else route.when(lk.contains(needle), field))
    kv = kv.select(*keys, "pos", F.concat(F.col("k"), F.lit(": "), text, F.lit(".")).alias("line"),
                   route.alias("field"),
                   F.when(route == "Metrics", text).otherwise(F.col("v")).alias("value"))
    aggs = [F.expr("listagg(line, '\\n ') WITHIN GROUP (ORDER BY pos)").alias("notes")]
    for field in ANSWER_FIELDS:
        aggs.append(F.coalesce(F.max_by(F.when(F.col("field") == field, F.col("value")),
                                        F.when(F.col("field") == field, F.col("pos"))),
                               F.lit(MISSING)).alias(field))
    fields = kv.groupBy(*keys).agg(*aggs)
    # answers that never parsed keep their raw text as the notes, fields NA
    return (parsed.select(*keys, "is_json", answer).join(fields, keys, "left")
            .select(*keys, "is_json", F.coalesce("notes", answer).alias("notes"),
                    *[F.coalesce(F.col(f"`{f}`"), F.lit(MISSING)).alias(f) for f in ANSWER_FIELDS]))
