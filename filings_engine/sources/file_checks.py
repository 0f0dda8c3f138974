"""Accounts of landed documents (S1-S5): no file vanishes.

``check_documents`` reads a table of documents once per need and gives three
DataFrames: ``files`` with one row per document (its bytes, its number of rows and
the reason why it is not right, or null), ``errors`` with the raw text of those that
have a reason, and ``rows``, the parsed rows of all documents that can be read.  A
document is in ``errors``, or has all its rows in ``rows``, or both: one wrong value
costs that value, not the company.

Reasons:

* ``empty`` - null, or white space only
* ``malformed`` - not one JSON object (cut off, a list, text behind it) or no XML
* ``wrong type`` - a value does not fit the schema; it is null in the rows, a record
  without a usable number is left out
* ``missing part`` - the object that holds the records is absent
* ``unequal arrays`` - the parallel arrays of a submission index differ in length
* ``no rows`` - right, but without a record

Everything is Catalyst expressions on the document, which is read once (once more as
the element of a list if it is JSON): no shuffle but for the last-file-wins rule of
filing summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from filings_engine import schemas as S
from filings_engine.functions import pad_cik
from filings_engine.sources import edgar_files as ef

BROKEN = "_broken"
RECORD = "cik_str string, ticker string, title string, _broken string"


@dataclass
class Checked:
    rows: DataFrame
    errors: DataFrame
    files: DataFrame


def _json(col: Column, schema: StructType) -> Column:
    """The document with the raw text in ``_broken`` if any value does not fit."""
    return F.from_json(col, StructType([*schema.fields, StructField(BROKEN, StringType())]), {"columnNameOfCorruptRecord": BROKEN})


def _elements(col: Column) -> Column:
    """The text as the only element of a list, its members as text: finds text behind the object."""
    return F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<map<string,string>>")


def _root(one: Column) -> Column:
    """The members of the one JSON object that a text is (of its ``_elements``); else null."""
    return F.when(F.size(one) == 1, one[0])


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the columns, worked out once a row: a column that is named often, or
    under a filter, would be read again each time; a generator's is not."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# each kind is read in two steps, ``_one`` and ``_d`` of a document, and then judged by them
def _json_parts(schema: StructType) -> Callable:
    return lambda df, v: _once(df, _one=_elements(v), _d=_json(v, schema))


def _identifier_parts(df: DataFrame, v: Column) -> DataFrame:
    records = F.transform(F.map_values(_root(F.col("_one"))), lambda r: F.from_json(r, RECORD, {"columnNameOfCorruptRecord": BROKEN}))
    return _once(_once(df, _one=_elements(v)), _d=records)


def _summary_parts(df: DataFrame, v: Column) -> DataFrame:
    schema = StructType([*S.FILING_SUMMARY_XML.fields, StructField(BROKEN, StringType())])
    return _once(df, _d=F.from_xml(v, schema, {"columnNameOfCorruptRecord": BROKEN}))


def _identifiers() -> tuple[Column, Column, Column]:
    """(malformed, reason, number of rows) of S1; a record needs a number."""
    records = F.col("_d")
    good = F.size(F.filter(records, _usable))
    return records.isNull(), F.when(good < F.size(records), "wrong type"), good


def _usable(record: Column) -> Column:
    return record[BROKEN].isNull() & F.coalesce(record["cik_str"].rlike("^[0-9]+$"), F.lit(False))


def _submissions() -> tuple[Column, Column, Column]:
    d = F.col("_d")
    arrays = [d["filings"]["recent"][f] for f in S.FILING_FIELDS]
    sizes = F.array_distinct(F.array(*[F.size(a) for a in arrays]))
    reason = (F.when(d[BROKEN].isNotNull(), "wrong type").when(d["filings"]["recent"].isNull(), "missing part")
              .when(F.size(sizes) > 1, "unequal arrays"))
    return _root(F.col("_one")).isNull(), reason, F.greatest(F.lit(0), F.size(arrays[0]))


def _items(units: Column) -> Column:
    return F.aggregate(F.map_values(units), F.lit(0), lambda n, x: n + F.greatest(F.lit(0), F.size(x)))


def _facts(taxonomy: str = "us-gaap") -> tuple[Column, Column, Column]:
    d = F.col("_d")
    facts = d["facts"][taxonomy]
    n = F.aggregate(F.map_values(facts), F.lit(0), lambda n, x: n + F.coalesce(_items(x["units"]), F.lit(0)))
    return _root(F.col("_one")).isNull(), F.when(d[BROKEN].isNotNull(), "wrong type").when(facts.isNull(), "missing part"), n


def _concept(unit: str = "USD") -> tuple[Column, Column, Column]:
    d = F.col("_d")
    reason = F.when(d[BROKEN].isNotNull(), "wrong type").when(d["units"].isNull(), "missing part")
    return _root(F.col("_one")).isNull(), reason, F.size(d["units"][unit])


def _summary() -> tuple[Column, Column, Column]:
    d = F.col("_d")
    reports = d["MyReports"]["Report"]
    kept = F.filter(reports, ef.is_statement_report)
    return (d.isNull() | d[BROKEN].isNotNull(), F.when(reports.isNull(), "missing part"),
            F.size(F.array_distinct(F.transform(kept, lambda r: F.lower(r["ShortName"])))))


def _identifier_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    entry = df.select(*keys, F.posexplode("_d").alias("ordinal", "r"))
    return entry.where(_usable(F.col("r"))).select(*keys, F.col("ordinal").cast("long"), pad_cik("r.cik_str").alias("cik_str"), "r.ticker", "r.title")


#: kind -> (the parts of a document, what it is by them, its rows from (documents with parts, key columns))
KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "identifiers": (_identifier_parts, _identifiers, _identifier_rows),
    "submissions": (_json_parts(S.SUBMISSIONS_JSON), _submissions,
                    lambda df, keys: ef.submission_rows(df, "_d", cik="_file_cik" if "_file_cik" in df.columns else None)),
    "facts": (_json_parts(S.COMPANY_FACTS_JSON), _facts, lambda df, keys: ef.company_fact_rows(df, "_d", doc_order=keys[0] if keys else None)),
    "concept": (_json_parts(S.COMPANY_CONCEPT_JSON), _concept, lambda df, keys: ef.company_concept_rows(df, "_d", doc_order=keys[0] if keys else None)),
    "summary": (_summary_parts, _summary, lambda df, keys: ef.filing_summary_rows(df, "_d", key_cols=keys)),
}


def check_documents(df: DataFrame, kind: str, keys: list[str], col: str = ef.TEXT) -> Checked:
    """Accounts and rows of a table of documents of one kind (a key of ``KINDS``)."""
    parts, describe, rows = KINDS[kind]
    text = F.col(col)
    malformed, wrong, n = describe()
    blank = text.isNull() | (F.regexp_replace(text, r"\s", "") == "")
    df = _once(parts(df, text), _reason=F.when(blank, "empty").when(malformed, "malformed").otherwise(wrong))
    reason = F.col("_reason")
    readable = reason.isNull() | (reason == "wrong type")
    kept = F.when(readable, F.coalesce(F.greatest(F.lit(0), n), F.lit(0))).otherwise(0).cast("long")
    told = (df.select(*keys, text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), kept.alias("n_rows"), reason.alias("reason"))
            .withColumn("reason", F.coalesce("reason", F.when(F.col("n_rows") == 0, "no rows"))))
    return Checked(rows(df.where(readable), keys), told.where("reason IS NOT NULL"), told.drop("text"))


def _same_path(path: Column) -> Column:
    """A path without its differences of notation (slashes, percent signs)."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^([a-z]+):/+", "$1:/")


def read_checked(spark: SparkSession, path: str, kind: str) -> Checked:
    """Accounts and rows of landed files, known by their path.  Spark's scan gives
    no row for files without a byte: they come from its file listing."""
    found = spark.read.text(path, wholetext=True)
    files = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(ef.TEXT))
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "path string")
    seen = files.select(_same_path(F.col("path")).alias("seen"))
    bare = listed.join(seen, _same_path(F.col("path")) == F.col("seen"), "left_anti")
    docs = files.unionByName(bare.withColumn(ef.TEXT, F.lit(None).cast("string")))
    if kind == "submissions":
        docs = docs.withColumn("_file_cik", F.regexp_extract("path", r"CIK(\d+)", 1))
    if kind != "summary":
        return check_documents(docs, kind, ["path"])
    docs = docs.withColumn("accession", F.regexp_extract("path", r"/(\d{18})/[^/]*$", 1))
    return check_documents(docs, kind, ["path", "accession"])
