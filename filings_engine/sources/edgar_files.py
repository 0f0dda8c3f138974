"""Sources for landed filing files (S1-S6) and the links sink.

Each ``read_*`` reads files with a fixed schema and hands a DataFrame of
raw documents to the matching ``parse_*``; the parsers take any DataFrame
holding the document text, so data landed in tables parses the same way.
Parsing is pure Catalyst (from_json/from_xml + explode): no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filings_engine import schemas as S
from filings_engine.functions import pad_cik
from filings_engine.session import materialize

TEXT = "value"


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``(path, value)``."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col(TEXT)))


# S1 -------------------------------------------------------------------------
def parse_company_identifiers(df: DataFrame, col: str = TEXT) -> DataFrame:
    """Object of records ``{"0": {cik_str, ticker, title}, ...}`` -> rows in
    file order, CIK zero-padded to 10 (never truncated)."""
    m = F.from_json(col, "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    return (df.select(F.posexplode(m).alias("ordinal", "_key", "r"))
            .select(F.col("ordinal").cast("long"), pad_cik("r.cik_str").alias("cik_str"),
                    F.col("r.ticker"), F.col("r.title")))


def read_company_identifiers(spark: SparkSession, path: str) -> DataFrame:
    return parse_company_identifiers(_whole_files(spark, path))


# S2 -------------------------------------------------------------------------
def parse_submissions(df: DataFrame, col: str = TEXT, cik: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``filings.recent`` (a struct of parallel arrays) -> one row per
    filing with its array position as ``ordinal`` (0 = newest); ``keep``: columns of
    the document that every row carries."""
    return submission_rows(df, F.from_json(col, S.SUBMISSIONS_JSON), cik, keep)


def submission_rows(df: DataFrame, d: Column | str, cik: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``parse_submissions`` of documents that are read already (a struct)."""
    d = F.col(d) if isinstance(d, str) else d
    base = df.select(*keep, (F.col(cik) if cik else F.lit(None)).alias("_cik"), d.alias("d"))
    rec = "d.filings.recent"
    zipped = F.arrays_zip(*[F.col(f"{rec}.{f}").alias(f) for f in S.FILING_FIELDS])
    return (base.select(*keep, F.coalesce(pad_cik("d.cik"), pad_cik("_cik")).alias("cik"),
                        F.posexplode(zipped).alias("ordinal", "r"))
            .select(*keep, "cik", F.col("ordinal").cast("long"), *[F.col(f"r.{f}") for f in S.FILING_FIELDS]))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission JSON files; a file without a ``cik`` field takes it from
    its name (``CIK##########.json``)."""
    files = _whole_files(spark, path).withColumn(
        "_file_cik", F.regexp_extract("path", r"CIK(\d+)", 1))
    return parse_submissions(files, cik="_file_cik")


# S3 -------------------------------------------------------------------------
def parse_company_facts(df: DataFrame, col: str = TEXT, doc_order: str | None = None,
                        taxonomy: str = "us-gaap") -> DataFrame:
    """Flatten company facts: fact -> unit -> item, one row per item.

    ``ordinal`` = (document order, fact position, unit position, item
    position) is the order in which the items are met, kept for
    first-wins de-duplication.  The unit is kept (the reference drops it)."""
    return company_fact_rows(df, F.from_json(col, S.COMPANY_FACTS_JSON), doc_order, taxonomy)


def company_fact_rows(df: DataFrame, d: Column | str, doc_order: str | None = None, taxonomy: str = "us-gaap") -> DataFrame:
    """``parse_company_facts`` of documents that are read already (a struct)."""
    d = F.col(d) if isinstance(d, str) else d
    order = F.col(doc_order) if doc_order else F.lit(0).cast("long")
    return (df.select(order.alias("_doc"), d.alias("d"))
            .select("_doc", pad_cik("d.cik").alias("cik"),
                    F.posexplode(F.col("d.facts")[taxonomy]).alias("_fp", "fact", "detail"))
            .select("_doc", "cik", "_fp", "fact", F.col("detail.label").alias("label"),
                    F.posexplode("detail.units").alias("_up", "unit", "items"))
            .select("_doc", "cik", "_fp", "fact", "label", "_up", "unit",
                    F.posexplode("items").alias("_ip", "i"))
            .select("cik", F.lit(taxonomy).alias("taxonomy"), "fact", "label", "unit",
                    F.try_to_date("i.start").alias("start"), F.try_to_date("i.end").alias("end"),
                    F.col("i.val").alias("val"), F.col("i.accn").alias("accn"),
                    F.col("i.form").alias("form"), F.col("i.filed").alias("filed"),
                    F.struct(F.col("_doc").alias("doc"), F.col("_fp").alias("fact_pos"),
                             F.col("_up").alias("unit_pos"), F.col("_ip").alias("item_pos")).alias("ordinal")))


def read_company_facts(spark: SparkSession, path: str, taxonomy: str = "us-gaap") -> DataFrame:
    files = _whole_files(spark, path)
    return parse_company_facts(files, doc_order="path", taxonomy=taxonomy)


# S4 -------------------------------------------------------------------------
def parse_company_concept(df: DataFrame, col: str = TEXT, unit: str = "USD",
                          doc_order: str | None = None) -> DataFrame:
    """One concept's series for one unit: one row per item."""
    return company_concept_rows(df, F.from_json(col, S.COMPANY_CONCEPT_JSON), unit, doc_order)


def company_concept_rows(df: DataFrame, d: Column | str, unit: str = "USD", doc_order: str | None = None) -> DataFrame:
    """``parse_company_concept`` of documents that are read already (a struct)."""
    d = F.col(d) if isinstance(d, str) else d
    order = F.col(doc_order) if doc_order else F.lit(0).cast("long")
    return (df.select(order.alias("_doc"), d.alias("d"))
            .select("_doc", pad_cik("d.cik").alias("cik"), F.col("d.tag").alias("tag"),
                    F.posexplode(F.col("d.units")[unit]).alias("_ip", "i"))
            .select("cik", "tag", F.try_to_date("i.start").alias("start"),
                    F.try_to_date("i.end").alias("end"), F.col("i.val").alias("val"),
                    F.col("i.accn").alias("accn"), F.col("i.form").alias("form"),
                    F.col("i.filed").alias("filed"),
                    F.struct(F.col("_doc").alias("doc"), F.col("_ip").alias("item_pos")).alias("ordinal")))


def read_company_concept(spark: SparkSession, path: str, unit: str = "USD") -> DataFrame:
    return parse_company_concept(_whole_files(spark, path), unit=unit, doc_order="path")


# S5 -------------------------------------------------------------------------
def parse_filing_summary(df: DataFrame, col: str = TEXT, key_cols: list[str] | None = None) -> DataFrame:
    """Filing-summary XML -> ``(*keys, short_name, file_name)`` for statement
    reports: both names present, a non-empty file name (HTML file, else XML
    file) and ``Statement`` (case-sensitive) in the long name.  A short name
    met twice keeps the last file."""
    return filing_summary_rows(df, F.from_xml(col, S.FILING_SUMMARY_XML), key_cols)


def filing_summary_rows(df: DataFrame, x: Column | str, key_cols: list[str] | None = None) -> DataFrame:
    """``parse_filing_summary`` of documents that are read already (a struct).  A document's
    names are dealt out by ``key_cols`` in one row, which later groups by these keys share."""
    keys = key_cols or []
    x = F.col(x) if isinstance(x, str) else x
    places = F.transform(x["MyReports"]["Report"], lambda r, i: F.struct(i.alias("pos"), r.alias("r")))
    named = F.transform(F.filter(places, lambda p: is_statement_report(p["r"])), lambda p: F.struct(
        p["pos"].alias("pos"), F.lower(p["r"]["ShortName"]).alias("short_name"), report_file(p["r"]).alias("file_name")))
    documents = df.select(*keys, named.alias("_named"))
    reports = (documents.repartition(*keys) if keys else documents).select(*keys, F.inline("_named"))
    return reports.groupBy(*keys, "short_name").agg(F.max_by("file_name", "pos").alias("file_name"))


def report_file(report: Column) -> Column:
    return F.coalesce(report["HtmlFileName"], report["XmlFileName"], F.lit(""))


def is_statement_report(report: Column) -> Column:
    return (report["ShortName"].isNotNull() & report["LongName"].isNotNull()
            & (report_file(report) != "") & report["LongName"].contains("Statement"))


def read_filing_summary(spark: SparkSession, path: str) -> DataFrame:
    """Accession taken from the folder name of each FilingSummary.xml."""
    files = _whole_files(spark, path).withColumn(
        "accession", F.regexp_extract("path", r"/(\d{18})/[^/]*$", 1))
    return parse_filing_summary(files, key_cols=["accession"])


# S6 -------------------------------------------------------------------------
#: Declared charsets that are read as one byte a character; all else is UTF-8.
SINGLE_BYTE_CHARSETS = ["iso-8859-1", "latin1", "latin-1", "us-ascii", "windows-1252", "cp1252"]
CHARSET = r"""(?i)charset\s*=\s*["']?([a-z0-9_-]+)"""
CHARSET_BYTES = 2048            # a declaration stands at the start of a page
WINDOWS_CHARSETS = ["windows-1252", "cp1252"]
#: The control characters of ISO-8859-1 and what the Windows charset has in their places.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))


def page_html(content) -> Column:
    """The text of a page's bytes by its declared charset; bytes that are no
    UTF-8 become the replacement character, never an error."""
    c = F.col(content) if isinstance(content, str) else content
    head = F.decode(F.substring(c, 1, CHARSET_BYTES), "ISO-8859-1")
    declared, latin = F.lower(F.regexp_extract(head, CHARSET, 1)), F.decode(c, "ISO-8859-1")
    return (F.when(declared.isin(WINDOWS_CHARSETS), F.translate(latin, CONTROLS, WINDOWS))
            .when(declared.isin(SINGLE_BYTE_CHARSETS), latin).otherwise(F.make_valid_utf8(c.cast("string"))))


def read_filing_html(spark: SparkSession, path: str) -> DataFrame:
    """Landed filing pages: ``(doc_id, url, status, html)``; one file = one
    page, known by its path; a landed page was fetched, so its status is 200.
    Spark's file scan skips files without a byte: they have no row here."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("doc_id"), F.col("path").alias("url"), F.lit(200).alias("status"),
                        page_html("content").alias("html"))


def fetched_pages(pages: DataFrame, status: str = "status") -> DataFrame:
    """Keep only successfully fetched pages (status 200) of a fetch log."""
    return pages.filter(F.col(status) == 200) if status in pages.columns else pages


# S8 -------------------------------------------------------------------------
def write_links(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None,
                mode: str | None = None, check: bool = True) -> None:
    """Write the links table.  All columns stay strings/dates, so CIKs keep
    their leading zeros in CSV.

    ``partition_by='ticker'`` gives one folder per company (the per-company
    tables).  Only the companies in ``df`` are replaced (dynamic partition
    overwrite); the folders of all others stay.  The rows of a company go to one
    task and one file; adaptive execution splits a company beyond its partition
    size into several.  A null and an empty company share Spark's default folder.

    Without ``partition_by`` an existing table is an error unless ``mode`` says
    otherwise.  ``check`` reads the written rows back and compares their number
    per company with ``df``; a difference is an error."""
    company = [partition_by] if partition_by else []
    if check:           # the same rows are counted and written, also if df reads the table that it replaces
        df = materialize(df, as_table=True)
    w = df.hint("rebalance", *company) if company else df
    w = w.write.mode(mode or ("overwrite" if company else "error")).format(fmt)
    if company:
        w = w.partitionBy(*company).option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
    if not check or mode in ("append", "ignore"):
        return
    back = read_links(df.sparkSession, path, df, fmt)
    names = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in company] or [F.lit(None).cast("string").alias("_all")]
    was = df.select(*names).groupBy(*[F.col(x).alias("company") for x in (company or ["_all"])]).agg(F.count("*").alias("rows"))
    now = back.select(*names).groupBy(*[F.col(x).alias("found") for x in (company or ["_all"])]).agg(F.count("*").alias("n"))
    wrong = was.join(now, F.col("company").eqNullSafe(F.col("found")), "left").where(~F.col("rows").eqNullSafe(F.col("n")))
    first = wrong.limit(1).collect()
    if first:
        raise RuntimeError(f"links written to {path}: {first[0].rows} rows of {first[0].company!r} became {first[0].n}")


def read_links(spark: SparkSession, path: str, like: DataFrame, fmt: str = "csv") -> DataFrame:
    """The table of ``write_links`` with the columns and types of ``like``."""
    r = spark.read.schema(like.schema).format(fmt)
    return (r.option("header", True) if fmt == "csv" else r).load(path).select(like.columns)
