"""Fixed schemas (no inference: an absent key must not change a schema)."""

from pyspark.sql.types import (ArrayType, DateType, DoubleType, LongType,
                               MapType, StringType, StructField, StructType)

S = StringType()

# D2/D3 submission index: filings.recent is a struct of parallel arrays
FILING_FIELDS = ["accessionNumber", "filingDate", "reportDate", "form", "fileNumber",
                 "filmNumber", "primaryDocument", "primaryDocDescription"]
SUBMISSIONS_JSON = StructType([
    StructField("cik", S), StructField("name", S),
    StructField("filings", StructType([
        StructField("recent", StructType([StructField(f, ArrayType(S)) for f in FILING_FIELDS]))]))])

# D4 proxy-links table (the fixed output of the links finder)
LINK_COLUMNS = ["ticker", "title", "form", "filingDate", "primaryDocDescription", "doc_url",
                "cik", "accessionNumber", "fileNumber", "filmNumber", "reportDate"]
LINK = StructType([
    StructField(c, DateType() if c in ("filingDate", "reportDate") else S) for c in LINK_COLUMNS])

# D5 company facts
FACT_ITEM = StructType([
    StructField("start", S), StructField("end", S), StructField("val", DoubleType()),
    StructField("accn", S), StructField("fy", LongType()), StructField("fp", S),
    StructField("form", S), StructField("filed", S)])
FACT_DETAIL = StructType([
    StructField("label", S), StructField("description", S),
    StructField("units", MapType(S, ArrayType(FACT_ITEM)))])
COMPANY_FACTS_JSON = StructType([
    StructField("cik", LongType()), StructField("entityName", S),
    StructField("facts", MapType(S, MapType(S, FACT_DETAIL)))])

# D6 company concept
COMPANY_CONCEPT_JSON = StructType([
    StructField("cik", LongType()), StructField("taxonomy", S), StructField("tag", S),
    StructField("label", S), StructField("units", MapType(S, ArrayType(FACT_ITEM)))])

# D7 filing summary (XML)
REPORT = StructType([
    StructField("ShortName", S), StructField("LongName", S),
    StructField("HtmlFileName", S), StructField("XmlFileName", S)])
FILING_SUMMARY_XML = StructType([
    StructField("MyReports", StructType([StructField("Report", ArrayType(REPORT))]))])
