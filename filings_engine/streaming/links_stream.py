"""Q1 as an incremental job: proxy links for submission files as they land.

The reference fetches each company's submission index on request.  Here new
submission files (one JSON per company, ``CIK##########.json``) are picked
up from a landing folder as they arrive, parsed with the same fixed-schema
parser, filtered with the same predicates and joined (stream-static) with
the identifier table; rows are appended to a links table.  Exactly-once
delivery comes from the checkpoint (kept in the shared checkpoint folder).

Coverage (A1) is kept up to date by two chained jobs.  ``distinct_links_stream`` drops
filings that land again within ``delay`` of a landing (state: one key a filing of that
time); its table feeds ``write_counts_stream``, whose state is one count a (ticker,
year).  Every batch writes the changed counts under its own number, so a batch that
runs again replaces itself; ``current_coverage`` reads the newest count of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from filings_engine.operators.filters import conform
from filings_engine.plans.proxy_links import proxy_filings
from filings_engine.schemas import LINK
from filings_engine.session import checkpoint_dir
from filings_engine.sources.edgar_files import parse_submissions


def submission_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000, whole_files: bool = True) -> DataFrame:
    """Streaming filing rows (D3) from submission files, with the time at which each
    landed.  A file is one document, or has one a line (``whole_files=False``)."""
    raw = (spark.readStream.format("text").option("wholetext", whole_files).option("recursiveFileLookup", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(landing_dir)
           .select(F.regexp_extract(F.col("_metadata.file_path"), r"CIK(\d+)", 1).alias("_file_cik"), "value",
                   F.col("_metadata.file_modification_time").alias("landed_at")))
    return parse_submissions(raw, cik="_file_cik", keep=("landed_at",))


def proxy_links_stream(spark: SparkSession, landing_dir: str, identifiers: DataFrame,
                       start_year: int, end_year: int, tickers=None) -> DataFrame:
    """Streaming D4 rows (unsorted: order is a property of a finished table)."""
    return conform(proxy_filings(identifiers, submission_stream(spark, landing_dir), tickers,
                                 start_year, end_year), LINK)


def distinct_links_stream(spark: SparkSession, landing_dir: str, identifiers: DataFrame, start_year: int, end_year: int, tickers=None,
                          delay: str = "30 days", whole_files: bool = True) -> DataFrame:
    """Streaming D4 rows, each filing of a company once however often it lands within
    ``delay`` (the watermark is on the time of landing, so old filings are not late)."""
    rows = proxy_filings(identifiers, submission_stream(spark, landing_dir, whole_files=whole_files), tickers, start_year, end_year)
    return conform(rows.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["ticker", "accessionNumber"]), LINK)


def write_counts_stream(spark: SparkSession, links_path: str, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the number of links of every (ticker, year) of a links table that
    ``write_links_stream`` appends to."""
    links = spark.readStream.schema(StructType([*LINK.fields, StructField("filing_year", IntegerType())])).parquet(links_path)
    counts = links.groupBy("ticker", F.year("filingDate").alias("year")).agg(F.count(F.lit(1)).alias("n"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")
    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def current_coverage(spark: SparkSession, counts_path: str, start: int, end: int) -> DataFrame:
    """A1 from the counts kept so far: ``(ticker, year, n)`` of every year whose
    number of links is not one."""
    counts = spark.read.parquet(counts_path).groupBy("ticker", "year").agg(F.max_by("n", "batch").alias("n"))
    years = [F.max(F.when(F.col("year") == y, F.col("n"))).alias(f"n{y}") for y in range(start, end + 1)]
    grid = F.array(*[F.struct(F.lit(y).alias("year"), F.coalesce(f"n{y}", F.lit(0).cast("long")).alias("n")) for y in range(start, end + 1)])
    return counts.groupBy("ticker").agg(*years).select("ticker", F.inline(grid)).where("n <> 1")


def write_links_stream(links: DataFrame, out_path: str, checkpoint: str | None = None,
                       available_now: bool = True) -> StreamingQuery:
    """Append to a parquet links table partitioned by filing year.  The
    checkpoint defaults to the shared checkpoint folder."""
    spark = links.sparkSession
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/proxy_links"
    w = (links.withColumn("filing_year", F.year("filingDate")).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", ckpt)
         .partitionBy("filing_year").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
