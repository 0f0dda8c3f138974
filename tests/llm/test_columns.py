"""Tables with clashing, dotted and map columns, and without rows, through every operator that returns whole rows."""
import pytest
from pyspark.sql import functions as F

from filings_engine.llm import common, pii, sentence_spans, simhash, template_decontam

EXTRA = ["_key", "_row", "_tag", "_gone", "_text", "key", "row", "doc", "text.b", "a.b", "s", "kind", "end", "hash", "item", "n", "t"]
COPY = "The long river runs through the old town and ends in a cold lake. Nobody who lives there has ever seen it dry."
QUESTION = "a farmer keeps hens in two sheds and sells every egg on the market before noon so how many are left at night"
TEXTS = [COPY, COPY, f"Ask for it at ann.lee@example.com before ten, or call the desk. {COPY}", QUESTION, None, ""]


def table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    df = df.withColumns({f"`{c}`" if "." in c else c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in EXTRA if "." not in c})
    return df.select("*", *[F.col("doc_id").alias(c) for c in EXTRA if "." in c], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))


def operators(spark):
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    return {"keep_first": simhash.keep_first, "redact": pii.redact, "remove_repeats": sentence_spans.remove_repeats,
            "keep_clean": lambda d: template_decontam.keep_clean(d, items)}


@pytest.mark.parametrize("name", ["keep_first", "redact", "remove_repeats", "keep_clean"])
def test_extra_columns(spark, name):
    run, df = operators(spark)[name], table(spark)
    plain = {(r.doc_id, r.text) for r in run(df.select("doc_id", "text")).collect()}
    got = run(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == plain and len(rows) == len(plain)
    assert all(r["_key"] == f"_key{r.doc_id}" and r["a.b"] == r.doc_id and r["m"] == {"k": r.doc_id} for r in rows)
    want = {"keep_first": len(TEXTS) - 2, "redact": len(TEXTS), "remove_repeats": len(TEXTS), "keep_clean": len(TEXTS) - 1}[name]
    assert len(rows) == want


@pytest.mark.parametrize("name", ["keep_first", "redact", "remove_repeats", "keep_clean"])
def test_empty_table(spark, name):
    df = table(spark).where("doc_id < 0")
    got = operators(spark)[name](df)
    assert got.columns == df.columns and got.count() == 0


def test_equal_rows_with_maps_are_one(spark):
    df = table(spark).where("doc_id < 2")
    assert simhash.keep_first(df.unionByName(df)).count() == 1


def test_components_with_a_hub(spark):
    """A hub of 400 links, a chain of 60 nodes and a pair; the chain ends at the hub."""
    links = [(1000, i) for i in range(400)] + [(2000 + i, 2001 + i) for i in range(60)] + [(2060, 1000), (5000, 4999)]
    nodes = sorted({n for e in links for n in e} | {9999})
    got = dict(common.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {n: 4999 if n in (4999, 5000) else 9999 if n == 9999 else 0 for n in nodes}
