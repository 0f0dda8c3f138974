"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filings_engine.session import checkpoint_dir

#: Rows of one Arrow batch are regrouped to about this many characters, so a
#: Python worker holds a bounded amount of text whatever the row count.
BATCH_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by the session."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(name: str) -> str:
    """A column name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns; columns that hold maps count as their JSON."""
    parts = [(F.col(quoted(f.name)), "map<" in f.dataType.simpleString()) for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if mapped else c for c, mapped in parts])


def boxed(docs: DataFrame, key: str, row: Column) -> DataFrame:
    """(doc, key, row): all columns of ``docs`` in one struct, so that no name among
    them meets a name of the operator's; ``select("doc.*")`` gives them back."""
    return docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), row.alias("row"))


def sample_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows (never over twice that) chosen by the hash of
    ``key``; all rows when there are no more than that."""
    n = df.count()
    if n <= rows:
        return df
    cells = 1_000_000
    share = max(1, round(cells * rows / n))
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(cells)) < share).limit(2 * rows)


def hot_join(rows: DataFrame, stats: DataFrame, key: str, count: str, hot_share: float = 0.005) -> DataFrame:
    """Left join of ``rows`` with one ``stats`` row per ``key`` (``count``: rows
    of that key) that no hot key can stall.

    Keys holding over ``hot_share`` of the rows number at most
    ``1 / hot_share``, so their statistics are broadcast (a proven bound);
    the rows of these keys, and those without a key, then join nothing in the
    shuffled join and are spread over all tasks by their own hash."""
    values = [c for c in stats.columns if c != key]
    stats = cut_lineage(stats.where(F.col(key).isNotNull()))
    total = stats.agg(F.sum(count)).first()[0] or 0
    hot = stats.where(F.col(count) > hot_share * total).select(F.col(key).alias("_hot"), F.struct(*values).alias("_h"))
    cold = stats.where(F.col(count) <= hot_share * total).select(F.col(key).alias("_cold"), F.struct(*values).alias("_c"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    spread = F.when(F.col("_hot").isNull(), F.col(key))
    salt = F.when(spread.isNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0))
    out = out.withColumn("_k", spread).withColumn("_s", salt)
    cold = cold.withColumn("_s0", F.lit(0).cast("long"))
    out = out.join(cold, (F.col("_k") == F.col("_cold")) & (F.col("_s") == F.col("_s0")), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col("_h")[v], F.col("_c")[v]).alias(v) for v in values])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Connected components.  nodes(node), links(a, b) over comparable ids;
    returns (node, component) with the smallest node reachable.

    Each round a node takes the smallest label among its neighbours, hands it to
    the node whose label it held, and takes the label of its label (pointer
    jumping), so the rounds grow with the logarithm of a chain.  Only linked nodes take part;
    aggregation is partial before each shuffle, so a hub ships one row per
    task.  Labels reach the links of a hub, and the members of a large
    component its label, by ``hot_join``.  Labels are checkpointed every round."""
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct())
    label = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l"), F.count("*").alias("degree")).withColumnRenamed("a", "n"))
    while True:
        near = hot_join(both, label.withColumnRenamed("n", "b"), "b", "degree").groupBy("a").agg(F.min("l").alias("m"))
        step = cut_lineage(label.join(near, F.col("n") == F.col("a")).select("n", "l", "degree", F.least("l", "m").alias("m")))
        # the node that gave a label learns of a smaller one next to any node that holds it
        told = step.where("m < l").groupBy(F.col("l").alias("h")).agg(F.min("m").alias("hm"))
        step = cut_lineage(step.join(told, F.col("n") == F.col("h"), "left").select("n", "l", "degree", F.least("m", F.coalesce("hm", "m")).alias("m")))
        held = step.groupBy(F.col("m").alias("j")).agg(F.count("*").alias("held"))
        jump = held.join(step.select("n", F.col("m").alias("jm")), F.col("j") == F.col("n")).select(F.col("j").alias("m"), "jm", "held")
        step = hot_join(step, jump, "m", "held").select("n", "l", "degree", F.least("m", F.coalesce("jm", "m")).alias("m"))
        step = cut_lineage(step)
        changed = step.where("m < l").limit(1).count()
        label = step.select("n", F.col("m").alias("l"), "degree")
        if not changed:
            break
    return nodes.join(label, F.col("node") == F.col("n"), "left").select("node", F.coalesce("l", "node").alias("component"))
