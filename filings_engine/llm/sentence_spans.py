"""Substring dedup by sliding sentence spans.

A text is cut behind its sentence ends (``.``, ``!``, ``?``, line breaks); pieces that are
only white space are no sentences.  Every run of ``span`` consecutive sentences with at
least ``min_words`` words is hashed (ASCII and other capitals lower-cased, outer blanks
off) and counted over the whole corpus.  Of each run that occurs more than once, the
occurrence with the smallest (id, text hash, position) is the first; the sentences of all
others are removed.  ``span = 2`` is the default since a passage of 50 words that starts and
ends inside sentences may hold only two whole ones.

``whole`` adds to these runs, for every sentence, the shortest run from it on that reaches
the minimum: one long sentence alone, or as many short ones as it takes (at most
``min_words``).  Words are then split at any white space and each letter of a script written
without blanks counts as one.  Still kept are pieces of a sentence that a copy cuts, and the
last sentences of a copied passage if they have under ``min_words`` words together.

Counting is a partial aggregation, so a run that a third of the corpus shares ships one
row per task; only runs that repeat are landed and met again with their occurrences, in a
join whose large partitions adaptive execution can split.

Defined results: null and empty texts have no sentences; null ids come last in the order;
rows equal in id and text count as one document (each keeps its row); an empty table gives
an empty result; a very long text is one array of sentences in the task that reads it;
extra columns, of whatever names, do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filings_engine.llm.common import boxed, cut_lineage, quoted

SPAN = 2
MIN_WORDS = 10
PIECE = r"[^.!?\n]*[.!?]*\n*"
#: Letters of scripts without blanks between words.
DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def pieces(text: Column) -> Column:
    """The text in pieces that join to it again, without those of only blanks."""
    return F.filter(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.trim(F.translate(p, "\n", " ")) != "")


def sentences(docs: DataFrame, key: str, text: str, whole: bool = False) -> DataFrame:
    """(key, row, s: array of sentence hash h and words n)."""
    blanks = lambda x: F.size(F.split(x, " "))
    words = (lambda x: F.greatest(blanks(x), F.size(F.split(x, r"\s+")) + F.regexp_count(x, F.lit(DENSE)))) if whole else blanks
    clean = F.transform(pieces(F.col(text)), lambda p: F.trim(F.translate(F.lower(p), "\n", " ")))
    return (docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), clean.alias("s"))
            .select("key", "row", F.transform("s", lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("n"))).alias("s")))


def runs(docs: DataFrame, key: str, text: str, span: int, min_words: int, whole: bool = False) -> DataFrame:
    """(key, row, at, hash, size) of every run of ``span`` sentences, with ``whole`` also of
    the shortest run from each sentence on."""
    s = sentences(docs, key, text, whole)
    width = max(span, min_words) if whole else span      # a sentence has one word at least
    # with ``whole`` the last runs are shorter than the width: arrays_zip fills up with nulls
    parts = [F.slice("s", i + 1, F.greatest(F.size("s") - (i if whole else span - 1), F.lit(0))) for i in range(width)]
    rows = s.select("key", "row", *[p.alias(f"p{i}") for i, p in enumerate(parts)]).select("key", "row", F.arrays_zip(*[f"p{i}" for i in range(width)]).alias("z"))
    words = lambda z, n: sum((z[f"p{i}"]["n"] for i in range(n)), F.lit(0))
    run = lambda z, n: F.struct(F.xxhash64(*[z[f"p{i}"]["h"] for i in range(n)]).alias("hash"), words(z, n).alias("n"), F.lit(n).alias("size"))
    joined = F.transform("z", lambda z: run(z, span))
    if whole:
        def both(z):
            fixed = F.when(words(z, span) >= min_words, run(z, span))
            shortest = F.lit(None)
            for n in range(width, 0, -1):
                shortest = F.when(words(z, n) >= min_words, run(z, n)).otherwise(shortest)
            return F.array(fixed, F.when(fixed.isNull() | (shortest["size"] != span), shortest))
        joined = F.transform("z", both)
    # outer: a plain one infers a filter on the array, which would be built twice for it
    out = rows.select("key", "row", F.posexplode_outer(joined).alias("at", "r"))
    if whole:
        out = out.select("key", "row", "at", F.explode_outer("r").alias("r"))
    return out.where(F.col("r.n") >= min_words).select("key", "row", "at", "r.hash", "r.size")


def repeated_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """(key, row, sentences: sorted positions, first_key), one row per document
    (key, row) with a sentence to remove; first_key is the document that keeps the
    first of them."""
    found = runs(docs, key, text, span, min_words, whole)
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row").alias("row"), F.col("at").alias("at"))
    again = found.groupBy("hash").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
    again = cut_lineage(again.select("hash", "first"))
    later = found.join(again, "hash").where(place != F.col("first"))
    # rows equal in id and text are one document
    hit = later.select("key", "row", F.col("first.key").alias("first_key"), F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("sentence"))
    return hit.groupBy("key", "row").agg(F.array_sort(F.collect_set("sentence")).alias("sentences"), F.min_by("first_key", F.struct("sentence", "first_key")).alias("first_key"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """``docs`` without the sentences of later repeats, all columns; a text without any
    passes unchanged."""
    gone = repeated_sentences(docs, key, text, span, min_words, whole).select(F.col("key").alias("_key"), F.col("row").alias("_row"), F.col("sentences").alias("_gone"))
    out = boxed(docs, key, F.xxhash64(text)).join(gone, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left")
    old = F.col("doc")[text]
    put = F.when(F.col("_gone").isNull(), old).otherwise(without(old, F.col("_gone")))
    return out.select(F.col("doc").withField(quoted(text), put).alias("doc")).select("doc.*")


def without(text: Column, gone: Column) -> Column:
    """The text without the sentences at the sorted positions ``gone``; the kept
    stretches between them are slices, so the work stays linear."""
    p = pieces(text)
    begin = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g + 1))
    end = F.concat(gone, F.array(F.size(p)))
    return F.array_join(F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(p, a + 1, F.greatest(b - a, F.lit(0))))), "")
