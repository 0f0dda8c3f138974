"""Benchmark decontamination by template windows (DataFrame functions only).

Both sides are canonicalised: punctuation goes, words are lower-cased, and
numbers, names (a capital after a lower-case word, comma or semicolon) and units
(after a number) become typed placeholders.  Every window of ``window`` template
words is hashed; benchmark windows with at least ``MIN_LITERALS`` literal words
are joined with the windows of all documents.  Matches of a document and an item
on one diagonal (document position minus item position) are one placement.  Its
slots are consistent if each filler of the item meets one filler of the document
and the reverse; windows with a slot that conflicts do not count, the others do.  So
a question with other numbers or names is caught, a chance mix of slots is not.  A document is contaminated by an
item if consistent placements cover ``min_share`` of the item's windows or
``min_run`` words.

Windows with fewer literals are searched by their lower-cased words, so a verbatim copy
of them counts; the share is that of all windows or of the template windows alone,
whichever is larger.  An item's first word is searched as a name and as a literal, since
the text before a copy decides which it is there.

Capitals decide what is a name, so a copy in other case has other templates.  With
``any_case`` the lower-cased words themselves are searched as well, by the same windows; the
query and ``keep_clean`` do so.

The benchmark's windows are broadcast only if their counted rows are at most
``broadcast_rows``; beyond that they are landed and joined by shuffle, where
adaptive execution can split a hot window.

Defined results: null or empty texts and items match nothing; items under
``window`` words are one window of their own length; items with fewer than
``MIN_LITERALS`` literal words never match; items of equal canonical text are
reported as the one with the smallest id; rows with a null id, and repeated rows
are judged as one by (id, text); extra columns do not take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from filings_engine.llm.common import boxed, cut_lineage

WINDOW = 8
MIN_LITERALS = 4
MIN_SHARE = 0.5
MIN_RUN = 13
BROADCAST_ROWS = 500_000
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "yards", "miles", "mile", "mg", "g", "kg", "tons", "pounds", "ounces",
         "ml", "l", "liters", "litres", "gallons", "ms", "s", "sec", "seconds", "min", "minutes", "minute", "h", "hours", "hour", "days", "day",
         "weeks", "week", "months", "month", "years", "year", "percent", "dollars", "euros", "cents", "kmh", "mph", "hz", "khz", "mhz", "ghz",
         "kb", "mb", "gb", "tb", "watts", "kw", "volts", "degrees", "meters", "metres", "kilometers", "kilograms", "grams"]
NAME = "\u0001"


def words_of(text: Column) -> Column:
    """Canonical words, names still marked with ``NAME`` and fillers in place."""
    t = F.translate(F.coalesce(text, F.lit("")), NAME, " ")
    t = F.regexp_replace(t, r" (?<=[\p{Ll},;] )(\p{Lu})", " " + NAME + "$1")
    digits = F.regexp_replace(F.regexp_replace(t, r"(\d)[.,](?=\d)", "$1"), r"(\d)(\p{L})", "$1 $2")
    t = F.when(text.rlike("[0-9]"), digits).otherwise(t)
    return F.array_remove(F.split(F.lower(t), r"[^a-z0-9\p{L}\p{M}\p{N}" + NAME + "]+"), "")


def kind_of(word: Column, before: Column) -> Column:
    """Placeholder of a word, or null for a literal one."""
    number = lambda w: w.between("0", "9\uffff")
    return (F.when(word.startswith(NAME), "<name>").when(number(word), "<number>")
            .when(number(before) & word.isin(UNITS), "<unit>"))


def template_hashes(words: Column, digits: Column) -> Column:
    """Hash of each template word.  ``digits``: whether any word may start with one."""
    plain = F.transform(words, lambda w: F.when(w.startswith(NAME), F.xxhash64(F.lit("<name>"))).otherwise(F.xxhash64(w)))
    before = F.concat(F.array(F.lit("")), words)
    full = F.zip_with(words, F.slice(before, 1, F.size(words)), lambda w, b: F.xxhash64(F.coalesce(kind_of(w, b), w)))
    return F.when(digits, full).otherwise(plain)


def plain_hashes(words: Column) -> Column:
    """Hash of each lower-cased word as it stands, apart from those of templates."""
    return F.transform(words, lambda w: F.xxhash64(F.translate(w, NAME, ""), F.lit(1)))


def with_windows(hashed: DataFrame, k: int) -> DataFrame:
    """hashed(.., h, n: size of h) with ``w``: the hashes of all windows of k entries,
    built by doubling.  Each level is a projection of its own, so it is evaluated once;
    entries past the last window are cut off at the end."""
    def level(k: int, df: DataFrame) -> tuple[DataFrame, str]:
        if k == 1:
            return df, "h"
        df, half = level(k // 2 if k % 2 == 0 else k - 1, df)
        other, by = (half, k // 2) if k % 2 == 0 else ("h", k - 1)
        pair = F.zip_with(half, F.slice(other, by + 1, F.col("n")), lambda a, b: F.xxhash64(a, b))
        return df.withColumn(f"w{k}", pair), f"w{k}"

    df, name = level(k, hashed)
    return df.withColumn("w", F.slice(name, 1, F.greatest(F.col("n") - (k - 1), F.lit(0))))


def benchmark_windows(items: DataFrame, key: str, text: str, window: int, any_case: bool) -> DataFrame:
    """(item, at, k, h: word hashes, n_windows, n_open, n_words, fillers, plain, open) of the
    windows to search; ``plain`` ones hold lower-cased words instead of templates, ``open``
    ones (``n_open`` of an item) have enough literals for a template."""
    t = items.select(F.col(key).alias("item"), words_of(F.col(text)).alias("words"),
                     F.col(text).rlike(r"^[^\p{L}\p{M}\p{N}]*\p{Lu}").alias("capital")).where(F.size("words") > 0)
    t = t.groupBy("words").agg(F.min("item").alias("item"), F.bool_or("capital").alias("capital"))
    before = F.concat(F.array(F.lit("")), F.col("words"))
    start = F.col("words")[0]
    turned = F.when(start.startswith(NAME), F.translate(start, NAME, "")).when(F.col("capital"), F.concat(F.lit(NAME), start))
    t = t.select("item", turned.alias("turned"), F.zip_with("words", F.slice(before, 1, F.size("words")), lambda w, b: F.struct(w.alias("w"), kind_of(w, b).alias("kind"))).alias("slots"))
    t = t.withColumn("n", F.size("slots")).withColumn("k", F.least(F.lit(window), F.col("n")))
    literals = lambda part: F.size(F.filter(part, lambda x: x["kind"].isNull()))
    t = t.where(literals(F.col("slots")) >= MIN_LITERALS)
    window_at = lambda at: F.slice("slots", at + 1, F.col("k"))
    ats = F.sequence(F.lit(0), F.col("n") - F.col("k"))
    t = t.withColumn("n_open", F.size(F.filter(ats, lambda a: literals(window_at(a)) >= MIN_LITERALS)))
    t = t.select("item", "turned", "n", "n_open", "k", "slots", F.explode(ats).alias("at"))
    t = t.withColumn("part", window_at(F.col("at")))
    other = F.when((F.col("at") == 0) & F.col("turned").isNotNull(), F.concat(
        F.array(F.struct(F.col("turned").alias("w"), kind_of(F.col("turned"), F.lit("")).alias("kind"))), F.slice("slots", F.lit(2), F.col("k") - 1)))
    t = t.withColumn("other", other)

    def form(part):
        fillers = F.transform(part, lambda x: F.when(x["kind"].isNotNull(), x["w"]))
        template = F.transform(part, lambda x: F.xxhash64(F.coalesce(x["kind"], x["w"])))
        return F.when(literals(F.col(part)) >= MIN_LITERALS, F.struct(F.lit(False).alias("plain"), template.alias("h"), fillers.alias("fillers")))

    dense = literals(F.col("part")) < MIN_LITERALS
    none = F.transform("part", lambda x: F.lit(None).cast("string"))
    plain = F.struct(F.lit(True).alias("plain"), plain_hashes(F.transform("part", lambda x: x["w"])).alias("h"), none.alias("fillers"))
    wanted = F.lit(any_case) | dense | F.coalesce(F.col("other").isNotNull() & (literals(F.col("other")) < MIN_LITERALS), F.lit(False))
    t = t.withColumn("open", ~dense).withColumn("form", F.explode(F.filter(F.array(form("part"), form("other"), F.when(wanted, plain)), lambda x: x.isNotNull())))
    return t.select("item", F.col("n").alias("n_words"), (F.col("n") - F.col("k") + 1).alias("n_windows"), "n_open", "open", "at", "k", "form.*")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, min_share: float = MIN_SHARE, min_run: int = MIN_RUN, broadcast_rows: int = BROADCAST_ROWS,
                 any_case: bool = False) -> DataFrame:
    """(key, item_id, matched_windows, item_windows, longest_run_words, first_word,
    row), one row per contaminated document and item; ``row`` is the hash of the
    text, and first_word the document's word where the earliest placement starts."""
    # the hashing of a short window must agree with the doubling on the documents' side
    known = benchmark_windows(items, item_key, item_text, window, any_case)
    lengths = sorted(r.k for r in known.select("k").distinct().collect())       # at most ``window`` values
    known = known.withColumn("n", F.size("h"))
    sized = [with_windows(known.where(F.col("k") == k), k).withColumn("hash", F.col("w")[0]).select("hash", *known.columns) for k in lengths]
    known = cut_lineage(reduce(DataFrame.unionByName, sized) if sized else known.withColumn("hash", F.lit(0).cast("long")).limit(0))
    plain = known.where("plain").limit(1).count() > 0
    small = known.count() <= broadcast_rows
    index = known.select("item", "at", "k", "hash", "n_words", "n_windows", "n_open", "open", "plain", F.exists("fillers", lambda x: x.isNotNull()).alias("slots"))

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    found = None
    hashed = rows.select("key", F.xxhash64("text").alias("row"), F.col("text").rlike("[0-9]").alias("digits"), words_of(F.col("text")).alias("words"))
    # the plain words follow the template words; a window across both matches nothing
    both = template_hashes(F.col("words"), F.col("digits"))
    both = F.concat(both, plain_hashes(F.col("words"))) if plain else both
    hashed = hashed.select("key", "row", F.size("words").alias("size"), both.alias("h")).withColumn("n", F.size("h"))
    for k in lengths:
        # outer: a plain one infers a filter on the array, which would be built twice for it
        w = with_windows(hashed, k).select("key", "row", "size", F.posexplode_outer("w").alias("pos", "hash"))
        side = index.where(F.col("k") == k).drop("k")
        m = w.join(F.broadcast(side) if small else side, "hash").withColumn("k", F.lit(k))
        found = m if found is None else found.unionByName(m)
    if found is None:
        found = (hashed.select("key", "row", "size", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("hash"))
                 .join(index.drop("k"), "hash").withColumn("k", F.lit(1)).limit(0))
    placed = ["key", "row", "item", "diagonal"]
    found = found.withColumn("pos", F.col("pos") - F.when(F.col("plain"), F.col("size")).otherwise(0)).drop("size", "plain")
    found = cut_lineage(found.withColumn("diagonal", F.col("pos") - F.col("at")).drop("hash").distinct())

    # only placements with slots need the documents' fillers
    open_slots = found.where("slots").select(*placed, "pos", "at", "k")
    if open_slots.limit(1).count():
        wanted = open_slots.select("key", "row").distinct().withColumnRenamed("key", "_key").withColumnRenamed("row", "_row")
        again = rows.withColumn("row", F.xxhash64("text")).join(wanted, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left_semi")
        again = again.dropDuplicates(["key", "row"]).select("key", "row", F.posexplode(words_of(F.col("text"))).alias("p", "doc_filler"))
        items_slots = known.select(F.col("item").alias("_item"), F.col("at").alias("_at"), F.col("k").alias("_k"), F.posexplode("fillers").alias("o", "item_filler")).where("item_filler is not null")
        slots = (open_slots.join(items_slots, (F.col("item") == F.col("_item")) & (F.col("at") == F.col("_at")) & (F.col("k") == F.col("_k")))
                 .select("key", "row", "item", "diagonal", (F.col("pos") + F.col("o")).alias("p"), "item_filler").distinct())
        met = slots.withColumnRenamed("key", "_key").join(again, F.col("_key").eqNullSafe(F.col("key")) & (slots["row"] == again["row"]) & (slots["p"] == again["p"]))
        met = cut_lineage(met.select(F.col("_key").alias("key"), slots["row"], "item", "diagonal", slots["p"], "item_filler", "doc_filler"))
        # a pair of fillers conflicts if one of the two has another partner in the placement
        pairs = met.select(*placed, "item_filler", "doc_filler").distinct()
        partners = [F.count("*").over(Window.partitionBy(*placed, side)) > 1 for side in ("item_filler", "doc_filler")]
        pairs = pairs.withColumn("bad", partners[0]).withColumn("bad", F.col("bad") | partners[1]).where("bad")
        pairs = pairs.select(*[F.col(c).alias(f"_{c}") for c in (*placed, "item_filler", "doc_filler")])
        same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")) & (F.col("item") == F.col("_item")) & (F.col("diagonal") == F.col("_diagonal"))
        bad = met.join(pairs, same & (F.col("item_filler") == F.col("_item_filler")) & (F.col("doc_filler") == F.col("_doc_filler")), "left_semi")
        bad = bad.join(open_slots.select(*[F.col(c).alias(f"_{c}") for c in placed], "k").distinct(), same)
        bad = bad.select(*[F.col(c).alias(f"_{c}") for c in placed], F.explode(F.sequence(F.col("p") - F.col("k") + 1, F.col("p"))).alias("_pos")).distinct()
        found = found.join(bad, same & (F.col("pos") == F.col("_pos")) & F.col("slots"), "left_anti")

    runs = found.groupBy(*placed).agg(F.count_distinct("pos").alias("n"), F.first("k").alias("k"), F.min("pos").alias("pos"))
    longest = runs.groupBy("key", "row", "item").agg(F.max(F.col("n") + F.col("k") - 1).alias("longest_run_words"))
    windows = found.groupBy("key", "row", "item", "n_windows", "n_open", "n_words", "at", "open").agg(F.min("pos").alias("pos"))
    share = windows.groupBy("key", "row", "item", "n_windows", "n_open", "n_words").agg(F.count("*").alias("matched_windows"), F.count_if("open").alias("matched_open"), F.min("pos").cast("long").alias("first_word"))
    longest = longest.select(F.col("key").alias("_key"), F.col("row").alias("_row"), F.col("item").alias("_item"), "longest_run_words")
    out = share.join(longest, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")) & (F.col("item") == F.col("_item")))
    out = out.where((F.col("matched_windows") >= min_share * F.col("n_windows")) |
                    ((F.col("n_open") > 0) & (F.col("matched_open") >= min_share * F.col("n_open"))) | (F.col("longest_run_words") >= min_run))
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "matched_windows", F.col("n_windows").cast("long").alias("item_windows"),
                      F.col("longest_run_words").cast("long").alias("longest_run_words"), "first_word", "row")


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns."""
    hits = contaminated(docs, items, key, text, any_case=True).select(F.col(key).alias("_key"), F.col("row").alias("_row")).distinct()
    whole = boxed(docs, key, F.xxhash64(text))
    return whole.join(hits, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left_anti").select("doc.*")
