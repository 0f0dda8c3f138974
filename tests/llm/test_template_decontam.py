"""Template matches against a plain Python search."""
import re

import duckdb
from pyspark.sql import functions as F

from filings_engine.llm import template_decontam as T


def plain_words(text):
    t = re.sub(r"([a-zà-ÿ,;] )([A-ZÀ-Þ])", "\\1\x01\\2", text.replace("\x01", " "))
    if re.search("[0-9]", t):
        t = re.sub(r"(\d)([^\W\d_])", r"\1 \2", re.sub(r"(\d)[.,](?=\d)", r"\1", t))
    return [w for w in re.sub(r"[^\w\x01]+|_", " ", t.lower()).split(" ") if w]


def plain_template(words):
    out = []
    for i, w in enumerate(words):
        number = "0" <= w[0] <= "9"
        unit = i and "0" <= words[i - 1][0] <= "9" and w in T.UNITS
        out.append("<name>" if w[0] == "\x01" else "<number>" if number else "<unit>" if unit else w)
    return out


QUESTION = "A train leaves the old station with 40 km to go and Anna waits for it until Anna is tired of 40 trains."


def test_templates(spark):
    for t in [QUESTION, "", "3.5kg of a,b", "x Yb Zc. New one 7 miles", "été, Édith à 5 m"]:
        df = spark.createDataFrame([(t,)], "t string").select(T.words_of(F.col("t")).alias("w"), F.col("t").rlike("[0-9]").alias("d"))
        words = df.first().w
        assert words == plain_words(t), t
        got = df.select(T.template_hashes(F.col("w"), F.col("d"))).first()[0]
        want = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(plain_template(words))], "i int, w string").orderBy("i").select(F.xxhash64("w")).collect()]
        assert got == want, t


def find(spark, texts, items, **kw):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((r.doc_id is None, r.doc_id, r.item_id) for r in T.contaminated(docs, bench, **kw).collect())


def test_reparameterised_questions(spark):
    far = " filler words that stand apart from every question of the set "
    other = QUESTION.replace("40", "75").replace("km", "miles").replace("Anna", "Karl")
    texts = [(1, far + QUESTION + far), (2, far + other), (3, far + other.replace("75 trains", "80 trains").replace("until Karl", "until Eva")),
             (4, far * 4), (5, None), (6, ""), (None, "so. " + QUESTION), (1, far + QUESTION + far), (8, QUESTION.upper()), (9, QUESTION[:40])]
    items = [(7, QUESTION), (3, "  " + QUESTION), (9, None), (10, ""), (11, "1 2 3"), (12, "short but quite clear question")]
    want = [(False, 1, 3), (False, 2, 3), (True, None, 3)]
    for rows in (T.BROADCAST_ROWS, 0):
        got = find(spark, texts, items, broadcast_rows=rows)
        assert sorted(set(got), key=str) == sorted(set(want), key=str)
        assert len(got) == 3
    assert find(spark, [(1, "well, a short but quite clear question it is")], items) == [(False, 1, 12)]
    assert find(spark, texts[:0] or [(1, "")], items) == [] and find(spark, texts, [(1, None)]) == []


def test_keep_clean(spark):
    docs = spark.createDataFrame([(1, QUESTION, 0), (2, "clean", 0), (2, "clean", 0), (None, QUESTION, 0), (None, None, 1)], "doc_id long, text string, at int")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    got = [(r.doc_id, r.text, r["at"]) for r in T.keep_clean(docs, bench).collect()]
    assert sorted(got, key=str) == [(2, "clean", 0), (2, "clean", 0), (None, None, 1)]


def test_against_plain_search(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{d}/benchmark.parquet'").fetchall()
    index, size = {}, {}
    for i, t in items:
        w = plain_template(plain_words(t))
        size[i] = len(w) - T.WINDOW + 1
        for p in range(size[i]):
            if sum(x[0] != "<" for x in w[p:p + T.WINDOW]) >= T.MIN_LITERALS:
                index.setdefault(tuple(w[p:p + T.WINDOW]), []).append((i, p))
    want = set()
    for k, t in docs:
        w, hit = plain_template(plain_words(t)), {}
        for p in range(len(w) - T.WINDOW + 1):
            for i, q in index.get(tuple(w[p:p + T.WINDOW]), ()):
                hit.setdefault(i, set()).add(q)
        want |= {(k, i) for i, q in hit.items() if len(q) >= 0.5 * size[i]}
    got = T.contaminated(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert want and got >= want and len(got - want) <= 0.05 * len(want)


def test_exact_copies_in_changed_case(spark):
    item = QUESTION + " Say, Who Pays, and Where Is Karl, Or Eva, of Rome then?"
    texts = [(1, item.upper()), (2, item.lower()), (3, item.title()), (4, "well, " + item), (5, "plain text about nothing of the kind that the item asks for"), (6, item.swapcase())]
    assert find(spark, texts, [(1, item)], any_case=True) == [(False, i, 1) for i in (1, 2, 3, 4, 6)]
    assert find(spark, texts, [(1, item)], any_case=True, broadcast_rows=0) == [(False, i, 1) for i in (1, 2, 3, 4, 6)]


def test_conflicts_leave_the_other_windows(spark):
    words = " ".join(f"word{c}" for c in "abcdefghijklmnopqrst")
    item = words + " costs 3 coins or 5 coins in the end"
    texts = [(1, item.replace("3", "4").replace("5", "4")), (2, words[:60] + " costs 4 coins or 4 coins in the end"), (None, item.replace("3", "4").replace("5", "4"))]
    assert find(spark, texts, [(1, item)], min_share=0.7) == [(False, 1, 1), (True, None, 1)]
    twice = "so 3 old men of the far west had 3 hats and " + words
    assert find(spark, [(1, twice.replace("3 hats", "7 hats"))], [(1, twice)], min_share=1) == [(False, 1, 1)]
    short = "so 3 old men of the far west had 3 hats"
    assert find(spark, [(1, short.replace("3 hats", "7 hats"))], [(1, short)], min_run=99) == []


def test_dense_windows_and_first_words(spark):
    dense = "Add 3 and 4 then 5 6 7 8 9 10 11 12 or 13 14"
    half = "what is the total of all these numbers 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 10 11 12"
    short, bare = "Paris lies on the river Seine", "1 2 3"
    items = [(1, dense), (2, half), (3, short), (4, bare)]
    texts = [(1, "so: " + dense + " end"), (2, "so: " + half.replace("1 2 3", "1 2 4")), (3, "they say Paris lies on the river Seine"), (4, "1 2 3"), (5, dense.replace(" 8 ", " 80 ")), (6, "in short, Rome lies on the river Tiber")]
    for rows in (T.BROADCAST_ROWS, 0):
        assert find(spark, texts, items, min_run=99, broadcast_rows=rows) == [(False, 1, 1), (False, 2, 2), (False, 3, 3), (False, 6, 3)]
