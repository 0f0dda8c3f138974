import pytest

from filings_engine.functions import after_marker, digit_lines
from filings_engine.operators import prompts as pr
from filings_engine.operators import retrieval as rt


def test_chunk_counts_and_code_points(spark):
    texts = [(i, "x" * n) for i, n in enumerate([0, 768, 769, 1024, 1025])] + [(9, "😀" * 800)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    counts = {r.doc_id: r["count"] for r in rt.chunk_text(df).groupBy("doc_id").count().collect()}
    assert [counts.get(i, 0) for i in range(5)] == [0, 1, 2, 2, 2]
    emoji = rt.chunk_text(df.filter("doc_id = 9")).orderBy("chunk_id").collect()
    assert [len(r.chunk) for r in emoji] == [800, 32] and emoji[1].start == 768
    with pytest.raises(ValueError):
        rt.chunk_text(df, size=10, overlap=10)


def test_markers_digits_years(spark):
    df = spark.createDataFrame([("a|M|b|M|c", "x\nline ٣\n", ["t 2024 x", "t 20 24", "t 2023", "none"])],
                               "t string, d string, tabs array<string>")
    r = df.select(after_marker("t", "|M|").alias("a"), after_marker("t", "??").alias("b"),
                  digit_lines("d").alias("d"), rt.filter_table_texts("tabs").alias("k")).first()
    assert r.a == "b" and r.b is None and r.d == "line ٣" and r.k == ["t 2023"]
    ctx = rt.numeric_context(spark.createDataFrame([("no digits", ["t 1"])], "text string, tables array<string>"),
                             tables="tables").first().context
    assert ctx == " t 1"


def test_rank_ties_and_zero_vector(spark):
    ch = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])],
                               "chunk_id long, embedding array<double>")
    got = rt.rank_chunks(ch, [1.0, 0.0], top=4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 3, 4, 2] and got[-1].score is None and got[2].score == 0.0
    assert [r.chunk_id for r in rt.rank_chunks(ch, [1.0, 0.0], top=2).collect()] == [1, 3]


def test_context_and_prompts(spark):
    ranked = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, rank long, chunk string")
    ctx = rt.assemble_context(ranked, ["doc_id"])
    assert ctx.first().context == "a b"
    p = pr.flatten_messages(pr.prompt_rows(ctx, ["doc_id"], question="Q?"), ["doc_id"]).orderBy("turn").collect()
    assert p[0].role == "system" and p[1].content == "Query: Q?\n Relevant texts:a b"


def test_answers(spark):
    ans = spark.createDataFrame([
        (1, 0, "junk"), (1, 1, ' {"CEO name": "X", "Total year comp": 5, "Metrics": ["a", "b"], "CEO name": "Y"} '),
        (2, 0, "junk"), (2, 6, "plain text")], "doc_id long, attempt int, content string")
    parsed = pr.parse_answers(ans, ["doc_id"])
    f = {r.doc_id: r for r in pr.answer_fields(parsed, ["doc_id"]).collect()}
    assert f[1].is_json and f[1].CEO == "Y"                     # repeated key: last value
    assert f[1]["Year Covered"] == "5"                           # 'year' route before 'total'
    assert f[1].Metrics == "a, b" and f[1]["Total Compensation"] == "NA"
    assert f[1].notes == "CEO name: Y.\n Total year comp: 5.\n Metrics: a, b."
    assert not f[2].is_json and f[2].notes == "plain text" and f[2].CEO == "NA"


def test_token_profile(spark):
    df = spark.createDataFrame([("a", "Hello, world!"), ("a", "x")], "g string, text string")
    r = rt.token_profile(df, ["g"]).first()
    assert (r.n_docs, r.total_tokens, r.max_tokens) == (2, 5, 4)


def test_tfidf_scores_rank_term_overlap(spark):
    ch = spark.createDataFrame([(1, 0, "bonus targets revenue"), (1, 1, "nothing here"), (1, 2, "!!!")],
                               "doc_id long, chunk_id long, chunk string")
    s = {r.chunk_id: r.score for r in rt.tfidf_scores(ch, "What were the bonus targets?").collect()}
    assert s[0] > 0 and s[1] == 0.0 and s[2] is None


def test_frequent_terms_change_no_score(spark, monkeypatch):
    chunks = [(i, 0, "the bonus " + " ".join(f"w{(i * k) % 37}" for k in range(1, 9))) for i in range(60)]
    ch = spark.createDataFrame(chunks, "doc_id long, chunk_id long, chunk string")

    def scores():
        return {r.doc_id: round(r.score, 12) for r in rt.tfidf_scores(ch, "the bonus w3 w5").collect()}
    expected = None
    for most in (0, 10, 1000):                  # none, a few, all terms go by broadcast
        monkeypatch.setattr(rt, "FREQUENT_TERMS", most)
        expected = expected or scores()
        assert scores() == expected


def test_answers_beyond_the_json_attempts(spark):
    rows = [(1, 7, '{"a": "x"}'), (2, 1, '{"a": "x"} trailing }'), (2, 2, '{"a": "y"}'), (3, 1, "junk"), (3, 6, '{"a": "x"}'), (4, 1, '{"a": 1}, {"b": 2}'), (5, 1, None)]
    parsed = pr.parse_answers(spark.createDataFrame(rows, "doc_id int, attempt int, content string"), ["doc_id"])
    got = {r.doc_id: (r.is_json, r.answer) for r in parsed.collect()}
    assert got == {1: (False, '{"a": "x"}'), 2: (True, '{"a": "y"}'), 3: (False, '{"a": "x"}'), 4: (False, '{"a": 1}, {"b": 2}'), 5: (False, None)}
    assert pr.parse_answers(spark.createDataFrame(rows, "doc_id int, attempt int, content string"), ["doc_id"], json_attempts=7).where("doc_id = 1").first().is_json


def test_chunks_of_any_overlap(spark):
    text = "".join(chr(97 + i % 26) for i in range(57)) + "\n😀z"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    for size, overlap in ((10, 3), (10, 9), (7, 0), (100, 40)):
        got = [r.chunk for r in rt.chunk_text(df, size=size, overlap=overlap).orderBy("chunk_id").collect()]
        assert got == [text[i:i + size] for i in range(0, len(text), size - overlap)]


KINDS = ['{"a": "[1,2]", "b": [1, [2, "x"], null, true, 1.5], "c": NaN, "d": null}', '{"a": false, "b": {"k": ["it\'s", "say \\"x\\""], "n": null}, "c": -Infinity}',
         '{"a": 12345678901234567890, "b": [], "c": 1.5, "d": "None", "e": [NaN, "NaN", {"p": [true]}]}', '{"a": "x\\ny", "b": ["a, b", "c"], "ceo name": "NaN"}', "{}", '{"a": [1}',
         "NaN", '{"a": nan}', '{"k: v, null": ["q: null, true"]}', '{"a": [["t\\tab", "back\\\\slash"]]}']


def test_values_print_as_python_prints_them(spark):
    import json

    def shown(value):
        return ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    parsed = pr.parse_answers(spark.createDataFrame([(i, 0, t) for i, t in enumerate(KINDS)], "doc_id int, attempt int, content string"), ["doc_id"])
    got = {r.doc_id: (r.is_json, r.notes) for r in pr.answer_fields(parsed, ["doc_id"]).collect()}
    for i, text in enumerate(KINDS):
        try:
            value = json.loads(text)
        except ValueError:
            value = None
        if isinstance(value, dict):
            lines = [f"{k}: {shown(v)}." for k, v in value.items()]
            assert got[i] == (True, "\n ".join(lines) if lines else text), text
        else:
            assert got[i] == (False, text)
