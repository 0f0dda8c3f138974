"""The pipeline against the operators' plain versions, stage by stage, and its entry."""
import random

import corpus_pipeline as C
from tests.llm.test_simhash import brute
from filings_engine.llm import line_quality, simhash


def test_stages_on_a_small_corpus(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmn") for _ in range(5))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(8)) for _ in range(n)) + "."
    good = [prose(8) for _ in range(30)]
    junk = ["\n".join(" | ".join(word() + "###" for _ in range(8)) for _ in range(4)) for _ in range(30)]
    item = prose(3)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)] + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)]
    rows += [(200, good[4], "en", "s", 1), (201, prose(2) + " " + item + " " + prose(2), "en", "s", 1), (202, prose(5) + " mail me@here.org now.", "en", "s", 1), (203, None, None, None, None), (204, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, f in C.STAGES:
        docs = f(spark, docs, str(tmp_path)).cache()
        left.append({x.doc_id for x in docs.collect()})
    assert left[0] == {*range(30), 200, 201, 202}
    kept = [x for x in rows if x[0] in left[0]]
    fps = [(x[0], simhash.fingerprint(x[1].encode())) for x in kept]
    assert left[1] == {k for (k, _), c in zip(fps, brute(fps)) if k == c} and 200 not in left[1]
    assert left[2] == left[1] - {201} == left[3] == left[4]
    out = {x.doc_id: x for x in C.run(spark, str(tmp_path)).collect()}
    assert set(out) == left[4] and all(len(x.ids) == 4 * x.n_tokens for x in out.values())
    assert len(C.STAGES) == 5 and line_quality.judge("", ([], []))[-1] is False
