"""Registered queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filings_engine.llm import (bpe_tree, host_reputation, language_id, line_quality, maxscore, periodic_runs, pii, sentence_spans, sharding, simhash,
                                template_decontam, token_alignment, tool_calls)
from filings_engine.llm.common import table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_calls(*tool_calls.calls_of_turns(table(spark, sf_dir, "conversations")), tool_calls.SCHEMAS, every=True)


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(sentence_spans.repeated_sentences(table(spark, sf_dir, "documents")))


def op2_whole_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(sentence_spans.repeated_sentences(table(spark, sf_dir, "documents"), whole=True))


def _spans(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").alias("doc_id"), F.size("sentences").cast("long").alias("n_removed"),
                        F.array_join(F.col("sentences").cast("array<string>"), ",").alias("sentences"), F.col("first_key").alias("first_doc_id"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return host_reputation.judge_urls(pages, host_reputation.readable_share(F.col("html")))


def op5_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True).drop("row")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    found = language_id.identify(docs, language_id.fit_language(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(*pii.detect(table(spark, sf_dir, "documents")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality.judge_lines(docs, line_quality.fit_lines(docs, table(spark, sf_dir, "labels")))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(bpe_tree.encode_texts(table(spark, sf_dir, "documents")))


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digests(token_alignment.align_texts(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.plant_repeats(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_tool_calls, op2_sentence_spans, op2_whole_passages, op3_sharding, op4_url_filter, op5_template_decontam, op6_language_id, op7_pii, op8_simhash_near_dedup, op9_quality_rules, op10_bpe_tree,
    op11_maxscore, op12_token_alignment, op13_periodic_runs)}

_HEX = "".join(f"replace(" for _ in range(16))
_BITS = _HEX + "translate(md5(coalesce(doc_id::varchar, chr(0))), '01', 'gh')" + "".join(
    f", '{'gh'[i] if i < 2 else f'{i:x}'}', '{i:04b}')" for i in (*range(2, 16), 0, 1))

SQL: dict[str, str] = {
    "op2_sentence_spans": f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
     s AS (SELECT doc_id, text, [trim(lower(replace(x, chr(10), ' '))) FOR x IN regexp_extract_all(text, '[^.!?\\n]*[.!?]*\\n*')
                                 IF trim(replace(x, chr(10), ' ')) <> ''] AS l FROM d),
     r AS (SELECT doc_id, text, i, l[i] AS a, l[i + 1] AS b FROM (SELECT *, unnest(range(1, len(l))) AS i FROM s)),
     o AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS first_doc_id FROM r
           WHERE len(string_split(a, ' ')) + len(string_split(b, ' ')) >= {sentence_spans.MIN_WORDS}
           WINDOW w AS (PARTITION BY a, b ORDER BY doc_id NULLS LAST, i)),
     g AS (SELECT doc_id, text, first_doc_id, unnest([i - 1, i]) AS sentence FROM o WHERE nth > 1)
SELECT doc_id, count(DISTINCT sentence) AS n_removed, array_to_string(list_sort(list(DISTINCT sentence)), ',') AS sentences,
       first(first_doc_id ORDER BY sentence, first_doc_id) AS first_doc_id
FROM g GROUP BY doc_id, text""",
    "op3_sharding": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BITS} AS bits, coalesce(strlen(text), 0) AS bytes FROM documents),
     p AS (SELECT r, depth, substr(bits, 1, depth) AS shard, bits, bytes FROM d, range(0, 129) AS t(depth)),
     s AS (SELECT depth, shard, sum(bytes) AS shard_bytes, count(*) AS shard_rows, min(bits) = max(bits) AS alone FROM p GROUP BY ALL),
     f AS (SELECT r, min(depth) AS depth FROM p JOIN s USING (depth, shard) WHERE shard_bytes <= {sharding.LIMIT} OR alone GROUP BY r)
SELECT d.doc_id, s.shard, s.depth::INTEGER AS depth, s.shard_bytes::BIGINT AS shard_bytes, s.shard_rows::BIGINT AS shard_rows,
       s.shard_bytes <= {sharding.LIMIT} AS fits
FROM d JOIN f USING (r) JOIN s ON s.depth = f.depth AND s.shard = substr(d.bits, 1, f.depth)""",
    "op4_url_filter": r"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
     t AS (SELECT *, regexp_replace(html, '(?s)<(?:script|style).*?</(?:script|style)>|<[^>]*>|&[a-z]+;', ' ', 'g') AS txt FROM h),
     g AS (SELECT *, len(regexp_extract_all(txt, '\S+')) AS words, len(regexp_extract_all(txt, '[#*$%|]+')) AS junk FROM t),
     o AS (SELECT page_id, host, path, CASE WHEN words > 0 THEN (junk * 10 < words)::INT END AS good FROM g),
     hosts AS (SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
                      count(good) AS n, coalesce(sum(good), 0) AS good FROM o GROUP BY 1),
     domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
     suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1.0) / (sum(n) + 2) FROM hosts) AS mean FROM hosts GROUP BY ALL),
     s1 AS (SELECT coalesce(STRENGTH, 2) AS s FROM suffixes WHERE n > 0),
     m1 AS (SELECT suffix, (good + s * mean) / (n + s) AS mean FROM suffixes, s1),
     d1 AS (SELECT domain, n, good, mean FROM domains JOIN m1 USING (suffix)),
     s2 AS (SELECT coalesce(STRENGTH, 2) AS s FROM d1 WHERE n > 0),
     m2 AS (SELECT domain, (good + s * mean) / (n + s) AS mean FROM d1, s2),
     h1 AS (SELECT host, n, good, mean FROM hosts JOIN m2 USING (domain)),
     s3 AS (SELECT coalesce(STRENGTH, 2) AS s FROM h1 WHERE n > 0),
     m3 AS (SELECT host, n + s AS w, (good + s * mean) / (n + s) AS m FROM h1, s3),
     b AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (w + 1)) AS bound FROM m3),
     r AS (SELECT page_id, host, path, bound, CASE
             WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
             WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM o JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bound >= 0.8 THEN 'allow' ELSE 'block' END AS verdict, round(bound, 6) AS bound FROM r""".replace(
        "STRENGTH", """greatest(2.0, least(1000.0, CASE
             WHEN sum(mean * (1 - mean) * (n - 1)) > 0 AND sum(n * (good / n - mean) ** 2) > sum(mean * (1 - mean))
             THEN sum(mean * (1 - mean) * (n - 1)) / (sum(n * (good / n - mean) ** 2) - sum(mean * (1 - mean))) - 1 ELSE 1000.0 END))"""),
    "op11_maxscore": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS t FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.t, c.t)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
}
