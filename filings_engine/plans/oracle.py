"""Independent DuckDB SQL for each registered query (the correctness gate).

The views ``customer``, ``orders``, ... are registered by the checker.  The
adapter mappings are restated here in SQL, not imported from the Spark code.
"""

from __future__ import annotations


def pad(expr: str, n: int = 10) -> str:
    """Zero-pad to n, never truncating."""
    v = f"CAST({expr} AS VARCHAR)"
    return f"(CASE WHEN length({v}) >= {n} THEN {v} ELSE lpad({v}, {n}, '0') END)"

IDENTIFIERS = f"""identifiers AS (
  SELECT c_custkey AS id_ordinal,
         {pad('c_custkey')} AS cik_str,
         'T' || CAST(c_custkey AS VARCHAR) AS ticker, c_name AS title
  FROM customer)"""

FILINGS = f"""filings AS (
  SELECT {pad('o_custkey')} AS cik,
         o_orderkey, CAST(o_orderdate AS DATE) AS odate,
         {pad('o_orderkey')}
           || '-' || strftime(o_orderdate, '%y') || '-' || {pad('o_orderkey % 1000000', 6)}
           AS accessionNumber,
         CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filingDate,
         strftime(o_orderdate, '%Y-%m-%d') AS reportDate,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'DEF 14A' WHEN '2' THEN 'PREC14A' WHEN '3' THEN '10-K'
              WHEN '4' THEN '10-Q' WHEN '5' THEN 'DEFA14A' END AS form,
         '001-' || {pad('o_custkey % 100000', 5)} AS fileNumber,
         CAST(o_orderkey AS VARCHAR) AS filmNumber,
         'd' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primaryDocument,
         CASE o_orderstatus WHEN 'F' THEN 'FORM DEF 14A' WHEN 'O' THEN 'DEFINITIVE PROXY STATEMENT' END
           AS primaryDocDescription
  FROM orders)"""

LINKS = f"""WITH {IDENTIFIERS}, {FILINGS},
links AS (
  SELECT i.ticker, i.title, f.form, TRY_CAST(f.filingDate AS DATE) AS filingDate, f.primaryDocDescription,
         'https://www.sec.gov/Archives/edgar/data/' || i.cik_str || '/' || replace(f.accessionNumber, '-', '')
           || '/' || f.primaryDocument AS doc_url,
         i.cik_str AS cik, f.accessionNumber, f.fileNumber, f.filmNumber,
         TRY_CAST(f.reportDate AS DATE) AS reportDate, i.id_ordinal, f.o_orderkey, f.odate
  FROM filings f JOIN identifiers i ON f.cik = i.cik_str
  WHERE f.form LIKE '%14A%'
    AND coalesce(regexp_matches(f.primaryDocDescription,
        'DEF 14A|PREC14A|FORM DEF 14A|FORM PREC14A|DEFINITIVE PROXY STATEMENT'), false)
    AND TRY_CAST(f.filingDate AS DATE) IS NOT NULL
    AND year(TRY_CAST(f.filingDate AS DATE)) BETWEEN 1996 AND 1999)"""

LINK_COLS = ("ticker, title, form, filingDate, primaryDocDescription, doc_url, cik, accessionNumber, "
             "fileNumber, filmNumber, reportDate")

VIEW = """SELECT doc_url AS "File", regexp_replace(doc_url, '/[^/]*$', '') || '/R2.htm' AS "Summary",
       ticker AS "Ticker", form AS "Form", filingDate AS "Filing Date" FROM links"""

COVERAGE = f"""{LINKS},
grid AS (SELECT t.ticker, y.year FROM (SELECT DISTINCT ticker FROM links) t
         CROSS JOIN (SELECT range AS year FROM range(1996, 2000)) y),
cnt AS (SELECT ticker, year(filingDate) AS year, count(*) AS n FROM links GROUP BY ALL),
cov AS (SELECT g.ticker, CAST(g.year AS INTEGER) AS year, coalesce(c.n, 0) AS n
        FROM grid g LEFT JOIN cnt c ON c.ticker = g.ticker AND c.year = g.year
        WHERE coalesce(c.n, 0) <> 1)"""

FACT_LINES = f"""fl AS (
  SELECT {pad('o_custkey')} AS cik, 'us-gaap' AS taxonomy, l_returnflag || l_linestatus AS fact,
         'Label ' || l_returnflag || l_linestatus AS label, 'USD' AS unit,
         CASE WHEN l_linenumber % 2 = 1 THEN CAST(o_orderdate AS DATE) END AS start,
         CASE WHEN l_linenumber % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(l_shipdate AS DATE) END AS "end",
         l_quantity AS val,
         {pad('o_orderkey')} || '-' || strftime(o_orderdate, '%y') || '-' || {pad('o_orderkey % 1000000', 6)} AS accn,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'DEF 14A' WHEN '2' THEN 'PREC14A' WHEN '3' THEN '10-K'
              WHEN '4' THEN '10-Q' WHEN '5' THEN 'DEFA14A' END AS form,
         strftime(o_orderdate, '%Y-%m-%d') AS filed,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FACT_COLS = 'cik, taxonomy, fact, label, unit, start, "end", val, accn, form, filed'

DEDUP = f"""{FACT_LINES},
dd AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY cik, fact, "end", val
                                ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                         start NULLS FIRST, "end" NULLS FIRST, val NULLS FIRST) = 1)"""


def periodic(form: str) -> str:
    return f"""WITH {FILINGS}, {DEDUP},
      ff AS (SELECT cik, accessionNumber, TRY_CAST(reportDate AS DATE) AS rd FROM filings WHERE form = '{form}')
      SELECT cik, fact, label, "end", round(avg(val), 6) AS value FROM dd
      WHERE EXISTS (SELECT 1 FROM ff WHERE ff.cik = dd.cik AND ff.accessionNumber = dd.accn)
        AND EXISTS (SELECT 1 FROM ff WHERE ff.cik = dd.cik AND ff.rd = dd."end")
      GROUP BY ALL"""


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DIGIT = "list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, '\\p{{Nd}}'))"


def digit_text(t: str) -> str:
    return f"array_to_string({DIGIT.format(t=t)}, chr(10))"


def chunks_of(source: str) -> str:
    """source: a SELECT giving (doc_id, text)."""
    return f"""ch AS (SELECT doc_id, i AS chunk_id, i * 768 AS start, substring(text, i * 768 + 1, 1024) AS chunk
      FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 768)) AS i
            FROM ({source}) s WHERE length(text) > 0))"""


TERM_RE = "'[\\p{L}\\p{N}]+'"


def tfidf_ranked(source: str, question: str, top: int) -> str:
    q = sql_str(question)
    return f"""{chunks_of(source)},
    tc AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM
           (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(chunk), {TERM_RE})) AS term FROM ch)
           GROUP BY ALL),
    n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ch),
    idf AS (SELECT term, ln((any_value(n.n) + 1) / (count(*) + 1)) AS idf FROM tc, n GROUP BY term),
    q AS (SELECT term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower({q}), {TERM_RE})) AS term)
          GROUP BY term),
    qw AS (SELECT q.term, q.tf * coalesce(idf.idf, ln(n.n + 1)) AS qw FROM q LEFT JOIN idf USING (term), n),
    qn AS (SELECT sqrt(sum(qw * qw)) AS qnorm FROM qw),
    pc AS (SELECT tc.doc_id, tc.chunk_id, sum((tf * idf) * (tf * idf)) AS nn,
                  sum(coalesce(tf * idf * qw.qw, 0)) AS dot
           FROM tc JOIN idf USING (term) LEFT JOIN qw USING (term) GROUP BY ALL),
    sc AS (SELECT ch.doc_id, ch.chunk_id, ch.chunk,
                  CASE WHEN pc.dot / nullif(sqrt(pc.nn) * qn.qnorm, 0) IS NOT NULL THEN
                    1 - least(greatest(1 - pc.dot / nullif(sqrt(pc.nn) * qn.qnorm, 0), 0), 2) END AS score
           FROM ch LEFT JOIN pc USING (doc_id, chunk_id), qn),
    rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
                   ORDER BY round(score, 9) DESC NULLS LAST, chunk_id) AS rank FROM sc) WHERE rank <= {top})"""


TOKEN_RE = "'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\t\\n\\x0B\\f\\r ]'"

# Prompt texts restated for the oracle (same fixed values as the operator).
from filings_engine.operators.prompts import ANALYST_SYSTEM, EXTRACT_SYSTEM, METRICS_SYSTEM, REFORMAT_SYSTEM, SUMMARY_QUESTION  # noqa: E402
from filings_engine.plans.summaries import LITE_QUESTION, LITE_SYSTEM, METRICS_QUESTION, THIRD_QUESTION  # noqa: E402

ORDER_LINES = f"""ol AS (
  SELECT o_orderkey AS doc_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty, CAST(l_shipdate AS DATE) AS ship,
         'https://www.sec.gov/Archives/edgar/data/' || {pad('o_custkey')} || '/' || {pad('o_orderkey')}
           || strftime(o_orderdate, '%y') || {pad('o_orderkey % 1000000', 6)} || '/' AS folder,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# page text by a regex route: drop raw-text blocks, comments and declarations,
# split on tags, decode the entities present in the pages, trim.
PAGE_TEXT = r"""WITH a AS (
  SELECT page_id, regexp_replace(html,
     '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<![^>]*>', '<x>', 'gs') AS h FROM pages),
  b AS (SELECT page_id, unnest(regexp_split_to_array(h, '<[^>]*>')) AS piece,
               generate_subscripts(regexp_split_to_array(h, '<[^>]*>'), 1) AS i FROM a),
  c AS (SELECT page_id, i, regexp_replace(replace(replace(replace(replace(piece, '&copy;', '©'), '&middot;', '·'),
               '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS t FROM b)
  SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS text FROM c WHERE t <> '' GROUP BY page_id"""

ACCESSION_NODASH = f"({pad('o_orderkey')} || strftime(o_orderdate, '%y') || {pad('o_orderkey % 1000000', 6)})"

STATEMENT_FILES = f"""WITH o AS (SELECT o_orderkey AS k, {ACCESSION_NODASH} AS accession FROM orders)
  SELECT accession, 'balance_sheet' AS statement,
         CASE WHEN k % 16 < (k + 3) % 16 THEN 'R2.htm' ELSE 'R5.htm' END AS file_name FROM o
  UNION ALL SELECT accession, 'income_statement', CASE WHEN k % 5 = 0 THEN 'R3.xml' ELSE 'R3.htm' END FROM o
  UNION ALL SELECT accession, 'cash_flow_statement', 'R4.htm' FROM o WHERE k % 7 <> 0"""

STATEMENT_LINES = """sl AS (
  SELECT o_orderkey AS doc_id, left(o_orderpriority, 1) AS p1, CAST(o_orderdate AS DATE) AS odate,
         CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS r,
         'us-gaap_P' || CAST(l_partkey AS VARCHAR) AS concept, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS qty,
         l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
good AS (SELECT * FROM sl WHERE NOT (doc_id % 89 = 0 OR doc_id % 101 = 0 OR (doc_id % 103 = 0 AND p1 <> '2'))),
vals AS (
  SELECT doc_id, r AS "row", concept, CAST(0 AS INTEGER) AS period, odate AS period_end, p1 = '2' AS special,
         CASE WHEN p1 = '2' OR r = 2 THEN NULL ELSE round(qty * CASE WHEN p1 = '1' THEN 1000 ELSE 1 END, 6) END AS value
  FROM good
  UNION ALL
  SELECT doc_id, r, concept, CAST(1 AS INTEGER), CAST(odate - INTERVAL 365 DAY AS DATE), p1 = '2',
         CASE WHEN p1 = '2' THEN NULL ELSE round(-price * CASE WHEN p1 = '1' THEN 1000 ELSE 1 END, 6) END
  FROM good)"""

# the three statements of each latest 10-K (always priority 3) and whether a page is there
WANTED = """wanted AS (
  SELECT cik, k, 'balance_sheet' AS statement, CASE WHEN k % 16 < (k + 3) % 16 THEN 'page' ELSE 'no page' END AS state FROM latest
  UNION ALL SELECT cik, k, 'income_statement', 'page' FROM latest
  UNION ALL SELECT cik, k, 'cash_flow_statement', CASE WHEN k % 7 = 0 THEN 'no statement file' ELSE 'page' END FROM latest)"""

# text after the contents heading, images and tables of each rendered filing page
DOCUMENT_PARTS = """body AS (
  SELECT doc_id, chr(10) || 'Part I' || chr(10) || 'Summary' || chr(10)
      || string_agg(CAST(r AS VARCHAR) || '.' || chr(10) || 'Item ' || CAST(r AS VARCHAR), chr(10) ORDER BY r) || chr(10)
      || string_agg('Item ' || CAST(r AS VARCHAR) || chr(10) || 'Part ' || CAST(pk AS VARCHAR) || ' ships '
           || strftime(ship, '%Y-%m-%d') || chr(10) || 'Qty' || chr(10) || qty || chr(10) || 'Supplier' || chr(10)
           || 'S' || CAST(sk AS VARCHAR), chr(10) ORDER BY r)
      || chr(10) || 'End of filing ' || CAST(doc_id AS VARCHAR) AS body,
    string_agg(folder || 'img/' || CAST(pk AS VARCHAR) || '.png', chr(10) ORDER BY r) AS images,
    'Part I Summary ' || string_agg(CAST(r AS VARCHAR) || '. Item ' || CAST(r AS VARCHAR), ' ' ORDER BY r) || chr(10)
      || string_agg('Qty ' || qty || ' Supplier S' || CAST(sk AS VARCHAR) || chr(10) || 'S' || CAST(sk AS VARCHAR),
                    chr(10) ORDER BY r) AS tables
  FROM ol GROUP BY doc_id)"""

# idf of the chunks of all documents, and the TF-IDF weights of a table of terms (keys, term, tf)
CHUNK_IDF = f"""{chunks_of('SELECT doc_id, text FROM documents')},
    tc AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM
           (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(chunk), {TERM_RE})) AS term FROM ch) GROUP BY ALL),
    n AS (SELECT CAST(count(*) AS DOUBLE) + 1 AS n FROM ch),
    idf AS (SELECT term, ln(any_value(n.n) / (count(*) + 1)) AS idf FROM tc, n GROUP BY term)"""


def weighed(keys: str, counts: str) -> str:
    return f"""(SELECT {keys}, term, w, sqrt(sum(w * w) OVER (PARTITION BY {keys})) AS norm
      FROM (SELECT {keys}, term, tf * coalesce(idf, ln(n.n)) AS w FROM {counts} LEFT JOIN idf USING (term), n))"""


# what is wrong with the document of a key, by kind of document
def fault(kind: str) -> str:
    json = kind != "summary"
    return f"""CASE WHEN k % 53 = 0 THEN 'malformed' WHEN k % 59 = 0 THEN 'empty'
      WHEN k % 61 = 0 THEN {"'wrong type'" if json else "'missing part'"}
      {"WHEN k % 67 = 0 THEN 'malformed'" if json else ""}
      WHEN k % 71 = 0 THEN {"'no rows'" if kind == "identifiers" else "'missing part'"}
      {"WHEN k % 73 = 0 THEN 'unequal arrays'" if kind == "submissions" else ""} END"""


SOURCE_DOCUMENTS = {
    "identifiers": "SELECT c_custkey AS k, 1 AS n, 0 AS if_wrong FROM customer",
    "submissions": "SELECT o_orderkey AS k, 1 AS n, 0 AS if_wrong FROM orders",
    "facts": "SELECT l_orderkey AS k, count(*) AS n, count(*) AS if_wrong FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "concept": "SELECT l_orderkey AS k, count(*) AS n, count(*) AS if_wrong FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
               "WHERE l_returnflag || l_linestatus = 'NO' GROUP BY 1",
    "summary": "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 4 END AS n, 0 AS if_wrong FROM orders"}
SOURCE_FILES = " UNION ALL ".join(f"""SELECT '{kind}' AS kind, k AS doc_order,
      CAST(CASE WHEN reason IS NULL THEN n WHEN reason = 'wrong type' THEN if_wrong ELSE 0 END AS BIGINT) AS n_rows, reason
      FROM (SELECT *, {fault(kind)} AS reason FROM ({docs}) d) x""" for kind, docs in SOURCE_DOCUMENTS.items())

SQL = {
    "proxy_links": f"{LINKS} SELECT {LINK_COLS} FROM links",
    "links_view": f"{LINKS} {VIEW}",
    "links_by_year": f"""{LINKS}, v AS ({VIEW})
      SELECT "Ticker",
        arg_max("File", strftime("Filing Date", '%Y-%m-%d') || "File") FILTER (WHERE year("Filing Date") = 1996) AS "1996",
        arg_max("File", strftime("Filing Date", '%Y-%m-%d') || "File") FILTER (WHERE year("Filing Date") = 1997) AS "1997",
        arg_max("File", strftime("Filing Date", '%Y-%m-%d') || "File") FILTER (WHERE year("Filing Date") = 1998) AS "1998",
        arg_max("File", strftime("Filing Date", '%Y-%m-%d') || "File") FILTER (WHERE year("Filing Date") = 1999) AS "1999"
      FROM v GROUP BY "Ticker" """,
    "coverage_gaps": f"{COVERAGE} SELECT ticker, year, n FROM cov",
    "filing_year_options": f"""{LINKS} SELECT t.ticker, p AS position, 1999 - p AS year, count(l.ticker) AS n
        FROM (SELECT DISTINCT ticker FROM links) t CROSS JOIN range(4) r(p)
        LEFT JOIN links l ON l.ticker = t.ticker AND year(l.filingDate) = 1999 - p GROUP BY t.ticker, p""",
    "coverage_alerts": f"""{COVERAGE}
      SELECT ticker,
        CASE WHEN count(*) FILTER (WHERE n = 0) > 0 THEN '* ' || ticker || ': ' ||
          string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (WHERE n = 0) END AS missing_alert,
        CASE WHEN count(*) FILTER (WHERE n > 1) > 0 THEN '* ' || ticker || ': ' ||
          string_agg(CAST(year AS VARCHAR) || ' (' || CAST(n AS VARCHAR) || ' files found)', ', ' ORDER BY year)
          FILTER (WHERE n > 1) END AS duplicate_alert
      FROM cov GROUP BY ticker""",
    "cik_lookup": f"""WITH {IDENTIFIERS}
      SELECT o.o_orderkey, 'T' || CAST(o.o_custkey AS VARCHAR) AS ticker,
             (SELECT min_by(i.cik_str, i.id_ordinal) FROM identifiers i
              WHERE i.ticker = 'T' || CAST(o.o_custkey AS VARCHAR)) AS cik
      FROM orders o""",
    "latest_filing": f"""WITH {FILINGS}, r AS (
        SELECT cik, accessionNumber, primaryDocument,
               row_number() OVER (PARTITION BY cik ORDER BY odate DESC, o_orderkey) AS rn
        FROM filings WHERE form = '10-K')
      SELECT cik, accessionNumber, primaryDocument FROM r WHERE rn = 1""",
    "first_filing": f"""{LINKS.replace('BETWEEN 1996 AND 1999', 'BETWEEN 1998 AND 1998')},
      r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filingDate DESC, odate DESC, o_orderkey) AS rn
            FROM links)
      SELECT doc_url AS "File", regexp_replace(doc_url, '/[^/]*$', '') || '/R2.htm' AS "Summary",
             ticker AS "Ticker", form AS "Form", filingDate AS "Filing Date" FROM r WHERE rn = 1""",
    "facts_flat": f"WITH {FACT_LINES} SELECT {FACT_COLS} FROM fl",
    "facts_dedup": f"WITH {DEDUP} SELECT {FACT_COLS} FROM dd",
    "annual_facts": periodic("10-K"),
    "quarterly_facts": periodic("10-Q"),
    "concept_series": f"""WITH {FACT_LINES}
      SELECT cik, 'NO' AS tag, start, "end", val, accn, form, filed FROM fl WHERE fact = 'NO'""",
    "digit_lines": f"SELECT doc_id, {digit_text('text')} AS digit_text FROM documents",
    "numeric_context": f"SELECT doc_id, replace({digit_text('text')}, chr(10), ' ') AS context FROM documents",
    "after_marker": "SELECT doc_id, string_split(text, 'License')[2] AS after FROM documents",
    "chunks": f"WITH {chunks_of('SELECT doc_id, text FROM documents')} SELECT doc_id, chunk_id, start, chunk FROM ch",
    "token_profile": f"""SELECT lang, count(*) AS n_docs, CAST(sum(t) AS BIGINT) AS total_tokens, round(avg(t), 6) AS mean_tokens,
        quantile_cont(t, 0.5) AS p50_tokens, quantile_cont(t, 0.9) AS p90_tokens, max(t) AS max_tokens
      FROM (SELECT lang, len(regexp_extract_all(text, {TOKEN_RE})) AS t FROM documents) GROUP BY lang""",
    "rank_chunks": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      u AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
      c AS (SELECT label, list(m ORDER BY i) AS cv FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i)
            GROUP BY label),
      s0 AS (SELECT e.label, e.vec_id, list_dot_product(e.v, c.cv)
                 / nullif(sqrt(list_dot_product(e.v, e.v) * list_dot_product(c.cv, c.cv)), 0) AS cs
            FROM e JOIN c USING (label)),
      s AS (SELECT label, vec_id, CASE WHEN cs IS NOT NULL THEN 1 - least(greatest(1 - cs, 0), 2) END AS score FROM s0),
      r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC NULLS LAST, vec_id) AS rank
            FROM s)
      SELECT label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 25""",
    "tfidf_rank": f"""WITH {tfidf_ranked('SELECT doc_id, text FROM documents', SUMMARY_QUESTION, 5)}
      SELECT doc_id, chunk_id, rank, round(score, 6) AS score FROM rk""",
    "context": f"""WITH {tfidf_ranked('SELECT doc_id, text FROM documents', SUMMARY_QUESTION, 5)}
      SELECT doc_id, string_agg(chunk, ' ' ORDER BY rank) AS context FROM rk GROUP BY doc_id""",
    "prompts": f"""WITH {tfidf_ranked("SELECT doc_id, replace(" + digit_text('text') + ", chr(10), ' ') AS text FROM documents",
                                      SUMMARY_QUESTION, 100)},
      ctx AS (SELECT doc_id, string_agg(chunk, ' ' ORDER BY rank) AS context FROM rk GROUP BY doc_id)
      SELECT doc_id, 0 AS turn, 'system' AS role, {sql_str(ANALYST_SYSTEM)} AS content FROM ctx
      UNION ALL
      SELECT doc_id, 1, 'user', 'Query: ' || {sql_str(SUMMARY_QUESTION)} || chr(10) || ' Relevant texts:' || context
      FROM ctx""",
    "answer_fields": """SELECT c_custkey AS doc_id, c_custkey % 49 <> 0 AS is_json,
        CASE WHEN c_custkey % 49 = 0 THEN 'CEO: ' || c_name ELSE
          'CEO name: ' || c_name || '.' || chr(10) || ' Year covered: ' || CAST(1990 + c_nationkey AS VARCHAR) || '.'
          || chr(10) || ' Names of metrics used to evaluate performance: ' || c_mktsegment || ', Revenue.'
          || chr(10) || ' Total CEO Compensation $: ' || printf('$%.2f', c_acctbal) || '.' END AS notes,
        CASE WHEN c_custkey % 49 = 0 THEN 'NA' ELSE c_name END AS "CEO",
        CASE WHEN c_custkey % 49 = 0 THEN 'NA' ELSE CAST(1990 + c_nationkey AS VARCHAR) END AS "Year Covered",
        CASE WHEN c_custkey % 49 = 0 THEN 'NA' ELSE c_mktsegment || ', Revenue' END AS "Metrics",
        CASE WHEN c_custkey % 49 = 0 THEN 'NA' ELSE printf('$%.2f', c_acctbal) END AS "Total Compensation"
      FROM customer""",
    "rate_audit": """SELECT user_id, event_id, ts,
        count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                       RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS n_recent,
        count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                       RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 >= 10 AS over_limit
      FROM events""",
    "page_text": PAGE_TEXT,
    "page_links": r"""SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS BIGINT) AS link_no, unnest(h) AS href
      FROM (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS h FROM pages)""",
    "page_images": f"""WITH {ORDER_LINES}
      SELECT doc_id, CAST(r - 1 AS BIGINT) AS image_no, folder || 'img/' || CAST(pk AS VARCHAR) || '.png' AS url FROM ol""",
    "page_tables": f"""WITH {ORDER_LINES}
      SELECT doc_id, CAST(0 AS BIGINT) AS table_no,
             'Part I Summary ' || string_agg(CAST(r AS VARCHAR) || '. Item ' || CAST(r AS VARCHAR), ' ' ORDER BY r) AS text
      FROM ol GROUP BY doc_id
      UNION ALL
      SELECT doc_id, CAST(2 * r - 1 AS BIGINT), 'Qty ' || qty || ' Supplier S' || CAST(sk AS VARCHAR) FROM ol
      UNION ALL
      SELECT doc_id, CAST(2 * r AS BIGINT), 'S' || CAST(sk AS VARCHAR) FROM ol""",
    "toc_sections": f"""WITH {ORDER_LINES},
      last AS (SELECT doc_id, max(r) AS mr FROM ol GROUP BY doc_id)
      SELECT ol.doc_id, 's' || CAST(r AS VARCHAR) AS id,
             'Part ' || CAST(pk AS VARCHAR) || ' ships ' || strftime(ship, '%Y-%m-%d') || ' Qty ' || qty
               || ' Supplier S' || CAST(sk AS VARCHAR)
               || CASE WHEN r = mr THEN ' End of filing ' || CAST(ol.doc_id AS VARCHAR) ELSE '' END AS text
      FROM ol JOIN last USING (doc_id)""",
    "statement_files": STATEMENT_FILES,
    "statement_values": f"WITH {STATEMENT_LINES} SELECT * FROM vals",
    "statement_dedup": f"""WITH {STATEMENT_LINES},
      vec AS (SELECT doc_id, "row", max(value) FILTER (WHERE period = 0) AS v0,
                     max(value) FILTER (WHERE period = 1) AS v1 FROM vals GROUP BY ALL),
      keep AS (SELECT doc_id, min("row") AS "row" FROM vec GROUP BY doc_id, v0, v1)
      SELECT v.* FROM vals v SEMI JOIN keep k ON v.doc_id = k.doc_id AND v."row" = k."row" """,
    "statement_errors": """SELECT o_orderkey AS doc_id,
        CASE WHEN o_orderkey % 89 = 0 THEN 'empty' WHEN o_orderkey % 101 = 0 THEN 'unparsable date'
             ELSE 'more cells than dates' END AS reason
      FROM orders WHERE (o_orderkey % 89 = 0 OR o_orderkey % 101 = 0 OR (o_orderkey % 103 = 0 AND left(o_orderpriority, 1) <> '2'))
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "proxy_texts": f"""{LINKS},
      pick AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY ticker
               ORDER BY filingDate, o_orderkey DESC) = 1),
      {ORDER_LINES}, {DOCUMENT_PARTS}
      SELECT p.ticker, p.doc_url, b.body AS text, b.images, b.tables FROM pick p LEFT JOIN body b ON b.doc_id = p.o_orderkey""",
    "filing_documents": f"""WITH {ORDER_LINES}, {DOCUMENT_PARTS}
      SELECT doc_id, CASE WHEN doc_id % 71 <> 0 THEN 'Filing ' || CAST(doc_id AS VARCHAR) || chr(10) || 'TABLE OF' || chr(10)
                          || 'CONTENTS' || body END AS text,
             CASE WHEN doc_id % 71 <> 0 THEN images END AS images, CASE WHEN doc_id % 71 <> 0 THEN tables END AS tables
      FROM body""",
    "lite_prompts": f"""{LINKS},
      sp AS (SELECT o_orderkey AS k, left(o_orderpriority, 1) AS p1,
                    strftime(o_orderdate, '%b. %-d, %Y') AS d0,
                    CASE WHEN o_orderkey % 101 = 0 THEN 'Foo. 31, 1999'
                         ELSE strftime(CAST(o_orderdate AS DATE) - INTERVAL 365 DAY, '%b. %-d, %Y') END AS d1,
                    CASE left(o_orderpriority, 1) WHEN '1' THEN '$ in Millions'
                         WHEN '2' THEN 'Share data unless otherwise specified' ELSE '$ in Thousands' END AS unit
             FROM orders),
      li AS (SELECT l_orderkey AS k,
                    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS i,
                    l_partkey AS pk, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty,
                    '(' || format('{{:,.2f}}', l_extendedprice) || ')' AS price FROM lineitem),
      cells AS (SELECT k, i, list_filter(['Part ' || CAST(pk AS VARCHAR),
                          CASE WHEN i = 2 THEN NULL ELSE '$ ' || qty END, price,
                          CASE WHEN k % 103 = 0 AND i = 0 THEN '(1)' END], lambda x: x IS NOT NULL) AS parts
                FROM li),
      body AS (SELECT k, flatten(list(parts ORDER BY i)) AS parts FROM cells GROUP BY k),
      page AS (SELECT sp.k, ['CONSOLIDATED BALANCE SHEETS - USD ($)', sp.unit, sp.d0, sp.d1] || body.parts AS parts
               FROM sp JOIN body USING (k)),
      ctx AS (SELECT k,
                array_to_string(list_filter(parts, lambda x: regexp_matches(x, '\\p{{Nd}}')), ' ') AS lines,
                array_to_string(parts, ' ') AS tab FROM page),
      fullctx AS (SELECT k, CASE WHEN k % 89 = 0 THEN '' ELSE lines || CASE WHEN regexp_matches(tab, '\\b2024\\b|\\b20\\s24\\b') THEN ''
                                       ELSE ' ' || tab END END AS context FROM ctx)
      SELECT l.doc_url, 0 AS turn, 'system' AS role, {sql_str(LITE_SYSTEM)} AS content
      FROM links l JOIN fullctx f ON f.k = l.o_orderkey
      UNION ALL
      SELECT l.doc_url, 1, 'user', 'Query: ' || {sql_str(LITE_QUESTION)} || chr(10) || ' Relevant texts:' || f.context
      FROM links l JOIN fullctx f ON f.k = l.o_orderkey""",
    "company_statements": f"""WITH {FILINGS},
      latest AS (SELECT cik, o_orderkey AS k FROM filings WHERE form = '10-K'
                 QUALIFY row_number() OVER (PARTITION BY cik ORDER BY odate DESC, o_orderkey) = 1),
      {WANTED},
      {STATEMENT_LINES},
      vec AS (SELECT doc_id, "row", max(value) FILTER (WHERE period = 0) AS v0,
                     max(value) FILTER (WHERE period = 1) AS v1 FROM vals GROUP BY ALL),
      keep AS (SELECT doc_id, min("row") AS "row" FROM vec GROUP BY doc_id, v0, v1)
      SELECT w.cik, w.statement, v."row", v.concept, v.period, v.period_end, v.special, v.value
      FROM vals v SEMI JOIN keep k ON v.doc_id = k.doc_id AND v."row" = k."row"
      JOIN wanted w ON w.k = v.doc_id AND w.state = 'page'""",
    "company_statement_errors": f"""WITH {FILINGS},
      latest AS (SELECT cik, o_orderkey AS k FROM filings WHERE form = '10-K'
                 QUALIFY row_number() OVER (PARTITION BY cik ORDER BY odate DESC, o_orderkey) = 1),
      {WANTED},
      r AS (SELECT cik, statement, CASE WHEN state <> 'page' THEN state
                   WHEN k NOT IN (SELECT l_orderkey FROM lineitem) THEN 'no page'
                   WHEN k % 89 = 0 THEN 'empty' WHEN k % 101 = 0 THEN 'unparsable date'
                   WHEN k % 103 = 0 THEN 'more cells than dates' END AS reason FROM wanted)
      SELECT * FROM r WHERE reason IS NOT NULL""",
    "reformat_prompts": f"""WITH bad AS (SELECT c_custkey AS doc_id, 'json' || chr(10) || '{{"CEO name":"' || c_name || '","Year covered":'
          || CAST(1990 + c_nationkey AS VARCHAR) || ',"Names of metrics used to evaluate performance":["' || c_mktsegment
          || '","Revenue"],"Total CEO Compensation $":"' || printf('$%.2f', c_acctbal) || '"}}' AS answer
        FROM customer WHERE c_custkey % 7 = 0)
      SELECT doc_id, 0 AS turn, 'system' AS role, {sql_str(REFORMAT_SYSTEM)} AS content FROM bad
      UNION ALL SELECT doc_id, 1, 'user', 'Data:' || answer FROM bad""",
    "identifiers_parsed": f"WITH {IDENTIFIERS} SELECT cik_str, ticker, title FROM identifiers",
    "submissions_parsed": f"""WITH {FILINGS}
      SELECT cik, accessionNumber, filingDate, reportDate, form, fileNumber, filmNumber, primaryDocument,
             primaryDocDescription FROM filings""",
    "accessions_of_form": f"WITH {FILINGS} SELECT cik, reportDate, accessionNumber FROM filings WHERE form = '10-Q'",
    "requested_companies": f"""WITH {IDENTIFIERS}
      SELECT cik_str, ticker, title FROM identifiers
      WHERE ticker IN (SELECT 'T' || CAST(s_suppkey AS VARCHAR) FROM supplier
                       UNION ALL SELECT 'T' || CAST(s_suppkey + 10 AS VARCHAR) FROM supplier)""",
    "company_slices": f"{LINKS} SELECT {LINK_COLS} FROM links WHERE ticker IN ('T1', 'T4', 'T22', 'NONE')",
    "statement_urls": f"""WITH sf AS ({STATEMENT_FILES}), {FILINGS}
      SELECT f.cik, f.accessionNumber, sf.statement, sf.file_name,
             'https://www.sec.gov/Archives/edgar/data/' || f.cik || '/' || sf.accession || '/' || sf.file_name AS statement_url,
             'https://www.sec.gov/Archives/edgar/data/' || ltrim(f.cik, '0') || '/' || sf.accession || '/FilingSummary.xml'
               AS summary_file_url,
             CASE WHEN sf.file_name LIKE '%.xml' THEN 'xml' ELSE 'html' END AS parser
      FROM sf JOIN filings f ON replace(f.accessionNumber, '-', '') = sf.accession""",
    "fact_matrix": f"""WITH {DEDUP},
      t AS (SELECT cik, fact, max(val) AS v FROM dd GROUP BY ALL),
      g AS (SELECT cik, unnest(['AF', 'NF', 'NO', 'RF']) AS fact FROM (SELECT DISTINCT cik FROM dd))
      SELECT g.cik, g.fact, t.v AS value,
             CASE WHEN t.v = floor(t.v) THEN format('{{:,}}', CAST(t.v AS BIGINT)) ELSE format('{{:,.2f}}', t.v) END AS shown
      FROM g LEFT JOIN t ON t.cik = g.cik AND t.fact = g.fact""",
    "multi_step_prompts": f"""WITH {tfidf_ranked("SELECT doc_id, replace(" + digit_text('text') + ", chr(10), ' ') AS text FROM documents",
                                                 METRICS_QUESTION, 50)},
      ctx AS (SELECT doc_id, chr(10) || ' Relevant texts:' || string_agg(chunk, ' ' ORDER BY rank) AS c FROM rk GROUP BY doc_id)
      SELECT doc_id, 1 AS step, 0 AS turn, 'system' AS role, {sql_str(METRICS_SYSTEM)} AS content FROM ctx
      UNION ALL SELECT doc_id, 1, 1, 'user', 'Query: ' || {sql_str(METRICS_QUESTION)} || c FROM ctx
      UNION ALL SELECT doc_id, s, 0, 'system', {sql_str(EXTRACT_SYSTEM)} FROM ctx, (VALUES (2), (3)) v(s)
      UNION ALL SELECT ctx.doc_id, 2, 1, 'user', 'Query: For each of these metrics Revenue, ' || coalesce(lang, 'none')
        || ', please give me the proxy target and actual values. Keep your response as short as possible.' || c
        FROM ctx JOIN documents USING (doc_id)
      UNION ALL SELECT doc_id, 3, 1, 'user', 'Query ' || {sql_str(THIRD_QUESTION)} || c FROM ctx""",
    "source_files": SOURCE_FILES,
    "submissions_checked": f"""WITH {FILINGS} SELECT cik, accessionNumber, form, filingDate FROM (SELECT *, o_orderkey AS k FROM filings) f
      WHERE {fault('submissions')} IS NULL""",
    "facts_checked": f"""WITH {FACT_LINES}, f AS (SELECT *, l_orderkey AS k FROM fl), g AS (SELECT *, {fault('facts')} AS reason FROM f)
      SELECT cik, taxonomy, fact, label, unit, start, "end", CASE WHEN reason IS NULL THEN val END AS val, accn, form, filed FROM g
      WHERE coalesce(reason, 'wrong type') = 'wrong type'""",
    "links_written": f"""{LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filingDate DESC, accessionNumber DESC) AS n FROM links)
      SELECT {LINK_COLS} FROM r WHERE CAST(cik AS BIGINT) % 25 % 3 <> 0 OR n = 1""",
    "rate_audit_hot": """WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS sender, event_id, ts FROM events),
      r AS (SELECT *, count(*) OVER (PARTITION BY sender ORDER BY epoch_us(ts)
                       RANGE BETWEEN 31535999999999 PRECEDING AND CURRENT ROW) - 1 AS n_recent FROM e)
      SELECT sender, event_id, ts, n_recent, n_recent >= 100 AS over_limit FROM r""",
    "links_listing": f"""{LINKS} SELECT row_number() OVER (ORDER BY id_ordinal, filingDate DESC, odate DESC, o_orderkey) AS position,
      ticker, accessionNumber, filingDate FROM links""",
    "question_chunks": f"""WITH {CHUNK_IDF},
      qc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), {TERM_RE})) AS term FROM benchmark) GROUP BY ALL),
      c AS {weighed('doc_id, chunk_id', 'tc')}, q AS {weighed('item_id', 'qc')},
      s AS (SELECT item_id, doc_id, chunk_id, sum(c.w / c.norm * (q.w / q.norm)) AS cs FROM q JOIN c USING (term)
            WHERE c.norm > 0 AND q.norm > 0 GROUP BY ALL),
      r AS (SELECT *, 1 - least(greatest(1 - cs, 0), 2) AS score FROM s)
      SELECT item_id AS question_id, doc_id, chunk_id, rank, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id, chunk_id) AS rank FROM r) WHERE rank <= 5""",
    "turn_vectors": f"""WITH {CHUNK_IDF},
      t AS (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY ALL),
      qc AS (SELECT conv_id, turn, term, count(*) AS tf FROM
             (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), {TERM_RE})) AS term FROM t) GROUP BY ALL),
      q AS {weighed('conv_id, turn', 'qc')}
      SELECT conv_id, turn, count(*) FILTER (WHERE norm > 0) AS n_terms, round(max(w / nullif(norm, 0)), 6) AS greatest,
             round(coalesce(sum(w / nullif(norm, 0)), 0), 6) AS total FROM q GROUP BY ALL""",
    "answer_kinds": """SELECT s_suppkey AS doc_id, true AS is_json,
        'CEO name: [' || s_suppkey || ',2].' || chr(10) || ' Year covered: nan.' || chr(10) || ' Metrics: [''EPS'', ' || s_suppkey || '], TSR, None, True.'
          || chr(10) || ' Total: {''cash'': 1.5, ''note'': "it''s ' || s_name || '"}.' || chr(10) || ' Checked: False.' AS notes,
        '[' || s_suppkey || ',2]' AS "CEO", 'nan' AS "Year Covered", '[''EPS'', ' || s_suppkey || '], TSR, None, True' AS "Metrics",
        '{''cash'': 1.5, ''note'': "it''s ' || s_name || '"}' AS "Total Compensation"
      FROM supplier""",
    "coverage_stream": f"{COVERAGE} SELECT ticker, year, n FROM cov",
}
SQL["company_profile"] = " UNION ALL ".join(
    f"SELECT cik, '{part}' AS part, count(*) AS n FROM ({SQL[query]}) GROUP BY cik"
    for part, query in [("facts", "facts_dedup"), ("annual", "annual_facts"), ("quarterly", "quarterly_facts"),
                        ("statements", "company_statements"), ("statement_errors", "company_statement_errors"),
                        ("assets", "concept_series")])
