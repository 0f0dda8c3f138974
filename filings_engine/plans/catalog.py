"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads whole test tables through the adapters; parameters are
the defaults a user of the links finder would pass for this data
(filing years 1996-1999)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Window, functions as F

from filings_engine.session import checkpoint_dir, materialize, spread
from filings_engine.operators import audit as au
from filings_engine.operators import coverage as cov
from filings_engine.operators import facts as fx
from filings_engine.operators import html as hx
from filings_engine.operators import html_native as nat
from filings_engine.operators import statements as stm
from filings_engine.sources.keys import statement_keys
from filings_engine.operators.html_nodes import html_nodes, html_tables
from filings_engine.operators import positions as ps
from filings_engine.operators import prompts as pr
from filings_engine.operators import questions as qs
from filings_engine.operators import retrieval as rt
from filings_engine.operators import filters as flt
from filings_engine.plans import proxy_links as pl
from filings_engine.functions.strings import display_amount
from filings_engine.plans import fundamentals as fu
from filings_engine.plans import summaries as sm
from filings_engine.sources import adapters as ad
from filings_engine.sources import edgar_files as ef
from filings_engine.sources import file_checks as fc
from filings_engine.streaming import links_stream as ls

START, END = 1996, 1999
YEARS = list(range(START, END + 1))


def _links_rich(spark, d):
    return pl.proxy_filings(ad.identifiers(spark, d), ad.filings(spark, d), None, START, END)


def q_proxy_links(spark, d, sort=True):
    return pl.find_proxy_filings(ad.identifiers(spark, d), ad.filings(spark, d), None, START, END, sort)


def q_links_view(spark, d):
    return flt.links_view(q_proxy_links(spark, d))


def q_links_by_year(spark, d):
    return cov.pivot_links(flt.links_view(q_proxy_links(spark, d, sort=False)), YEARS, on_duplicate="latest")


def q_coverage_gaps(spark, d):
    return cov.filing_coverage(q_proxy_links(spark, d, sort=False), START, END)


def q_coverage_alerts(spark, d):
    return cov.coverage_alerts(q_coverage_gaps(spark, d))


def q_filing_year_options(spark, d):
    """O2: the selectable years of every company with a link, newest first, with its links of each."""
    counted = q_proxy_links(spark, d, sort=False).groupBy("ticker", F.year("filingDate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    options = counted.select("ticker").distinct().select("ticker", F.posexplode(cov.year_options(START, END)).alias("position", "year"))
    found = options.join(counted, ["ticker", "year"], "left")
    return found.select("ticker", F.col("position").cast("long").alias("position"), F.col("year").cast("long").alias("year"), F.coalesce("n", F.lit(0)).alias("n"))


def q_coverage_stream(spark, d):
    """A1 kept up to date: the submission documents land in three parts and the first
    one again; after each landing the two streams run as far as there are files."""
    docs = ad.submission_documents(spark, d)
    top = f"{checkpoint_dir(spark).rstrip('/')}/coverage-{uuid.uuid4().hex}"
    for n, part in enumerate((0, 1, 2, 0)):
        docs.where(F.col("doc_order") % 3 == part).select("value").write.text(f"{top}/landing/{n}")
        links = ls.distinct_links_stream(spark, f"{top}/landing", ad.identifiers(spark, d), START, END, whole_files=False)
        ls.write_links_stream(links, f"{top}/links", f"{top}/state/links").awaitTermination()
        ls.write_counts_stream(spark, f"{top}/links", f"{top}/counts", f"{top}/state/counts").awaitTermination()
    return ls.current_coverage(spark, f"{top}/counts", START, END)


def q_cik_lookup(spark, d):
    requests = ad.table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("ticker"))
    found = flt.lookup_cik(ad.identifiers(spark, d), requests.select("ticker").distinct())
    return requests.join(found, "ticker", "left").select("o_orderkey", "ticker", "cik")


def q_latest_filing(spark, d):
    return fx.latest_filing_of_form(ad.filings(spark, d), "10-K").drop("reportDate")


def q_first_filing(spark, d):
    return pl.single_year_first_filing(ad.identifiers(spark, d), ad.filings(spark, d), 1998)


FACT_COLS = ["cik", "taxonomy", "fact", "label", "unit", "start", "end", "val", "accn", "form", "filed"]


def _facts(spark, d):
    return ef.parse_company_facts(ad.company_facts_documents(spark, d), doc_order="doc_order")


def q_facts_flat(spark, d):
    return _facts(spark, d).select(FACT_COLS)


def q_facts_dedup(spark, d):
    return fx.dedupe_facts(_facts(spark, d)).select(FACT_COLS)


def _periodic(spark, d, form):
    out = fx.periodic_facts(_facts(spark, d), ad.filings(spark, d), form, dedupe=True)
    return out.withColumn("value", F.round("value", 6))


def q_annual_facts(spark, d):
    return _periodic(spark, d, "10-K")


def q_quarterly_facts(spark, d):
    return _periodic(spark, d, "10-Q")


def q_concept_series(spark, d):
    c = ef.parse_company_concept(ad.company_concept_documents(spark, d, "NO"), doc_order="doc_order")
    return c.drop("ordinal")


MARKER = "License"
RANK_TOP = 25          # top-k per label of the vector ranking
CONTEXT_TOP = 5        # top-k chunks per document for the context report
QUESTION_TOP = 5       # top-k chunks of all documents per question


def _docs(spark, d):
    return spread(ad.table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")


def q_digit_lines(spark, d):
    return flt.digit_lines(_docs(spark, d)).select("doc_id", "digit_text")


def q_numeric_context(spark, d):
    return rt.numeric_context(_docs(spark, d)).select("doc_id", "context")


def q_after_marker(spark, d):
    return flt.after_marker(_docs(spark, d), MARKER).select("doc_id", "after")


def q_chunks(spark, d):
    return rt.chunk_text(_docs(spark, d), "text", ["doc_id"]).select("doc_id", "chunk_id", "start", "chunk")


def q_token_profile(spark, d):
    return rt.token_profile(_docs(spark, d), ["lang"])


def q_rank_chunks(spark, d):
    v = ad.table(spark, d, "embeddings")
    ranked = rt.rank_chunks(v, rt.centroids(v, ["label"]), RANK_TOP, by=["label"], chunk_key="vec_id")
    return ranked.select("label", "vec_id", "rank", F.round("score", 6).alias("score"))


def _tfidf_top(spark, d, top):
    chunks = rt.chunk_text(_docs(spark, d), "text", ["doc_id"])
    scores = rt.tfidf_scores(chunks, pr.SUMMARY_QUESTION, ["doc_id", "chunk_id"], model=_term_model(spark, chunks), carry=["chunk"])
    return rt.top_n(scores, ["doc_id"], "chunk_id", top)


def q_tfidf_rank(spark, d):
    return _tfidf_top(spark, d, CONTEXT_TOP).select("doc_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def q_context(spark, d):
    return rt.assemble_context(_tfidf_top(spark, d, CONTEXT_TOP), ["doc_id"])


def q_prompts(spark, d):
    """Q3 on documents: numeric context -> chunks -> TF-IDF ranking (top
    100) -> context -> one conversation per document."""
    return pr.flatten_messages(sm.summary_prompts(_docs(spark, d), ["doc_id"], tables=None, fit=functools.partial(_term_model, spark)), ["doc_id"])


def q_multi_step_prompts(spark, d):
    """Q4 on documents: the metrics conversation, the targets conversation
    (over first answers rendered from the language) and the third one."""
    docs = _docs(spark, d)
    ctx, first = sm.multi_step_prompts(docs, ["doc_id"], tables=None, fit=functools.partial(_term_model, spark),
                                       land=functools.partial(materialize, as_table=True))
    answers = docs.select("doc_id", F.concat(F.lit("Revenue, "), F.coalesce("lang", F.lit("none"))).alias("content"))
    steps = [first, pr.metric_targets_prompts(answers, ctx, ["doc_id"]), sm.third_step_prompts(ctx, ["doc_id"])]
    rows = [pr.flatten_messages(s, ["doc_id"]).withColumn("step", F.lit(i + 1)) for i, s in enumerate(steps)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _term_model(spark, chunks):
    return qs.fit_terms(chunks, f"{checkpoint_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}")


def q_question_chunks(spark, d):
    """J8 for many questions: every benchmark text against all chunks of all documents."""
    chunks = rt.chunk_text(_docs(spark, d), "text", ["doc_id"])
    model = _term_model(spark, chunks)
    asked = ad.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    questions = materialize(qs.vectorize_chunks(asked, model, ["question_id"], "text"), as_table=True)
    vectors = qs.vectorize_chunks(chunks, model, only=questions.select(F.explode("terms.term").alias("term")))
    ranked = qs.rank_questions(materialize(vectors, as_table=True), questions, QUESTION_TOP)
    return ranked.select("question_id", "doc_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def q_turn_vectors(spark, d):
    """R3 without refitting: the turns of all conversations by the terms of the documents."""
    model = _term_model(spark, rt.chunk_text(_docs(spark, d), "text", ["doc_id"]))
    turns = ad.table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    found = qs.vectorize_chunks(turns, model, ["conv_id", "turn"], "text")
    weights = F.transform("terms", lambda t: t["w"])
    return found.select("conv_id", "turn", F.size("terms").cast("long").alias("n_terms"), F.round(F.array_max(weights), 6).alias("greatest"),
                        F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 6).alias("total"))


def q_answer_fields(spark, d):
    parsed = pr.parse_answers(ad.model_answers(spark, d), ["doc_id"])
    return pr.answer_fields(parsed, ["doc_id"])


def q_answer_kinds(spark, d):
    """L2 and L3 for values of every JSON kind."""
    return pr.answer_fields(pr.parse_answers(ad.answers_of_all_kinds(spark, d), ["doc_id"]), ["doc_id"])


def q_reformat_prompts(spark, d):
    """L1 for the first answers that did not parse: one extraction conversation each."""
    parsed = pr.parse_answers(ad.model_answers(spark, d).filter("attempt = 0"), ["doc_id"])
    return pr.flatten_messages(pr.reformat_prompts(parsed, ["doc_id"]), ["doc_id"])


def q_rate_audit(spark, d):
    ev = ad.table(spark, d, "events")
    return au.request_rate_audit(ev, "user_id", "ts", limit=10, period_us=3_600_000_000)


def q_rate_audit_hot(spark, d):
    """W5 with a key that sends a third of all requests, over a year."""
    ev = ad.table(spark, d, "events").withColumn("sender", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")))
    return au.request_rate_ranks(ev, "sender", "ts", limit=100, period_us=365 * 86_400_000_000)


def q_links_listing(spark, d):
    """O1: the place of every link in the whole listing: companies in file order,
    newest filings first."""
    rich = _links_rich(spark, d)
    order = [F.col("id_ordinal").asc(), F.col("filingDate").desc_nulls_last(), F.col("ordinal").asc()]
    return ps.with_position(rich, order).select("position", "ticker", "accessionNumber", "filingDate")


# parser projections: each job asks only for the nodes and columns it reads
TEXT_COLUMNS = ["pos", "kind", "text"]
TABLE_TEXT = dict(elements=["img"], id_elements=False, blank_text=False, columns=[*TEXT_COLUMNS, "tag", "link", "table_path"])


def _pages(spark, d):
    return spread(ad.table(spark, d, "pages"), "page_id")


def _numbered(df, order_col, out):
    w = Window.partitionBy("doc_id").orderBy(order_col)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("long")).drop(order_col)


def q_page_text(spark, d):
    return nat.page_text(_pages(spark, d), "page_id")


def q_page_links(spark, d):
    links = nat.page_links(_pages(spark, d), "page_id").withColumnRenamed("page_id", "doc_id")
    return _numbered(links, "pos", "link_no").select(F.col("doc_id").alias("page_id"), "link_no", "href")


def q_page_images(spark, d):
    pages = spread(ad.filing_pages(spark, d), "doc_id", always=True)
    return _numbered(nat.page_images(pages), "pos", "image_no").select("doc_id", "image_no", "url")


def q_page_tables(spark, d):
    pages = spread(ad.filing_pages(spark, d), "doc_id", always=True)
    return hx.numbered_tables(html_tables(pages)).select("doc_id", "table_no", "text")


def q_toc_sections(spark, d):
    nodes = html_nodes(ad.dealt(spark, d, ad.filing_pages(spark, d)), **hx.CONTENTS_NODES)
    return hx.toc_sections(nodes, hx.toc_ids(hx.toc_entries(nodes)))


def q_statement_files(spark, d):
    summary = ef.parse_filing_summary(ad.filing_summaries(spark, d), key_cols=["accession"])
    return stm.match_statement_files(summary, statement_keys(spark), ["accession"])


def _statement(spark, d):
    nodes = html_nodes(ad.dealt(spark, d, ad.statement_pages(spark, d)), **stm.STATEMENT_NODES)
    return stm.statement_frame(nodes, ad.order_ids(spark, d))


def _rounded(values):
    return values.withColumn("value", F.round("value", 6))


def q_statement_values(spark, d):
    return _rounded(_statement(spark, d)[0])


def q_statement_dedup(spark, d):
    return _rounded(stm.dedupe_statement_rows(_statement(spark, d)[0]))


def q_statement_errors(spark, d):
    return _statement(spark, d)[1]


TEXT_MARKER = "CONTENTS"


def _documents(pages):
    """H5 of filing pages, parsed once."""
    return hx.extract_documents(pages, html_nodes(pages, **hx.DOCUMENT_NODES, carry=["status"]))


def _listed(df):
    """Lists as lines, so that results compare as plain values."""
    return df.withColumns({c: F.array_join(c, "\n") for c in ("images", "tables")})


def q_filing_documents(spark, d):
    """H5 of every filing page; every 71st fetch failed and gives no document."""
    pages = ad.dealt(spark, d, ad.filing_pages(spark, d)).withColumn("status", F.when(F.col("doc_id") % 71 == 0, 404).otherwise(F.col("status")))
    return _listed(_documents(pages).select("doc_id", "document.*"))


def q_proxy_texts(spark, d):
    """H6 + A8 on the rendered filing pages: only the pages of the chosen
    filings are parsed (semi-join before the parse)."""
    rich = _links_rich(spark, d)
    chosen = pl.latest_text_per_ticker(rich)
    pages = ad.filing_pages(spark, d).join(chosen.select(F.col("doc_url").alias("url")), "url", "left_semi")
    docs = _documents(spread(pages, "doc_id", always=True)).join(pages.select("doc_id", F.col("url").alias("doc_url")), "doc_id")
    return _listed(pl.proxy_texts(rich, docs.select("doc_url", "document"), TEXT_MARKER))


def q_lite_prompts(spark, d):
    """Q2 for every link: its summary page -> text and tables -> numeric
    context -> lite conversation.  Only the linked pages are parsed."""
    links = _links_rich(spark, d).select("doc_url", flt.summary_url(F.col("doc_url")).alias("url"))
    pages = ad.statement_pages(spark, d).join(links.select("url"), "url", "left_semi")
    # text, images and tables each read the node table: parse once
    nodes = materialize(html_nodes(spread(pages, "doc_id", always=True), **TABLE_TEXT), as_table=True)
    docs = (hx.extract_documents(pages, nodes).join(pages.select("doc_id", "url"), "doc_id")
            .join(links, "url").select("doc_url", "document.text", "document.tables"))
    return pr.flatten_messages(sm.lite_answer_prompts(docs, ["doc_url"]), ["doc_url"])


def _company_statements(spark, d):
    """the three statements of every company's latest 10-K (summary -> key
    match -> statement address -> page -> values, de-duplicated).  Only the
    wanted pages are rendered and parsed."""
    filings, keys = ad.filings(spark, d), statement_keys(spark)
    summary = ef.parse_filing_summary(ad.filing_summaries(spark, d), key_cols=["accession"])
    wanted, pages, nodes = _wanted_pages(spark, d, filings, summary, keys)
    return fu.company_statements(filings, summary, nodes, pages, keys, wanted=wanted)


def _wanted_pages(spark, d, filings, summary, keys):
    """The wanted statements, and the addresses and the nodes of their pages.  The wanted
    ones (three rows a company) and the parts of their pages are landed, the pages are not."""
    wanted = materialize(fu.wanted_statements(filings, summary, keys), as_table=True)
    pages = ad.all_statement_pages(spark, d, wanted.select("url"))
    pages = pages.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")))
    nodes = materialize(html_nodes(pages, **stm.STATEMENT_NODES, carry=["url", "copy"]), as_table=True)
    # every page has a row with its address; the copies of a page count as one, which each of them tells
    return wanted, nodes.select("doc_id", "url"), nodes.where(F.col("copy") == 1).drop("url", "copy")


def q_company_statements(spark, d):
    return _rounded(_company_statements(spark, d)[0])


def q_company_statement_errors(spark, d):
    return _company_statements(spark, d)[1]


def q_company_profile(spark, d):
    """rows of every part of the bundle per company."""
    filings, keys = ad.filings(spark, d), statement_keys(spark)
    summary = ef.parse_filing_summary(ad.filing_summaries(spark, d), key_cols=["accession"])
    wanted, pages, nodes = _wanted_pages(spark, d, filings, summary, keys)
    concept = ef.parse_company_concept(ad.company_concept_documents(spark, d, "NO"), doc_order="doc_order")
    p = fu.company_profile(filings, _facts(spark, d), concept, summary, nodes, pages, keys, wanted=wanted)
    parts = [df.select("cik", F.lit(name).alias("part")) for name, df in vars(p).items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("cik", "part").agg(F.count(F.lit(1)).alias("n"))


def q_accessions_of_form(spark, d):
    return flt.accessions_of_form(ad.filings(spark, d), "10-Q")


def q_requested_companies(spark, d):
    """P1 + P2 over a request table: each supplier asks for three companies."""
    s = ad.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    requests = s.select(F.concat(F.lit(" t"), "k", F.lit(" ,T"), F.col("k") + 10, F.lit(",no such")).alias("tickers"))
    found = flt.filter_by_tickers(ad.identifiers(spark, d), flt.explode_tickers(requests))
    return found.select("cik_str", "ticker", "title")


def q_company_slices(spark, d):
    """The links of the companies that a request names."""
    return flt.company_slices(q_proxy_links(spark, d, sort=False), "t1, T4 ,t22,none")


def q_statement_urls(spark, d):
    """P16 for every matched statement file (J6) of every filing."""
    files = q_statement_files(spark, d)
    filings = ad.filings(spark, d).select("cik", "accessionNumber", F.replace("accessionNumber", F.lit("-"), F.lit("")).alias("accession"))
    return flt.with_statement_url(filings.join(files, "accession")).drop("accession")


def q_fact_matrix(spark, d):
    """The largest value of each fact, one column a fact and back to rows,
    with its display form."""
    top = fx.dedupe_facts(_facts(spark, d)).groupBy("cik", "fact").agg(F.max("val").alias("value"))
    long = fx.to_long(fx.to_wide(top, "cik", "fact", "value", ["AF", "NF", "NO", "RF"]), "cik", "fact")
    return long.withColumn("shown", display_amount("value"))


def q_identifiers_parsed(spark, d):
    """S1 round trip: identifier JSON records -> rows (CIK zero-padded)."""
    docs = ad.identifier_documents(spark, d)
    return ef.parse_company_identifiers(docs).select("cik_str", "ticker", "title")


def q_submissions_parsed(spark, d):
    """S2 round trip: submission JSON (parallel arrays) -> filing rows."""
    from filings_engine.schemas import FILING_FIELDS
    return ef.parse_submissions(ad.submission_documents(spark, d)).select("cik", *FILING_FIELDS)


#: The documents of each kind.
DOCUMENTS = {
    "identifiers": ad.identifier_documents, "submissions": ad.submission_documents, "facts": ad.company_facts_documents,
    "concept": lambda spark, d: ad.company_concept_documents(spark, d, "NO"),
    "summary": lambda spark, d: ad.filing_summaries(spark, d).withColumn("doc_order", F.substring("accession", 1, 10).cast("long"))}


def _checked(spark, d, kind):
    """S1-S5 over documents some of which are spoilt: accounts, errors and rows."""
    return fc.check_documents(ad.broken_documents(DOCUMENTS[kind](spark, d), kind), kind, ["doc_order"])


def q_source_files(spark, d):
    """Every document with its number of rows and what is wrong with it."""
    parts = [_checked(spark, d, k).files.select(F.lit(k).alias("kind"), "doc_order", "n_rows", "reason") for k in DOCUMENTS]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def q_submissions_checked(spark, d):
    """The filings of the submission indexes that can be read."""
    return _checked(spark, d, "submissions").rows.select("cik", "accessionNumber", "form", "filingDate")


def q_facts_checked(spark, d):
    """S3: the facts of the documents that can be read; a value that is no number is null."""
    return _checked(spark, d, "facts").rows.select(FACT_COLS)


def q_links_written(spark, d):
    """The links are written, one folder for each of 25 desks, then those of
    every third desk again with the newest link of a company only; read back."""
    links = q_proxy_links(spark, d, sort=False).withColumn("desk", F.concat(F.lit("d"), F.col("cik").cast("long") % 25))
    path = f"{checkpoint_dir(spark).rstrip('/')}/links-{uuid.uuid4().hex}"
    ef.write_links(links, path, "parquet", partition_by="desk")
    again = links.where(F.col("cik").cast("long") % 25 % 3 == 0)
    newest = again.groupBy("ticker").agg(F.max(F.struct("filingDate", "accessionNumber")).alias("n")).select(F.col("n.accessionNumber").alias("accessionNumber"))
    ef.write_links(again.join(newest, "accessionNumber", "left_semi").select(links.columns), path, "parquet", partition_by="desk")
    return ef.read_links(spark, path, links, "parquet").drop("desk")


QUERIES = {
    "proxy_links": q_proxy_links,
    "links_view": q_links_view,
    "links_by_year": q_links_by_year,
    "coverage_gaps": q_coverage_gaps,
    "coverage_alerts": q_coverage_alerts,
    "cik_lookup": q_cik_lookup,
    "latest_filing": q_latest_filing,
    "first_filing": q_first_filing,
    "facts_flat": q_facts_flat,
    "facts_dedup": q_facts_dedup,
    "annual_facts": q_annual_facts,
    "quarterly_facts": q_quarterly_facts,
    "concept_series": q_concept_series,
    "digit_lines": q_digit_lines,
    "numeric_context": q_numeric_context,
    "after_marker": q_after_marker,
    "chunks": q_chunks,
    "token_profile": q_token_profile,
    "rank_chunks": q_rank_chunks,
    "tfidf_rank": q_tfidf_rank,
    "context": q_context,
    "prompts": q_prompts,
    "answer_fields": q_answer_fields,
    "rate_audit": q_rate_audit,
    "page_text": q_page_text,
    "page_links": q_page_links,
    "page_images": q_page_images,
    "page_tables": q_page_tables,
    "toc_sections": q_toc_sections,
    "statement_files": q_statement_files,
    "statement_values": q_statement_values,
    "statement_dedup": q_statement_dedup,
    "statement_errors": q_statement_errors,
    "proxy_texts": q_proxy_texts,
    "lite_prompts": q_lite_prompts,
    "company_statements": q_company_statements,
    "company_statement_errors": q_company_statement_errors,
    "reformat_prompts": q_reformat_prompts,
    "identifiers_parsed": q_identifiers_parsed,
    "submissions_parsed": q_submissions_parsed,
    "multi_step_prompts": q_multi_step_prompts,
    "filing_documents": q_filing_documents,
    "company_profile": q_company_profile,
    "accessions_of_form": q_accessions_of_form,
    "requested_companies": q_requested_companies,
    "company_slices": q_company_slices,
    "statement_urls": q_statement_urls,
    "fact_matrix": q_fact_matrix,
    "coverage_stream": q_coverage_stream,
    "filing_year_options": q_filing_year_options,
    "answer_kinds": q_answer_kinds,
    "question_chunks": q_question_chunks,
    "turn_vectors": q_turn_vectors,
    "rate_audit_hot": q_rate_audit_hot,
    "links_listing": q_links_listing,
    "source_files": q_source_files,
    "submissions_checked": q_submissions_checked,
    "facts_checked": q_facts_checked,
    "links_written": q_links_written,
}
