"""Document jobs over the H1 node table.

Containment ("descendants of X") is an interval of pre-order positions: a
binned interval join, whose work follows the matches, never a pair of every
node with every element of a page.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from filings_engine.operators.html_nodes import PageParts

# --- fixed values -----------------------------------------------------------
TOC_HEADING = "TABLE OF CONTENTS"
TOC_CONTAINERS = ["div", "span"]
TOC_SKIP_WORD = "part"
# ---------------------------------------------------------------------------

#: Unicode white space and the separators that Python strips as well.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip(c) -> Column:
    """Python-style strip: Unicode white space at both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WHITE_SPACE))


def text_nodes(nodes: DataFrame) -> DataFrame:
    """Document strings (not script/style/template/ruby text, comments or
    declarations)."""
    return nodes.filter(F.col("kind") == "text")


def interval_join(points: DataFrame, intervals: DataFrame, pos: str, lo: str, hi: str,
                  key: str = "doc_id", bin_size: int = 64) -> DataFrame:
    """J9 as a binned range join: points with ``lo < pos < hi`` of the same
    ``key``.  Each interval is listed once per position bin it covers and
    joined on (key, bin), so work is proportional to the matches plus the
    intervals' length / bin_size, never to all pairs of a document."""
    b = F.lit(bin_size)
    first, last = F.floor((F.col(lo) + 1) / b), F.floor((F.col(hi) - 1) / b)
    iv = intervals.select("*", F.explode(F.when(F.col(hi) - F.col(lo) >= 2, F.sequence(first, last)))
                          .alias("_bin"))
    pt = points.withColumn("_bin", F.floor(F.col(pos) / b))
    return (pt.join(iv, [key, "_bin"]).filter((F.col(pos) > F.col(lo)) & (F.col(pos) < F.col(hi)))
            .drop("_bin"))


def descendants(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes inside each ``outer`` element ``(doc_id, outer_pos,
    outer_end, ...)``; a node inside nested outer elements has a row for each."""
    o = outer.withColumn("_hi", F.col("outer_end") + 1)
    return interval_join(nodes, o, "pos", "outer_pos", "_hi").drop("_hi")


def element_texts(nodes: DataFrame, elements: DataFrame, sep: str = "") -> DataFrame:
    """``(doc_id, outer_pos, text)``: the strings inside each element
    ``(doc_id, outer_pos, outer_end)`` joined in document order; an element
    without strings has no row."""
    strings = text_nodes(nodes).select("doc_id", "pos", "text")
    return descendants(strings, elements).groupBy("doc_id", "outer_pos").agg(_joined("text", sep).alias("text"))


def _joined(text: str, sep: str, order: str = "pos") -> Column:
    """Strings of a group joined by ``sep`` in ``order`` (ordered listagg)."""
    return F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY {order})")


# --- H2, H3, H4, H5 --------------------------------------------------------------

def page_text(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """H2: stripped non-empty strings joined by newline, document order.  With
    ``pages`` (doc_id), pages without any string keep a row with empty text."""
    t = text_nodes(nodes).select("doc_id", "pos", strip("text").alias("s")).filter(F.col("s") != "")
    texts = t.groupBy("doc_id").agg(_joined("s", "\\n").alias("text"))
    if pages is None:
        return texts
    return pages.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def page_images(nodes: DataFrame) -> DataFrame:
    """H3: ``(doc_id, pos, url)`` of every image with a non-empty source,
    resolved against the page URL; duplicates kept."""
    return (nodes.filter((F.col("tag") == "img") & F.col("link").isNotNull())
            .select("doc_id", "pos", F.col("link").alias("url")))


def page_tables(nodes: DataFrame) -> DataFrame:
    """H4: ``(doc_id, table_pos, text)`` for every table (nested ones too, so
    inner text appears in both), strings stripped and joined by a space;
    tables without text are dropped."""
    t = (text_nodes(nodes).select("doc_id", "pos", "table_path", strip("text").alias("s"))
         .filter(F.col("s") != ""))
    a = t.select("doc_id", F.explode("table_path").alias("table_pos"), "pos", "s")
    return a.groupBy("doc_id", "table_pos").agg(_joined("s", " ").alias("text"))


def numbered_tables(page_tables: DataFrame) -> DataFrame:
    """H4 of ``html_tables``: ``(doc_id, table_no, table_pos, text)`` with the number of the
    table among those of its page that have text.  The pages of one ``doc_id`` count as
    one, as in ``page_tables``; what is gathered is one page's, which a task holds anyway."""
    pages = page_tables.groupBy("doc_id").agg(F.collect_list("tables").alias("_p"))
    found = F.flatten("_p")

    def merged(pos: Column) -> Column:
        same = F.filter(found, lambda t: t["pos"] == pos)
        parts = F.flatten(F.transform(same, lambda t: F.arrays_zip(t["places"].alias("place"), t["strings"].alias("s"))))
        return F.transform(F.array_sort(parts), lambda x: x["s"])

    one = F.transform(F.get("_p", F.lit(0)), lambda t: F.struct(t["pos"].alias("pos"), F.array_join(t["strings"], " ").alias("text")))
    several = F.transform(F.array_sort(F.array_distinct(F.transform(found, lambda t: t["pos"]))),
                          lambda p: F.struct(p.alias("pos"), F.array_join(merged(p), " ").alias("text")))
    texts = F.filter(F.when(F.size("_p") == 1, one).otherwise(several), lambda t: t["text"] != "")
    return (pages.select("doc_id", F.posexplode(texts).alias("table_no", "_t"))
            .select("doc_id", F.col("table_no").cast("long").alias("table_no"), F.col("_t.pos").alias("table_pos"), "_t.text"))


def page_links(nodes: DataFrame) -> DataFrame:
    """``(doc_id, pos, href)`` of every anchor carrying an href."""
    return (nodes.filter((F.col("tag") == "a") & F.col("attrs").getItem("href").isNotNull())
            .select("doc_id", "pos", F.col("attrs")["href"].alias("href")))


def _page_document(nodes: dict[str, Sequence]) -> tuple:
    """``(text, images, tables)`` of a page: H2, H3 and H4 in document order."""
    strings, images, tables = [], [], {}
    for pos, kind, text, tag, link, around in zip(*(nodes[c] for c in ("pos", "kind", "text", "tag", "link", "table_path"))):
        if kind == "text":
            s = text.strip()
            if s:
                strings.append(s)
                for t in around or ():
                    tables.setdefault(t, []).append(s)
        elif tag == "img" and link is not None:
            images.append((pos, link))
    return "\n".join(strings), [link for _, link in sorted(images)], [" ".join(tables[t]) for t in sorted(tables)]


_STRINGS = T.ArrayType(T.StringType())
#: What H5 reads of a page (arguments of ``html_nodes``): a row for every page.
DOCUMENT_NODES = dict(elements=["img"], id_elements=False, blank_text=False, columns=["pos", "kind", "text", "tag", "link", "table_path"],
                      parts=PageParts((T.StructField("text", T.StringType()), T.StructField("images", _STRINGS), T.StructField("tables", _STRINGS)), _page_document))


def extract_documents(pages: DataFrame, nodes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """H5: ``(doc_id, document struct<text, images, tables>)``; the
    document is null for a page whose fetch failed (``status`` <> 200).

    ``nodes``: the nodes of ``pages``, or these read with ``DOCUMENT_NODES`` and
    ``carry=["status"]`` (if there is one), a row for every page; then nothing is joined."""
    if "images" in nodes.columns:
        read = F.col("status") == 200 if "status" in nodes.columns else F.lit(True)
        return nodes.select("doc_id", F.when(read, F.struct("text", "images", "tables")).alias("document"))
    text = page_text(nodes)
    imgs = (page_images(nodes).groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("_i"))
            .select("doc_id", F.transform("_i", lambda x: x["url"]).alias("images")))
    tabs = (page_tables(nodes).groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("table_pos", "text"))).alias("_t"))
            .select("doc_id", F.transform("_t", lambda x: x["text"]).alias("tables")))
    ok = F.col("status") == 200 if "status" in pages.columns else F.lit(True)
    base = pages.select(F.col(doc_id).alias("doc_id"), ok.alias("_ok"))
    j = base.join(text, "doc_id", "left").join(imgs, "doc_id", "left").join(tabs, "doc_id", "left")
    empty = F.array().cast("array<string>")
    doc = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("images", empty).alias("images"),
                   F.coalesce("tables", empty).alias("tables"))
    return j.select("doc_id", F.when(F.col("_ok"), doc).alias("document"))


# --- H7, H8: contents of a page as one row ------------------------------------

def _heading_place(nodes: dict[str, Sequence], strings: list[tuple], heading: str) -> int | None:
    """The position of the first div/span whose joined strings hold the heading; see ``contents_heading``."""
    joined, places, at = "".join(s for _, _, s in strings), [], 0
    while (at := joined.find(heading, at)) >= 0:
        places.append(at)
        at += len(heading)
    if places:
        for pos, tag, start, end in zip(*(nodes[c] for c in ("pos", "tag", "text_start", "text_end"))):
            if tag in TOC_CONTAINERS:
                i = bisect_left(places, start)
                if i < len(places) and places[i] + len(heading) <= end:
                    return pos
    return None


def _contents_page(nodes: dict[str, Sequence]) -> tuple:
    """``(rows, anchors, strings)`` of a page.  ``rows``: those with two cells in tables after
    the contents heading, with the joined strings of the first two cells and the links of the
    second; ``anchors``: the first element of each id, with the places among ``strings`` where
    it starts, what follows it starts, and its parent ends; ``strings``: stripped, not empty."""
    texts, links, anchors, rows = [], [], {}, {}
    for pos, end, parent, parent_end, kind, tag, attrs, text in zip(*(nodes[c] for c in ("pos", "end_pos", "parent_pos", "parent_end", "kind", "tag", "attrs", "text"))):
        if kind == "text":
            texts.append((pos, parent, text))
        elif attrs:
            own = dict(attrs)
            if tag == "a" and own.get("href") is not None:
                links.append((pos, own["href"].strip().replace("#", "")))
            if kind == "element" and own.get("id") is not None:
                anchors.setdefault(own["id"], (pos, end, parent, parent_end))
    heading = _heading_place(nodes, texts, TOC_HEADING)
    links.sort()
    text_places, link_places = [p for p, _, _ in texts], [p for p, _ in links]

    def inside(places: list[int], cell: int, end: int) -> range:
        return range(bisect_right(places, cell), bisect_right(places, end))

    for pos, tag, cells, ends, around in zip(*(nodes[c] for c in ("pos", "tag", "cells", "cell_ends", "table_path"))) if heading is not None else ():
        tables = [t for t in around or () if t > heading]
        if tag != "tr" or not tables or len(cells or ()) < 2:
            continue
        row = rows.setdefault(pos, (tables, [], [], []))
        row[1].extend(inside(text_places, cells[0], ends[0]))
        row[2].extend(inside(text_places, cells[1], ends[1]))
        row[3].extend(inside(link_places, cells[1], ends[1]))
    listed = [(pos, tables, "".join(texts[i][2] for i in sorted(first)), "".join(texts[i][2] for i in sorted(second)), [links[i][1] for i in sorted(ids)])
              for pos, (tables, first, second, ids) in sorted(rows.items())]
    strings = [(parent, s) for _, parent, text in texts if (s := text.strip())]
    places = [p for p, _, text in texts if text.strip()]
    found = [(name, pos, parent, bisect_left(places, pos), bisect_right(places, end), bisect_right(places, parent_end))
             for name, (pos, end, parent, parent_end) in anchors.items()]
    return listed, found, strings


def _fields(**types: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in types.items()]))


_INT, _STR = T.IntegerType(), T.StringType()
#: What H7 and H8 read of a page (arguments of ``html_nodes``): a row per page.
CONTENTS_NODES = dict(
    elements=["div", "span", "tr", "a"], columns=["pos", "end_pos", "parent_pos", "parent_end", "kind", "tag", "attrs", "text", "text_start", "text_end",
                                                  "cells", "cell_ends", "table_path"],
    parts=PageParts((T.StructField("toc_rows", _fields(row_pos=_INT, tables=T.ArrayType(_INT), first=_STR, second=_STR, ids=T.ArrayType(_STR))),
                     T.StructField("anchors", _fields(id=_STR, pos=_INT, parent_pos=_INT, starts=_INT, follows=_INT, parent_ends=_INT)),
                     T.StructField("strings", _fields(parent_pos=_INT, s=_STR))), _contents_page))


def _page_entries(nodes: DataFrame) -> DataFrame:
    """H7 of page rows: ``entries`` in place of ``toc_rows``."""
    kept = F.filter(F.transform("toc_rows", lambda r: F.struct(
        r["tables"].alias("tables"), r["row_pos"].alias("row_pos"), strip(r["first"]).alias("value"), strip(r["second"]).alias("title"), r["ids"].alias("ids"))),
        lambda r: (r["value"] != "") & ~F.lower(r["value"]).contains(TOC_SKIP_WORD))
    entries = F.flatten(F.transform(kept, lambda r: F.transform(r["tables"], lambda t: F.struct(
        t.alias("table_pos"), *[r[c].alias(c) for c in ("row_pos", "value", "title", "ids")]))))
    return nodes.withColumn("entries", entries).drop("toc_rows")


def _page_ids(entries: DataFrame) -> DataFrame:
    """The contents ids of page rows in reading order: ``ids`` in place of ``entries``."""
    ordered = F.array_sort(F.transform("entries", lambda e: F.struct(e["table_pos"], e["row_pos"], e["ids"].alias("ids"))))
    return entries.withColumn("ids", F.flatten(F.transform(ordered, lambda e: e["ids"]))).drop("entries")


def _page_sections(ids: DataFrame) -> DataFrame:
    """H8 of page rows: every section is a slice of the page's strings."""
    anchor = F.map_from_entries(F.transform("anchors", lambda a: F.struct(a["id"].alias("key"), a.alias("value"))))
    page = ids.select("doc_id", "strings", "ids", anchor.alias("_a"))

    def section(name, k):
        later = F.get("ids", k + 1)
        return F.struct(name.alias("id"), k.alias("k"), F.try_element_at("_a", name).alias("a"), later.alias("later"),
                        F.when(later.isNotNull(), F.try_element_at("_a", later)).alias("e"))

    found = F.filter(F.transform("ids", section), lambda s: s["a"].isNotNull() & (s["later"].isNull() | s["e"].isNotNull()))
    page = page.select("doc_id", "strings", F.array_sort(F.transform(found, lambda s: F.struct(s["id"].alias("id"), s["k"].alias("k"), s["a"].alias("a"), s["e"].alias("e")))).alias("_s"))
    # an id met twice keeps its last section
    last = F.filter("_s", lambda s, i: F.coalesce(F.get("_s", i + 1)["id"] != s["id"], F.lit(True)))
    page = page.select("doc_id", "strings", F.explode(last).alias("_s"))
    a, e = F.col("_s.a"), F.col("_s.e")
    stop = F.when((e["parent_pos"] == a["parent_pos"]) & (e["pos"] > a["pos"]), e["starts"]).otherwise(a["parent_ends"])
    inside = F.filter(F.slice("strings", a["follows"] + 1, F.greatest(stop - a["follows"], F.lit(0))), lambda s: s["parent_pos"] != a["parent_pos"])
    return page.select("doc_id", F.col("_s.id").alias("id"), F.array_join(F.transform(inside, lambda s: s["s"]), " ").alias("text"))


# --- H7: table-of-contents entries -------------------------------------------

def contents_heading(nodes: DataFrame, heading: str = TOC_HEADING) -> DataFrame:
    """``(doc_id, toc_pos)``: the first div/span whose joined strings hold the
    heading, also when it is split over several elements.  The heading's places
    in the page's joined strings are compared with the elements' offsets."""
    n = len(heading)
    pages = (text_nodes(nodes).groupBy("doc_id").agg(_joined("text", "").alias("t"))
             .filter(F.col("t").contains(heading)))
    before = F.slice(F.split("t", f"\\Q{heading}\\E", -1), 1, F.size(F.split("t", f"\\Q{heading}\\E", -1)) - 1)
    places = F.aggregate(before, F.array().cast("array<int>"), lambda acc, piece: F.array_append(
        acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + n, F.lit(0)) + F.length(piece)))
    places = pages.select("doc_id", places.alias("places"))
    boxes = nodes.filter(F.col("tag").isin(TOC_CONTAINERS)).select("doc_id", "pos", "text_start", "text_end")
    holds = F.exists("places", lambda p: (p >= F.col("text_start")) & (p + n <= F.col("text_end")))
    return boxes.join(places, "doc_id").filter(holds).groupBy("doc_id").agg(F.min("pos").alias("toc_pos"))


def toc_entries(nodes: DataFrame) -> DataFrame:
    """H7: ``(doc_id, table_pos, row_pos, value, title, ids)``.

    The contents heading is the first div/span whose text holds the heading
    phrase; every table after it is read (no break); a row with at least two
    cells, a non-empty first cell not containing the skip word, gives value,
    title and the hrefs of the second cell with ``#`` removed.

    Strings and links meet the two cells in one interval join, and one
    aggregation per row builds the entry.

    Of ``nodes`` read with ``CONTENTS_NODES`` (a row per page) the entries are a column
    ``entries`` of that row, which ``toc_ids`` and ``toc_sections`` take on: no shuffle."""
    if "toc_rows" in nodes.columns:
        return _page_entries(nodes)
    rows = nodes.filter((F.col("tag") == "tr") & (F.size("cells") >= 2)).select(
        "doc_id", F.col("pos").alias("row_pos"), "cells", "cell_ends", "table_path")
    rows = rows.join(contents_heading(nodes), "doc_id").select(
        "doc_id", "row_pos", "cells", "cell_ends",
        F.filter("table_path", lambda t: t > F.col("toc_pos")).alias("tables")).filter(F.size("tables") > 0)
    cells = rows.select("doc_id", "row_pos", "tables", F.posexplode(F.arrays_zip(
        F.col("cells").alias("outer_pos"), F.col("cell_ends").alias("outer_end"))).alias("cell_no", "c")).select(
        "doc_id", "row_pos", "tables", "cell_no", "c.*")
    href = F.when(F.col("tag") == "a", F.col("attrs")["href"])
    parts = (nodes.filter((F.col("kind") == "text") | href.isNotNull())
             .select("doc_id", "pos", F.when(F.col("kind") == "text", F.col("text")).alias("text"),
                     F.replace(strip(href), F.lit("#"), F.lit("")).alias("id")))
    inside = descendants(parts, cells).select(
        "doc_id", "row_pos", "tables", "pos", F.when(F.col("cell_no") == 0, F.col("text")).alias("first"),
        F.when(F.col("cell_no") == 1, F.col("text")).alias("second"),
        F.when((F.col("cell_no") == 1) & F.col("id").isNotNull(), F.struct("pos", "id")).alias("link"))
    entries = inside.groupBy("doc_id", "row_pos").agg(
        F.first("tables").alias("tables"), strip(_joined("first", "")).alias("value"),
        F.coalesce(strip(_joined("second", "")), F.lit("")).alias("title"),
        F.transform(F.array_sort(F.collect_list("link")), lambda x: x["id"]).alias("ids"))
    entries = entries.filter((F.col("value") != "") & ~F.lower("value").contains(TOC_SKIP_WORD))
    return entries.select("doc_id", F.explode("tables").alias("table_pos"), "row_pos", "value", "title", "ids")


def toc_ids(entries: DataFrame) -> DataFrame:
    """``(doc_id, k, id)``: the contents ids in reading order (tables, rows,
    links), duplicates kept.  For page rows a column ``ids``."""
    if "entries" in entries.columns:
        return _page_ids(entries)
    e = entries.select("doc_id", "table_pos", "row_pos", F.posexplode("ids").alias("i", "id"))
    w = Window.partitionBy("doc_id").orderBy("table_pos", "row_pos", "i")
    return e.select("doc_id", (F.row_number().over(w) - 1).alias("k"), "id")


# --- H8: sections between anchors ----------------------------------------------

def toc_sections(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """H8: ``(doc_id, id, text)``: for consecutive ids, the text (strings
    joined by a space) of the elements following the start anchor among its
    siblings, up to the end anchor; the last id runs to the last sibling.
    A missing anchor skips the section; an end anchor that is not a sibling
    lets the text run to the last sibling; an id met twice keeps its last
    section.

    The siblings' subtrees form one contiguous pre-order range, so each
    section is an open interval (lo, hi) of positions, and its strings are
    those in the range that are not direct children of the anchor's parent:
    an interval join (binned, see ``interval_join``), no ancestor paths.  In page rows
    (``toc_ids`` of such) it is a slice of the row's strings."""
    if "ids" in ids.columns:
        return _page_sections(ids)
    w = Window.partitionBy("doc_id").orderBy("k")
    seq = ids.select("doc_id", "k", "id", F.lead("id").over(w).alias("next_id"),
                     F.lead("k").over(w).alias("next_k"))
    anchors = (nodes.filter((F.col("kind") == "element") & F.col("attrs").getItem("id").isNotNull())
               .groupBy("doc_id", F.col("attrs")["id"].alias("id"))
               .agg(F.min_by(F.struct("pos", "end_pos", "parent_pos", "parent_end"), "pos").alias("a")))
    st = anchors.select("doc_id", "id", "a.pos", "a.end_pos", "a.parent_pos", "a.parent_end")
    en = anchors.select("doc_id", F.col("id").alias("next_id"), F.col("a.pos").alias("end_anchor"),
                        F.col("a.parent_pos").alias("end_parent"))
    sec = seq.join(st, ["doc_id", "id"]).join(en, ["doc_id", "next_id"], "left")
    sec = sec.filter(F.col("next_id").isNull() | F.col("end_anchor").isNotNull())
    sibling_end = ((F.col("end_parent") == F.col("parent_pos")) & (F.col("end_anchor") > F.col("pos")))
    sec = sec.select("doc_id", "k", "id", "parent_pos", F.col("end_pos").alias("lo"),
                     F.when(sibling_end, F.col("end_anchor")).otherwise(F.col("parent_end") + 1).alias("hi"))
    # keep the last section of an id met twice
    sec = (sec.groupBy("doc_id", "id").agg(F.max_by(F.struct("k", "parent_pos", "lo", "hi"), "k").alias("s"))
           .select("doc_id", "id", "s.*"))
    t = (text_nodes(nodes).select("doc_id", "pos", F.col("parent_pos").alias("own_parent"),
                                  strip("text").alias("s"))
         .filter(F.col("s") != ""))
    hit = interval_join(t, sec, "pos", "lo", "hi").filter(F.col("own_parent") != F.col("parent_pos"))
    texts = hit.groupBy("doc_id", "id").agg(_joined("s", " ").alias("text"))
    # adjacent anchors enclose nothing: an empty section
    return sec.select("doc_id", "id").join(texts, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("text", F.lit("")).alias("text"))
