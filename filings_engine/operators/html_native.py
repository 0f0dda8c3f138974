r"""Text, links and images of pages by column expressions alone (H2, H3): no Python worker,
no shuffle, one array of tokens per page.

A page is cut into tokens by one pattern: comments, declarations, raw elements (``script``
and ``style`` with their content), tags, and the strings between them.  Strings inside
``template``, ``rt`` and ``rp`` are no document text: their tags are matched by running
depths over those few tags alone, and a string is left out if it lies between.

Equal to the node table (``html_nodes``) on all given pages.  It differs on markup that is
cut off or nested wrongly around those elements: an unclosed ``rt`` ends with its ``ruby``, a tag
without an end is text of its own, and a ``script`` that ends in ``/>`` is empty also
where the slash belongs to a bare value."""

from __future__ import annotations

import functools
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

from filings_engine.operators.html import strip

# --- fixed values: tokens of a page -------------------------------------------
ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+"""
TOKEN = "(?is)" + "|".join([
    r"<!--.*?(?:--\s*>|\z)",
    r"<!\[\s*(?:temp|cdata|ignore|include|rcdata)\b.*?\]\s*\]\s*>",
    r"<!\[\s*(?:if|else|endif)\b.*?\]\s*>",
    r"<![^>]*>", r"<\?[^>]*>",
    rf"<(script|style)(?=[\s/>]){ATTRIBUTES}(?<!/)>.*?(?=</\s*\1\s*>|\z)",
    rf"<[a-z]{ATTRIBUTES}>", r"</[^>]*>",
    r"(?:[^<]++|<(?![a-z/!?]))++", r"<"])
PLAIN_LINK = r"^(?:[A-Za-z0-9_-][A-Za-z0-9_.-]*/)*[A-Za-z0-9_-][A-Za-z0-9_.-]*$"
PLAIN_FOLDER = r"^(https?://[A-Za-z0-9-][A-Za-z0-9.-]*/(?:[A-Za-z0-9_-][A-Za-z0-9_.-]*/)*)[A-Za-z0-9_.-]*$"
MARKUP = r"^<[a-zA-Z/!?]"
ATTRIBUTE = r"""(?s)([^\s/>=]+)(?:\s*=+\s*("[^"]*"|'[^']*'|(?!["'])[^>\s]*))?"""
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
BRACKETED = r"^(?:[^@\[\]]*@)?\[[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?\](?::[0-9]*)?$"
JOINED_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp",
                  "svn", "svn+ssh", "ws", "wss"]
COMMON_REFERENCES = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\xa0"}
# ---------------------------------------------------------------------------------
REPLACEMENT = "�"
#: Names that count without their semicolon, the longest first.
BARE_NAMES = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_tokens(html) -> Column:
    return F.regexp_extract_all(_col(html), F.lit(TOKEN), F.lit(0))


def _tags_of(html, tag: str) -> Column:
    """The start tags of a name, in order: the tokens between them are passed over by the
    pattern (as ``TOKEN`` would cut them), none of them is listed."""
    own = rf"<{tag}(?=[\t\n\r\f />\x00]){ATTRIBUTES}>"
    return F.regexp_extract_all(_col(html), F.lit(rf"(?is)\G(?:(?!{own})(?:{TOKEN[5:]}))*+({own})"), F.lit(2))


def is_markup(token: Column) -> Column:
    return token.rlike(MARKUP) & (F.length(token) > 1)


# --- character references -----------------------------------------------------------
def _code_point(code: Column) -> Column:
    """The character of a numeric reference, by the rules for bad ones."""
    western = F.array(*[F.lit(bytes([c]).decode("cp1252", "ignore") or chr(c)) for c in range(0x80, 0xA0)])
    none = (code.between(1, 8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code % 0x10000 >= 0xFFFE))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), REPLACEMENT)
            .when(code.between(0x80, 0x9F), F.get(western, (code - 0x80).cast("int"))).when(none, "").otherwise(char))


def _reference(x: Column) -> Column:
    """What follows an ampersand (its text, name and bare name), resolved."""
    name, bare = x["name"], x["bare"]
    rest = F.substring(x["p"], F.length(name) + 1, F.length(x["p"]))
    names = F.str_to_map(F.lit("\ue000".join(f"{k}\ue001{v}" for k, v in html5.items())), F.lit("\ue000"), F.lit("\ue001"))
    known = functools.reduce(lambda w, r: w.when(name == r[0], r[1]), COMMON_REFERENCES.items(), F.when(x["code"].isNotNull(), _code_point(x["code"])))
    known = known.when(bare == name, names[name])
    named = F.coalesce(known, F.when(name.endswith(";"), names[name]),
                       F.when(bare != "", F.concat(names[bare], F.substring(name, F.length(bare) + 1, F.length(name)))), F.concat(F.lit("&"), name))
    return F.when(name == "", F.concat(F.lit("&"), x["p"])).otherwise(F.concat(named, rest))


def _number(name: Column) -> Column:
    """The code of a numeric reference, null for a name."""
    digits = F.ltrim(F.regexp_replace(name, "[#xX;]", ""), F.lit("0"))

    def code(base: int, most: int) -> Column:
        return F.when(F.length(digits) > most, 0x110000).otherwise(F.conv(F.concat(F.lit("0"), digits), base, 10).cast("long"))
    return F.when(name.rlike("^#[xX]"), code(16, 7)).when(name.startswith("#"), code(10, 8))


def unescape(text) -> Column:
    """The text with its character references resolved."""
    text = _col(text)
    # in stages, so that each part is worked out once a reference
    pieces = F.transform(F.slice(F.split(text, "&", -1), F.lit(2), F.length(text)), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, REFERENCE, 1).alias("name")))
    pieces = F.transform(pieces, lambda x: F.struct(x["p"].alias("p"), x["name"].alias("name"), F.regexp_extract(x["name"], BARE_NAMES, 1).alias("bare"), _number(x["name"]).alias("code")))
    done = F.concat(F.substring_index(text, "&", 1), F.array_join(F.transform(pieces, _reference), ""))
    return F.when(text.contains("&"), done).otherwise(text)


# --- H2 ---------------------------------------------------------------------------------
def _hidden(tokens: Column) -> Column:
    """The places between which strings are no document text, from the tags of
    ``template``, ``rt`` and ``rp`` (and the end of ``ruby``) alone."""
    tagged = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.lower(F.regexp_extract(t, r"^<(/?(?:template|rt|rp|ruby))(?=[\s/>])", 1)).alias("n"), t.endswith("/>").alias("empty")))
    events = F.filter(tagged, lambda e: (e["n"] != "") & (e["n"] != "ruby") & ~e["empty"])
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("rt"), F.lit(-1).alias("since"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        depth = F.when(e["n"] == "template", s["depth"] + 1).when(e["n"] == "/template", F.greatest(F.lit(0), s["depth"] - 1)).otherwise(s["depth"])
        rt = F.when(e["n"].isin("rt", "rp"), True).when(e["n"].isin("/rt", "/rp", "/ruby"), False).otherwise(s["rt"])
        was, now = s["since"] >= 0, (depth > 0) | rt
        span = F.array(F.struct(s["since"].alias("lo"), e["i"].alias("hi")))
        return F.struct(depth.alias("depth"), rt.alias("rt"), F.when(now, F.when(was, s["since"]).otherwise(e["i"])).otherwise(-1).alias("since"),
                        F.when(was & ~now, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    end = F.lit(2 ** 31 - 1)
    return F.aggregate(events, start, step, lambda s: F.when(s["since"] >= 0, F.concat(s["out"], F.array(F.struct(s["since"].alias("lo"), end.alias("hi"))))).otherwise(s["out"]))


def page_text(pages: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """H2: ``(doc_id, text)``: stripped non-empty strings joined by newline; a page
    without any (or a null one) has empty text."""
    rows = pages.select(doc_id, page_tokens(html).alias("_tokens"), F.lower(html).rlike("<(?:template|rt|rp)").alias("_any"))
    rows = rows.withColumn("_hidden", F.when(F.col("_any"), _hidden(F.col("_tokens"))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>")))
    strings = F.filter("_tokens", lambda t, i: ~is_markup(t) & ~F.exists("_hidden", lambda h: (h["lo"] < i) & (i < h["hi"])))
    texts = F.filter(F.transform(strings, lambda t: strip(unescape(t))), lambda t: t != "")
    return rows.select(doc_id, F.coalesce(F.array_join(texts, "\n"), F.lit("")).alias("text"))


# --- links and images -----------------------------------------------------------------
def _tags(pages: DataFrame, tag: str, attr: str, keep: list[str], html: str) -> DataFrame:
    """``(*keep, pos, value)`` of each tag of a name that has the attribute: its last
    value, empty without one; ``pos`` is its number among the tags of the name."""
    rows = pages.select(*keep, F.posexplode(_tags_of(html, tag)).alias("pos", "_t"))
    # in stages, so that each part is worked out once a tag
    rows = rows.select(*keep, "pos", F.regexp_extract_all(F.regexp_replace("_t", r"^<[a-zA-Z][^\t\n\r\f />\x00]*|/?>$", ""), F.lit(ATTRIBUTE), F.lit(0)).alias("_a"))
    rows = rows.withColumn("_a", F.filter("_a", lambda a: F.lower(F.regexp_extract(a, ATTRIBUTE, 1)) == attr))
    rows = rows.select(*keep, "pos", F.regexp_extract(F.try_element_at("_a", F.lit(-1)), ATTRIBUTE, 2).alias("_v"))
    quoted = F.substring("_v", 1, 1).isin("'", '"')
    rows = rows.select(*keep, "pos", F.when(quoted, F.expr("substring(_v, 2, length(_v) - 2)")).otherwise(F.col("_v")).alias("_v"))
    return _only(rows.select(*keep, "pos", unescape("_v").alias("value")), keep, "value")


def _only(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    """The rows with a value.  A filter would be pushed down and work the value out
    again below each stage; a generator is not."""
    return df.select(*keep, F.inline(F.filter(F.array(F.struct("pos", value)), lambda x: x[value].isNotNull())))


def page_links(pages: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """``(doc_id, pos, href)`` of every anchor with an href; ``pos`` is its number
    among the anchors of the page, so it orders the links."""
    return _tags(pages, "a", "href", [doc_id], html).withColumnRenamed("value", "href")


def page_images(pages: DataFrame, doc_id: str = "doc_id", html: str = "html", url: str = "url") -> DataFrame:
    """H3: ``(doc_id, pos, url)`` of every image with a non-empty source,
    resolved against the page's address; duplicates kept, sources that are no address
    left out.  Plain relative sources only follow the folder of a plain address; the
    others are joined by the rules."""
    based = pages.withColumnRenamed(url, "_base").withColumn("_folder", F.regexp_extract("_base", PLAIN_FOLDER, 1))
    rows = _tags(based, "img", "src", [doc_id, "_base", "_folder"], html)
    rows = rows.withColumn("_plain", (F.col("_folder") != "") & F.col("value").rlike(PLAIN_LINK) & ~F.col("value").endswith("\n"))
    odd = F.coalesce(~F.col("_plain"), F.lit(True))
    rows = rows.withColumns({"_odd_base": F.when(odd, F.col("_base")), "_odd_value": F.when(odd, F.col("value"))})
    joined = join_urls(rows, "_odd_base", "_odd_value", "url")
    address = F.when(F.col("_plain"), F.concat("_folder", "value")).otherwise(F.col("url"))
    return _only(joined.select(doc_id, "pos", F.when(F.col("value") != "", address).alias("url")), [doc_id], "url")


def join_urls(df: DataFrame, base: str, link: str, out: str) -> DataFrame:
    """``df`` with the link against the address of its page in ``out``; null if a host
    in either is no host."""
    some = F.col(base).isNotNull() | F.col(link).isNotNull()          # without any, nothing is worked out
    clean = {n: F.regexp_replace(F.regexp_replace(F.when(some, F.coalesce(F.col(c), F.lit(""))), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "") for n, c in (("_b", base), ("_u", link))}
    part = {"scheme": 1, "host": 2, "path": 3, "query": 4, "fragment": 5}
    x = df.select("*", *[c.alias(n) for n, c in clean.items()])
    x = x.select("*", *[F.struct(*[F.regexp_extract(n, URL, i).alias(p) for p, i in part.items()]).alias(f"{n}p") for n in clean])
    b, u = F.col("_bp"), F.col("_up")
    scheme, other = F.lower(F.when(u["scheme"] != "", u["scheme"]).otherwise(b["scheme"])), F.lower(b["scheme"])
    steps = F.split(u["path"], "/", -1)
    directory = F.split(F.regexp_replace(b["path"], r"[^/]+$", ""), "/", -1)
    directory = F.when(b["path"].rlike("[^/]$"), F.slice(directory, 1, F.size(directory) - 1)).otherwise(directory)
    x = x.select("*", scheme.alias("_scheme"), other.alias("_other"), F.when(u["host"] != "", u["host"]).otherwise(b["host"]).alias("_host"),
                 F.when(u["path"].startswith("/"), steps).otherwise(F.concat(directory, steps)).alias("_steps"))
    x = x.withColumn("_steps", F.filter("_steps", lambda s, i: (s != "") | (i == 0) | (i == F.size("_steps") - 1)))
    walked = F.aggregate("_steps", F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)))
                         .when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    x = x.withColumn("_walked", F.array_join(F.concat(walked, F.when(F.element_at("_steps", -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))
    own, same = u["host"] != "", u["path"] == ""
    path = F.when(own, u["path"]).when(same, b["path"]).when(F.col("_walked") == "", "/").otherwise(F.col("_walked"))
    x = x.select("*", path.alias("_path"), F.when(~own & same & (u["query"] == ""), b["query"]).otherwise(u["query"]).alias("_query"))
    rooted = F.when((F.col("_host") != "") & (F.col("_path") != "") & ~F.col("_path").startswith("/"), F.lit("/")).otherwise("")
    whole = F.concat(F.when(F.col("_scheme") != "", F.concat("_scheme", F.lit(":"))).otherwise(""), F.when(F.col("_host") != "", F.concat(F.lit("//"), "_host")).otherwise(""),
                     rooted, "_path", F.when(F.col("_query") != "", F.concat(F.lit("?"), "_query")).otherwise(""),
                     F.when(u["fragment"] != "", F.concat(F.lit("#"), u["fragment"])).otherwise(""))
    bad = functools.reduce(lambda p, q: p | q, [h["host"].rlike(r"[\[\]]") & ~h["host"].rlike(BRACKETED) for h in (b, u)])
    foreign = (F.col("_scheme") != F.col("_other")) | ~F.col("_scheme").isin(JOINED_SCHEMES)
    plain = F.col(base).isNull() | (F.col(base) == "")
    joined = F.when(plain, F.col(link)).when(F.col(link) == "", F.col(base)).when(bad, None).when(foreign, F.col(link)).otherwise(whole)
    return x.select(*[F.col(f"`{c}`") for c in df.columns], joined.alias(out))
