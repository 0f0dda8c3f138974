"""Personal data by gradient boosting over candidate spans (DataFrame functions
only).

Base patterns (email, ip, card, phone) give spans that always stay.  For each
kind a second, high-recall generator proposes spans that overlap whatever it
likes: obfuscated emails, addresses with other dots, cards with other separators,
phones without a plus.  Every proposal is described by format and context bits.
Proposals that overlap a base span of their kind are the positive examples, the
others the unlabelled ones.  The bits leave out what tells the base pattern from
the generator, so a proposal that looks like the positives in all other respects
scores like them.

Learning: the counts of each (kind, bit vector) over all proposals of all documents
are the training table; it has at most ``4 * 2 ** len(FEATURES)`` rows whatever the
corpus, and boosted trees of depth two are fitted to it on the driver.  Scores are
calibrated by isotonic regression on the share of positives; a kind's threshold is
the lowest score with a calibrated share of ``PRECISION``.  Unlabelled proposals
over the threshold are added.

Spans are code points, end exclusive, and are found by splitting the text at the
matches: a span's start is the running sum of the lengths before it, so no position is
searched for and the work is linear in the text.

Defined results: null and empty texts have no spans; rows equal in id and text get
the same spans; null ids keep their rows; extra columns do not take part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from filings_engine.llm.common import boxed, cut_lineage, quoted

KINDS = ["email", "ip", "card", "phone"]
#: Possessive and anchored forms of the base patterns: a match can only start where a
#: run of its first class starts or the last match ended, so each is linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DOT = r"(?:\.|\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?|\x20dot\x20)"
AT = r"(?:@|\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?|\x20at\x20)"
WIDE = {
    "email": rf"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++{AT}[a-z0-9-]++(?:{DOT}[a-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|,|\x20?[\[(](?:\.|dot)[\])]\x20?)[0-9]{1,3}+){3}(?![0-9])",
    "card": r"[0-9](?:[\x20._/\xA0-]{0,2}[0-9])++",
    "phone": r"[+(]{0,2}[0-9](?:[\x20().\xA0/-]{0,3}[0-9])++",
}
FEATURES = ["digits_9_11", "digits_12_15", "digits_13_19", "luhn", "ip_parts", "one_run", "bracket", "many_groups", "word_before", "common_end"]
#: Features of each kind: those that its base pattern and its generator can share.
USED = {"email": ["word_before", "common_end"], "ip": ["ip_parts", "word_before"],
        "card": ["digits_13_19", "luhn", "word_before"],
        "phone": ["digits_9_11", "digits_12_15", "ip_parts", "one_run", "bracket", "many_groups", "word_before"]}
CONTEXT = 24
TREES = 30
RATE = 0.3
MIN_GAIN = 4.0
PRECISION = 0.97
BLOCK_CHARS = 4096


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn test of a string of at most 19 digits."""
    value = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(span: Column) -> Column:
    """Four dotted parts of at most 255 each (leading zeros allowed)."""
    parts = F.transform(F.regexp_extract_all(span, F.lit("([0-9]+)"), F.lit(1)), lambda p: F.ltrim(p, F.lit("0")))
    return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def holds(kind: Column, span: Column) -> Column:
    """The base rules behind the patterns."""
    d = digits_of(span)
    return (F.when(kind == 0, True).when(kind == 1, small_parts(span))
            .when(kind == 2, F.length(d).between(13, 19) & F.when(F.length(d) <= 19, luhn(d)).otherwise(False))
            .otherwise(F.length(d).between(9, 15)))


def gates() -> dict[str, dict[bool, Column]]:
    """Whether a text(text, digit) can hold a match at all, where digits do not tell: each
    form of ``AT`` implies the gate of the email generator."""
    low = F.lower("text")
    return {"email": {True: F.col("text").contains("@"), False: F.col("text").contains("@") | low.contains(" at ") | low.contains(" dot ") | low.rlike(r"[\[(]\x20?(?:dot|at|\.|@)")},
            "phone": {True: F.col("text").contains("+") & F.col("digit"), False: F.col("digit")}}


def matches(docs: DataFrame) -> DataFrame:
    """(key, row, kind, base, start, end, span, before) of every match of
    every pattern in docs(key, text)."""
    rows = docs.where("text is not null").select("key", F.xxhash64("text").alias("row"), "text").withColumn("digit", F.col("text").rlike("[0-9]"))
    gate = gates()
    sets = []
    for k, kind in enumerate(KINDS):
        for base in (True, False):
            p = (BASE if base else WIDE)[kind]
            use = gate.get(kind, {}).get(base, F.col("digit"))
            found = F.when(use, F.regexp_extract_all("text", F.lit(p), F.lit(0)))
            gaps = F.when(use, F.split("text", p, -1))
            pieces = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(
                m.alias("span"), F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before")))
            sets.append(F.struct(F.lit(k).alias("kind"), F.lit(base).alias("base"), pieces.alias("pieces")))
    some = rows.where(F.col("digit") | gate["email"][False]).select("key", "row", F.explode(F.array(*sets)).alias("s"))
    some = some.select("key", "row", "s.kind", "s.base", F.posexplode("s.pieces").alias("i", "p"))
    some = some.select("key", "row", "kind", "base", "i", "p.*").dropDuplicates(["key", "row", "kind", "base", "i"])
    passed = Window.partitionBy("key", "row", "kind", "base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("span")).over(passed)
    out = some.select("key", "row", "kind", "base", "span", "before", end.alias("end"))
    out = out.withColumn("start", F.col("end") - F.length("span"))
    return out.where(~F.col("base") | holds(F.col("kind"), F.col("span")))


def features() -> list[Column]:
    """Format and context bits of a candidate, in the order of FEATURES."""
    span, d = F.col("span"), digits_of(F.col("span"))
    n = F.length(d)
    word = F.lower(F.regexp_extract("before", r"(\p{L}+)\P{L}*$", 1))
    hints = ["mail", "email", "contact", "write", "phone", "tel", "call", "fax", "mobile", "ip", "host", "server", "address", "card", "visa", "pay"]
    return [n.between(9, 11), n.between(12, 15), n.between(13, 19), F.when(n.between(13, 19), luhn(d)).otherwise(False), small_parts(span),
            span.rlike(r"^[0-9]+$"), span.contains("("), F.size(F.split(span, "[^0-9A-Za-z]+")) > 4, word.isin(hints),
            F.lower(span).rlike(r"(?:com|org|net|edu|gov|info|io)$")]


def candidates(found: DataFrame) -> DataFrame:
    """Generator matches with their bits and whether they overlap a base
    span of their kind.  The bounds come from two running windows over the spans of
    one text and kind, ordered by start."""
    order = Window.partitionBy("key", "row", "kind").orderBy("start", "end", "base")
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    ends, starts = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    hit = (F.coalesce(F.max(ends).over(earlier), F.lit(0)) > F.col("start")) | F.coalesce(F.min(starts).over(later) < F.col("end"), F.lit(False))
    on = lambda name: F.col("kind").isin([k for k, kind in enumerate(KINDS) if name in USED[kind]])
    bits = reduce(lambda a, b: a + b, [F.when(on(f) & b, 1 << i).otherwise(0) for i, (f, b) in enumerate(zip(FEATURES, features()))])
    return (found.withColumn("overlaps", hit).where(~F.col("base"))
            .select("key", "row", "kind", "start", "end", bits.cast("int").alias("bits"), "overlaps"))


# --- boosted trees on the table of counts --------------------------------
def boost(cells: list[tuple[int, int, int]], n_features: int, trees: int = TREES, rate: float = RATE):
    """Trees of depth two for cells (bits, positives, others): a list of
    (first, second if clear, second if set, four leaf values)."""
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((pos + 1) / (neg + 1))
    score = {c[0]: start for c in cells}
    model = []

    def split(part, grads):
        """Best feature of a part by gain, smallest index first; one that is
        never set if none gains ``MIN_GAIN`` (a few odd examples split nothing)."""
        def value(g, h):
            return g * g / (h + 1)
        best = (MIN_GAIN, None)
        total = [sum(grads[c[0]][j] for c in part) for j in (0, 1)]
        for f in range(n_features):
            on = [sum(grads[c[0]][j] for c in part if c[0] >> f & 1) for j in (0, 1)]
            gain = value(*on) + value(total[0] - on[0], total[1] - on[1]) - value(*total)
            if gain > best[0]:
                best = (gain, f)
        return n_features if best[1] is None else best[1]

    for _ in range(trees):
        grads = {}
        for b, p, q in cells:
            prob = 1 / (1 + math.exp(-score[b]))
            grads[b] = (p - (p + q) * prob, (p + q) * prob * (1 - prob))
        first = split(cells, grads)
        halves = [[c for c in cells if (c[0] >> first & 1) == side] for side in (0, 1)]
        second = [split(h, grads) if h else 0 for h in halves]
        leaves = []
        for side in (0, 1):
            for way in (0, 1):
                part = [c for c in halves[side] if (c[0] >> second[side] & 1) == way]
                g, h = (sum(grads[c[0]][j] for c in part) for j in (0, 1))
                leaves.append(rate * max(-8.0, min(8.0, g / (h + 1))))
        tree = (first, second[0], second[1], leaves)
        model.append(tree)
        for b in score:
            score[b] += leaf(tree, b)
    return start, model


def leaf(tree, bits: int) -> float:
    first, clear, on, leaves = tree
    side = bits >> first & 1
    return leaves[2 * side + (bits >> (on if side else clear) & 1)]


def threshold(cells: list[tuple[int, int, int]], start: float, model, precision: float = PRECISION) -> float:
    """Lowest score whose calibrated probability reaches ``precision``;
    infinite if none does.  Calibration is isotonic: neighbouring scores whose shares
    of positives fall as the score rises are pooled, then smoothed by add-one."""
    groups: dict[float, list[int]] = {}
    for b, p, q in cells:
        g = groups.setdefault(round(start + sum(leaf(t, b) for t in model), 6), [0, 0])
        g[0] += p
        g[1] += q
    pools: list[list[float]] = []                     # lowest score, positives, others
    for s in sorted(groups):
        pools.append([s, *groups[s]])
        while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
            _, p, q = pools.pop()
            pools[-1][1] += p
            pools[-1][2] += q
    return min((s for s, p, q in pools if (p + 1) / (p + q + 2) >= precision), default=math.inf)


def fit(found: DataFrame):
    """{kind: (start, trees, threshold)} from the counts over all candidates."""
    counts = found.groupBy("kind", "bits").agg(F.count_if("overlaps").alias("p"), F.count_if(~F.col("overlaps")).alias("q")).collect()
    models = {}
    for kind in range(len(KINDS)):
        cells = sorted((r.bits, r.p, r.q) for r in counts if r.kind == kind)
        if sum(c[1] for c in cells):
            start, trees = boost(cells, len(FEATURES))
            models[kind] = (start, trees, threshold(cells, start, trees))
    return models


def score(models) -> Column:
    """Score minus threshold of a candidate row, null for a kind without model."""
    bit = lambda f: F.col("bits").bitwiseAND(F.lit(1 << f)) != 0
    out = F.lit(None).cast("double")
    for kind, (start, trees, least) in models.items():
        if least == math.inf:
            continue
        total = F.lit(start)
        for first, clear, on, v in trees:
            total = total + F.when(bit(first), F.when(bit(on), v[3]).otherwise(v[2])).otherwise(F.when(bit(clear), v[1]).otherwise(v[0]))
        out = F.when(F.col("kind") == kind, F.round(total, 6) - least).otherwise(out)
    return out


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows(key, row) of all documents, row the hash of the text;
    spans(key, row, kind, start, end, base) of the selected spans, one set for
    each (key, row)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = cut_lineage(matches(rows))
    proposed = cut_lineage(candidates(found))
    chosen = proposed.where(~F.col("overlaps")).withColumn("margin", score(fit(proposed))).where("margin >= 0")
    spans = (found.where("base").select("key", "row", "kind", "start", "end", "base")
             .unionByName(chosen.select("key", "row", "kind", "start", "end", F.lit(False).alias("base"))))
    return rows.select(F.col("key").alias(key), F.xxhash64("text").alias("row")), spans


def digests(rows: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document row: n_email, n_ip, n_card, n_phone and the digest of
    the base spans, and the list of all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    per = spans.groupBy(F.col("key").alias("_key"), F.col("row").alias("_row")).agg(
        *[F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("all"))
    per = per.select("_key", "_row", *[f"n_{k}" for k in KINDS], joined(F.filter("all", lambda s: s["base"])).alias("based"), joined(F.col("all")).alias("spans"))
    out = rows.join(per, F.col(key).eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left")
    return out.select(key, *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce("based", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every selected span replaced by its kind, like ``[EMAIL]``
    (overlapping spans of several kinds become one, under the first kind's name).  Texts
    without spans pass unchanged; the others are rebuilt from blocks of
    ``BLOCK_CHARS``, so no task searches a long text once per span."""
    _, spans = detect(docs, key, text)
    spans = cut_lineage(spans)
    # merge overlaps: a span starts a group if it begins at or after all earlier ends
    order = Window.partitionBy("key", "row").orderBy("start", "kind", "end")
    new = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    merged = spans.withColumn("new", new.cast("int")).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("key", "row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    block = F.lit(BLOCK_CHARS)
    cut = merged.select("key", "row", "start", "end", "kind", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    cut = cut.select("key", "row", "block", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).cast("int").alias("a"),
                     F.least(F.col("end") - F.col("block") * block, block).cast("int").alias("b"),
                     F.when(F.floor(F.col("start") / block) == F.col("block"), F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), F.col("kind").cast("int") + 1), F.lit("]"))).otherwise("").alias("put"))
    per_block = cut.groupBy(F.col("key").alias("_key"), F.col("row").alias("_row"), F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "put"))).alias("s"))

    touched = merged.select(F.col("key").alias("_key"), F.col("row").alias("_row")).distinct()
    whole = boxed(docs, key, F.xxhash64(text))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row"))
    clean = whole.join(touched, same, "left_anti").select("doc")
    hit = whole.join(touched, same, "left_semi")
    texts = hit.select("key", "row", F.col("doc")[text].alias("text")).dropDuplicates(["key", "row"])
    blocks = texts.select("key", "row", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))).alias("block", "t"))
    blocks = blocks.join(per_block, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")) & (F.col("block") == F.col("_block")), "left")
    # each span brings the text since the span before it; the rest follows the last
    ends = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x["b"]))
    kept = F.zip_with("s", F.slice(ends, 1, F.size("s")), lambda x, e: F.concat(F.substring(F.col("t"), e + 1, x["a"] - e), x["put"]))
    rest = F.substring(F.col("t"), F.element_at(ends, -1) + 1, F.length("t"))
    done = F.when(F.col("s").isNull(), F.col("t")).otherwise(F.concat(F.array_join(kept, ""), rest))
    rebuilt = (blocks.select("key", "row", F.struct("block", done.alias("t")).alias("part")).groupBy(F.col("key").alias("_key"), F.col("row").alias("_row"))
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["t"]), "").alias("_text")))
    fixed = hit.join(rebuilt, same).select(F.col("doc").withField(quoted(text), F.col("_text")).alias("doc"))
    return clean.unionByName(fixed).select("doc.*")
