"""Base spans against the contract's patterns in Python's engine."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from filings_engine.llm import pii as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and plain_luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(5)
    yield from ["", "a@b.c_d@e.f x@y", "a@b.com@c.de.", "1.2.3.4.5.6.7.8", "0001.2.3.255 1.2.3.256", "+1 (988) 555-2485 and +12345678", "4041894974608795 4041 8949 7460 8795",
                "9" * 5000, "1 " * 9000, "1." * 9000, "a." * 20000 + "@", "+1" + " ()" * 9000, "😀 é a@b.co 😀 1.1.1.1", "Ün 4041-8949-7460-8795", "%@-.-", "a@b..c", "+1+23 456 7890"]
    for alphabet in ("a@.1", "0123456789 -", "+1 ().-9", "12.", "ab@.-_ é😀1+"):
        for n in (5, 40, 300):
            yield from ("".join(r.choice(alphabet) for _ in range(n)) for _ in range(6))


def test_base_spans(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(None, "me@here.org", 1), (None, "me@here.org", 1), (0, "you@there.org", 2), (900, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    got = P.digests(*P.detect(docs)).collect()
    assert len(got) == len(rows)
    want = []
    for k, t, _ in rows:
        spans = plain_base(t or "")
        want.append((k, *[sum(s[0] == kind for s in spans) for kind in P.KINDS], hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    by = {r.doc_id: r.spans.split(",") for r in got}
    for k, t, _ in rows:
        if k and t:
            assert {"%s:%d:%d" % s for s in plain_base(t)} <= set(by[k])
    assert P.digests(*P.detect(docs.limit(0))).count() == 0


def test_added_spans(spark):
    def card(i):
        body = f"40418949746{i:04d}"
        return next(body + str(c) for c in range(10) if plain_luhn(body + str(c)))
    rows = [(i, f"text {card(i)} more") for i in range(400)] + [(1000 + i, f"number {i * 7919 + 1000003} in a plain text") for i in range(50)]
    c = card(77)
    rows += [(2000, f"pay {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} now"), (2001, "count 1234.5678.9012.3456 now")]
    out = {r.doc_id: r for r in P.digests(*P.detect(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[2000].spans == "card:4:23" and out[2000].n_card == 0
    assert out[2001].spans == "" and all(out[1000 + i].spans == "" for i in range(50))
    assert all(out[i].spans == "card:5:21" for i in range(400))


def test_redaction(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_CHARS", 16)
    rows = [(1, "write to me@here.org or 10.0.0.1 é", "a"), (2, "nothing here", "b"), (None, None, "c"), (3, "x" * 14 + " me@here.org", "d"), (1, "write to me@here.org or 10.0.0.1 é", "e"),
            (4, "no 4041894974608795 end\n.", "f"), (5, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((tuple(r) for r in P.redact(docs).collect()), key=lambda r: r[2])
    assert got == [(1, "write to [EMAIL] or [IP] é", "a"), (2, "nothing here", "b"), (None, None, "c"), (3, "x" * 14 + " [EMAIL]", "d"), (1, "write to [EMAIL] or [IP] é", "e"),
                   (4, "no [CARD] end\n.", "f"), (5, "", "g")]


def test_gate_is_implied(spark, monkeypatch):
    texts = ["john at example.com", "John AT example.com", "john (at) example.com", "john[ @ ]example.com", "john at example dot com", "john@example (dot) com", "look at this", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    proposed = lambda: sorted((r.key, r.start, r.end) for r in P.matches(docs).where("kind = 0 and not base").collect())
    got = proposed()
    monkeypatch.setattr(P, "gates", lambda: {k: {True: F.lit(True), False: F.lit(True)} for k in ("email", "phone")})
    assert got == proposed() and (0, 0, 19) in got and (1, 0, 19) in got
