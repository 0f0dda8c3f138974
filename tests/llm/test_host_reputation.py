"""Urls and rules against plain Python; priors shrink as they should."""
from pyspark.sql import functions as F

from filings_engine.llm import host_reputation as H

URLS = ["http://WWW.Example.com/en/1?x#y", "https://a.example.com/en/", "https://a.example.com/en", "http://example.com", "http://b.www.example.com/en/z", "x.net/es/1", None, "",
        "http://q.net/es/1", "http://net/fr/?a", "http://qnet/fr/", "ftp://h.org/a://b/c", "://", "http://ÄB.org/é#x", "http://u@h.co.uk:80/x y", "http://a.com?x", "http://a.com/\nb", "HTTP://n.net/fr/"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    rule = verdict = None
    for action, r in H.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (rule is None or len(r) > len(rule)):
            rule, verdict = r, action
    return host, path, rule, verdict


def test_rules(spark):
    rows = [(i, u, 1, "z") for i, u in enumerate(URLS)] + [(None, URLS[0], None, "z"), (3, URLS[3], 0, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, seen int, bound string")
    got = H.judge_urls(pages, F.col("seen")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule), u
        assert by[i].verdict == verdict if verdict else by[i].verdict in ("allow", "block")
    assert H.judge_urls(pages.limit(0), F.col("seen")).count() == 0


def test_shrinkage(spark):
    rows = [("big.a.org", 1)] * 900 + [("big.a.org", 0)] * 100 + [("bad.b.org", 0)] * 50 + [("one.a.org", 1), ("one.b.org", 1), ("new.a.org", None), ("x.c.net", 1)]
    out = {r.host: r for r in H.reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert abs(out["big.a.org"]["mean"] - 0.9) < 0.02 and out["bad.b.org"]["mean"] < 0.2
    assert out["one.a.org"]["mean"] > out["one.b.org"]["mean"]                # a good domain lends its name
    assert out["one.b.org"].bound < out["big.a.org"].bound and out["new.a.org"].outcomes == 0
    assert all(0 < r["mean"] < 1 and r.bound < r["mean"] for r in out.values())
    none = H.reputation(spark.createDataFrame([("a.b", None)], "host string, good int")).first()
    assert abs(none["mean"] - 0.5) < 1e-9


def test_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "y.com": ("y.com", "com"), "host": ("host", "host"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("d", H.domain_of(F.col("h"))).withColumn("s", H.suffix_of(F.col("d")))
    assert {r.h: (r.d, r.s) for r in df.collect()} == hosts
