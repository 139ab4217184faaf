"""URL filter against plain Python, on odd URLs and on rules with ties."""

import random

from lexiloom.llm import urls

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    ("block", "a.b.example.net", ""), ("allow", "x.y", "/p"), ("block", "x.y", "/p"), ("allow", "b", "/qq"), ("block", "a.b", "/"), ("block", "", "/"), ("block", "münchen.de", "/ü"),
]


def plain(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [
        (len(h + p), len(h), v, h + p)
        for v, h, p in RULES
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_against_plain_python(spark):
    random.seed(6)
    hosts = ["example.org", "WWW.Example.ORG", "org", "notorg", "a.com", "com", "z.a.b.example.net", "x.y", "q.x.y", "a.b", "c.a.b", "", ".org", "..", "münchen.de", "a.com.", "u:p@h.org:80"]
    paths = ["", "/", "/es/x", "/en/1", "/en/12", "/en/2", "/fr/?x=/de/", "/de/#y", "/p", "/pq", "/qq", "?a=b", "#/de/", "/ü/x", "//de/", "/de"]
    texts = [f"http://{h}{p}" for h in hosts for p in paths]
    texts += [None, "", "example.org/es/", "://org/", "a://b://c/", "http://org/\n/x", "http://" + "s." * 300 + "org/" + "y" * 5000]
    texts += texts[:40]
    random.shuffle(texts)
    df = spark.createDataFrame([(i, t, "old", "h") for i, t in enumerate(texts)], "id long, url string, rule string, host string").repartition(3)
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, urls.rule_table(spark, RULES)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def test_empty_tables(spark):
    pages = spark.createDataFrame([("http://a.org/x",), (None,)], "url string")
    none = urls.rule_table(spark, RULES).where("false")
    assert [(r.rule, r.verdict) for r in urls.filter_urls(pages, none, default="block").collect()] == [(None, "block")] * 2
    assert urls.filter_urls(pages.where("false"), urls.rule_table(spark, RULES)).count() == 0


def test_many_rules_are_joined_by_hash_prefix(spark):
    many = [("block", f"h{i}.example.com", f"/{i % 7}") for i in range(3000)]
    pages = spark.createDataFrame([(f"http://www.h{i}.example.com/{i % 5}/x",) for i in range(0, 3000, 7)], "url string")
    out = urls.filter_urls(pages, urls.rule_table(spark, many))
    want = {f"http://www.h{i}.example.com/{i % 5}/x": "block" if i % 5 == i % 7 else "allow" for i in range(0, 3000, 7)}
    assert {r.url: r.verdict for r in out.collect()} == want
