import random
import re

import numpy as np

from kinweave.llm import urlfilter as U


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, keys string")


def test_verdicts(spark):
    random.seed(1)
    hosts = ["example.com", "www.Example.com", "a.net", "NET", "com", "xcom", "b.example.com", "", "net.", ".net", "a.b.c.d.net"]
    paths = ["", "/", "/en/", "/en", "/es/x", "/fr/?q", "/fr#a/", "?en/", "/EN/"]
    urls = [f"{s}{h}{p}" for s in ("http://", "", "x://y://") for h in hosts for p in paths] + [None, "", "://", "a\nb://net/es/\n"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(spark, urls), U.RULES).collect()}
    assert got == {i: brute(u, U.RULES) for i, u in enumerate(urls)}


def test_many_rules(spark):
    random.seed(2)
    urls = [f"http://h{random.randint(0, 300)}.d{random.randint(0, 40)}.org/p{random.randint(0, 9)}/x" for _ in range(1500)]
    rules = list({(random.choice(["allow", "block"]), f"h{random.randint(0, 300)}.d{random.randint(0, 40)}.org", f"/p{random.randint(0, 9)}/") for _ in range(1500)})
    seen = {}
    rules = [r for r in rules if seen.setdefault(r[1:], r) == r]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(spark, urls), rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) AS key")
    listed = universe.where("substring(key, 2, 9) % 7 = 0")
    c = U.build(listed, universe)
    assert len(c.levels) > 1
    rows = U._hashed(universe).collect()
    h = [np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in ("h1", "h2")]
    assert c.has(*h).sum() == listed.count()


def test_empty(spark):
    assert U.judge(pages(spark, ["a"]).limit(0), U.RULES).collect() == []
    assert [r.verdict for r in U.judge(pages(spark, ["http://a/"]), []).collect()] == ["allow"]


def test_rules_may_be_a_table(spark):
    urls = ["http://a.net/es/1", "http://net/", "http://x.com/es/", "http://y/", None]
    table = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    rows = lambda rules: sorted(map(str, U.judge(pages(spark, urls), rules).collect()))
    assert rows(table) == rows(U.RULES)
    assert rows(table.limit(0)) == rows([])
