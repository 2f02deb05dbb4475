import random

import pytest

from tests.llm.conftest import DATA
from veritab.llm import urlrules
from veritab.llm.queries import QUERIES, URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in host), path[:cut]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fit = [
        (len(h) + len(p), len(h), h, p, v)
        for h, p, v in rules
        if h and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fit:
        return host, path, None, default
    _, _, h, p, v = max(fit, key=lambda x: (x[0], x[1], [-ord(c) for c in x[4]]))
    return host, path, h + p, v


def judged(spark, urls, rules):
    table = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = urlrules.judge(table, given).collect()
    assert len(rows) == len(urls)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


@pytest.mark.parametrize("rows", [200_000, 40])
def test_random_rules_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(urlrules, "RANGE_ROWS", rows)
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "x-y", "org"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice(["a/", "b/", "a", "1"]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), path() if rng.random() < 0.8 else "", rng.choice(["allow", "block"])) for _ in range(120)]
    urls = [f"http://{host()}{path()}" + rng.choice(["", "?q=/a", "#/b"]) for _ in range(500)]
    urls += ["http://a.org/a/"] * 300  # one URL fills several ranges
    got = judged(spark, urls, rules)
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_odd_urls(spark):
    rules = [("org", "/", "block"), ("org", "/", "allow"), ("", "/", "block"), ("EXAMPLE.org", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "http:///x", "HTTP://A.ORG/x?y", "http://b.org?x/", "http://org/", "://org/\nx",
            "http://norg/", "http://example.org/x" + "y" * 50_000, "http://xexample.org/x"]
    want = {k: brute(u, [r for r in rules if r[:3] != ("org", "/", "block")] ) for k, u in enumerate(urls)}
    got = judged(spark, urls, rules)
    want[10] = (want[10][0], want[10][1], "example.org/x", "block")
    assert got == want


def test_no_rules_and_no_rows(spark):
    assert judged(spark, ["http://a.org/", None], [("zz", "/", "block")])[0][2:] == (None, "allow")
    table = spark.createDataFrame([], "page_id long, url string, host string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    empty = urlrules.judge(table, rules)
    assert empty.count() == 0 and "host_" in empty.columns


def test_query(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op7_url_filters"](spark, DATA).collect()}
    assert got == {r.page_id: brute(r.url, URL_RULES) for r in pages}
