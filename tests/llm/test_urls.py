"""Verdicts on urls against a plain loop over all rules."""

import random

from spectraloom.llm import urls


def brute(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else otherwise


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(9)
    labels = ["a", "b", "net", "example", "A", "é", "a-b", "a0", ""]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/x"]
    rules = sorted({(".".join(r.choice(labels).lower() for _ in range(r.randint(0, 4))), r.choice(paths)) for _ in range(120)})
    rules = [(h, p, r.choice(["block", "allow"])) for h, p in rules]
    pages = [(k, r.choice(["http", "x", ""]) + r.choice(["://", "://", ":/"]) + ".".join(r.choice(labels) for _ in range(r.randint(0, 5))) + r.choice(paths) + r.choice(["", "c", "?q=/a", "#/a?", "://b"])) for k in range(3000)]
    pages += [(k, "http://A.net/a/" + "b" * (k % 4)) for k in range(4000, 5500)]
    pages += [(1, None), (1, None), (2, ""), (None, "http://net/"), (6, "http://" + "a." * 5000 + "net/a/" + "y" * 100_000)]
    df = spark.createDataFrame([(*p, "x", 0) for p in pages], "page_id long, url string, URL string, range int").repartition(6)
    given = spark.createDataFrame([(h.upper() if k % 2 else h, p, v) for k, (h, p, v) in enumerate(rules) if "é" not in h] + [x for x in rules if "é" in x[0]], "host string, path string, verdict string")
    want = sorted((str(i), *map(str, brute(u, rules))) for i, u in pages)
    for size in (urls.URLS, 60):
        monkeypatch.setattr(urls, "URLS", size)
        assert sorted(tuple(map(str, x)) for x in urls.judged(df, given).collect()) == want


def test_hot_host_is_dealt_over_its_ranges(spark, monkeypatch):
    monkeypatch.setattr(urls, "URLS", 100)
    df = spark.createDataFrame([(k, f"http://{'hot' if k % 3 else k}.net/{k % 2}") for k in range(3000)], "page_id long, url string")
    rules = spark.createDataFrame([("hot.net", "/1", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    out = urls.judged(df, rules)
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 4 * 100 and sum(sizes) == 3000
    assert all((x.rule, x.verdict) == (("hot.net/1", "block") if x.host == "hot.net" and x.path == "/1" else ("net/", "allow")) for x in out.collect())


def test_no_rules_no_urls(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow"), (None, None, "block")], "host string, path string, verdict string")
    assert {(x.page_id, x.rule, x.verdict) for x in urls.judged(df, rules.limit(0)).collect()} == {(1, None, "allow"), (2, None, "allow")}
    assert {(x.page_id, x.rule, x.verdict) for x in urls.judged(df, rules).collect()} == {(1, "net/", "block"), (2, "", "block")}
    assert urls.judged(df.limit(0), rules).collect() == []
