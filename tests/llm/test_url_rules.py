"""URL rules against a plain loop."""

import random

from rillhouse.llm import url_rules

RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "b.net/"),
    ("allow", "b.net/"),
    ("block", "x.org/a"),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [
        (len(r), v == "allow", r, v)
        for v, r in RULES
        if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith(r[r.index("/") :])
    ]
    best = max(fits, default=(0, False, None, "allow"))
    return host, path, best[2], best[3]


def test_against_plain(spark):
    rng = random.Random(3)
    hosts = ["example.com", "WWW.Example.com", "notexample.com", "com", "a.b.net", "net", "x.org", "Ä.org", ""]
    paths = ["", "/", "/en/", "/en", "/EN/", "/es/x", "/abc?q=/en/", "/a#x", "?/en/", "/en/" + "y" * 3000]
    urls = [f"{rng.choice(['http', 'ftp'])}://{h}{p}" for h in hosts for p in paths]
    urls += [None, "", "nothing", "a://b://example.com/en/", "http://" + "l." * 500 + "net/es/"]
    rows = [(i, u, "c") for i, u in enumerate(urls)] + [(1, urls[1], "c"), (None, urls[2], "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    found = url_rules.judge(pages, url_rules.rule_table(spark, RULES)).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(
        str((i, *plain(u))) for i, u, _ in rows
    )


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "verdict string, rule string")
    assert [r.verdict for r in url_rules.judge(pages, rules, default="block").collect()] == ["block"]
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, RULES)).collect() == []
