"""URL filters against brute force."""

import random

import numpy as np
import pytest

from briefkit.llm import urlfilter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/x?y#z",
        "http://myexample.com/en/", "http://x.net/es/?a", "http://x.net/es", "http://net/fr/#b", "http://é.Net/fr/É", "x://y://z.com/q", "http://com/", "http://.com/", "http://a..com/",
        "http://" + "a." * 5000 + "com/" + "p/" * 5000, "http://example.com?/en/", "http://example.com#/en/", "http://example.com:80/en/", "HTTP://X.NET/ES/", "http://a.net\n/es/", "://com/"]


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute(rows, rules, default="allow"):
    out = []
    for page_id, url in rows:
        host, path = parts(url)
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
                if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, 0, None, default)
        out.append((page_id, host, path, best[3], best[4]))
    return sorted(out, key=repr)


def judged(spark, rows, rules, **more):
    pages = spark.createDataFrame([(*r, "h", "k") for r in rows], "page_id long, url string, host string, keys string").repartition(3)
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted((tuple(r) for r in urlfilter.judge(pages, rules, **more).collect()), key=repr)


def test_contract_rules(spark):
    rows = [*enumerate(URLS), (None, URLS[6]), (3, URLS[7]), (3, URLS[7])]
    assert judged(spark, rows, RULES) == brute(rows, RULES)


@pytest.mark.parametrize("max_bits", [64, 4096, urlfilter.MAX_BITS])
def test_long_lists_in_shards_and_levels(spark, max_bits, monkeypatch):
    """Small filters need many levels and many shards; answers stay exact."""
    monkeypatch.setattr(urlfilter, "BITS", 1.5)
    dice = random.Random(7)
    n = 15 if max_bits == 64 else 600
    name = lambda: "".join(dice.choices("abc", k=dice.randint(1, 3)))
    rules = [(".".join(name() for _ in range(dice.randint(1, 2))), "/" + name() if dice.random() < 0.5 else "", dice.choice(["allow", "block"])) for _ in range(n)]
    rows = [(i, "h://" + ".".join(name() for _ in range(dice.randint(1, 4))) + "/" + name()) for i in range(1500)]
    rows += [(-1, "h://hot.aa/")] * 700
    assert judged(spark, rows, rules, default="block", max_bits=max_bits) == brute(rows, rules, "block")


def test_cascade_is_exact_on_its_universe(spark):
    r = np.random.default_rng(5)
    keys = r.integers(-2**63, 2**63, (6000, 2), dtype=np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in keys], "a long, b long")
    inside, outside = df.limit(0), df
    first = urlfilter._build(inside, 0, 0, 2, 1, 1 << 20)
    assert not urlfilter.listed(urlfilter.cascade(inside, outside, first), *keys.T).any()
    inside, outside = spark.createDataFrame(df.collect()[:1000], df.schema), spark.createDataFrame(df.collect()[1000:], df.schema)
    levels = urlfilter.cascade(inside, outside, urlfilter._build(inside, 0, 1000, 2, 1, 1 << 20))
    assert len(levels) > 4
    assert (urlfilter.listed(levels, *keys.T) == (np.arange(6000) < 1000)).all()


def test_no_rules_no_pages_and_wrong_rules(spark):
    rows = [*enumerate(URLS)]
    assert judged(spark, rows, []) == brute(rows, [])
    assert judged(spark, [], RULES) == []
    assert judged(spark, rows, [(None, None, "block"), ("COM", "", "block")]) == brute(rows, [("", "", "block"), ("com", "", "block")])
    with pytest.raises(ValueError):
        judged(spark, rows, [("a", "/", "maybe")])
