"""Homepage resolution and registry merge."""

from pyspark.sql import functions as F

from briefkit.functions.urls import extract_urls, homepage_from_body, is_valid_url
from briefkit.operators import sites, stats

REC = "ord long, subject string, date string, sender string, body string, body_format string"


def resolve(spark, rows, registry_rows=None, curated=None):
    df = spark.createDataFrame([(i, "s", "d", s, b, None) for i, (s, b) in enumerate(rows)], REC)
    reg = spark.createDataFrame(registry_rows or [], "name string, url string, verified boolean")
    cur = curated if curated is not None else sites.curated_sites(spark)
    src = stats.issues_per_source(df)
    return {r.sender: r for r in sites.resolve_homepages(src, reg, cur).collect()}


def test_fixture_cases(spark):
    out = resolve(spark, [
        ("Test Newsletter <test@example.com>", ""),
        ("The Neuron <different@domain.com>", "see https://wrong.com"),
        ("Test <test@test.com>", ""),
        ("Unknown Newsletter <unknown@random.com>", "visit https://website.com/"),
        ("Tracker <t@ex.org>", "https://track.example.com/c?id=1 https://example.com/"),
        ("Unknown <unknown@unknown.com>", ""),
        ("Example Newsletter <newsletter@example.com>", ""),
    ], registry_rows=[("test newsletter", "https://cached.example.com", True)])
    assert (out["Test Newsletter <test@example.com>"].url, out["Test Newsletter <test@example.com>"].verified) == \
        ("https://cached.example.com", True)
    assert (out["The Neuron <different@domain.com>"].url, out["The Neuron <different@domain.com>"].verified) == \
        ("https://www.theneurondaily.com", True)
    assert (out["Test <test@test.com>"].url, out["Test <test@test.com>"].verified) == ("https://test.com", False)
    assert out["Unknown Newsletter <unknown@random.com>"].url == "https://website.com/"
    assert out["Tracker <t@ex.org>"].url == "https://example.com/"
    assert out["Unknown <unknown@unknown.com>"].url == "https://unknown.com"
    assert out["Example Newsletter <newsletter@example.com>"].url is None


def test_registry_beats_curated_and_empty_url_is_absent(spark):
    out = resolve(spark, [("The Neuron <n@x.com>", ""), ("TLDR AI <t@x.com>", "")],
                  registry_rows=[("the neuron", "https://mine.example.com", True), ("tldr ai", "", True)])
    assert out["The Neuron <n@x.com>"].url == "https://mine.example.com"
    assert out["TLDR AI <t@x.com>"].url == "https://www.tldrnewsletter.com"  # first curated match wins


def test_curated_paths_agree(spark):
    senders = spark.createDataFrame([("a", "xxtldraixx"), ("b", "theneuron"), ("c", "none"), ("d", "")],
                                    "sender string, norm string")
    cur = sites.curated_sites(spark)
    small = {r.sender: r.curated_url for r in sites.curated_match(senders, cur, fixed=True).collect()}
    big = {r.sender: r.curated_url for r in sites.curated_match(senders, cur).collect()}
    assert small == big == {"a": "https://www.tldrnewsletter.com", "b": "https://www.theneurondaily.com"}


def test_url_functions(spark):
    df = spark.createDataFrame([("a https://x.com/home?a=1 http://y.org/p#frag",),
                                ("https://img.cdn.com/logo.png https://ok.com/deep/path",),
                                ("nothing",)], "b string")
    rows = df.select(extract_urls(F.col("b")).alias("u"), homepage_from_body(F.col("b")).alias("h")).collect()
    assert rows[0].u == ["https://x.com/home?a=1", "http://y.org/p"]
    assert rows[1].h == "https://ok.com/deep/path"
    assert rows[2].h is None
    v = spark.createDataFrame([(u,) for u in ["http://a.com", "HTTPS://a.com/x", "ftp://a.com", "mailto:a@b.c",
                                               "javascript:x", "a.com", "http://", "", None]], "u string")
    assert [r[0] for r in v.select(is_valid_url(F.col("u"))).collect()] == [True, True] + [False] * 7


def test_registry_merge_last_in_rank_wins(spark):
    old = spark.createDataFrame([("keep", "https://k.com", True), ("same", "https://old.com", False)],
                                "name string, url string, verified boolean")
    resolved = spark.createDataFrame([("same", "https://first.com", False, 1), ("same", "https://second.com", True, 2),
                                      ("new", "https://n.com", False, 3), ("none", None, False, 4)],
                                     "key string, url string, verified boolean, rank long")
    got = {r.name: (r.url, r.verified) for r in sites.merge_registry(old, resolved).collect()}
    assert got == {"keep": ("https://k.com", True), "same": ("https://second.com", True), "new": ("https://n.com", False)}
    again = {r.name: (r.url, r.verified) for r in sites.merge_registry(sites.merge_registry(old, resolved), resolved).collect()}
    assert again == got  # idempotent
