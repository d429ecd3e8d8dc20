"""Registry file validation (I1–I13, F13) on untyped JSON entries."""

import json
import os

from briefkit.operators import quality
from briefkit.sources.registry import read_registry_file, registry_entries


def write(tmp_dir, obj_or_text):
    p = os.path.join(tmp_dir, "sites.json")
    with open(p, "w") as f:
        f.write(obj_or_text if isinstance(obj_or_text, str) else json.dumps(obj_or_text))
    return p


def errors(spark, path):
    file_errs, ent = registry_entries(spark, path)
    fe = [r.message for r in file_errs.collect()]
    if fe:
        return fe
    errs = quality.registry_errors(quality.variant_entries(ent))
    return [r.message for r in errs.orderBy("ord", "rule_seq").collect()]


def test_two_good_rows(spark, tmp_dir):
    p = write(tmp_dir, {"a": {"url": "https://a.com", "verified": True}, "b": {"url": "https://b.com/x", "verified": False}})
    assert errors(spark, p) == []
    roll = quality.validation_rollup(quality.registry_errors(quality.variant_entries(registry_entries(spark, p)[1]))).first()
    assert roll.is_valid and roll.n_errors == 0


def test_file_level(spark, tmp_dir):
    assert errors(spark, os.path.join(tmp_dir, "none.json"))[0].startswith("Newsletter websites file not found")
    assert errors(spark, write(tmp_dir, "{not json"))[0].startswith("Invalid JSON in")
    assert errors(spark, write(tmp_dir, [1, 2]))[0].startswith("Root element must be a dictionary")


def test_entry_rules(spark, tmp_dir):
    p = write(tmp_dir, {
        "nourl": {"verified": True},
        "noverified": {"url": "https://x.com"},
        "notobj": "https://x.com",
        "badurl": {"url": "bakery dot example", "verified": True},
        "numurl": {"url": 5, "verified": True},
        "track": {"url": "https://track.bakery.example/open?utm_campaign=7", "verified": False},
        "first": {"url": "https://dup.com", "verified": True},
        "second": {"url": "https://dup.com", "verified": True},
        "generic": {"url": "https://substack.com", "verified": True},
        " pad ": {"url": "https://pad.com", "verified": "yes"},
        "   ": {"url": "https://blank.com", "verified": True},
        "nullurl": {"url": None, "verified": True},
    })
    got = errors(spark, p)
    assert got == [
        "Missing 'url' field for newsletter 'nourl'",
        "Missing 'verified' field for newsletter 'noverified'",
        "Configuration for 'notobj' must be a dictionary",
        "Invalid URL for 'badurl': bakery dot example",
        "URL for 'numurl' must be a string: 5",
        "URL for 'track' appears to be a tracking/temporary URL: https://track.bakery.example/open?utm_campaign=7",
        "Duplicate URL found: 'second' and 'first' both use https://dup.com",
        "URL for 'generic' is too generic, should be more specific: https://substack.com",
        "Newsletter name has leading/trailing whitespace: ' pad '",
        "'verified' field for ' pad ' must be a boolean: 'yes'",
        "Newsletter name must be a non-empty string: '   '",
        "URL for 'nullurl' must be a string: None",
    ]


def test_typed_registry_read(spark, tmp_dir):
    p = write(tmp_dir, {"a": {"url": "https://a.com", "verified": True}, "b": {"url": "https://b.com", "verified": False}})
    rows = sorted((r.name, r.url, r.verified) for r in read_registry_file(spark, p).collect())
    assert rows == [("a", "https://a.com", True), ("b", "https://b.com", False)]
    listing = [r.line for r in quality.validation_listing(
        quality.registry_errors(quality.typed_entries(read_registry_file(spark, p)))).orderBy("line_no").collect()]
    assert listing == ["📁 Newsletter Websites:"]


def test_repr_of_odd_values(spark, tmp_dir):
    p = write(tmp_dir, {"x\u00a0": {"url": ["a", "b's"], "verified": True}, "y": {"url": "https://y.example.org", "verified": ["x"]}})
    assert errors(spark, p) == [
        "Newsletter name has leading/trailing whitespace: 'x\\xa0'",
        "URL for 'x\u00a0' must be a string: ['a', \"b's\"]",
        "'verified' field for 'y' must be a boolean: ['x']",
    ]


def test_versions_round_trip(spark, tmp_dir):
    from briefkit.sources.registry import read_registry, write_registry_version

    root = "file:" + os.path.join(tmp_dir, "reg")
    for rows in ([("a", "https://a.com", True)], [("a", "https://a.com", True), ("b", "nope", False)]):
        write_registry_version(spark.createDataFrame(rows, "name string, url string, verified boolean"), root)
    assert sorted(r.name for r in read_registry(spark, root).collect()) == ["a", "b"]
    assert errors(spark, root) == ["Invalid URL for 'b': nope"]
