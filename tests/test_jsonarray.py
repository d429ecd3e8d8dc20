"""JSON arrays read by ranges (A2, A3): state carried over the cuts."""

import json
import os
import random

import pytest
from pyspark.sql import types as T

from briefkit.session import scratch_path
from briefkit.sources.jsonarray import PLACES, _fragments, read_json_arrays, read_json_members
from briefkit.sources.messages import read_records_json

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType()),
                       T.StructField("o", T.StructType([T.StructField("x", T.ArrayType(T.LongType()))]))])


@pytest.fixture()
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def put(folder, **files):
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            f.write(text)
    return folder


def rows(n, seed=1):
    dice = random.Random(seed)
    odd = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", '\\"', "}}", '"}', "x" * 40]
    return [{"a": i, "s": "".join(dice.choices(odd, k=dice.randint(0, 12))), "o": {"x": list(range(i % 3))}} for i in range(n)]


def got(df):
    return [(r.ord, r.a, r.s, r.o and list(r.o.x or [])) for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_file_is_read_by_many_tasks(spark, tmp_dir, small_ranges, indent):
    data = rows(300)
    path = put(tmp_dir, one=json.dumps(data, indent=indent))
    df = read_json_arrays(spark, path, SCHEMA)
    assert got(df) == [(i, d["a"], d["s"], d["o"]["x"]) for i, d in enumerate(data)]
    assert df.where("_corrupt_record is not null").count() == 0
    assert _fragments(spark, path).select("at").distinct().count() > 10


def test_files_lines_and_empty_ones(spark, tmp_dir, small_ranges):
    a, b, c = rows(40, 2), rows(30, 3), rows(20, 4)
    path = put(tmp_dir, a=json.dumps(a), b="\n".join(map(json.dumps, b)) + "\nbroken {\n", c=" \n " + json.dumps(c) + "\n", d="[]", e="", f="[ ]\n")
    df = read_json_arrays(spark, path, SCHEMA)
    good = df.where("_corrupt_record is null")
    want = [(k, d["a"], d["s"], d["o"]["x"]) for k, part in ((0, a), (1, b), (2, c)) for d in part]
    assert [(o // PLACES, *rest) for o, *rest in got(good)] == want
    assert [r._corrupt_record for r in df.where("_corrupt_record is not null").collect()] == ["broken {"]


@pytest.mark.parametrize("text,wrong", [('[{"a": 1}, {broken', 1), ('[{"a": 1}, {"a": 2}', 0), ('[{"a": 1}] trailing', 1), ('[{"a": 1}, 5, {"a": 3}]', 1), ('[{"a": "x}', 1)])
def test_a_broken_array_is_no_array(spark, tmp_dir, text, wrong):
    df = read_json_arrays(spark, put(tmp_dir, x=text), SCHEMA)
    if wrong:
        assert df.where("_corrupt_record is null").count() == 0
        assert df.where("_corrupt_record is not null").count() == wrong
        saved = read_json_arrays(spark, tmp_dir, SCHEMA, salvage=True)
        assert saved.where("_corrupt_record is null").count() == (1 if '"a": 1}' in text else 0)
    else:
        assert df.where("_corrupt_record is not null").count() >= 1 and df.where("_corrupt_record is null").count() == 0


def test_records_keep_list_order(spark, tmp_dir, small_ranges):
    recs = [{"subject": f"s{i}", "date": "d", "sender": "x", "body": "{" * (i % 5)} for i in range(100)]
    df = read_records_json(spark, put(tmp_dir, r=json.dumps(recs)))
    assert [(r.ord, r.subject, r.body) for r in df.orderBy("ord").collect()] == [(i, r["subject"], r["body"]) for i, r in enumerate(recs)]
    own = read_records_json(spark, put(scratch(spark), r=json.dumps([{"ord": 9 - i, "subject": str(i)} for i in range(3)])))
    assert [r.subject for r in own.orderBy("ord").collect()] == ["2", "1", "0"]


def scratch(spark):
    path = scratch_path(spark, "t-json").removeprefix("file:")
    os.makedirs(path)
    return path


def members(spark, path):
    faults, found = read_json_members(spark, path)
    return [r.fault for r in faults.collect()], [(r.ord, r.name, json.loads(r.json)) for r in found.orderBy("ord").collect()]


@pytest.mark.parametrize("indent", [None, 2])
def test_one_object_is_read_by_many_tasks(spark, tmp_dir, small_ranges, indent):
    data = {f"n{i}" + "}{\"\\"[i % 4:]: r for i, r in enumerate(rows(200, 5))}
    data |= {"plain": 5, "none": None, "list": [1, {"x": {}}], "text": "}", "last": {"url": "u", "verified": True}, "after": "z"}
    path = put(tmp_dir, one=json.dumps(data, indent=indent))
    assert members(spark, path) == ([], [(i, k, v) for i, (k, v) in enumerate(data.items())])


def test_objects_as_the_original_reads_them(spark, tmp_dir):
    cases = {'{"a": 1}': [("a", 1)], "{}": [], " \n{ }\n": [], '{"a": {"x": 1}, "b": {}, "a": {"x": 2}}': [("a", {"x": 2}), ("b", {})], '{"a": "}", "b": {"c": "}"}}': [("a", "}"), ("b", {"c": "}"})]}
    for text, want in cases.items():
        assert members(spark, put(tmp_dir, x=text)) == ([], [(i, *w) for i, w in enumerate(want)]), text
    for text, fault in {'{"a": {"x": 1}': "invalid", '{"a": {"x": 1}} more': "invalid", '{"a": {"x": }}': "invalid", '{"a" {"x": 1}}': "invalid", "[]": "no object",
                        '[{"a": 1}]': "no object", "5": "no object", "nonsense": "invalid", '{"a": {"x": 1}, "b": "open}': "invalid"}.items():
        assert members(spark, put(tmp_dir, x=text)) == ([fault], []), text
