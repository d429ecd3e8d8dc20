"""One reply per report (E2, E3) and the ledger of answers."""

import functools
import json
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from briefkit.functions.responses import keep_topics, topics
from briefkit.operators import digest, prompts, scoring
from briefkit.session import scratch_path

REPLIES = "report_id long, batch_id long, text string"


class Counting:
    """Notes every call in a file of its own; dies on some prompts."""

    def __init__(self, folder, inner, deadly=""):
        self.folder, self.inner, self.deadly = folder, inner, deadly

    def __call__(self, model, prompt, **options):
        if self.deadly and self.deadly in prompt:
            os._exit(1)  # as a lost executor: no row, no exception
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            json.dump([model, prompt, options], f)
        return self.inner(model, prompt, **options)


def calls(folder):
    return [json.load(open(os.path.join(folder, f))) for f in os.listdir(folder)]


def topic_text(pairs):
    return "".join(f"### {i}. {t}\n- **Mentions:** {k}\n\n" for i, (t, k) in enumerate(pairs, 1))


def merged(levels, n, fan_in):
    """Brute force: votes summed and cut round by round."""
    while list(levels) != [0]:
        up = {}
        for b in sorted(levels):
            up.setdefault(b // fan_in, []).append(levels[b])
        levels = {}
        for b, group in up.items():
            votes = Counter()
            for pairs in group:
                for t, k in pairs:
                    votes[t] += k
            levels[b] = group[0] if len(group) == 1 else sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:n]
    return levels[0]


@pytest.mark.parametrize("fan_in", [3, 10])
def test_one_reply_for_any_number_of_batches(spark, tmp_dir, fan_in):
    reports = {0: 1, 1: 2, 2: 23, 5: 100}
    made = {r: {b: [(f"t{(b * 7 + i * i) % 31} of {r}", 1 + (b + i) % 5) for i in range(4)] for b in range(m)} for r, m in reports.items()}
    rows = [(r, b, topic_text(p)) for r, bs in made.items() for b, p in bs.items()]
    client = functools.partial(Counting, tmp_dir, scoring.TopicClient(6))
    score = functools.partial(scoring.score_once, model="m", ledger=scratch_path(spark, "t-ledger"), client_factory=client)
    final, rounds = digest.one_reply(spark.createDataFrame(rows, REPLIES).repartition(3), score, num_topics=6, fan_in=fan_in)
    got = {r.report_id: [(t.title, t.body) for t in r.t] for r in final.select("report_id", topics(F.col("text")).alias("t")).collect()}
    for r, bs in made.items():
        assert [t for t, _ in got[r]] == [t for t, _ in merged(bs, 6, fan_in)]
    assert all(len(got[r]) == 6 for r in (2, 5))
    assert len(calls(tmp_dir)) == sum(x.count() for x in rounds)
    longest = max(len(p) for _, p, _ in calls(tmp_dir))
    assert longest < len(digest.MERGE_HEAD) + fan_in * 400  # no prompt grows with the number of batches


def test_topics_are_cut_renumbered_and_distinct(spark):
    texts = ["intro\n### 1. A\nbody a\n### 2. B\nb1\nb2\n### 3. A\nagain\n### 9. C\nc\n", "no headings", "", None, "### 1. Only\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(keep_topics(F.col("t"), 2)).collect()]
    assert got == ["### 1. A\nbody a\n### 2. B\nb1\nb2\n", "no headings", "", None, "### 1. Only\n"]


def test_failed_merges_and_replies(spark):
    def broken(model, prompt, **options):
        raise RuntimeError("down")
    score = functools.partial(scoring.score_once, model="m", ledger=scratch_path(spark, "t-ledger"), client_factory=lambda: broken)
    rows = [(0, 0, topic_text([("a", 1), ("b", 1)])), (0, 1, None), (0, 2, topic_text([("b", 1), ("c", 1)]))]
    final, rounds = digest.one_reply(spark.createDataFrame(rows, REPLIES), score, num_topics=3)
    assert [t.title for t in final.select(topics(F.col("text"))).first()[0]] == ["a", "b", "c"]
    assert [r.status for r in rounds[0].collect()] == ["error"]
    none, rounds = digest.one_reply(spark.createDataFrame([], REPLIES), score)
    assert none.count() == 0 and rounds == []


def asked(spark, n):
    return spark.createDataFrame([(i, f"SUBJECT: s{i % (n - 2)}\n") for i in range(n)], "batch_id long, prompt string").repartition(2)


def test_ledger_sends_each_prompt_once(spark, tmp_dir):
    ledger = scratch_path(spark, "t-ledger")
    client = functools.partial(Counting, tmp_dir, scoring.EchoClient())
    one = scoring.score_once(asked(spark, 12), "m", ledger, client, per_commit=3)
    assert one.columns == ["batch_id", "response", "status", "error", "attempt", "model"]
    first = {r.batch_id: r.response for r in one.collect()}
    assert len(first) == 12 and first[0] == first[10] and len(calls(tmp_dir)) == 10   # two prompts are equal
    again = {r.batch_id: r.response for r in scoring.score_once(asked(spark, 14), "m", ledger, client).collect()}
    assert {k: again[k] for k in range(10)} == {k: first[k] for k in range(10)} and len(calls(tmp_dir)) == 12
    scoring.score_once(asked(spark, 14), "m", ledger, client, max_tokens=9, system="be brief").count()
    assert len(calls(tmp_dir)) == 24   # other options are other questions
    assert {json.dumps(o, sort_keys=True) for _, _, o in calls(tmp_dir)} == {"{}", '{"max_tokens": 9, "system": "be brief"}'}


def test_rerun_of_a_failed_run_sends_only_the_missing(spark, tmp_dir):
    ledger = scratch_path(spark, "t-ledger")
    asked_ = spark.createDataFrame([(i, f"SUBJECT: s{i}\n") for i in range(60)], "batch_id long, prompt string")
    with pytest.raises(Exception):
        scoring.score_once(asked_, "m", ledger, functools.partial(Counting, tmp_dir, scoring.EchoClient(), deadly="s17\n"), per_commit=4).count()
    kept = spark.read.parquet(ledger).count()
    assert 0 < kept < 60   # tasks that ended have left their answers
    before = len(calls(tmp_dir))
    done = scoring.score_once(asked_, "m", ledger, functools.partial(Counting, tmp_dir, scoring.EchoClient()), per_commit=4)
    assert done.where("status = 'ok'").count() == 60
    assert len(calls(tmp_dir)) - before == 60 - kept


def test_errors_are_sent_again(spark, tmp_dir):
    ledger = scratch_path(spark, "t-ledger")

    def broken(model, prompt, **options):
        raise RuntimeError("down")
    bad = scoring.score_once(asked(spark, 5), "m", ledger, lambda: broken).collect()
    assert {r.status for r in bad} == {"error"} and all("down" in r.error for r in bad)
    good = scoring.score_once(asked(spark, 5), "m", ledger, functools.partial(Counting, tmp_dir, scoring.EchoClient())).collect()
    assert {r.status for r in good} == {"ok"} and len(calls(tmp_dir)) == 3
    back = scoring.score_once(asked(spark, 9), "m", scratch_path(spark, "t-ledger"), lambda: broken, scoring.echo_factory, "f").collect()
    assert {(r.status, r.attempt, r.model) for r in back} == {("fallback", 2, "f")}


def test_prompt_options_reach_the_client(spark):
    def client(model, prompt, system, max_tokens):
        return f"{system}:{max_tokens}"
    df = spark.createDataFrame([(1, "p")], "batch_id long, prompt string")
    assert scoring.score_prompts(df, "m", lambda: client, system="s", max_tokens=7).first().response == "s:7"
    assert prompts.response_content(scoring.score_prompts(df, "m")).first().text == ""
