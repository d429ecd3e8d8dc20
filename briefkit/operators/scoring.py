"""Model scoring (E4): the one place a Python worker runs.

``score_prompts`` sends every prompt through a caller-supplied client via
``mapInPandas`` (Arrow batches; one client per task, built by the factory
on the executor).  A failed call is retried on the fallback client when
one is given; errors become rows (status/error), never job failures.

``score_once`` does the same through a ledger of answers: a table keyed by the
hash of what is asked.  Only prompts without an answer there are sent, and each
task's answers are added to it when the task ends, whatever becomes of the
others, so a run that failed half-way goes on where it stopped.

No HTTP client ships with the package: the built-in clients are
deterministic stand-ins for tests and benchmarks.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..schemas import LEDGER, SCORED
from ..session import exists, stored

#: (model, prompt, **options) -> JSON response text.  ``options`` are
#: ``system`` and ``max_tokens``, each given only if the caller set it.
Client = Callable[..., str]

_SUBJECT = re.compile(r"^SUBJECT: (.*)$", re.M)
_MERGED = re.compile(r"^ANALYSIS #\d+$", re.M)
_TOPIC = re.compile(r"^### \d+\. (.*)\n(?:- \*\*Mentions:\*\* (\d+)$)?", re.M)


def _reply(prompt: str, text: str) -> str:
    return json.dumps({
        "choices": [{"message": {"content": text}}],
        "usage": {"total_tokens": len(prompt) // 4 + len(text) // 4,
                  "prompt_tokens": len(prompt) // 4, "completion_tokens": len(text) // 4, "cost": 0.0},
    })


class EchoClient:
    """Deterministic stub: one '### i. subject' topic per item, or per topic
    of the analyses in a prompt that merges them."""

    def __call__(self, model: str, prompt: str, **options) -> str:
        titles = [t for t, _ in _TOPIC.findall(prompt)] if _MERGED.search(prompt) else _SUBJECT.findall(prompt)
        return _reply(prompt, "".join(f"### {i}. {s}\n- **Source:** stub\n\n" for i, s in enumerate(titles, 1)))


class TopicClient:
    """Deterministic stub: the ``n`` most frequent subjects of the items, or
    the ``n`` topics with most mentions over the analyses of a prompt."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, model: str, prompt: str, **options) -> str:
        votes: Counter = Counter()
        if _MERGED.search(prompt):
            for title, k in _TOPIC.findall(prompt):
                votes[title] += int(k or 1)
        else:
            votes.update(s for s in _SUBJECT.findall(prompt) if s.strip())
        best = sorted(votes, key=lambda t: (-votes[t], t))[:self.n]
        return _reply(prompt, "".join(f"### {i}. {t}\n- **Mentions:** {votes[t]}\n\n" for i, t in enumerate(best, 1)))


def echo_factory() -> Client:
    return EchoClient()


def _caller(model: str, client_factory: Callable[[], Client], fallback_factory: Callable[[], Client] | None,
            fallback_model: str | None, options: dict) -> Callable[[], Callable[[str], tuple]]:
    """What builds, once a task, the function from a prompt to (response,
    status, error, attempt, model)."""
    def build() -> Callable[[str], tuple]:
        client = client_factory()
        fallback = fallback_factory() if fallback_factory else None

        def ask(prompt: str) -> tuple:
            try:
                return client(model, prompt, **options), "ok", None, 1, model
            except Exception as e:  # noqa: BLE001 - a row-level error, not a job failure
                if fallback is None:
                    return None, "error", str(e), 1, model
                other = fallback_model or model
                try:
                    return fallback(other, prompt, **options), "fallback", str(e), 2, other
                except Exception as e2:  # noqa: BLE001
                    return None, "error", f"{e}; {e2}", 2, other
        return ask

    # The package's functions and classes travel to the Python workers by
    # value, so executors need nothing installed beyond PySpark.
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])
    return build


def _options(system: str | None, max_tokens: int | None) -> dict:
    return {k: v for k, v in (("system", system), ("max_tokens", max_tokens)) if v is not None}


def score_prompts(prompts: DataFrame, model: str, client_factory: Callable[[], Client] = echo_factory,
                  fallback_factory: Callable[[], Client] | None = None, fallback_model: str | None = None,
                  system: str | None = None, max_tokens: int | None = None) -> DataFrame:
    """Prompts (batch_id, prompt) → (batch_id, response, status, error, attempt, model)."""
    build = _caller(model, client_factory, fallback_factory, fallback_model, _options(system, max_tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = build()
        for pdf in batches:
            out = [(bid, *ask(prompt)) for bid, prompt in zip(pdf["batch_id"], pdf["prompt"])]
            yield pd.DataFrame(out, columns=[f.name for f in SCORED.fields])

    return prompts.select("batch_id", "prompt").mapInPandas(run, SCORED)


def read_ledger(prompts: DataFrame, ledger: str) -> DataFrame:
    """The ledger's answers (schema ``LEDGER``); none if nothing is written yet."""
    spark = prompts.sparkSession
    return spark.read.schema(LEDGER).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], LEDGER)


def score_once(prompts: DataFrame, model: str, ledger: str, client_factory: Callable[[], Client] = echo_factory,
               fallback_factory: Callable[[], Client] | None = None, fallback_model: str | None = None,
               system: str | None = None, max_tokens: int | None = None,
               per_commit: int = cfg.PROMPTS_PER_COMMIT) -> DataFrame:
    """E4 with a ledger: the columns of ``prompts`` without ``prompt``, and
    (response, status, error, attempt, model).

    A prompt is known by the hash of model, options and text.  Those with an
    answer in the ledger are not sent again, equal ones are sent once, failed
    ones are sent again by the next run.  Prompts are dealt in tasks of some
    ``per_commit``; a task's answers are in the ledger once it ends (output
    committer 2 moves them at once), even if the run fails later: what is lost
    is at most the unfinished tasks' calls."""
    spark = prompts.sparkSession
    options = _options(system, max_tokens)
    asked = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(json.dumps(options, sort_keys=True)).alias("options"), F.col("prompt")))
    keep = [c for c in prompts.columns if c != "prompt"]
    keyed = stored(prompts.withColumn("_key", F.sha2(asked, 256)), "prompts")
    done = read_ledger(prompts, ledger).where("status <> 'error'").select(F.col("key").alias("_key"))
    todo = keyed.select("_key").distinct().join(done, "_key", "left_anti")
    n = todo.count()
    if n:
        build = _caller(model, client_factory, fallback_factory, fallback_model, options)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = build()
            for pdf in batches:
                out = [(key, *ask(prompt)) for key, prompt in zip(pdf["_key"], pdf["prompt"])]
                yield pd.DataFrame(out, columns=[f.name for f in LEDGER.fields])

        missing = keyed.select("_key", "prompt").join(done, "_key", "left_anti").dropDuplicates(["_key"])
        missing.repartition(math.ceil(n / per_commit), "_key").mapInPandas(run, LEDGER) \
            .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    answers = read_ledger(prompts, ledger).withColumnRenamed("key", "_key").join(keyed.select("_key").distinct(), "_key", "left_semi")
    best = answers.groupBy("_key").agg(F.max_by(F.struct("response", "status", "error", "attempt", "model"), F.col("status") != "error").alias("_a"))
    return keyed.select("_key", *keep).join(best, "_key").select(*keep, "_a.*")
