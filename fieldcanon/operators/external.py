"""Classification by an external client, in batches, with retries.

Spark cuts the distinct keys into batches and writes their request texts; tasks call the client,
one row a batch; the responses are written before they are used, so a lost executor never
repeats finished calls; and the answers are parsed by ``responses``.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import ERROR_LABEL
from ..sources.commits import CommittedTable
from ..sources.storage import written
from .batches import batch_plan, display_text, messages
from .responses import aligned, batch_warnings


class Client(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class TransientError(Exception):
    """A failure that another attempt may mend."""


class RulesClient:
    """Answers from written rules, so that a run needs no network: a field's first rule that fits gives the label
    with HIGH, otherwise the last label comes with LOW and the first two as alternatives.

    ``rules``: of each field, in order, kind, label and phrases, as in ``rules.RULES``; ``labels``: each field's
    labels. A field is named by its prompt.
    """

    FORMS = {"exact": r"\A(?:%s)\Z", "prefix": r"\A(?:%s)", "word": r"(?<![a-z0-9])(?:%s)(?![a-z0-9])", "within": "%s", "pattern": "%s"}

    def __init__(self, rules: dict[str, tuple[tuple[str, str, tuple[str, ...]], ...]], labels: dict[str, tuple[str, ...]]):
        phrase = lambda kind, p: p if kind == "pattern" else re.escape(p)
        self.rules = {f: [(re.compile(self.FORMS[k] % "|".join(phrase(k, p) for p in ps)), label) for k, label, ps in own] for f, own in rules.items()}
        self.labels = labels

    def complete(self, system: str, user: str) -> str:
        labels, out = self.labels[system], []
        for line in user.split("\n")[2:]:
            number, value = line.split(". ", 1)
            text = re.sub(r"^\[Country: .*?\] ", "", value).lower()
            label = next((x for pattern, x in self.rules.get(system, ()) if pattern.search(text)), None)
            out.append(f"{number}. {labels[-1]} | LOW | Alternatives: {', '.join(labels[:2])} | Reason: no rule fits" if label is None else f"{number}. {label} | HIGH")
        return "\n".join([*out, f"[Total: {len(out)} of {len(out)} mapped]"])


def call_with_retry(call: Callable[[], str], attempts: int = 4, base_delay: float = 1.0, max_delay: float = 20.0, transient: tuple[type[BaseException], ...] = (TransientError,), sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str | None]:
    """The response, how often it was tried again, and the last error if no attempt succeeded.

    Delays double up to ``max_delay``, with a quarter more at random. Other errors are raised at
    once.
    """
    for n in range(attempts):
        try:
            return call(), n, None
        except transient as e:
            if n + 1 == attempts:
                return None, n, f"gave up after {attempts} attempt(s): {e}"
            delay = min(max_delay, base_delay * 2**n)
            sleep(delay * (1 + random.random() / 4))
    raise ValueError("attempts must be positive")


def with_batch_id(df: DataFrame) -> DataFrame:
    return df.withColumn("batch_id", F.concat_ws("#", "field_key", F.col("batch_no").cast("string")))


def call_client(requests: DataFrame, client: Callable[[], Client], prompts: dict[str, str], name: str = "batch_id", **retry) -> DataFrame:
    """``batch_id, response, retries, error`` of requests ``batch_id, field_key, message``; or with another
    ``name`` for what tells them apart.

    ``client`` makes a client, once in each task; it must be serialisable.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = client()
        for part in parts:
            rows = []
            for batch, field, message in zip(part[name], part["field_key"], part["message"]):
                response, retries, error = call_with_retry(lambda: own.complete(prompts.get(field, ""), message), **retry)
                rows.append((batch, response, retries, error))
            yield pd.DataFrame(rows, columns=[name, "response", "retries", "error"])

    return requests.select(name, "field_key", "message").mapInPandas(run, f"{name} string, response string, retries bigint, error string")


#: A ledger's rows: what was asked, by the digest of prompt and message, and what came back.
LEDGER = "digest string, response string, retries bigint, error string"
#: Requests that are sent before their responses are entered in the ledger.
WAVE = 1_000


def ledger(spark: SparkSession, path: str) -> CommittedTable:
    """A table of responses that later runs share."""
    return CommittedTable(spark, path, LEDGER)


def ask(requests: DataFrame, client: Callable[[], Client], prompts: dict[str, str], book: CommittedTable, parallel: int = 8, wave: int = WAVE, **retry) -> DataFrame:
    """The same as ``call_client`` for requests whose responses are entered in a ledger.

    A request is the digest of its prompt and message. Equal ones are sent once, answered ones not at all,
    failed ones again. They go out in waves, and each wave's responses are in the ledger before the next
    one is sent: a run that breaks has lost a wave at most, and the next run sends only what is open.
    """
    texts = F.create_map(*(F.lit(x) for pair in prompts.items() for x in pair)) if prompts else F.create_map().cast("map<string,string>")
    prompt = F.coalesce(F.try_element_at(texts, F.col("field_key")), F.lit(""))
    asked = written(requests.withColumn("digest", F.sha2(F.concat(F.length(prompt).cast("string"), F.lit(":"), prompt, F.col("message")), 256)), "asked")
    answered = lambda: book.read().where("error is null").select("digest").distinct()
    todo = written(asked.select("digest", "field_key", "message").dropDuplicates(["digest"]).join(answered(), "digest", "left_anti"), "todo")
    n = -(-todo.count() // wave)
    dealt = todo.withColumn("_wave", F.pmod(F.xxhash64("digest"), F.lit(max(1, n))))
    for k in range(n):
        # Written first, so that entering them again after another writer's entry asks nobody again.
        book.append(written(call_client(dealt.where(F.col("_wave") == k).repartition(parallel), client, prompts, "digest", **retry), "wave"))
    best = F.min_by(F.struct("response", "retries", "error"), F.struct(F.col("error").isNotNull(), F.coalesce("response", F.lit(""))))
    found = book.read().groupBy("digest").agg(best.alias("r"))
    return asked.join(found, "digest").select("batch_id", "r.response", "r.retries", "r.error")


def external_classifier(client: Callable[[], Client], prompts: dict[str, str], folder: str, batch_size: int = 100, parallel: int = 8, book: CommittedTable | None = None, wave: int = WAVE, **retry) -> Callable[[DataFrame], DataFrame]:
    """A classifier for ``standardize`` that asks a client.

    ``folder`` is a new path in storage that all executors share; batches, responses and warnings
    are written there. ``parallel`` bounds the concurrent calls. Keys of a batch that failed get
    the error label with an empty confidence. With a ledger as ``book``, see ``ask``: then a run that is
    repeated, in a new folder, sends only what has no answer yet.
    """

    def classify(keys: DataFrame) -> DataFrame:
        spark = keys.sparkSession
        ordered = keys.select("field_key", "country", "raw").distinct()
        # Distinct hashes give the keys an order that a retry can't change.
        numbered = ordered.withColumn("first_row", F.xxhash64("field_key", "country", "raw"))
        with_batch_id(batch_plan(numbered, batch_size)).write.parquet(f"{folder}/batches")
        plan = spark.read.parquet(f"{folder}/batches")
        requests = with_batch_id(messages(plan))
        came = call_client(requests.repartition(parallel), client, prompts, **retry) if book is None else ask(requests, client, prompts, book, parallel, wave, **retry)
        came.write.parquet(f"{folder}/responses")
        responses = spark.read.parquet(f"{folder}/responses")
        inputs = plan.select("batch_id", F.col("item").alias("idx"), display_text(F.col("raw"), F.col("country")).alias("raw"))
        answered = responses.where("error is null")
        batch_warnings(answered, inputs.join(answered.select("batch_id"), "batch_id", "left_semi")).write.parquet(f"{folder}/warnings")
        found = aligned(answered, inputs).drop("raw")
        failed = responses.where("error is not null").select("batch_id", F.lit(True).alias("failed"))
        joined = plan.join(found, (plan["batch_id"] == found["batch_id"]) & (plan["item"] == found["idx"]), "left").drop(found["batch_id"]).join(failed, "batch_id", "left")
        lost = F.coalesce("failed", F.lit(False))
        return joined.select(
            "field_key",
            "country",
            "raw",
            F.when(lost, ERROR_LABEL).otherwise(F.col("std")).alias("std"),
            F.when(lost, "").otherwise(F.col("confidence")).alias("confidence"),
            F.when(lost, F.array().cast("array<string>")).otherwise(F.col("alternatives")).alias("alternatives"),
            F.when(lost, "").otherwise(F.col("reasoning")).alias("reasoning"),
        )

    return classify


def failures(folder: str, spark) -> DataFrame:
    """The failed batches of a run for its log record: ``field_key, batch_index, values, error``. Batches are
    numbered inside each field."""
    responses = spark.read.parquet(f"{folder}/responses").where("error is not null")
    values = spark.read.parquet(f"{folder}/batches").groupBy("batch_id", "field_key", F.col("batch_no").cast("bigint").alias("batch_index")).agg(
        F.array_sort(F.collect_list(F.struct("item", display_text(F.col("raw"), F.col("country")).alias("value")))).alias("items")
    )
    return responses.join(values, "batch_id").select("field_key", "batch_index", F.transform("items", lambda i: i["value"]).alias("values"), "error")
