"""A table of questions answered in one job: refuse, reuse, retrieve, generate, cite, record."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import completion, request_outcome
from ..functions.hashing import cache_key
from ..functions.text import normalize_query
from ..functions.usage import ANSWER_OUTCOMES, Pricing, Quota, cost_usd, repaired_tokens
from ..session import materialize
from . import caching, citations
from .requests import OVERRIDABLE, resolve
from .retrieve import SearchSettings, build_context, prompt_chars, retrieve

GENERATED = "key string, text string, input_tokens bigint, output_tokens bigint, thinking_tokens bigint, finish_reason string, failure string"


@dataclass(frozen=True)
class Answered:
    """What one job produces. ``cache_rows``, ``history`` and ``ledger`` are to be appended."""

    refused: DataFrame
    responses: DataFrame
    results: DataFrame
    citations: DataFrame
    rule_references: DataFrame
    cache_rows: DataFrame
    history: DataFrame
    ledger: DataFrame


def effective_settings(s: SearchSettings):
    """The retrieval settings of a request as a struct: its overrides over the job's."""
    value = lambda k, kind, default: F.coalesce(F.element_at("overrides", k).try_cast(kind), F.lit(default)).cast(kind).alias(k)
    return F.struct(*[value(k, OVERRIDABLE[k], v) for k, v in asdict(s).items()])


def gate(requests: DataFrame, ledger: DataFrame, q: Quota) -> DataFrame:
    """query_id, degraded of requests that want a new answer, judged one after the other per bucket on top of the recorded
    answers; a day whose recorded spend has used up the budget admits nobody. A bucket's rows stream through a task
    in time order, only the times that still matter are held."""
    from ..streaming.usage import DAY_US, admit_times

    width = q.window_minutes * 60_000_000
    bucket = F.coalesce("ip_bucket", F.lit("")).alias("ip_bucket")
    past = ledger.filter(F.col("outcome").isin(*ANSWER_OUTCOMES) & ~F.coalesce("is_admin", F.lit(False)))
    rows = requests.select("query_id", bucket, "created_at", F.lit(False).alias("past")).unionByName(past.select(F.lit(None).cast("bigint").alias("query_id"), bucket, "created_at", F.lit(True).alias("past")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, admitted = None, []
        for batch in batches:
            for key, part in batch.groupby("ip_bucket", sort=False):
                if key != name:
                    name, admitted = key, []
                times = part["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
                old = part["past"].to_numpy(bool)
                codes = np.zeros(len(part), np.int8)
                for run in np.split(np.arange(len(part)), np.flatnonzero(np.diff(old)) + 1):
                    if old[run[0]]:
                        admitted.extend(times[run].tolist())
                    else:
                        codes[run] = admit_times(times[run], q, admitted)
                last = int(times[-1])
                admitted = [t for t in admitted if t >= min(last // DAY_US * DAY_US, last - width)]
                yield pd.DataFrame({"query_id": part["query_id"][~old].astype("int64"), "refused": codes[~old] > 0})

    ordered = rows.repartition("ip_bucket").sortWithinPartitions("ip_bucket", "created_at", F.desc("past"), "query_id")
    judged = ordered.mapInPandas(judge, "query_id bigint, refused boolean")
    spent = ledger.groupBy(F.to_date("created_at").alias("_day")).agg(F.sum("cost_usd").alias("_spent")).filter(F.round("_spent", 9) >= q.daily_budget_usd).select("_day", F.lit(True).alias("_broke"))
    days = requests.select("query_id", F.to_date("created_at").alias("_day")).join(spent, "_day", "left")
    return judged.join(days, "query_id").select("query_id", F.when(F.col("_broke"), "global_budget").when(F.col("refused"), "ip_quota").alias("degraded"))


def answer_questions(requests: DataFrame, encode: Callable[[DataFrame], DataFrame], cards: DataFrame, rules: DataFrame, points: DataFrame, cache: DataFrame,
                     load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], data_version: str, generator: str, model: str,
                     s: SearchSettings = SearchSettings(), pricing: Pricing = Pricing(), prompt_version: int = 1, system_chars: int = 0,
                     ordinary: DataFrame | None = None, eval_mode: bool = False, ledger: DataFrame | None = None, quota: Quota | None = None) -> Answered:
    """Answer every request of a table.

    ``requests``: query_id, query, overrides, fresh, may_refresh, source, ip_bucket,
    is_admin, created_at, and optionally generate (false: results only). ``cache``: key, answer, created_at. ``encode``
    adds the two vectors to the questions; ``load`` gives a batch function from (key, query, context) to
    GENERATED. Requests with the same key are generated once; the key holds the request's own settings, and one search
    serves all settings. With ``ledger`` and ``quota``, visitors' requests that no cached answer serves
    pass the gate; refused ones get results and no answer. Stages that feed several
    others are written to the shared folder, so nothing expensive runs twice."""
    if "generate" not in requests.columns:
        requests = requests.withColumn("generate", F.lit(True))
    checked = resolve(requests, eval_mode)
    asked = checked.filter(F.col("status") == 200).withColumn("_settings", effective_settings(s))
    key = cache_key(normalize_query(F.col("query")), F.lit(prompt_version), F.lit(data_version), {k: F.col(f"_settings.{k}") for k in asdict(s)}, F.lit(generator))
    asked = asked.withColumn("key", key)
    known = cache.select("key", F.col("answer").alias("cached_answer"), F.col("created_at").alias("cached_at"))
    probed = caching.probe(asked, known).withColumn("hit", F.col("hit") & F.col("generate") & ~F.col("fresh") & F.lit(not eval_mode))
    hits, todo = probed.filter("hit"), probed.filter(~F.col("hit")).drop("cached_answer", "cached_at", "hit")
    gated = todo.filter(F.col("generate") & ~F.coalesce("is_admin", F.lit(False)))
    if ledger is not None and quota is not None and not eval_mode:
        todo = todo.join(gate(gated, ledger, quota), "query_id", "left")
    else:
        todo = todo.withColumn("degraded", F.lit(None).cast("string"))
    todo = materialize(todo, "requests")

    questions = encode(todo.select("query_id", F.col("query").alias("text")))
    results = materialize(retrieve(questions, cards, rules, points, s, ordinary, settings=todo.select("query_id", "_settings.*")), "results")
    prompts = todo.join(build_context(results), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    wanted = F.col("generate") & F.col("degraded").isNull()
    once = caching.misses(prompts.filter(wanted).select("key", "query", "context"), cache.limit(0))
    made = materialize(caching.run_batches(once, load, GENERATED), "generated")

    chars = prompt_chars(F.col("query"), F.col("context"), system_chars)
    tokens = repaired_tokens(F.col("failure").isNull() | (F.col("text") != ""), F.col("finish_reason"), F.col("input_tokens"), F.col("output_tokens"),
                             F.col("thinking_tokens"), chars, F.coalesce("text", F.lit("")), pricing)
    done = prompts.filter(wanted).join(made, "key").withColumn("_c", completion(F.col("text"), F.col("failure"), F.col("finish_reason"))).withColumn("_t", tokens)
    written = done.select("query_id", "key", "query", "source", "ip_bucket", "is_admin", "created_at", "context_hash", "failure", "_c.*", "_t.*")
    written = materialize(citations.validate(written, results), "answers").withColumn("answer", F.when(F.col("answer").isNotNull(), F.col("cleaned"))).drop("cleaned")
    bare = todo.filter(~wanted)

    shared = ["query_id", "key", "query", "source", "created_at"]
    none = F.lit(None)
    responses = written.select(
        *shared, "answer", "answer_complete", "error", "cited", "cited_count", "invalid_count", "uncited_answer", F.lit(False).alias("cached"), none.cast("timestamp").alias("cached_at"), none.cast("string").alias("degraded"),
    ).unionByName(hits.select(*shared, F.col("cached_answer").alias("answer"), F.lit(True).alias("answer_complete"), F.lit(True).alias("cached"), "cached_at"), allowMissingColumns=True
    ).unionByName(bare.select(*shared, "degraded", F.lit(False).alias("cached")), allowMissingColumns=True)
    cost = cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("thinking_tokens"), pricing)
    zero = F.lit(0).cast("bigint")

    def recorded(rows: DataFrame, outcome, counts, spent) -> DataFrame:
        return rows.select("created_at", "ip_bucket", "is_admin", outcome.alias("outcome"), F.lit(model).alias("model"), *[c.alias(n) for n, c in zip(("input_tokens", "output_tokens", "thinking_tokens"), counts)], spent.alias("cost_usd"))

    said = lambda degraded, hit, failed: request_outcome(F.lit(True), degraded, F.lit(hit), failed)
    nobody = F.lit(None).cast("string")
    entries = recorded(written, said(nobody, False, F.col("failure").isNotNull()), [F.col(c) for c in ("input_tokens", "output_tokens", "thinking_tokens")], cost).unionByName(
        recorded(hits, said(nobody, True, F.lit(False)), [zero] * 3, F.lit(0.0))).unionByName(
        recorded(bare.filter("generate"), said(F.col("degraded"), False, F.lit(False)), [zero] * 3, F.lit(0.0)))
    keep = caching.cacheable(written.withColumn("eval_mode", F.lit(eval_mode)))
    saved = responses if not eval_mode else responses.filter(~F.coalesce(F.col("source") == "eval", F.lit(False)))
    return Answered(
        refused=checked.filter(F.col("status") != 200), responses=responses, results=citations.mark_cited(results, written),
        citations=citations.cited_sources(written, results), rule_references=citations.referenced_rules(written, rules, text="answer"),
        cache_rows=keep.groupBy("key").agg(F.max_by("answer", "created_at").alias("answer"), F.max("created_at").alias("created_at")),
        history=saved.select("query_id", "query", "answer", "error", "cached", "created_at"), ledger=entries if not eval_mode else entries.limit(0))
