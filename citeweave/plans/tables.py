"""Queries on table round trips, history, responses, settings and whole answering jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import history_replay
from ..functions.hashing import answer_key, judge_key
from ..functions.results import stat_line, summary_line
from ..functions.usage import Pricing, day_start
from ..operators import answering, caching, chunks, citations, encode, requests, retrieve
from ..operators.caching import PER_REQUEST_FIELDS, cached_form
from ..session import fresh_path
from ..sources import scans, tables
from ..streaming import answers as sa
from ..streaming import run
from .ledger import ANSWER, LEDGER, usage
from .registry import Tables, query
from .search import FULL_RESULTS, retrieval_inputs


@query("jsonl_round_trip", "SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "documents-jsonl")
    rows = t.documents.select("doc_id", "text", "lang")
    tables.write_counted(rows, path, "json")
    return scans.read_records(t.spark, path, rows.schema)


@query("lines_of_documents", "SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def lines_of_documents(t: Tables) -> DataFrame:
    return scans.document_lines(t.documents)


@query("ledger_append", f"WITH {LEDGER} SELECT CAST(created_at AS DATE)::VARCHAR AS day, count(*) AS rows, count(*) FILTER ({ANSWER}) AS answers FROM ledger GROUP BY ALL")
def ledger_append(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "ledger")
    rows = usage(t)
    tables.append_ledger(rows.filter("is_admin"), path)
    tables.append_ledger(rows.filter("NOT is_admin"), path)
    read = t.spark.read.parquet(path)
    return read.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"), F.count_if(F.col("outcome").isin("generated", "error", "pending")).alias("answers"))


@query("published_version", "SELECT '2024-01-01' AS version, count(*) AS rows FROM orders")
def published_version(t: Tables) -> DataFrame:
    return tables.publish(t.orders, fresh_path(t.spark, "published"), "2024-01-01").select("version", F.col("rows").cast("bigint").alias("rows"))


@query("card_summaries", """SELECT p_partkey, concat_ws(' · ', nullif(p_type, ''), CASE WHEN p_partkey % 3 = 0 THEN p_size || '/' || p_size WHEN p_partkey % 3 = 1 THEN 'Loyalty ' || p_size END, p_name) AS summary FROM part""")
def card_summaries(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    stats = stat_line(F.col("p_type"), F.when(k == 0, size), F.when(k == 0, size), F.when(k == 1, size))
    return t.part.select("p_partkey", summary_line(stats, F.concat("p_name", F.lit(" \nmore"))).alias("summary"))


@query("history_replay", """SELECT conv_id * 1000 + turn AS id, text AS answer, conv_id % 3 <> 0 AS answer_complete, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS citations, 0 AS rule_references FROM conversations WHERE role = 'assistant'""")
def history_replay_query(t: Tables) -> DataFrame:
    history = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "assistant", F.col("text")).when(F.col("role") == "system", "").alias("answer"),
        F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit(1).alias("number")))).alias("citations"), F.lit(None).cast("array<string>").alias("rule_references"), F.when(F.col("conv_id") % 3 == 0, "cut").alias("error"))
    return history_replay(history).select("id", "answer", "answer_complete", F.size("citations").alias("citations"), F.size("rule_references").alias("rule_references"))


@query("saved_and_cacheable", """SELECT conv_id, turn, turn % 3 <> 0 AS saved, text <> '' AND conv_id % 2 = 0 AND turn % 3 <> 0 AS cached FROM conversations WHERE role = 'assistant' AND (turn % 3 <> 0)""")
def saved_and_cacheable(t: Tables) -> DataFrame:
    r = t.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"), (F.col("conv_id") % 2 == 0).alias("answer_complete"),
                                                                    F.when(F.col("turn") % 3 == 0, "eval").alias("source"), (F.col("turn") % 3 == 0).alias("eval_mode"))
    saved = tables.savable_history(r, F.col("eval_mode"))
    kept = caching.cacheable(r).select("conv_id", "turn", F.lit(True).alias("cached"))
    return saved.join(kept, ["conv_id", "turn"], "left").select("conv_id", "turn", F.lit(True).alias("saved"), F.coalesce("cached", F.lit(False)).alias("cached"))


@query("merged_response", "SELECT doc_id AS stream_id, lang AS degraded, n_chars AS answers_remaining, text AS answer, source AS citation_stats FROM documents")
def merged_response(t: Tables) -> DataFrame:
    responses = t.documents.select(F.col("doc_id").alias("stream_id"), F.col("lang").alias("degraded"), F.col("n_chars").alias("answers_remaining"), F.col("text").alias("answer"), F.col("source").alias("citation_stats"))
    head, done = caching.split_response(responses)
    return caching.merge_response(head, done).select("stream_id", "degraded", "answers_remaining", "answer", "citation_stats")


@query("effective_settings", """SELECT p_partkey, 'hybrid_top_k' AS key, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '10' END AS value FROM part UNION ALL SELECT p_partkey, 'rules_top_k', '5' FROM part""")
def effective_settings(t: Tables) -> DataFrame:
    r = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("hybrid_top_k"), F.col("p_size").cast("string"))).alias("overrides"))
    return requests.settings_rows(r, "p_partkey", {"hybrid_top_k": 10, "rules_top_k": 5})


@query("live_citations", """SELECT conv_id, turn, text AS shown, CASE turn % 3 WHEN 0 THEN '1' WHEN 1 THEN '1,2' ELSE '' END AS numbers FROM conversations""")
def live_citations(t: Tables) -> DataFrame:
    from ..functions.text import visible_draft

    k = F.col("turn") % 3
    # Markers go in front of the text, so the shown text ends where the unfinished marker begins.
    draft = F.concat(F.when(k == 0, "[1]").when(k == 1, "[2, 1][9]").otherwise("[7]"), F.col("text"), F.lit("[1, "))
    known = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    shown = F.regexp_replace(visible_draft(draft), r"^(?:\[[\d, ]+\])+", "")
    return t.conversations.select("conv_id", "turn", shown.alias("shown"), F.array_join(citations.live_numbers(draft, known).cast("array<string>"), ",").alias("numbers"))


@query("dense_encoding", """WITH l AS (SELECT doc_id, list_transform(string_split('  ' || lower(text) || ' ', ''), lambda c: unicode(c)::BIGINT) AS l FROM documents),
h AS (SELECT doc_id, unnest(list_transform(range(1, len(l) - 1), lambda i: ((961 * l[i] + 31 * l[i + 1] + l[i + 2]) * 2654435761) % 4294967296)) AS h FROM l),
s AS (SELECT doc_id, (h // 256) % 8388608 % 16 AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS n FROM h GROUP BY ALL)
SELECT doc_id, place::INTEGER AS place, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS value FROM s WHERE n <> 0""")
def dense_encoding(t: Tables) -> DataFrame:
    made = encode.dense_vector(t.spread("documents", "doc_id").select("doc_id", "text"), "text", encode.hashed_encoder(16))
    return made.select("doc_id", F.posexplode("dense").alias("place", "value")).filter("value <> 0").withColumn("value", F.col("value").cast("double"))


@query("point_ids_of_type", "SELECT doc_id::VARCHAR AS point_id FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 = 1")
def point_ids_of_type(t: Tables) -> DataFrame:
    from ..sources.points import point_ids
    from .sync import stored_points

    return point_ids(stored_points(t), "s1")


@query("utc_day_starts", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def utc_day_starts(t: Tables) -> DataFrame:
    return t.events.select("event_id", day_start(F.col("ts").cast("timestamp_ntz")).alias("day"))


@query("eval_keys", """SELECT doc_id, sha256('{"a_kind":"answer","context_hash":' || to_json(source) || ',"generator":"g","overrides":"{}","prompt_version":1,"question":' || to_json(text) || '}') AS answer_key,
 sha256('{"a_kind":"judge","answer":' || to_json(text) || ',"gold":' || to_json(lang) || ',"model":"m","prompt_version":2,"question":' || to_json(text) || ',"should_decline":' || (doc_id % 2 = 0) || '}') AS judge_key FROM documents""")
def eval_keys(t: Tables) -> DataFrame:
    text, one = F.col("text"), F.lit(1)
    return t.documents.select(
        "doc_id", answer_key(text, F.col("source"), F.lit("g"), one, F.lit("{}")).alias("answer_key"), judge_key(text, F.col("lang"), text, F.lit("m"), F.lit(2), F.col("doc_id") % 2 == 0).alias("judge_key"))


@query("cached_forms", "SELECT doc_id, text AS answer, source FROM documents")
def cached_forms(t: Tables) -> DataFrame:
    extra = {name: F.lit("x") for name in PER_REQUEST_FIELDS}
    return cached_form(t.documents.select("doc_id", F.col("text").alias("answer"), "source").withColumns(extra))


@query("all_sources_as_points", "SELECT p_partkey::VARCHAR AS point_id, 'oracle' AS source_type FROM part UNION ALL SELECT doc_id::VARCHAR, 'ruling' FROM documents")
def all_sources_as_points(t: Tables) -> DataFrame:
    cards = t.part.select(F.col("p_partkey").cast("string").alias("point_id"), F.lit("oracle").alias("source_type"))
    rulings = t.documents.select(F.lit("ruling").alias("source_type"), F.col("doc_id").cast("string").alias("point_id"))
    return chunks.all_chunks(cards, rulings)


@query("stream_head_done_join", """SELECT conv_id AS stream_id, min(turn) FILTER (role = 'user') AS head, max(turn) FILTER (role = 'assistant') AS done FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'assistant') > 0""")
def stream_head_done_join(t: Tables) -> DataFrame:
    stream = run.read_table_stream(t.spark, t.directory, "conversations", t.conversations.schema)
    ts = lambda extra: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + extra)
    head = stream.filter(F.col("role") == "user").select(F.col("conv_id").alias("stream_id"), ts(F.lit(0)).alias("ts"), F.col("turn").alias("head"))
    done = stream.filter(F.col("role") == "assistant").select(F.col("conv_id").alias("stream_id"), ts(F.col("turn")).alias("ts"), F.col("turn").alias("done"))
    joined = run.append_to_table(sa.join_head_done(head, done), "head-done")
    return joined.groupBy("stream_id").agg(F.min("head").alias("head"), F.max("done").alias("done"))


def _generator():
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["context"].str.len()
        return pd.DataFrame({"key": rows["key"], "text": "Yes [1]. See " + size.astype(str) + " [99].", "input_tokens": size, "output_tokens": 7, "thinking_tokens": 0, "finish_reason": "STOP", "failure": None})

    return write


@query("answered_questions", f"""WITH RECURSIVE {FULL_RESULTS}, ctx AS (SELECT query_id, length(string_agg('[' || number || '] ' || label || ': ' || text, chr(10) || chr(10) ORDER BY number)) AS n, count(*) AS m FROM numbered GROUP BY query_id)
SELECT id AS query_id, id % 3 = 0 AS bare, CASE WHEN bare THEN NULL WHEN n IS NULL THEN 'Yes. See 0.' WHEN m >= 99 THEN 'Yes [1]. See ' || n || ' [99].' ELSE 'Yes [1]. See ' || n || '.' END AS answer, CASE WHEN NOT bare THEN TRUE END AS answer_complete,
 CASE WHEN NOT bare THEN (n IS NOT NULL)::INT + (coalesce(m, 0) >= 99)::INT END AS cited_count, CASE WHEN NOT bare THEN (n IS NULL)::INT + (coalesce(m, 0) < 99)::INT END AS invalid_count, FALSE AS cached
FROM qs LEFT JOIN ctx ON query_id = id WHERE length(text) <= 500 AND id % 5 <> 0""")
def answered_questions(t: Tables) -> DataFrame:
    """Questions of visitors: every third wants results only, every fifth brings settings that visitors may not bring."""
    q, cards, rules, points = retrieval_inputs(t)
    vectors, no_map = q.select("query_id", "dense", "sparse"), F.create_map().cast("map<string,string>")
    asked = q.select("query_id", F.col("text").alias("query")).withColumns({
        "overrides": F.when(F.col("query_id") % 5 == 0, F.create_map(F.lit("rules_top_k"), F.lit("1"))).otherwise(no_map), "generate": F.col("query_id") % 3 != 0,
        "fresh": F.lit(False), "may_refresh": F.lit(False), "source": F.lit(None).cast("string"), "ip_bucket": F.lit("b"), "is_admin": F.lit(False),
        "created_at": F.timestamp_seconds(F.col("query_id") + 1_700_000_000)})
    empty = t.spark.createDataFrame([], "key string, answer string, created_at timestamp")
    a = answering.answer_questions(asked, lambda d: d.join(vectors, "query_id"), cards, rules, points, empty, _generator, "v1", "g:m", "m", retrieve.SearchSettings(), Pricing(1.0, 2.0))
    return a.responses.select("query_id", (F.col("query_id") % 3 == 0).alias("bare"), "answer", "answer_complete", "cited_count", "invalid_count", "cached")
