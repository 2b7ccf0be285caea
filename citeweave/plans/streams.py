"""Queries that run Structured Streaming over the tables to the end of what is available."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.usage import Quota
from ..session import fresh_path, materialize
from ..streaming import answers as sa
from ..streaming import run
from ..streaming import usage as su
from .ledger import KEYED, LEDGER, OUTCOMES, question_key
from .registry import Tables, query


def answer_events(t: Tables) -> DataFrame:
    """Conversations as recorded answer streams: a head, the turns as deltas, and an end.
    Some end without ``done``, some without a head, some with a second head."""
    c, n = F.col("conv_id"), F.col("turn")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + c * 60 + n)
    head = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("number")), F.struct(F.lit(2).alias("number"))).alias("sources")))
    base = t.conversations.select(F.concat(F.lit("s"), c.cast("string")).alias("stream_id"), (n * 2 + 1).alias("seq"), ts.alias("ts"), F.lit("delta").alias("event"),
                                  F.to_json(F.struct(F.concat(F.col("role"), F.lit(" ["), (n + 1).cast("string"), F.lit("] ")).alias("text"))).alias("data"))
    ends = t.conversations.groupBy(c).agg(F.max(n).alias("last"))
    first = ends.filter(c % 5 != 4).select(F.concat(F.lit("s"), c.cast("string")), F.lit(0).cast("bigint"), F.timestamp_seconds(F.lit(1_700_000_000) + c * 60), F.lit("results"), head)
    think = ends.select(F.concat(F.lit("s"), c.cast("string")), F.lit(2).cast("bigint"), F.timestamp_seconds(F.lit(1_700_000_000) + c * 60), F.when(c % 2 == 0, "thinking").otherwise("ping"), F.lit("{}"))
    done = F.when(c % 5 == 3, F.struct(F.lit("results").alias("e"), head.alias("d"))).otherwise(
        F.struct(F.lit("done").alias("e"), F.to_json(F.struct(F.concat(F.lit("final "), c.cast("string")).alias("answer"), (c % 2 == 0).alias("answer_complete"))).alias("d")))
    last = ends.filter(c % 5 != 2).select(F.concat(F.lit("s"), c.cast("string")).alias("stream_id"), (F.col("last") * 2 + 2).alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + c * 60 + F.col("last")).alias("ts"), done.alias("x")).select("stream_id", "seq", "ts", "x.e", "x.d")
    return base.union(first).union(think).union(last)


FINAL = """d AS (SELECT conv_id AS c, string_agg(role || ' [' || (turn + 1) || '] ', '' ORDER BY turn) AS draft, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT 's' || c AS stream_id, CASE WHEN c % 5 = 4 THEN 'failed' ELSE 'result' END AS phase, CASE WHEN c % 5 = 4 THEN NULL WHEN c % 5 IN (2, 3) THEN rtrim(draft) ELSE 'final ' || c END AS answer,
 CASE WHEN c % 5 = 4 THEN NULL WHEN c % 5 IN (2, 3) THEN FALSE ELSE c % 2 = 0 END AS answer_complete, CASE WHEN c % 5 = 4 THEN 'The answer couldn''t be read.' END AS message,
 CASE WHEN c % 5 IN (2, 3) THEN CASE WHEN last >= 1 THEN '1,2' ELSE '1' END END AS live_citations FROM d"""


def _shown(d: DataFrame) -> DataFrame:
    return d.withColumn("live_citations", F.array_join(F.col("live_citations").cast("array<string>"), ","))


@query("fold_answers_batch", f"WITH {FINAL}")
def fold_answers_batch(t: Tables) -> DataFrame:
    return _shown(sa.fold_batch(answer_events(t)))


def arriving_events(t: Tables, slots: int = 2) -> DataFrame:
    """The recorded streams in ``slots`` arrivals by time, each event up to eight minutes late: later ones overtake it."""
    events = materialize(answer_events(t), "answer-events")
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    late = F.pmod(F.xxhash64("stream_id", "seq"), F.lit(480))
    place = (F.unix_seconds("ts") + late - F.lit(first)) * slots / F.lit((last or 0) - (first or 0) + 481)
    return events.withColumn("slot", F.floor(place))


@query("stream_final_answers", f"WITH {FINAL}")
def stream_final_answers(t: Tables) -> DataFrame:
    return _shown(sa.final_answers(run.in_arrivals(arriving_events(t), "slot", 2, sa.fold_stream, "final-answers")))


@query("stream_live_view", """SELECT 's' || conv_id AS stream_id, string_agg(role || ' [' || (turn + 1) || '] ', '' ORDER BY turn) AS answer, CASE WHEN max(turn) >= 1 THEN '1,2' ELSE '1' END AS live_citations
FROM conversations WHERE conv_id % 5 = 2 GROUP BY conv_id""")
def stream_live_view(t: Tables) -> DataFrame:
    """What readers of the streams that never end see last."""
    live = sa.live_view(run.in_arrivals(arriving_events(t), "slot", 2, sa.fold_stream, "live-view").filter(F.pmod(F.substring("stream_id", 2, 20).cast("long"), F.lit(5)) == 2))
    last = live.groupBy("stream_id").agg(F.max_by(F.struct("answer", "live_citations"), F.struct("seq", F.length("answer"))).alias("s"))
    return _shown(last.select("stream_id", "s.*"))


@query("accumulated_chunks", """SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text, arg_max(CASE WHEN role = 'user' THEN turn END, turn) FILTER (role = 'user') AS input_tokens, (SELECT 'STOP') AS finish_reason FROM conversations GROUP BY conv_id""")
def accumulated_chunks(t: Tables) -> DataFrame:
    none = F.lit(None).cast("int")
    chunks = t.conversations.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), "text", F.when(F.col("role") == "user", F.col("turn")).alias("input_tokens"), none.alias("output_tokens"), none.alias("thinking_tokens"),
                                    F.lit("STOP").alias("finish_reason"))
    return sa.accumulate(chunks).select("stream_id", "text", "input_tokens", "finish_reason")


def usage_stream(t: Tables) -> DataFrame:
    outcome = F.create_map(*[F.lit(v) for pair in OUTCOMES.items() for v in pair])
    events = run.read_table_stream(t.spark, t.directory, "events", t.events.schema)
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip_bucket"),
                         (F.col("user_id") % 17 == 0).alias("is_admin"), outcome[F.col("event_type")].alias("outcome"), (F.col("value") / 1000).alias("cost_usd"))


@query("stream_daily_usage", f"WITH {LEDGER} SELECT CAST(created_at AS DATE)::VARCHAR AS date, outcome, count(*) AS requests, round(sum(cost_usd), 6) AS spend_usd FROM ledger GROUP BY ALL")
def stream_daily_usage(t: Tables) -> DataFrame:
    updates = run.updates_to_table(su.daily_usage(usage_stream(t)), "daily-usage")
    last = updates.groupBy("date", "outcome").agg(F.max_by(F.struct("requests", "spend_usd"), "batch").alias("u"))
    return last.select(F.col("date").cast("string").alias("date"), "outcome", "u.requests", F.round("u.spend_usd", 6).alias("spend_usd"))


_OPEN = "len(list_filter(adm, lambda x: x::DATE = r.at::DATE)) < 2 AND len(list_filter(adm, lambda x: x >= r.at - INTERVAL 120 MINUTE)) < 1"


@query("stream_admission", f"""WITH RECURSIVE {LEDGER}, gated AS (SELECT id, ip_bucket, created_at AS at, row_number() OVER (PARTITION BY ip_bucket ORDER BY created_at, id) AS n FROM ledger WHERE NOT is_admin AND outcome <> 'cached'),
walk AS (SELECT DISTINCT ip_bucket, 0::BIGINT AS n, []::TIMESTAMP[] AS adm, NULL::BIGINT AS id, FALSE AS refused FROM gated
  UNION ALL SELECT r.ip_bucket, r.n, CASE WHEN {_OPEN} THEN list_append(adm, r.at::TIMESTAMP) ELSE adm END, r.id, NOT ({_OPEN}) FROM walk w JOIN gated r ON r.ip_bucket = w.ip_bucket AND r.n = w.n + 1)
SELECT l.id, l.ip_bucket, CASE WHEN w.refused THEN 'ip_quota' END AS degraded FROM ledger l LEFT JOIN walk w ON w.id = l.id""")
def stream_admission(t: Tables) -> DataFrame:
    return run.append_to_table(su.admission(usage_stream(t), Quota(daily_answers=2, window_answers=1, window_minutes=120)), "admission").select("id", "ip_bucket", "degraded")


@query("stream_dedup_questions", f"WITH {KEYED} SELECT DISTINCT key FROM keyed")
def stream_dedup_questions(t: Tables) -> DataFrame:
    """All questions of one day, asked twice."""
    turns = run.read_table_stream(t.spark, t.directory, "conversations", t.conversations.schema).filter(F.col("role") == "user")
    minute = F.timestamp_seconds(F.lit(1_700_006_400) + F.col("conv_id") % 1440 * 60 + F.col("turn"))
    keyed = turns.select(question_key(F.col("text")).alias("key"), minute.alias("ts"))
    return run.append_to_table(su.distinct_questions(keyed.unionByName(keyed), "1 day"), "dedup").select("key")


@query("stream_settlements", """WITH s AS (SELECT l_orderkey AS id, l_returnflag AS f, l_extendedprice AS c, (l_shipdate, l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem) SELECT id, arg_max(f, o) AS outcome, arg_max(c, o) AS cost_usd FROM s GROUP BY id""")
def stream_settlements(t: Tables) -> DataFrame:
    lines = run.read_table_stream(t.spark, t.directory, "lineitem", t.lineitem.schema)
    events = lines.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("outcome"), F.col("l_extendedprice").alias("cost_usd"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("ts"))
    updates = run.updates_to_table(su.settlements(events), "settlements")
    return updates.groupBy("id").agg(F.max_by(F.struct("outcome", "cost_usd"), "batch").alias("s")).select("id", "s.*")


_CLOSED = """CASE event_id % 5 WHEN 0 THEN 'settled' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'pending' ELSE 'settled' END AS outcome,
 round(CASE event_id % 5 WHEN 0 THEN value / 1000 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE value / 100 END, 6) AS cost_usd"""


@query("stream_reservations", f"SELECT event_id AS id, {_CLOSED} FROM events")
def stream_reservations(t: Tables) -> DataFrame:
    """Every event reserves; by its id it settles, cancels, does both, neither, or settles without a cost. Two arrivals, in
    which closings overtake their reservations."""
    e = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("v"), F.pmod("event_id", F.lit(5)).alias("m"))
    later = lambda minutes: F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    steps = F.array(
        F.struct(F.lit("reserve").alias("kind"), F.col("ts").alias("ts"), (F.col("v") / 100).alias("cost_usd")),
        F.when(F.col("m") == 0, F.struct(F.lit("settle").alias("kind"), later(1).alias("ts"), (F.col("v") / 1000).alias("cost_usd"))),
        F.when(F.col("m").isin(1, 2), F.struct(F.lit("cancel").alias("kind"), later(1).alias("ts"), F.lit(None).cast("double").alias("cost_usd"))),
        F.when(F.col("m") == 2, F.struct(F.lit("settle").alias("kind"), later(2).alias("ts"), (F.col("v") / 1000).alias("cost_usd"))),
        F.when(F.col("m") == 4, F.struct(F.lit("settle").alias("kind"), later(1).alias("ts"), F.lit(None).cast("double").alias("cost_usd"))))
    events = materialize(e.select("id", F.explode(F.array_compact(steps)).alias("s")).select("id", "s.*"), "reservation-events")
    first, last = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    late = F.pmod(F.xxhash64("id", "kind"), F.lit(480))
    place = (F.unix_seconds("ts") + late - F.lit(first)) * 2 / F.lit((last or 0) - (first or 0) + 481)
    updates = run.in_arrivals(events.withColumn("slot", F.floor(place)), "slot", 2, su.reservations, "reservations")
    last_state = updates.groupBy("id").agg(F.max_by(F.struct("outcome", "cost_usd"), F.struct("batch", F.col("outcome") == "expired")).alias("s"))
    outcome = F.when(F.col("s.outcome") == "expired", "pending").otherwise(F.col("s.outcome"))
    return last_state.select("id", outcome.alias("outcome"), F.round("s.cost_usd", 6).alias("cost_usd"))


#: Batches that bring the documents before the one that ends the snapshot.
SYNC_ARRIVALS = 3


@query("stream_sync", """SELECT doc_id::VARCHAR AS point_id, sha256(text) AS content_hash, length(text)::DOUBLE AS vector FROM documents""")
def stream_sync(t: Tables) -> DataFrame:
    """The documents as one snapshot that comes in several batches, its end in the last."""
    from .sync import _encode, stored_points

    base = fresh_path(t.spark, "points")
    stored_points(t).write.parquet(f"{base}/start")
    chunks = t.documents.select(F.col("doc_id").cast("string").alias("point_id"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("source_type"), F.col("text").alias("text_to_embed"),
                                F.sha2("text", 256).alias("content_hash"), F.sha2(F.concat("lang", "source"), 256).alias("payload_hash"), F.col("lang").alias("payload"), F.lit(False).alias("ends_snapshot"))
    end = t.spark.range(1).select(*[(F.lit(True) if f.name == "ends_snapshot" else F.lit(None)).cast(f.dataType).alias(f.name) for f in chunks.schema])
    done: list[int] = []
    write = su.sync_batches(lambda: f"{base}/{done[-1] if done else 'start'}", lambda i: f"{base}/{i}", _encode, f"{base}/seen")

    def step(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        done.append(batch_id)

    # Every arrival is written as its tasks come, in as many files as there are tasks: none holds more than the input's splits do.
    arrivals = [chunks.filter(F.pmod(F.xxhash64("point_id"), F.lit(SYNC_ARRIVALS)) == part) for part in range(SYNC_ARRIVALS)]
    checkpoint = fresh_path(t.spark, "sync-checkpoint")
    for arrival in (*arrivals, end):
        arrival.write.mode("append").parquet(f"{base}/arriving")
        run.each_batch(run.read_table_stream(t.spark, f"{base}/arriving", "", chunks.schema), "sync", step, "append", checkpoint)
    return t.spark.read.parquet(f"{base}/{done[-1]}").select("point_id", "content_hash", F.get("dense", F.lit(0)).cast("double").alias("vector"))
