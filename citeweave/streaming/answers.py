"""Answer streams: events folded into drafts and final answers, in batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.text import visible_draft
from ..operators.citations import live_numbers

# The events of the protocol; other names are ignored.
EVENTS = ("results", "thinking", "delta", "error", "done")
UNREADABLE = "The answer couldn't be read."


def typed_events(events: DataFrame) -> DataFrame:
    """Known events with their payload: text of a delta, message of an error, answer of the
    last event, source numbers of the first."""
    known = events.filter(F.col("event").isin(*EVENTS))
    head = F.from_json("data", "sources array<struct<number:bigint>>")
    done = F.from_json("data", "answer string, answer_complete boolean")
    return known.select(
        "stream_id", "seq", "ts", "event",
        F.when(F.col("event") == "delta", F.get_json_object("data", "$.text")).when(F.col("event") == "done", done.answer)
        .when(F.col("event") == "error", F.get_json_object("data", "$.message")).alias("text"),
        F.when(F.col("event") == "done", done.answer_complete).alias("complete"),
        F.when(F.col("event") == "results", F.transform(head.sources, lambda s: s.number)).alias("sources"),
    )


def _final(d: DataFrame, broken: str) -> DataFrame:
    """The state shown after a stream broke or ended: a cut-off answer keeps its text."""
    draft = F.regexp_replace(visible_draft(F.col("draft")), r"(?U)\s+$", "")
    cut = F.nullif(draft, F.lit(""))
    open_ = F.col("phase") == "streaming"
    answer = F.when(open_, cut).otherwise(F.col("answer"))
    return d.select(
        "stream_id",
        F.when(open_, "result").when(F.col("phase") == "loading", "failed").otherwise(F.col("phase")).alias("phase"),
        answer.alias("answer"),
        F.when(open_ & cut.isNotNull(), F.lit(False)).otherwise(F.when(~open_, F.col("complete"))).alias("answer_complete"),
        F.when(F.col("phase") == "loading", broken).otherwise(F.col("message")).alias("message"),
        F.when(open_ & cut.isNotNull(), live_numbers(cut, F.col("sources"))).alias("live_citations"),
    )


def fold_batch(events: DataFrame, broken: str = "The connection was lost.") -> DataFrame:
    """Final answers of recorded streams. The first event must be ``results``; the first
    ``done`` or second ``results`` ends a stream and only deltas before it count. A stream
    is one answer, so its events are a short list."""
    e = typed_events(events)
    w = Window.partitionBy("stream_id").orderBy("seq")
    e = e.withColumn("_first", F.first("event").over(w)).withColumn("_n", F.row_number().over(w))
    stop = (F.col("_n") > 1) & F.col("event").isin("results", "done")
    before = F.coalesce(F.sum(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("_stop", stop).withColumn("_live", before == 0)
    deltas = F.sort_array(F.collect_list(F.when(F.col("_live") & (F.col("event") == "delta"), F.struct("seq", "text"))))
    g = e.groupBy("stream_id").agg(
        F.first("_first").alias("first"),
        F.array_join(F.transform(deltas, lambda p: p.text), "").alias("draft"),
        F.first(F.when(F.col("_stop") & F.col("_live"), F.struct("event", "text", "complete")), ignorenulls=True).alias("end"),
        F.first(F.when(F.col("_n") == 1, F.col("sources")), ignorenulls=True).alias("sources"),
    )
    good = F.col("first") == "results"
    phase = F.when(~good, "failed").when(F.col("end.event") == "done", "result").otherwise("streaming")
    return _final(g.select(
        "stream_id", phase.alias("phase"), "draft", F.col("sources"), F.when(phase == "result", F.col("end.text")).alias("answer"),
        F.when(phase == "result", F.col("end.complete")).alias("complete"), F.when(~good, UNREADABLE).alias("message")), broken)


_EVENT = "event string, text string, complete boolean, sources array<long>, seq long, at long"
_STATE = "phase string, draft string, answer string, complete boolean, message string, sources array<long>, seq long, events long"
_OUT = f"stream_id string, {_STATE}, timed_out boolean"
_START = ("loading", "", None, None, None, [], -1, 0)


def _advance(state: tuple, rows: list[tuple]) -> tuple:
    """The state after further events, in order of ``seq``: everything up to the end of the stream at once."""
    if not rows:
        return state
    phase, draft, answer, complete, message, sources, seq, events = state
    seq, events = max(seq, rows[-1][4]), events + len(rows)
    if phase == "loading":
        first, rows = rows[0], rows[1:]
        if first[0] == "results":
            phase, sources = "streaming", list(first[3] or [])
        else:
            phase, message = "failed", UNREADABLE
    if phase == "streaming":
        end = next((i for i, r in enumerate(rows) if r[0] in ("results", "done")), len(rows))
        draft += "".join(r[1] or "" for r in rows[:end] if r[0] == "delta")
        if end < len(rows):
            phase, answer, complete = ("result", rows[end][1], rows[end][2]) if rows[end][0] == "done" else ("cut", None, None)
    return phase, draft, answer, complete, message, sources, seq, events


class AnswerFold(StatefulProcessor):
    """State of one answer: what is folded for good, and the events that an earlier one may still precede. One value, as
    every access to state is a round trip from Python: one read and one write per stream and micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", f"{_STATE}, last long, tail array<struct<{_EVENT.replace(' ', ':').replace(',:', ', ')}>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        mark, known = timerValues.getCurrentWatermarkInMs(), self.known.get()
        *state, last, tail = known if known is not None else (*_START, -1, [])
        tail = sorted([tuple(e) for e in tail] + [(r.event, r.text, r.complete, r.sources, r.seq, r.at) for r in rows], key=lambda r: (r[4], r[5]))
        last = max([last, *(r[5] for r in tail)])
        if known is None:
            self.handle.registerTimer(max(last, mark) + 1)
        # Nothing at or before the watermark can still arrive.
        safe = next((i for i, r in enumerate(tail) if r[5] > mark), len(tail))
        now = _advance(tuple(state), tail[:safe])
        self.known.update((*now, last, tail[safe:]))
        yield Row(stream_id=key[0], **dict(zip(_NAMES, _advance(now, tail[safe:]))), timed_out=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        *state, last, tail = self.known.get()
        if last >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + 1)
            return
        self.known.clear()
        state = _advance(tuple(state), [tuple(e) for e in tail])
        if state[0] in ("loading", "streaming"):
            yield Row(stream_id=key[0], **dict(zip(_NAMES, state)), timed_out=True)


_NAMES = [part.split()[0] for part in _STATE.split(", ")]


def fold_stream(events: DataFrame, silence: str = "10 minutes") -> DataFrame:
    """The same fold as a stateful streaming query: per micro-batch the fold of all that has arrived of every stream that
    moved. Events may come in any order of batches, no more than ``silence`` behind the newest; a stream's times must not
    fall as ``seq`` rises. A stream silent for ``silence`` of event time is broken unless it has ended, and its state goes
    either way, so an event after that begins a stream of its own, which ``final_answers`` lets yield to the longer one.

    Needs the RocksDB state store, which the functions of ``run`` set."""
    typed = typed_events(events).withWatermark("ts", silence).withColumn("at", F.unix_millis("ts"))
    return typed.groupBy("stream_id").transformWithState(AnswerFold(), _OUT, "Update", "EventTime")


def final_answers(updates: DataFrame, broken: str = "The connection was lost.") -> DataFrame:
    """Last state per stream of a table of updates, with streams that stopped half-way cut off."""
    last = updates.groupBy("stream_id").agg(F.max_by(F.struct(*[c for c in updates.columns if c not in ("stream_id", "batch")]), F.struct("events", "timed_out")).alias("s"))
    d = last.select("stream_id", "s.*").withColumn("phase", F.when(F.col("phase") == "cut", "streaming").otherwise(F.col("phase")))
    return _final(d, broken)


def live_view(updates: DataFrame) -> DataFrame:
    """What a reader sees while text arrives: the draft without an unfinished marker and the
    sources it cites so far."""
    return updates.filter(F.col("phase") == "streaming").select(
        "stream_id", "seq", visible_draft(F.col("draft")).alias("answer"), live_numbers(F.col("draft"), F.col("sources")).alias("live_citations"))


def join_head_done(head: DataFrame, done: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream join of first and last events per stream; both sides carry ``ts``."""
    h = head.withColumnRenamed("ts", "head_ts").withWatermark("head_ts", within)
    d = done.withColumnRenamed("ts", "done_ts").withColumnRenamed("stream_id", "_stream").withWatermark("done_ts", within)
    on = (F.col("stream_id") == F.col("_stream")) & (F.col("done_ts") >= F.col("head_ts")) & (F.col("done_ts") <= F.col("head_ts") + F.expr(f"INTERVAL {within}"))
    return h.join(d, on).drop("_stream")


def accumulate(chunks: DataFrame, stream_id: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Recorded generation chunks per stream: text in order, the last reported counts."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("seq"), F.coalesce("text", F.lit("")).alias("text"))))
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c)
    return chunks.groupBy(stream_id).agg(
        F.array_join(F.transform(parts, lambda p: p.text), "").alias("text"),
        *[last(c) for c in ("input_tokens", "output_tokens", "thinking_tokens", "finish_reason")])
