"""Ledger work on streams: admission, settlement, daily usage, repeated questions, sync."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.usage import Quota
from ..operators import sync

DAY_US = 86_400_000_000


def admit_times(times: np.ndarray, q: Quota, admitted: list[int]) -> np.ndarray:
    """Which of the sorted request times (microseconds) are admitted, given earlier admitted
    ones: 0 open, 1 daily quota, 2 sliding window. Refused runs are skipped by binary search,
    so the work grows with admissions and not with requests."""
    width = q.window_minutes * 60_000_000
    out = np.zeros(len(times), dtype=np.int8)
    at = 0
    while at < len(times):
        now = int(times[at])
        today = sum(1 for t in admitted if t // DAY_US == now // DAY_US)
        recent = [t for t in admitted if t >= now - width]
        if today >= q.daily_answers:
            until, code = (now // DAY_US + 1) * DAY_US, 1
        elif len(recent) >= q.window_answers:
            # Free again once the oldest of the last N is outside the window, or next day
            # for the reason shown; times are whole microseconds.
            until, code = sorted(recent)[-q.window_answers] + width + 1, 2
        else:
            admitted.append(now)
            at += 1
            continue
        end = int(np.searchsorted(times, until, side="left"))
        out[at:end] = code
        at = end
    return out


_ADMISSION = "id long, created_at timestamp, ip_bucket string, degraded string"


def admission(requests: DataFrame, q: Quota, late: str = "10 minutes") -> DataFrame:
    """Decide every request of a stream in time order per bucket (id, created_at, ip_bucket, is_admin, outcome).

    Only visitors' requests that need a new answer pass the gate, and only admitted ones use up quota: administrators
    and answers out of the cache are let through and not counted. Requests of one micro-batch are judged by time;
    one that comes later than ``late`` behind the newest is judged against what was admitted before it arrived. State
    holds the admitted times that can still matter, and goes when the watermark has left the bucket's last day and window
    behind.

    The global budget is one key for all buckets, so it is applied afterwards to the
    admitted rows (``operators.ledger.gate_audit`` for the exact audit)."""
    width = q.window_minutes * 60_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        admitted = list(state.get[0]) if state.exists else []
        for rows in sorted_batches(batches):
            gated = (~rows["is_admin"].fillna(False).astype(bool) & (rows["outcome"] != "cached")).to_numpy()
            times = rows["created_at"].astype("datetime64[us]").astype("int64").to_numpy()
            codes = np.zeros(len(rows), dtype=np.int8)
            codes[gated] = admit_times(times[gated], q, admitted)
            last = int(times[-1])
            admitted = [t for t in admitted if t >= min(last // DAY_US * DAY_US, last - width)]
            names = np.array([None, "ip_quota", "ip_quota"], dtype=object)
            yield pd.DataFrame({"id": rows["id"], "created_at": rows["created_at"], "ip_bucket": key[0], "degraded": names[codes]})
        newest = max(admitted, default=0)
        state.update((admitted,))
        until = max(newest // DAY_US * DAY_US + DAY_US, newest + width) // 1000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    keyed = requests.withWatermark("created_at", late).select("id", "created_at", "ip_bucket", "is_admin", "outcome")
    return keyed.groupBy("ip_bucket").applyInPandasWithState(step, _ADMISSION, "admitted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def sorted_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's rows of one micro-batch in time order. Bound a micro-batch by ``files_per_trigger``."""
    rows = pd.concat(list(batches))
    if len(rows):
        yield rows.sort_values(["created_at", "id"])


def daily_usage(ledger: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and spend per UTC day and outcome, kept up to date."""
    day = F.window("created_at", "1 day").alias("w")
    return ledger.withWatermark("created_at", late).groupBy(day, "outcome").agg(
        F.count("*").alias("requests"), F.sum("cost_usd").alias("spend_usd")).select(
        F.to_date(F.col("w.start")).alias("date"), "outcome", "requests", "spend_usd")


def settlements(events: DataFrame) -> DataFrame:
    """Latest state per answer of a stream of reserve / settle / cancel events (update mode). An
    answer that never settles keeps its pending row at the worst-case cost, and so its state."""
    return events.groupBy("id").agg(F.max_by(F.struct("outcome", "cost_usd"), "ts").alias("s")).select("id", "s.outcome", "s.cost_usd")


#: Ids whose reservations share a state: an aligned run of 2 ** RUN_BITS numbers, so that a state holds no more than these.
RUN_BITS = 10
_HELD = "ids array<long>, reserved array<double>, kinds array<string>, costs array<double>, ats array<long>, dues array<long>"
_SHOWN = "id long, outcome string, cost_usd double, no_number boolean"


def _shown(id_: int, reserved: float | None, kind: str | None, cost: float | None) -> tuple[int, str, float | None]:
    outcome, amount = {"settle": ("settled", reserved if cost is None else cost), "cancel": ("cancelled", 0.0), None: ("pending", reserved)}[kind]
    return id_, outcome, amount


def _arrived(held: dict[int, list], rows: pd.DataFrame, patience: int, watermark: int) -> list[int]:
    """Add one micro-batch to the reservations of a run: per id what was reserved, the kind, cost and time of the first
    closing, and when the state goes. Returns the ids that moved."""
    newest: dict[int, int] = {}
    moved: dict[int, None] = {}
    for id_, kind, cost, has_cost, at in zip(*(rows[c].tolist() for c in ("id", "kind", "cost_usd", "has_cost", "at"))):
        entry = held.get(id_)
        if entry is None:
            entry = held[id_] = [None, None, None, None, None]
        if entry[4] is None:
            newest[id_] = max(at, newest.get(id_, at))
        moved[id_] = None
        cost = cost if has_cost else None
        if kind == "reserve":
            if cost is not None and (entry[0] is None or cost > entry[0]):
                entry[0] = cost
        elif entry[1] is None or (at, kind) < (entry[3], entry[1]):
            entry[1:4] = kind, cost, at
    for id_, at in newest.items():
        held[id_][4] = max(at + patience, watermark + 1)
    return list(moved)


def reservations(events: DataFrame, late: str = "10 minutes", patience_minutes: int = 60) -> DataFrame:
    """Cost per answer from events (id, kind, ts, cost_usd), update mode, one row per answer and micro-batch that moved it.

    ``reserve`` holds the worst case; the first ``settle`` or ``cancel`` by time closes it, whichever batch it comes in: at
    its own cost (without one, at the worst case), or at nothing. A closing may overtake its reservation. After
    ``patience_minutes`` of event time the state goes, with a last row ``expired`` at the worst case where nothing closed it;
    a closing that comes later still counts by itself. Other kinds are ignored, rows without an id are dropped, and of equal
    times a cancel comes first. Needs the RocksDB state store, which the functions of ``run`` set.

    Neighbouring ids share one state of bounded size, so that a call of Python handles up to 2 ** RUN_BITS answers at once;
    ids that are far apart have states of their own."""
    patience = patience_minutes * 60_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = {id_: entry for id_, *entry in zip(*state.get)} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            out = [_shown(id_, *held[id_][:3]) for id_ in _arrived(held, pd.concat(list(batches)), patience, watermark)]
        gone = [id_ for id_, entry in held.items() if entry[4] < watermark]
        out += [(id_, "expired", held[id_][0]) for id_ in gone if held[id_][1] is None]
        for id_ in gone:
            del held[id_]
        if held:
            state.update(tuple(map(list, zip(*([id_, *entry] for id_, entry in held.items())))))
            state.setTimeoutTimestamp(max(min(entry[4] for entry in held.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if out:
            # Pandas has one value for no cost and for a cost that is no number.
            yield pd.DataFrame([(id_, outcome, cost, cost is not None and cost != cost) for id_, outcome, cost in out], columns=["id", "outcome", "cost_usd", "no_number"]).astype({"cost_usd": float})

    known = events.withWatermark("ts", late).where("id is not null and kind in ('reserve', 'settle', 'cancel')")
    cost = F.col("cost_usd").cast("double")
    rows = known.select(F.col("id").cast("long").alias("id"), "kind", cost.alias("cost_usd"), cost.isNotNull().alias("has_cost"), "ts", F.unix_millis("ts").alias("at"))
    run = rows.withColumn("run", F.shiftright("id", RUN_BITS))
    shown = run.groupBy("run").applyInPandasWithState(step, _SHOWN, _HELD, "update", GroupStateTimeout.EventTimeTimeout)
    return shown.select("id", "outcome", F.when(F.col("no_number"), F.lit(float("nan"))).otherwise(F.col("cost_usd")).alias("cost_usd"))


def distinct_questions(questions: DataFrame, within: str = "1 day", ts: str = "ts", key: str = "key") -> DataFrame:
    """The first request of every key; the key holds the data version, so a new version
    makes a question new."""
    return questions.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def sync_batches(points_path: Callable[[], str], next_path: Callable[[int], str], encode: Callable[[DataFrame], DataFrame], seen_path: str):
    """A foreachBatch writer that syncs the point table with a snapshot that arrives in any number of batches.

    Rows have the columns of chunks and ``ends_snapshot``: true in one last row, without a point id, which says that the
    snapshot is complete. Only then are points pruned that no batch of the snapshot has brought. The new table goes to
    ``next_path``, the ids seen so far to ``seen_path``; a batch that is repeated writes the same again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.filter(F.col("point_id").isNotNull()).drop("ends_snapshot")
        rows.select("point_id", "source_type").write.mode("overwrite").parquet(f"{seen_path}/batch={batch_id}")
        out = sync.apply(rows, spark.read.parquet(points_path()), encode, prune=False)
        if not batch.filter("ends_snapshot").isEmpty():
            seen = spark.read.parquet(seen_path)
            out = out.join(sync.stale_points(seen, out).select("point_id"), "point_id", "left_anti")
        out.write.mode("overwrite").parquet(next_path(batch_id))

    return write
