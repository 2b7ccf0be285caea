import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeweave.functions.usage import Pricing, Quota
from citeweave.operators import answering, caching, citations, ledger, requests
from citeweave.sources import tables
from citeweave.streaming import answers as sa
from citeweave.streaming import run
from citeweave.streaming import usage as su
from tests.test_matching_search import full_inputs

RESULT = "query_id long, number int, source string, title string, text string, score double, match_type string, oracle_id string, rule_id string, card_name string, published_at string, scryfall_uri string"


def results(spark):
    return spark.createDataFrame([
        (1, 1, "rule", "702.4", "T", 1.0, "m", None, "702.4", None, None, None), (1, 2, "ruling", "Fog", "R", 1.0, "m", "o2", None, "Fog", "2020-01-01", "http://f"),
        (1, 3, "oracle", "Fog", "O", 1.0, "m", "o2", None, None, "2020-01-01", None)], RESULT)


def test_citing_an_answer(spark):
    answers = spark.createDataFrame([(1, "Yes [3][1], see 702.4 and 999.9 [8]."), (2, None), (3, "plain")], "query_id long, answer string")
    rules = spark.createDataFrame([("702.4",)], "rule_id string")
    v, cites, refs = citations.cite(answers, results(spark), rules)
    rows = {r["query_id"]: r for r in v.collect()}
    assert rows[1]["cleaned"] == "Yes [3][1], see 702.4 and 999.9." and rows[1]["cited"] == [3, 1] and rows[1]["invalid_count"] == 1
    assert (rows[2]["cited_count"], rows[2]["invalid_count"], rows[2]["uncited_answer"]) == (0, 0, False)
    assert rows[3]["uncited_answer"] is True
    c = {r["number"]: r for r in cites.collect()}
    assert (c[1]["url"], c[1]["title"], c[3]["source_type"], c[3]["published_at"]) == ("/rules/702.4", "Rule 702.4", "card", None)
    assert [r["rule_id"] for r in refs.collect()] == ["702.4"]
    assert {r["number"]: r["cited"] for r in citations.mark_cited(results(spark), v).collect()} == {1: True, 2: False, 3: True}


def laid_out(spark, text):
    df = spark.createDataFrame([(1, text, [1, 2, 3, 4], ["510.1c"])], "query_id int, answer string, citation_numbers array<bigint>, rule_refs array<string>")
    pieces = citations.sentences(citations.segments(df))
    leads = citations.lead(pieces)
    rows = sorted(((r["piece"], r["kind"], r["text"], r["numbers"], r["sentence"]) for r in pieces.collect()))
    paragraphs = {}
    for r in citations.paragraphs(pieces, leads).orderBy("piece", "cut").collect():
        paragraphs.setdefault(r["paragraph"], []).append(r["text"])
    return rows, leads.first()["lead"], ["".join(p) for _, p in sorted(paragraphs.items())]


def test_sentences_and_layout(spark):
    rows, lead, paragraphs = laid_out(spark, "Short one. [1] Then more [2] follows.\n\nLast [9] has 510.1c here. [3]")
    assert [(r[3][0], r[4]) for r in rows if r[1] == "cite"] == [(1, 0), (2, 1), (3, 3)]
    assert [r[2] for r in rows if r[1] == "rule"] == ["510.1c"] and any("[9]" in r[2] for r in rows if r[1] == "text")
    assert lead == "Short one." and paragraphs == ["Then more [2] follows.", "Last [9] has 510.1c here. [3]"]
    assert laid_out(spark, "x" * 141 + ". More.")[1] is None
    assert laid_out(spark, "Only this.")[1:] == (None, ["Only this."])
    assert laid_out(spark, "No stop\nMore text.")[1] is None


NOW = dt.datetime(2024, 5, 3, 12, 0)


def book(spark, rows):
    full = [(i, r.get("at", NOW), r.get("bucket", "b"), r.get("admin", False), r.get("outcome", "generated"), r.get("cost", 0.0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id long, created_at timestamp, ip_bucket string, is_admin boolean, outcome string, cost_usd double")


def ago(**kw):
    return NOW - dt.timedelta(**kw)


@pytest.mark.parametrize(("earlier", "want"), [
    ([{"at": ago(hours=2)}], (None, 2)), ([{"bucket": "x", "cost": 1.0}], ("global_budget", 3)), ([{"at": ago(hours=h)} for h in (5, 4, 3)], ("ip_quota", 0)),
    ([{"at": ago(minutes=3)}, {"at": ago(minutes=1)}], ("ip_quota", 1)), ([{"at": ago(days=1)}] * 3, (None, 3)), ([{"admin": True, "at": ago(minutes=1)}] * 3, (None, 3)), ([{"outcome": "cached", "at": ago(minutes=1)}] * 3, (None, 3)),
    ([{"at": ago(minutes=10)}, {"at": ago(minutes=10)}], ("ip_quota", 1)), ([{"at": ago(minutes=10, seconds=1)}, {"at": ago(minutes=10)}], (None, 1))])
def test_gate(spark, earlier, want):
    q = Quota(daily_budget_usd=1.0, daily_answers=3, window_answers=2, window_minutes=10)
    audit = ledger.gate_audit(book(spark, earlier + [{"bucket": "b"}]), q).orderBy(F.desc("id")).first()
    assert (audit["degraded"], audit["answers_remaining"]) == want


def test_window_counts_cross_slots(spark):
    rng = random.Random(9)
    rows = [{"at": NOW + dt.timedelta(seconds=rng.randint(0, 4 * 3600)), "bucket": rng.choice("bc"), "outcome": rng.choice(["generated", "cached"])} for _ in range(300)]
    got = {r["id"]: r["window_used"] for r in ledger._window_counts(book(spark, rows), 10).collect()}
    for i, r in enumerate(rows):
        assert got[i] == sum(1 for j, o in enumerate(rows) if j != i and o["bucket"] == r["bucket"] and o["outcome"] == "generated" and r["at"] - dt.timedelta(minutes=10) <= o["at"] <= r["at"])


def test_usage_report(spark):
    b = book(spark, [{"at": ago(days=2), "cost": 0.1}, {"cost": 0.2}, {"outcome": "cached"}, {"outcome": "degraded_ip", "bucket": "z"}])
    today = F.lit(NOW.date())
    days = {str(r["date"]): r for r in ledger.usage_report(b, today).collect()}
    assert len(days) == 7 and days["2024-05-03"]["outcomes"] == {"generated": 1, "cached": 1, "degraded_ip": 1} and days["2024-05-02"]["outcomes"] == {}
    assert ledger.cache_hit_rate(b, today).first()[0] == pytest.approx(0.5) and ledger.cache_hit_rate(b.limit(0), today).first()[0] is None
    assert [(r["ip_bucket"], r["requests"], r["answers"]) for r in ledger.top_buckets(b, today).collect()] == [("b", 2, 1), ("z", 1, 0)]
    assert ledger.spend_since(b.limit(0), today).first()[0] == 0.0


def naive_admission(times, q):
    admitted, out = [], []
    for now in times:
        today = sum(t // su.DAY_US == now // su.DAY_US for t in admitted)
        recent = sum(t >= now - q.window_minutes * 60_000_000 for t in admitted)
        code = 1 if today >= q.daily_answers else 2 if recent >= q.window_answers else 0
        out.append(code)
        if not code:
            admitted.append(now)
    return out


def test_admission_equals_a_plain_loop():
    rng = random.Random(1)
    for q in (Quota(1, 5, 2, 10), Quota(1, 100, 1, 60), Quota(1, 2, 5, 1), Quota(1, 3, 3, 2000)):
        times = np.array(sorted(rng.randint(0, 3 * su.DAY_US // 1_000_000) * 1_000_000 for _ in range(800)))
        assert su.admit_times(times, q, []).tolist() == naive_admission(times.tolist(), q)


def test_admission_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "id long, created_at timestamp, ip_bucket string, is_admin boolean, outcome string"
    q = Quota(daily_answers=3, window_answers=2, window_minutes=10)
    rows = [(i, NOW + dt.timedelta(minutes=i), "b", False, "generated") for i in range(40)] + [(100 + i, NOW + dt.timedelta(minutes=7 * i), "c", False, "pending") for i in range(10)]
    free = [(200 + i, NOW + dt.timedelta(minutes=i), "b", i % 2 == 0, "cached" if i % 2 else "generated") for i in range(39)]
    rows += free
    for n in range(4):
        part = [r for r in rows if (r[1] - NOW).seconds // 60 // 10 == n]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    got = {r["id"]: r["degraded"] for r in run.append_to_table(su.admission(stream, q), "admission-test").collect()}
    assert all(got[r[0]] is None for r in free)
    for bucket in "bc":
        mine = sorted((r for r in rows if r[2] == bucket and r[0] in got and r[0] < 200), key=lambda r: r[1])
        base = dt.datetime(1970, 1, 1)
        want = naive_admission([int((r[1] - base).total_seconds() * 1_000_000) for r in mine], q)
        assert [got[r[0]] is not None for r in mine] == [w > 0 for w in want]


EVENTS = [
    ("full", 0, "results", '{"sources": [{"number": 1}]}'), ("full", 1, "thinking", "{}"), ("full", 2, "delta", '{"text": "Yes "}'), ("full", 3, "delta", '{"text": "[1]."}'), ("full", 4, "done", '{"answer": "Yes [1].", "answer_complete": true}'), ("full", 5, "delta", '{"text": "late"}'),
    ("failed", 0, "results", "{}"), ("failed", 1, "error", '{"message": "boom"}'), ("failed", 2, "done", '{"answer": null}'),
    ("cut", 0, "results", '{"sources": [{"number": 1}, {"number": 2}]}'), ("cut", 1, "delta", '{"text": "Half [2] \\n"}'), ("cut", 2, "delta", '{"text": " [1"}'),
    ("early", 0, "delta", '{"text": "x"}'), ("early", 1, "results", "{}"),
    ("twice", 0, "results", "{}"), ("twice", 1, "delta", '{"text": "a"}'), ("twice", 2, "results", "{}"), ("twice", 3, "done", '{"answer": "no"}'),
    ("unknown", 0, "ping", "{}"), ("unknown", 1, "results", "{}"), ("unknown", 2, "done", '{"answer": "", "answer_complete": true}'),
    ("empty", 0, "results", "{}"),
]
FOLDED = {"full": ("result", "Yes [1].", True, None, None), "failed": ("result", None, None, None, None), "cut": ("result", "Half [2]", False, None, [2]), "early": ("failed", None, None, sa.UNREADABLE, None),
          "twice": ("result", "a", False, None, []), "unknown": ("result", "", True, None, None), "empty": ("result", None, None, None, None)}


def events(spark):
    return spark.createDataFrame([(s, n, NOW + dt.timedelta(seconds=n), e, d) for s, n, e, d in EVENTS], "stream_id string, seq long, ts timestamp, event string, data string")


def folded(df):
    return {r["stream_id"]: (r["phase"], r["answer"], r["answer_complete"], r["message"], r["live_citations"]) for r in df.collect()}


def test_stream_fold_in_batch_and_streaming(spark, tmp_path):
    assert folded(sa.fold_batch(events(spark))) == FOLDED
    path = str(tmp_path / "events")
    for n in range(6):
        events(spark).filter(F.col("seq") == n).coalesce(1).write.parquet(f"{path}/{n}")
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    updates = run.updates_to_table(sa.fold_stream(stream), "fold-test")
    assert folded(sa.final_answers(updates)) == FOLDED
    live = {(r["stream_id"], r["seq"]): (r["answer"], r["live_citations"]) for r in sa.live_view(updates).collect()}
    assert live[("cut", 2)] == ("Half [2] \n ", [2])


def test_silent_stream_times_out(spark, tmp_path):
    path = str(tmp_path / "events")
    first = spark.createDataFrame([("quiet", 0, NOW, "results", "{}"), ("quiet", 1, NOW, "delta", '{"text": "half"}')], events(spark).schema)
    later = spark.createDataFrame([("other", 0, NOW + dt.timedelta(hours=2), "results", "{}")], events(spark).schema)
    last = spark.createDataFrame([("other", 1, NOW + dt.timedelta(hours=2), "delta", '{"text": "x"}')], events(spark).schema)
    for n, part in enumerate((first, later, last)):
        part.coalesce(1).write.parquet(f"{path}/{n}")
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    rows = run.updates_to_table(sa.fold_stream(stream, "10 minutes"), "silence-test").filter("timed_out").collect()
    assert [(r["stream_id"], r["draft"]) for r in rows] == [("quiet", "half")]


def test_stream_fold_with_events_out_of_order(spark):
    rng = random.Random(4)
    for slots in (2, 5):
        arrival = {(s, n): rng.randrange(slots) for s, n, _, _ in EVENTS}
        rows = [(s, n, NOW + dt.timedelta(seconds=n), e, d, arrival[s, n]) for s, n, e, d in EVENTS]
        table = spark.createDataFrame(rows, "stream_id string, seq long, ts timestamp, event string, data string, slot long")
        assert folded(sa.final_answers(run.in_arrivals(table, "slot", slots, sa.fold_stream, "disorder-test"))) == FOLDED


def test_state_of_finished_streams_goes(spark, tmp_path):
    rows = [(s, n, NOW + dt.timedelta(seconds=n), e, d, 0) for s, n, e, d in EVENTS] + [("new", 0, NOW + dt.timedelta(days=1), "results", "{}", 1)]
    table = spark.createDataFrame(rows, "stream_id string, seq long, ts timestamp, event string, data string, slot long")
    kept, source, path = (str(tmp_path / name) for name in ("checkpoint", "in", "out"))
    for part, left in ((0, 7), (1, 1)):
        table.filter(F.col("slot") == part).drop("slot").write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.drop("slot").schema).parquet(source)
        updates = run.updates_to_table(sa.fold_stream(stream), "state-test", "update", kept, path)
        with run.rocksdb(spark):
            assert spark.read.format("statestore").option("stateVarName", "known").load(kept).count() == left
    assert folded(sa.final_answers(updates.filter("stream_id <> 'new'"))) == FOLDED


def test_reservations_settle_cancel_and_expire(spark):
    minute = lambda n: NOW + dt.timedelta(minutes=n)
    rows = [(1, "reserve", 0, 5.0, 0), (1, "settle", 1, 2.0, 0), (2, "reserve", 0, 5.0, 0), (2, "cancel", 2, None, 1), (3, "settle", 3, 1.0, 0), (3, "reserve", 2, 5.0, 1),
            (4, "reserve", 0, 7.0, 0), (5, "settle", 4, 3.0, 0), (5, "cancel", 3, None, 1), (5, "reserve", 1, 9.0, 1), (6, "reserve", 2, 4.0, 0), (6, "settle", 5, None, 1), (7, "other", 1, 1.0, 0),
            (None, "reserve", 1, 1.0, 0), (8, "reserve", 24 * 60, 6.0, 2), (9, "settle", 2, 8.0, 1), (9, "settle", 1, 3.0, 1)]
    table = spark.createDataFrame([(i, k, minute(m), c, s) for i, k, m, c, s in rows], "id long, kind string, ts timestamp, cost_usd double, slot long")
    updates = run.in_arrivals(table, "slot", 3, su.reservations, "reservation-test")
    last = updates.groupBy("id").agg(F.max_by(F.struct("outcome", "cost_usd"), F.struct("batch", F.col("outcome") == "expired")).alias("s")).select("id", "s.*")
    want = {1: ("settled", 2.0), 2: ("cancelled", 0.0), 3: ("settled", 1.0), 4: ("expired", 7.0), 5: ("cancelled", 0.0), 6: ("settled", 4.0), 8: ("pending", 6.0), 9: ("settled", 3.0)}
    assert {r["id"]: (r["outcome"], r["cost_usd"]) for r in last.collect()} == want
    empty = run.in_arrivals(table.limit(0), "slot", 1, su.reservations, "reservation-test")
    assert empty.count() == 0


def test_reservations_share_states_of_bounded_size(spark, tmp_path):
    """Neighbouring ids are one call and one state; far ones are apart, also below zero and with costs that are no numbers."""
    rng = random.Random(7)
    ids = [*range(-1100, 1500), 10**12, 10**15]
    minute = lambda n: NOW + dt.timedelta(minutes=n)
    rows = [(i, "reserve", minute(i % 7), float("nan") if i == 3 else 5.0 + i, rng.randrange(2)) for i in ids]
    rows += [(i, "settle", minute(i % 7 + 2), None if i % 4 else float(i), rng.randrange(2)) for i in ids if i % 3 == 0]
    rows += [(i, "cancel", minute(i % 7 + 2 + i % 2), None, rng.randrange(2)) for i in ids if i % 6 == 0 or i % 5 == 0]
    rows += [(77_000_000, "reserve", minute(24 * 60), 1.0, 2)]
    table = spark.createDataFrame(rows, "id long, kind string, ts timestamp, cost_usd double, slot long")
    kept, source, path = (str(tmp_path / name) for name in ("checkpoint", "in", "out"))
    for part in range(3):
        states = 1 if part == 2 else len({i >> su.RUN_BITS for i, *_, slot in rows if slot <= part})
        table.filter(F.col("slot") == part).drop("slot").write.mode("append").parquet(source)
        updates = run.updates_to_table(su.reservations(spark.readStream.schema(table.drop("slot").schema).parquet(source)), "run-test", "update", kept, path)
        with run.rocksdb(spark):
            assert spark.read.format("statestore").load(kept).count() == states
    last = updates.groupBy("id").agg(F.max_by(F.struct("outcome", "cost_usd"), F.struct("batch", F.col("outcome") == "expired")).alias("s")).select("id", "s.*")
    got = {r["id"]: (r["outcome"], repr(r["cost_usd"])) for r in last.collect()}
    want = {77_000_000: ("pending", "1.0")}
    for i in ids:
        reserved = float("nan") if i == 3 else 5.0 + i
        closings = sorted((at, k, c) for j, k, at, c, _ in rows if j == i and k != "reserve") if i % 3 == 0 or i % 5 == 0 else []
        if not closings:
            want[i] = ("expired", repr(reserved))
        else:
            _, kind, cost = closings[0]
            want[i] = ("cancelled", "0.0") if kind == "cancel" else ("settled", repr(reserved if cost is None else cost))
    assert got == want


def test_head_and_done_join(spark, tmp_path):
    e = events(spark)
    e.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    pick = lambda name: s.filter(F.col("event") == name).select("stream_id", "ts", F.col("data").alias(name))
    got = run.append_to_table(sa.join_head_done(pick("results"), pick("done")), "join-test")
    assert {r["stream_id"] for r in got.collect()} >= {"full", "failed", "unknown"}


def test_memoised_inference_runs_once_per_key(spark):
    inputs = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "key string, n long")
    cache = spark.createDataFrame([("a", 100)], "key string, value long")

    def load():
        return lambda rows: pd.DataFrame({"key": rows["key"], "value": rows["n"] * 10})

    got, new = caching.memoize(inputs, cache, load, keep=F.col("value") != 30)
    assert sorted((r["key"], r["value"], r["hit"]) for r in got.collect()) == [("a", 100, True), ("b", 20, False), ("b", 20, False), ("c", 30, False)]
    assert [r["key"] for r in new.collect()] == ["b"]


def test_responses_split_and_merge(spark):
    r = spark.createDataFrame([("s", "q", "a", "ip_quota", 2)], "stream_id string, query string, answer string, degraded string, answers_remaining int")
    head, done = caching.split_response(r)
    assert set(head.columns) == {"stream_id", "degraded", "answers_remaining"} and set(done.columns) == {"stream_id", "answer"}
    assert set(caching.merge_response(head, done).columns) == {"stream_id", "degraded", "answers_remaining", "answer"}
    assert "query" not in caching.cached_form(r).columns


def test_requests_outside_evaluation_take_no_overrides(spark):
    r = spark.createDataFrame([(1, "q", {"rules_top_k": "3"}, False, False), (2, "q", {}, True, False), (3, "x" * 501, {}, False, False), (4, "q", {}, True, True), (5, "q", None, False, False)],
                              "id int, query string, overrides map<string,string>, fresh boolean, may_refresh boolean")
    assert {x["id"]: x["status"] for x in requests.resolve(r, False).collect()} == {1: 403, 2: 403, 3: 422, 4: 200, 5: 200}
    rows = requests.settings_rows(r.filter("id = 1"), "id", {"rules_top_k": 5, "hybrid_top_k": 10}).collect()
    assert {(x["key"], x["value"]) for x in rows} == {("rules_top_k", "3"), ("hybrid_top_k", "10")}


def test_a_table_of_questions_is_answered_in_one_job(spark):
    cards, rules, points, enc = full_inputs(spark)
    asked = spark.createDataFrame(
        [(1, "Does Fog work?", False, "b", NOW), (2, "does fog work", False, "c", NOW), (3, "x" * 600, False, "b", NOW), (4, "old one", False, "b", NOW), (5, "fail please", False, "b", NOW)],
        "query_id long, query string, fresh boolean, ip_bucket string, created_at timestamp").withColumns(
        {"overrides": F.create_map().cast("map<string,string>"), "may_refresh": F.lit(False), "source": F.lit(None).cast("string"), "is_admin": F.lit(False)})
    args = dict(encode=enc, cards=cards, rules=rules, points=points, data_version="v1", generator="g:m", model="m", pricing=Pricing(1.0, 2.0))
    calls = spark.sparkContext.accumulator(0)

    def load():
        def write(rows):
            calls.add(len(rows))
            bad = rows["query"].str.contains("fail")
            return pd.DataFrame({"key": rows["key"], "text": np.where(bad, "", "Yes [1] and [99]."), "input_tokens": 10, "output_tokens": 5, "thinking_tokens": 0, "finish_reason": np.where(bad, None, "STOP"), "failure": np.where(bad, "boom", None)})

        return write

    empty = spark.createDataFrame([], "key string, answer string, created_at timestamp")
    first = answering.answer_questions(asked, cache=empty, load=load, **args)
    got = {r["query_id"]: r for r in first.responses.collect()}
    assert calls.value == 3 and set(got) == {1, 2, 4, 5}
    assert got[1]["answer"] == got[2]["answer"] == "Yes [1] and." and got[1]["invalid_count"] == 1 and got[1]["answer_complete"]
    assert got[5]["answer"] is None and got[5]["error"] == "boom"
    assert [r["status"] for r in first.refused.collect()] == [422]
    assert first.cache_rows.count() == 2 and first.history.count() == 4
    assert sorted(r["outcome"] for r in first.ledger.collect()) == ["error", "generated", "generated", "generated"]
    assert {(r["query_id"], r["number"]) for r in first.citations.collect()} == {(1, 1), (2, 1), (4, 1)}
    second = answering.answer_questions(asked, cache=first.cache_rows, load=load, **args)
    again = {r["query_id"]: r for r in second.responses.collect()}
    assert calls.value == 4 and again[1]["cached"] and again[4]["cached"] and not again[5]["cached"]


def test_requests_pass_the_gate_with_their_own_settings(spark):
    cards, rules, points, enc = full_inputs(spark)
    rows = [(i, "Does Fog work?" if i < 4 else f"question {i}", {"rules_top_k": "1"} if i == 3 else None, "b", i == 6, i != 5, NOW + dt.timedelta(seconds=i)) for i in range(1, 8)]
    asked = spark.createDataFrame(rows, "query_id long, query string, overrides map<string,string>, ip_bucket string, is_admin boolean, generate boolean, created_at timestamp").withColumns(
        {"fresh": F.lit(False), "may_refresh": F.lit(False), "source": F.lit(None).cast("string")})
    past = spark.createDataFrame([(NOW, "b", False, "generated", 0.5)], "created_at timestamp, ip_bucket string, is_admin boolean, outcome string, cost_usd double")
    empty = spark.createDataFrame([], "key string, answer string, created_at timestamp")

    def load():
        return lambda rows: pd.DataFrame({"key": rows["key"], "text": "Yes.", "input_tokens": 1, "output_tokens": 1, "thinking_tokens": 0, "finish_reason": "STOP", "failure": None})

    args = dict(encode=enc, cards=cards, rules=rules, points=points, cache=empty, load=load, data_version="v1", generator="g:m", model="m", ledger=past)
    plain = asked.withColumn("overrides", F.lit(None).cast("map<string,string>"))
    made = answering.answer_questions(plain, quota=Quota(daily_budget_usd=9.0, daily_answers=3, window_answers=9, window_minutes=10), **args)
    got = {r["query_id"]: (r["answer"], r["degraded"]) for r in made.responses.collect()}
    assert got == {1: ("Yes.", None), 2: ("Yes.", None), 3: (None, "ip_quota"), 4: (None, "ip_quota"), 5: (None, None), 6: ("Yes.", None), 7: (None, "ip_quota")}
    assert sorted(r["outcome"] for r in made.ledger.collect()) == ["degraded_ip"] * 3 + ["generated"] * 3
    broke = answering.answer_questions(plain, quota=Quota(daily_budget_usd=0.5, daily_answers=3, window_answers=9, window_minutes=10), **args)
    assert {r["degraded"] for r in broke.responses.filter("query_id not in (5, 6)").collect()} == {"global_budget"}
    tried = answering.answer_questions(asked, eval_mode=True, **args)
    keys = {r["query_id"]: r["key"] for r in tried.responses.collect()}
    assert keys[1] == keys[2] != keys[3]


def test_history_page_and_cache_hits(spark):
    h = spark.createDataFrame([(i, NOW - dt.timedelta(minutes=i // 2)) for i in range(10)], "id long, created_at timestamp")
    assert [r["id"] for r in tables.history_page(h, 3, 1).collect()] == [0, 3, 2]
    assert tables.history_entry(h, 4).count() == 1


@pytest.mark.parametrize("parts", [None, 3])
@pytest.mark.parametrize("key", ["stream_dedup_questions", "stream_head_done_join"])
def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path, parts, key):
    """F8, F9: a table that is a folder of files gave no rows."""
    from citeweave.plans import all_queries

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Question {c}?") for c in range(20) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if parts:
        df.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        df.toPandas().to_parquet(tmp_path / "conversations.parquet")
    assert all_queries()[key](spark, str(tmp_path)).count() == 20


def test_client_buckets_of_users_that_fit_no_part_of_an_address(spark, tmp_path):
    """from 256 users on, mapped addresses were none and came back whole; from 65,536 on, the longer ones too."""
    import duckdb

    from citeweave.plans import all_oracles, all_queries

    users = [*range(0, 12), *range(250, 268), *range(65_530, 65_548), 1_000_003]
    path = tmp_path / "events.parquet"
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").toPandas().to_parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}')")
    want = sorted(db.execute(all_oracles()["client_buckets"]).fetchall())
    assert sorted(tuple(r) for r in all_queries()["client_buckets"](spark, str(tmp_path)).collect()) == want


def test_streamed_snapshot_comes_in_as_many_files_as_its_input(spark, tmp_path, monkeypatch):
    """No file of an arrival, and so no task, holds more than a file of the documents."""
    from citeweave.plans import all_queries, streams

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    at = iter(range(99))
    monkeypatch.setattr(streams, "fresh_path", lambda _spark, name: str(tmp_path / f"{name}-{next(at)}"))
    got = all_queries()["stream_sync"](spark, str(tmp_path))
    files = spark.read.parquet(str(tmp_path / "points-0" / "arriving")).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 15 and max(r["count"] for r in files) <= -(-got.count() // 5)
    batches = [p.name for p in (tmp_path / "points-0").iterdir() if p.name.isdigit()]
    assert sorted(batches) == ["0", "1", "2", "3"]
