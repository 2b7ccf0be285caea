import json

import pytest
from pyspark.sql import functions as F

from citeweave.operators import cases as cs
from citeweave.operators import evaluation, rundiff, scoring

CASE = "id string, question string, tags array<string>, split string, rules array<string>, rulings array<string>, cards array<string>, expected_cards array<string>, forbidden_cards array<string>, gold_answer string, verdict string, should_decline boolean"
RESULT = "case_id string, number int, source string, rule_id string, card_name string, text string, match_type string"


def case(spark, *rows):
    full = [(r["id"], "q", r.get("tags", ["keyword"]), r.get("split", "dev"), r.get("rules"), r.get("rulings"), r.get("cards"), r.get("expected"), r.get("forbidden"), r.get("gold"), r.get("verdict"), r.get("decline", False)) for r in rows]
    return spark.createDataFrame(full, CASE)


def test_requirement_is_a_plain_prefix(spark):
    s = lambda k, v, src, rule, card: scoring.satisfied(*[F.lit(x) for x in (k, v, src, rule, card)])
    row = spark.range(1).select(
        s("rules", "702.1", "rule", "702.19b", None).alias("a"), s("rules", "702.19b", "rule", "702.19", None).alias("b"), s("rules", "7", "ruling", "702", None).alias("c"),
        s("rulings", "Fog", "ruling", None, "Fog").alias("d"), s("cards", "Fog", "oracle", None, "Fog").alias("e"), s("cards", "Fog", "ruling", None, "Fog").alias("f")).first()
    assert tuple(row) == (True, False, False, True, True, False)


def test_retrieval_scores(spark):
    cases = case(spark, {"id": "a", "rules": ["1", "2", "9"]}, {"id": "none"}, {"id": "named", "expected": ["Fog"], "forbidden": ["Bolt"]}, {"id": "empty", "rules": ["1"]})
    results = spark.createDataFrame([("a", 1, "rule", "5", None, "abc", "v"), ("a", 2, "rule", "1.1", None, "de", "v"), ("a", 3, "rule", "2", None, None, "v"), ("named", 1, "card", None, "Bolt", "x", "card_name_match")], RESULT)
    got = {r["id"]: r for r in scoring.score_retrieval(cases, results).collect()}
    a = got["a"]
    assert (a["pass"], a["sources_pass"], a["first_hit_rank"], a["result_count"], a["context_chars"]) == (False, False, 2, 3, 5) and a["recall"] == pytest.approx(2 / 3)
    assert a["requirement_ranks"] == {"rules:1": 2, "rules:2": 3, "rules:9": None}
    assert got["none"]["pass"] is None and got["none"]["recall"] is None
    assert got["named"]["pass"] is False and got["named"]["expected_missing"] == ["Fog"] and got["named"]["forbidden_hits"] == ["Bolt"]
    assert got["empty"]["pass"] is False and got["empty"]["result_count"] == 0


def test_run_aggregates_leave_unscored_cases_out(spark):
    cases = case(spark, {"id": "a", "rules": ["1"]}, {"id": "b"}, {"id": "c", "rules": ["1"], "tags": ["messy"]}, {"id": "d", "rules": ["1"]})
    results = spark.createDataFrame([("a", 1, "rule", "1", None, "abc", "v"), ("b", 1, "rule", "1", None, "abc", "v")], RESULT)
    errors = spark.createDataFrame([("d", "boom")], "case_id string, error string")
    records, totals = evaluation.run(cases, results, errors=errors)
    t = {r["category"]: r for r in totals.collect()}
    assert (t[None]["cases"], t[None]["errors"], t[None]["scored"], t[None]["passed"]) == (4, 1, 3, 1)
    assert t["keyword"]["pass_rate"] == pytest.approx(0.5) and t["messy"]["pass_rate"] == 0.0 and records.count() == 4


def test_full_runs_grade_answers(spark):
    cases = case(spark, {"id": "a", "gold": "g", "verdict": "yes"}, {"id": "b", "decline": True}, {"id": "c", "gold": "g"}, {"id": "d"})
    rows = [("a", "Yes.", "correct", False), ("b", "I cannot say", "declined_properly", True), ("c", None, "x", False), ("d", "Hm", None, False)]
    answers = spark.createDataFrame(rows, "case_id string, answer string, grade string, answer_cached boolean").withColumns({
        "context_hash": F.lit("h"), "retrieval_context_hash": F.lit("h"), "generation_error": F.lit(None).cast("string"), "judge_cached": F.lit(False), "invalid_citations": F.lit(1), "generate_ms": F.lit(10.0), "prompt_tokens": F.lit(5)})
    _records, totals = evaluation.run(cases, spark.createDataFrame([], RESULT), answers)
    t = totals.filter("category is null").first()
    assert (t["answered"], t["judged"], t["correct_rate"], t["incorrect_rate"], t["verdict_accuracy"], t["decline_accuracy"], t["answer_cache_hit_rate"], t["invalid_citations"]) == (3, 2, 0.5, 0.5, 1.0, 1.0, 0.25, 4)


RECORD = "id string, error string, pass boolean, requirement_ranks map<string,int>, forbidden_hits array<string>, expected_missing array<string>, grade string, should_decline boolean, verdict_correct boolean, verdict_parsed string"


def records(spark, **rows):
    return spark.createDataFrame([(k, v.get("error"), v.get("pass"), v.get("ranks", {}), v.get("forbidden", []), v.get("missing", []), v.get("grade"), v.get("decline", False), v.get("vc"), v.get("v")) for k, v in rows.items()], RECORD)


def test_run_diff(spark):
    base = records(spark, lost={"ranks": {"rules:1": 2}}, found={"ranks": {"cards:Fog": None}}, moved={"ranks": {"rules:1": 2}}, card={}, gone={}, err={"pass": True}, flip={"pass": True, "ranks": {"rules:1": 1}}, graded={"grade": "correct"}, verdict={"vc": False, "v": "no"})
    new = records(spark, lost={"ranks": {"rules:1": None}}, found={"ranks": {"cards:Fog": 4}}, moved={"ranks": {"rules:1": 9}}, card={"forbidden": ["Bolt"]}, fresh={}, err={"error": "503", "pass": None}, flip={"pass": False, "ranks": {"rules:2": 1}}, graded={"grade": "partial"}, verdict={"vc": True, "v": "yes"})
    got = {r["id"]: (r["status"], r["reasons"]) for r in rundiff.diff_cases(base, new).collect()}
    assert got == {
        "lost": ("regression", "rank:rules:1:2>"), "found": ("fixed", "rank:cards:Fog:>4"), "moved": ("same", None), "card": ("regression", "forbidden:Bolt:+"), "gone": ("removed", None), "fresh": ("added", None),
        "err": ("regression", "error:+"), "flip": ("regression", "pass:1>0"), "graded": ("regression", "grade:correct>partial"), "verdict": ("fixed", "verdict:no>yes")}
    counts = rundiff.diff_counts(rundiff.diff_cases(base, new)).first()
    assert (counts["regressions"], counts["fixed"], counts["added"], counts["removed"], counts["shared"], counts["exit_code"]) == (5, 2, 1, 1, 8, 1)
    assert rundiff.diff_counts(rundiff.diff_cases(base, new), filtered=True).first()["removed"] == 0


def test_runs_with_shuffled_ties_are_equal(spark):
    a = spark.createDataFrame([("c", 0.5, "x"), ("c", 0.5, "y"), ("c", 0.4, "z")], "case string, score double, item string")
    assert rundiff.ties_differ(a, a.orderBy("item"), ["case", "score", "item"]).count() == 0
    assert rundiff.ties_differ(a, a.union(a.limit(1)), ["case", "score", "item"]).count() == 1


def test_configuration_differences(spark):
    meta = "run_id string, mode string, settings map<string,string>, overrides map<string,string>, data_files map<string,string>, generator string, prompt_version int, collection_name string, points_count long, judge_model string, judge_prompt_version int"
    runs = spark.createDataFrame([("a", "full", {"k": "1", "w": "2"}, {}, {"rules": "r1"}, "g", 1, "c", 10, "j", 1), ("b", "full", {"k": "1", "w": "2"}, {"k": "3"}, {"rules": "r2"}, "g", 1, "c", 10, "j", 1)], meta)
    view = rundiff.config_view(runs)
    side = lambda n: view.filter(F.col("run_id") == n).select("key", "value")
    explained = spark.createDataFrame([("settings.k",)], "key string")
    assert [(r["key"], r["base_value"], r["new_value"]) for r in rundiff.config_diff(side("a"), side("b"), explained).collect()] == [("data_files.rules", "r1", "r2")]


def test_case_file_checks(spark):
    entries = [
        {"id": "ok", "question": "q", "tags": ["keyword"], "split": "dev", "verdict": True, "required_sources": {"rules": ["1"]}, "expected_cards": []},
        {"id": "ok", "question": " ", "tags": [], "split": "x", "zzz": 1}, {"id": 5, "tags": ["odd"], "verdict": "maybe", "required_sources": {"odd": [], "cards": "a"}, "should_decline": "no", "gold_answer": 3}, ["not", "a", "mapping"]]
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(entries)], "index int, entry string")
    got = {}
    for r in cs.schema_errors(df).collect():
        got.setdefault(r["index"], set()).add((r["case_id"], r["field"], r["code"], r["detail"]))
    assert 0 not in got
    assert got[1] == {("ok", "question", "type", None), ("ok", "tags", "type", None), ("ok", "split", "value", "x"), ("ok", "zzz", "unknown", None), ("ok", "id", "repeated", None)}
    assert got[2] == {(None, *found) for found in (
        ("question", "absent", None), ("split", "absent", None), ("id", "type", None), ("tags", "category", "odd"), ("verdict", "value", "maybe"), ("required_sources.odd", "unknown", None),
        ("required_sources.cards", "type", None), ("should_decline", "type", None), ("gold_answer", "type", None))}
    assert got[3] == {(None, "entry", "shape", None)}
    read = cs.read_cases(df.limit(1)).first()
    assert (read["id"], read["verdict"], read["rules"], read["should_decline"]) == ("ok", "yes", ["1"], False)


def test_case_data_checks_and_selection(spark):
    cases = case(spark, {"id": "a", "rules": ["702.1", "800"], "rulings": ["Fog", "Bolt"], "cards": ["Nope"]}, {"id": "b", "split": "test", "tags": ["messy", "x"]})
    rules = spark.createDataFrame([("702.19b",)], "rule_id string")
    cards = spark.createDataFrame([("Fog", "1"), ("Bolt", "2")], "name string, oracle_id string")
    rulings = spark.createDataFrame([("1",)], "oracle_id string")
    assert {tuple(r) for r in cs.data_errors(cases, rules, cards, rulings).collect()} == {
        ("a", "rules", "no_rule", "800"), ("a", "cards", "no_card", "Nope"), ("a", "rulings", "no_ruling", "Bolt")}
    assert [r["id"] for r in cs.select(cases, "all", tags=["x"]).collect()] == ["b"] and cs.select(cases, "dev", ids=["b"]).count() == 0
