import hashlib
import ipaddress
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from citeweave.functions import answers, hashing, text, usage
from citeweave.functions.tokens import block_starts, piece_start, pieces


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    df = spark.createDataFrame([tuple(v[1] for v in values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def many(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_content_hash_counts_null_as_empty_and_keeps_parts_apart(spark):
    got = one(spark, hashing.content_hash(F.col("a"), F.col("b")), a=("string", "x"), b=("string", None))
    assert got == hashlib.sha256(b"x\x1f").hexdigest()
    ab = one(spark, hashing.content_hash(F.lit("ab"), F.lit("c")))
    assert ab != one(spark, hashing.content_hash(F.lit("a"), F.lit("bc")))


def test_payload_hash_sorts_keys_and_keeps_nulls(spark):
    got = one(spark, hashing.payload_hash({"b": F.lit(1), "a": F.lit(None).cast("string")}))
    assert got == hashlib.sha256(json.dumps({"a": None, "b": 1}, separators=(",", ":")).encode()).hexdigest()


def test_uuid5_equals_the_standard_library(spark):
    space = uuid.UUID(hashing.POINT_NAMESPACE)
    names = ["rule:1", "oracle:é", "ruling:x:0", ""]
    assert many(spark, hashing.uuid5(F.col("v")), names) == [str(uuid.uuid5(space, n)) for n in names]


def test_key_kinds_never_collide(spark):
    c = F.lit("x")
    assert one(spark, hashing.answer_key(c, c, c, c, c)) != one(spark, hashing.judge_key(c, c, c, c, c, F.lit(False)))


def test_rule_numbers(spark):
    ids = ["100", "100.1", "100.1a", "704.5k"]
    assert many(spark, text.parent_id(F.col("v")), ids) == [None, "100", "100.1", "704.5"]
    assert many(spark, text.entry_id(F.col("v")), ids) == ["100", "100.1", "100.1", "704.5"]
    assert many(spark, text.section_of(F.col("v")), ids + ["x"]) == [1, 1, 1, 7, None]
    assert many(spark, text.normalize_rule_id(F.col("v")), [" 702.11B. ", "702.11b"]) == ["702.11b", "702.11b"]


def test_text_clean_up(spark):
    assert many(spark, text.strip_query(F.col("v")), ["http://a/b?c=1?d", "", None, "x"]) == ["http://a/b", None, None, "x"]
    assert many(spark, text.normalize_query(F.col("v")), ["  Does IT\n work ?! ", "a.b. "]) == ["does it work", "a.b"]
    assert many(spark, text.is_title(F.col("v")), ["Deathtouch", "A sentence.", "See also: ", "x" * 61]) == [True, False, False, False]
    assert many(spark, text.image_variant(F.col("v"), "small"), ["u/normal/a/normal/b", "none", None]) == ["u/small/a/normal/b", "none", None]
    assert many(spark, text.visible_draft(F.col("v")), ["a [1", "a [1, ", "a [1]", "a [x"]) == ["a ", "a ", "a [1]", "a [x"]
    assert many(spark, text.is_external_url(F.col("v")), ["https://x", "/rules/1", None]) == [True, False, False]


def test_word_forms(spark):
    assert many(spark, text.base_forms(F.col("v")), ["Onward!", "∞ (Forever)", "Dawn and Dusk"]) == [["onward"], ["∞", "forever"], ["dawn and dusk", "dawn", "dusk"]]
    assert many(spark, text.inflections(F.col("v")), ["raze", "leap", "∞"]) == [
        ["razes", "razees", "razeed", "razeing", "razed", "razing"], ["leaps", "leapes", "leaped", "leaping"], []]


def test_pieces_and_starts_rebuild_long_texts(spark):
    rng = random.Random(5)
    texts = ["", "word", "  ...", "Ünï cödé, ok", *["".join(rng.choice("ab1 .,-é\n") for _ in range(rng.randint(1, 900))) for _ in range(20)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", pieces(F.col("t")).alias("c")).withColumn("b", block_starts(F.col("c")))
    starts = F.transform("c", lambda _x, k: piece_start(F.col("c"), F.col("b"), k))
    for r in df.withColumn("s", starts).collect():
        assert "".join(r["c"]) == r["t"].lower()
        assert r["s"] == [len("".join(r["c"][:k])) for k in range(len(r["c"]))]


CITED = [
    ("a [1][9]. b [0]. c [2, 7].", [1, 2, 3], "a [1]. b. c [2].", [1, 2], 3),
    ("a [1-3]. b [^2]. c [1;2]. d [1 2].", [1, 2, 3], "a. b. c. d.", [], 4),
    ("x [2, 2,1] y [3]", [1, 2, 3], "x [2, 1] y [3]", [2, 1, 3], 0),
    ("no markers [here]", [1], "no markers [here]", [], 0),
    ("line\n[5] next", [1], "line\n next", [], 1),
    ("big [99999999999999999999]", [1], "big", [], 1),
]


def test_citation_markers(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CITED)], "i int, answer string, valid_numbers array<bigint>")
    for r in answers.parse_citations(df).collect():
        _answer, _valid, cleaned, cited, invalid = CITED[r["i"]]
        assert (r["cleaned"], r["cited"], r["invalid_count"]) == (cleaned, cited, invalid)


def test_rule_references_skip_prices_dates_and_versions(spark):
    given = ["Pay $100.50 on 2018.01.19 in v100.5.2, 12100.5 or 1.5.", "See 702.19b, then 510.1 and 702.19b.", "(601.2a)"]
    assert many(spark, answers.rule_references(F.col("v")), given) == [[], ["702.19b", "510.1"], ["601.2a"]]
    assert many(spark, answers.rule_text_references(F.col("v")), ["See rule 100 and rules 702.2 but 100 cards"]) == [["100", "702.2"]]


VERDICTS = [("Yes. It works.", "yes"), ("**No**, it does not.", "no"), ("Short answer: yes", "yes"), ("The answer is no. But yes later.", "no"), ("Not at all", "unclear"), ("Maybe yes or no, who knows", "unclear"),
            ("Nobody knows", "unclear"), ("First this. Yes.", "unclear"), ("", "unclear"), (None, "unclear"), ("Well, yes: it does", "yes"), ("x" * 210 + " yes", "unclear")]


def test_verdicts(spark):
    assert many(spark, answers.verdict(F.col("v")), [v[0] for v in VERDICTS]) == [v[1] for v in VERDICTS]


def test_grades(spark):
    replies = ['ok {"grade": "Correct ", "reason": " fine "}', '{"grade": "x"} {"grade": "partial"}', '{"grade": "answered_anyway"}', "{broken", None]
    assert [g["grade"] for g in many(spark, answers.parse_grade(F.col("v"), F.lit(False)), replies)] == ["correct", "partial", "error", "error", "error"]
    assert many(spark, answers.parse_grade(F.col("v"), F.lit(True)), replies[2:3])[0]["grade"] == "answered_anyway"


def test_completion(spark):
    rows = [("text", None, "STOP"), ("text", None, "MAX_TOKENS"), ("part", "boom", None), ("", "boom", None), ("", None, "STOP")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, f string, r string")
    got = [tuple(r["c"]) for r in df.orderBy("i").select(answers.completion(F.col("t"), F.col("f"), F.col("r")).alias("c")).collect()]
    assert got == [("text", True, None), ("text", False, "answer cut off (finish reason: MAX_TOKENS)"), ("part", False, "boom"), (None, None, "boom"), ("", True, None)]


def expected_bucket(host):
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return host
    if address.version == 4:
        return str(address)
    return str(address.ipv4_mapped) if address.ipv4_mapped else str(ipaddress.ip_network(f"{address}/64", strict=False))


def test_client_buckets_equal_the_standard_library(spark):
    rng = random.Random(3)
    hosts = ["203.0.113.7", "2001:db8:1:2:aaaa::1", "::ffff:203.0.113.7", "::ffff:c000:201", "testclient", "::1", "::", "fe80::", "1::2::3", "1:2:3:4:5:6:7:8:9", "2001:DB8::A", "0:0:1::", "1:0:0:1::", "64:ff9b::1.2.3.4",
             "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", ":1:2:3:4:5:6:7", "g::1", "300.1.1.1", "", "1:2:3:4:5:6:1.2.3.4", "a:b", "0:0:0:0:0:ffff:1.2.3.4"]
    for _ in range(200):
        groups = [rng.choice(["0", "0", format(rng.getrandbits(16), "x")]) for _ in range(8)]
        hosts.append(str(ipaddress.ip_address(":".join(groups))))
        hosts.append(":".join(g.zfill(rng.randint(1, 4)) for g in groups))
    assert many(spark, usage.ip_bucket(F.col("v")), hosts) == [expected_bucket(h) for h in hosts]


def test_costs(spark):
    p = usage.Pricing(1.0, 2.0)
    assert one(spark, usage.cost_usd(F.lit(1_000_000), F.lit(100_000), F.lit(150_000), p)) == pytest.approx(1.5)
    assert many(spark, usage.estimate_tokens(F.col("v")), [0, 1, 4, 5], "int") == [0, 1, 1, 2]
    assert one(spark, usage.worst_case_cost(F.lit(8), p)) == pytest.approx((2 + 2 * 2048) / 1e6)


def test_money(spark):
    amounts = [0.0, 1.0, 0.00012345678, 1234.5, -0.5, 12.3456789, 0.1]
    assert many(spark, usage.usd_precise(F.col("v")), amounts, "double") == ["$0.00", "$1.00", "$0.00012346", "$1,234.50", "-$0.50", "$12.346", "$0.10"]
    assert many(spark, usage.usd(F.col("v")), [1234.5, -2.0], "double") == ["$1,234.50", "-$2.00"]


def test_labels_and_metrics(spark):
    assert many(spark, answers.answers_left_label(F.col("v")), [1, 3, 4], "int") == ["1 AI answer left today", "3 AI answers left today", "4 answers left today"]
    assert many(spark, usage.format_metric(F.col("v"), F.lit("pct")), [0.886, None], "double") == ["88.6%", "-"]
    assert many(spark, usage.format_metric(F.col("v"), F.lit("int")), [2.5, 3.5], "double") == ["2", "4"]
    assert one(spark, usage.metric_arrow(F.lit(3.0), F.lit(2.0), F.lit(-1), F.lit("f2"))) == "▲"
    assert one(spark, usage.metric_arrow(F.lit(3.001), F.lit(3.0), F.lit(-1), F.lit("f2"))) == ""


def test_chunk_formats(spark):
    candidate = json.dumps({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "t", "thought": True}, {"text": "b"}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 7}})
    blocked = json.dumps({"promptFeedback": {"blockReason": "SAFETY"}})
    a, b = many(spark, answers.candidate_chunk(F.col("v")), [candidate, blocked])
    assert (a["text"], a["input_tokens"], a["finish_reason"], a["error"]) == ("ab", 7, "STOP", None)
    assert b["error"] == "no answer: SAFETY"
    lines = [json.dumps({"message": {"content": "x"}, "done": False, "eval_count": 3}), json.dumps({"message": {"content": ""}, "done": True, "done_reason": "length", "eval_count": 3}), json.dumps({"error": "bad"})]
    c, d, e = many(spark, answers.message_chunk(F.col("v")), lines)
    assert (c["text"], c["output_tokens"]) == ("x", None)
    assert (d["output_tokens"], d["thinking_tokens"], d["finish_reason"]) == (3, 0, "MAX_TOKENS")
    assert e["error"] == "bad"
