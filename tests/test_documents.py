import gzip
import json
import re
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave import schemas
from citeweave.operators import chunks, encode, outline, sync
from citeweave.operators.running import ordinal, running_before
from citeweave.sources import points, scans, tables

OUTLINE = """Effective soon.

1. Basics
100. General
Glossary

1. Basics
100. General
100.1. The first rule wraps
over two lines.
100.1a A part of it.

2. More
200. Second
Glossary
300. Not a rule.
"""


def rules_of(spark, text):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    return [(r["rule_id"], r["text"], r["parent_id"]) for r in outline.parse_outline(df).orderBy("line_no").collect()]


def test_outline_skips_contents_and_stops_at_the_glossary(spark):
    assert rules_of(spark, OUTLINE) == [
        ("100", "General", None), ("100.1", "The first rule wraps over two lines.", "100"), ("100.1a", "A part of it.", "100.1"), ("200", "Second", None)]


def test_outline_without_headings_is_all_body(spark):
    assert rules_of(spark, "loose text\n100. One\nmore\r\n100.1 Two\n\n") == [("100", "One more", None), ("100.1", "Two", "100")]


def test_outline_with_unfinished_contents_keeps_only_what_came_before(spark):
    assert rules_of(spark, "100. One\n1. Basics\n200. Listed\n") == [("100", "One", None)]


def tree(spark):
    rows = [("601", None, "Casting Spells", 0), ("601.2", "601", "Playing one", 1), ("601.2a", "601.2", "Announce it: first.", 2), ("601.3", "601", "Illegal.", 3), ("999.1", "999", "Orphan", 4)]
    return spark.createDataFrame(rows, "rule_id string, parent_id string, text string, line_no long")


def test_breadcrumbs_headings_children(spark):
    a = outline.with_ancestors(tree(spark)).select("rule_id", outline.breadcrumb(F.col("ancestors")).alias("b"), outline.heading(F.col("text"), F.col("ancestors")).alias("h"))
    got = {r["rule_id"]: (r["b"], r["h"]) for r in a.collect()}
    assert got["601.2a"] == ("Section 601: Casting Spells > 601.2: Playing one\n", "Playing one")
    assert got["601.3"][1] == "Casting Spells" and got["601"] == ("", "Casting Spells") and got["999.1"] == ("", "Orphan")
    kids = {(r["parent_id"], r["position"]): r["rule_id"] for r in outline.children(tree(spark)).collect()}
    assert kids == {("601", 0): "601.2", ("601", 1): "601.3", ("601.2", 0): "601.2a"}


def test_ancestors_double_per_round(spark, monkeypatch):
    rounds = []
    keep = outline.materialize
    monkeypatch.setattr(outline, "materialize", lambda df, name: rounds.append(name) or keep(df, name))
    chain = [(str(i), str(i - 1) if i else None, f"t{i}") for i in range(500)]
    rows = chain + [("orphan", "gone", "o"), ("child", "orphan", "c"), ("leaf", "499", "l")]
    got = {r["rule_id"]: [a["id"] for a in r["ancestors"]] for r in outline.with_ancestors(spark.createDataFrame(rows, "rule_id string, parent_id string, text string")).collect()}
    assert got == {str(i): [str(j) for j in range(i)] for i in range(500)} | {"orphan": [], "child": ["orphan"], "leaf": [str(j) for j in range(500)]}
    assert len(rounds) == 1 + 9
    for loop in ([("a", "a", "x")], [("a", "b", "x"), ("b", "c", "y"), ("c", "a", "z"), ("d", "a", "w"), ("e", "d", "v")]):
        with pytest.raises(ValueError):
            outline.with_ancestors(spark.createDataFrame(loop, "rule_id string, parent_id string, text string"))
    assert outline.with_ancestors(spark.createDataFrame([], "rule_id string, parent_id string, text string")).count() == 0


def test_neighbours_and_windows(spark):
    n = {r["rule_id"]: (r["prev"], r["next"]) for r in outline.neighbours(tree(spark).withColumn("g", F.lit(1)), ["g"], "line_no", "rule_id").collect()}
    assert n["601"] == (None, "601.2") and n["601.3"] == ("601.2a", "999.1")
    rows = spark.range(20).select(F.lit("g").alias("group_id"), F.col("id").alias("position"), F.col("id").alias("v"))
    centres = rows.filter("position in (0, 10, 19)").withColumn("window_id", F.col("v")).withColumn("total", F.lit(20))
    w = outline.window_around(rows, centres, 6).groupBy("window_id").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n"))
    assert {r["window_id"]: (r["a"], r["b"], r["n"]) for r in w.collect()} == {0: (0, 5, 6), 10: (7, 12, 6), 19: (14, 19, 6)}


def test_running_sums_do_not_depend_on_chunks_or_partitions(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), (F.col("id") * 7 % 11).alias("v"))
    want, seen = {}, {}
    for i in range(500):
        want[i] = seen.get(i % 3, 0)
        seen[i % 3] = want[i] + i * 7 % 11
    for block, parts in ((1, 3), (7, 17), (10_000, 1)):
        got = running_before(df.repartition(parts), ["k"], ["n"], F.floor(F.col("n") / block), {"s": F.col("v")})
        assert {r["n"]: r["s"] for r in got.collect()} == want


def test_cards_fill_faces_and_skip_records_without_an_id(spark):
    raw = [
        {"oracle_id": "a", "name": "One", "oracle_text": "Text", "type_line": "T", "mana_cost": "", "scryfall_uri": "u?x=1", "power": "1", "image_uris": {"normal": "n"}},
        {"oracle_id": "b", "name": "Two", "card_faces": [{"oracle_text": "Front", "power": "2", "image_uris": {"normal": "f"}}, {}]},
        {"name": "No id"},
    ]
    df = spark.read.schema(schemas.RAW_CARD).json(spark.sparkContext.parallelize([json.dumps(r) for r in raw]))
    got = {r["oracle_id"]: r for r in chunks.parse_cards(df).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["mana_cost"], got["a"]["scryfall_uri"], got["a"]["image_uri"]) == (None, "u", "n")
    assert (got["b"]["oracle_text"], got["b"]["power"], got["b"]["image_uri"]) == ("Front\n//\n", "2", "f")


def test_ruling_ordinals_count_before_the_card_lookup(spark):
    rulings = spark.createDataFrame([("x", "2020-01-01", "first", 0), ("gone", "2020-01-01", "lost", 1), ("x", "2020-01-02", "second", 2)], "oracle_id string, published_at string, comment string, line_no long")
    cards = spark.createDataFrame([("x", "Bolt", "B" * 300, None)], "oracle_id string, name string, oracle_text string, scryfall_uri string")
    placed = {r["comment"]: r["ordinal"] for r in chunks.rulings_with_cards(chunks.parse_rulings(rulings), cards).collect()}
    assert placed == {"first": 0, "lost": 0, "second": 1}
    made = {r["payload"]["text"]: r["text_to_embed"] for r in chunks.ruling_chunks(chunks.parse_rulings(rulings), cards).collect()}
    assert made["second"] == "Bolt — " + "B" * 200 + "\nRuling: second" and len(made) == 2
    assert chunks.skipped_rulings(rulings, cards).first()[0] == 1


POINT = "point_id string, source_type string, content_hash string, payload_hash string, payload string, dense array<float>, sparse struct<indices:array<bigint>,values:array<double>>"


def test_sync_embeds_only_what_changed(spark):
    stored = spark.createDataFrame([(i, "rule", c, p, "old", [1.0], None) for i, c, p in (("same", "c", "p"), ("text", "c0", "p"), ("meta", "c", "p0"), ("nohash", "c", None), ("gone", "c", "p"))] + [("other", "card", "c", "p", "old", [1.0], None)], POINT)
    new = spark.createDataFrame([(i, "rule", "t", "c", "p", "new") for i in ("same", "text", "meta", "nohash", "added")], "point_id string, source_type string, text_to_embed string, content_hash string, payload_hash string, payload string")
    assert {r["point_id"]: r["action"] for r in sync.classify(new, stored).collect()} == {"same": "skip", "text": "embed", "meta": "payload", "nohash": "payload", "added": "embed"}
    assert [r["point_id"] for r in sync.stale_points(new, stored).collect()] == ["gone"]
    assert sync.stale_points(new.limit(0), stored).count() == 0
    asked = []

    def encoder(rows):
        asked.extend(r["point_id"] for r in rows.collect() if r["text_to_embed"] is not None)
        return rows.withColumn("dense", F.array(F.lit(9.0).cast("float"))).withColumn("sparse", F.lit(None).cast("struct<indices:array<bigint>,values:array<double>>"))

    after = {r["point_id"]: (r["dense"][0], r["payload"]) for r in sync.apply(new, stored, encoder).collect()}
    assert sorted(asked) == ["added", "text"]
    assert after == {"same": (1.0, "new"), "text": (9.0, "new"), "meta": (1.0, "new"), "nohash": (1.0, "new"), "added": (9.0, "new"), "other": (1.0, "old")}
    kept = {r["point_id"] for r in sync.apply(new, stored, encoder, prune=False).collect()}
    assert "gone" in kept
    total = {r["source_type"]: r for r in sync.summary(sync.classify(new, stored), sync.stale_points(new, stored)).collect()}["TOTAL"]
    assert (total["total_seen"], total["embedded"], total["payload_updated"], total["skipped_unchanged"], total["pruned"]) == (5, 2, 2, 1, 1)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "id int, text string")
    rows = {r["id"]: (r["terms"], r["weights"]) for r in encode.sparse_terms(df, "text").collect()}
    norm = 1.2 * (0.25 + 0.75 * 3 / 256)
    assert rows[1][0] == ["a", "b"] and rows[1][1] == pytest.approx([2.2 / (1 + norm), 4.4 / (2 + norm)])
    assert rows[2] == ([], [])
    dense = {r["id"]: r["dense"] for r in encode.dense_vector(df, "text", encode.hashed_encoder(8)).collect()}
    assert dense[3] is None and len(dense[1]) == 8 and sum(x * x for x in dense[1]) == pytest.approx(1, abs=1e-5)


def test_dense_vectors_are_made_once_and_from_few_strings_at_a_time(spark):
    texts = spark.range(0, 8000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("text "), F.col("id"))).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    def load():
        import pyarrow.compute  # noqa: F401

        before = sys.getallocatedblocks()

        def encode_few(few):
            seen.add(len(few))
            return [[int(x[5:]), len(few), sys.getallocatedblocks() - before] for x in few]

        return encode_few

    made = encode.dense_vector(texts, "text", load)
    rows = sorted(made.filter("size(dense) = 3 AND dense IS NOT NULL").collect())
    assert [r["id"] for r in rows] == [i for i in range(8000) if i % 5] and all(r["dense"][:2] == [r["id"], 32] for r in rows)
    assert rows[0]["dense"][2] < 4000
    assert seen.value == 6400
    assert made.filter("dense IS NULL").count() == 1600
    assert encode.dense_vector(texts.filter("id = 0"), "text", load).first()["dense"] is None


@pytest.mark.parametrize("size", [0, 1, encode.RUN - 1, encode.RUN, encode.RUN + 1, 2 * encode.RUN + 7])
def test_long_texts_are_hashed_in_runs(size):
    text = "".join(chr(97 + i * i % 23) if i % 7 else "\u03a9" for i in range(size))
    points, counts = [ord(c) for c in f"  {text.lower()} "], np.zeros(8)
    for a, b, c in zip(points, points[1:], points[2:]):
        h = (961 * a + 31 * b + c) * 2654435761 % 2**32
        counts[h // 256 % 2**23 % 8] += 1 if h >= 2**31 else -1
    assert (encode.hashed_encoder(8)()([text])[0] == counts / np.sqrt((counts * counts).sum())).all()


def test_memory_of_the_hashed_encoder_does_not_grow_with_multiples_of_a_text():
    made, text = encode.hashed_encoder(8)(), "some words " * 200_000
    tracemalloc.start()
    made([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text)


def test_scans_read_all_formats_in_file_order(spark, tmp_path):
    rows = [{"oracle_id": str(i), "published_at": "2020-01-01", "comment": f"c{i}"} for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n\n".join(json.dumps(r) for r in rows))
    for name in ("a.json", "b.jsonl.gz"):
        assert scans.read_records(spark, str(tmp_path / name), schemas.RAW_RULING).count() == 5
    plain = tmp_path / "c.jsonl"
    plain.write_text("\n".join(json.dumps(r) for r in rows))
    numbered = scans.read_numbered_records(spark, str(plain), schemas.RAW_RULING)
    assert [r["comment"] for r in numbered.orderBy("line_no").collect()] == [f"c{i}" for i in range(5)]
    assert scans.pick_format(spark, str(tmp_path), "b").endswith("b.jsonl.gz")
    with pytest.raises(FileNotFoundError):
        scans.pick_format(spark, str(tmp_path), "zzz")


def test_latest_snapshot_prunes_partitions_and_fails_when_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(6).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") % 3 + 1).cast("string")).alias("snapshot_date")).write.partitionBy("snapshot_date").parquet(path)
    t = spark.read.schema("id long, snapshot_date string").parquet(path)
    assert {r["id"] for r in scans.latest_snapshot(t).collect()} == {2, 5}
    plan = scans.latest_snapshot(t)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*subquery", plan)
    with pytest.raises(Exception, match="no snapshot found"):
        scans.latest_snapshot(t.filter("id > 99")).collect()


def test_feed_entry_without_location_fails(spark):
    bad = spark.createDataFrame([(json.dumps({"data": [{"type": "rulings"}]}),)], "body string")
    with pytest.raises(Exception, match="no location"):
        scans.resolve_feed_entry(bad, "rulings").collect()


def test_event_frames(spark):
    raw = "event: delta\ndata: {\"a\": 1}\n\n: comment\n\ndata: x\ndata:  y\n\nevent: done\ndata: cut"
    got = [(r["event"], r["data"]) for r in scans.sse_events(spark.createDataFrame([("s", raw)], "id string, raw string")).orderBy("frame").collect()]
    assert got == [("delta", '{"a": 1}'), ("message", "x\n y")]


def test_publish_checks_the_count_and_moves_the_version(spark, tmp_path):
    base = str(tmp_path / "published")
    versions = tables.publish(spark.range(10).toDF("v"), base, "2024-01-01T00:00:00")
    assert [(r["version"], r["rows"]) for r in versions.collect()] == [("2024-01-01T00:00:00", 10)]
    snaps = spark.createDataFrame([("cards", "cards_2024"), ("cards", "cards_2023")], "kind string, name string")
    assert tables.data_version(None, snaps).first()[0] == "cards_2024|none"
    assert tables.data_version(versions, snaps).first()[0] == "2024-01-01T00:00:00"


def test_point_table(spark, tmp_path):
    path = str(tmp_path / "points")
    assert points.create_if_absent(spark, path).count() == 0 and points.create_if_absent(spark, path).schema == schemas.POINT
    bad = spark.createDataFrame([("p", [1.0, 2.0])], "point_id string, dense array<float>")
    with pytest.raises(Exception, match="not of size 3"):
        points.check_vector_size(bad, 3).collect()


def test_baseline_names_and_latest_states(spark, tmp_path):
    keys = spark.createDataFrame([("full", "x:a"), ("retrieval", "x:a"), ("full", None)], "mode string, generator string").select(tables.baseline_key(F.col("mode"), F.col("generator")))
    assert [r[0] for r in keys.collect()] == ["full/x:a", "retrieval", "full"]
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, created_at int, v string")
    assert {(r["key"], r["v"]) for r in tables.cache_entries(rows).collect()} == {("k", "b"), ("j", "c")}
    ledger = spark.createDataFrame([(1, None)], "id long, x string")
    assert ordinal(ledger.withColumn("n", F.lit(5)), ["x"], "n").first()["ordinal"] == 0


def test_ledger_append_partitions_by_day(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.sql("SELECT 1L AS id, TIMESTAMP '2024-01-01 10:00:00' AS created_at UNION ALL SELECT 2L, TIMESTAMP '2024-01-02 10:00:00'")
    assert tables.append_ledger(rows, path) == 2 and tables.append_ledger(rows, path) == 2
    assert spark.read.parquet(path).filter("day = '2024-01-01'").count() == 2


def test_pages_that_share_an_address_have_one_feed_entry_each(spark, tmp_path):
    """entries were joined to pages by address, so pages of one address multiplied."""
    from citeweave.plans import all_queries

    spark.createDataFrame([(1, "https://a", ""), (2, "https://a", ""), (3, "http://a", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in all_queries()["feed_entry"](spark, str(tmp_path)).select("page_id", "url", "filename").collect())
    assert got == [(1, "https://a", "oracle_cards.jsonl.gz"), (2, "https://a", "oracle_cards.jsonl.gz"), (3, "http://a", "oracle_cards.json")]
