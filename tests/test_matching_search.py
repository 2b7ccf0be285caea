import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import encode, matching, retrieve, search

NAMES = ["Bolt", "Lightning Bolt", "Fog", "For Glory!", "∞", "a", "Fog Bank", "é", "b-a", "+2 Mace", "Fog"]


def brute_matches(text, names):
    low, out = text.lower(), set()
    for key in {n.lower() for n in names}:
        at = low.find(key)
        while at >= 0:
            end = at + len(key)
            if (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum()):
                out.add((key, at, end))
            at = low.find(key, at + 1)
    return out


def keys_of(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "line_no long, name string")
    return matching.dictionary(df).select("key")


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(11)
    parts = ["bolt", "Lightning", "fog", "Bank", "for", "glory", "!", "∞", " ", " ", " ", "-", "a", "b", "é", "+2", "mace", "x", ".", "\n", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return texts + ["", "∞", "a∞", "For glory!", "for glory!x", "+2 mace", "1+2 mace", "Lightning Bolt strikes Bolt", "Voltaic Boltcaster", "fog bank\nfog"]


def test_phrase_matches_equal_brute_force(spark, random_texts):
    df = spark.createDataFrame(list(enumerate(random_texts)), "text_id int, text string")
    found = {}
    for r in matching.phrase_matches(df, keys_of(spark, NAMES)).collect():
        found.setdefault(r["text_id"], set()).add((r["key"], r["start"], r["end"]))
    for i, text in enumerate(random_texts):
        assert found.get(i, set()) == brute_matches(text, NAMES), text


@pytest.mark.parametrize("few", [0, 32])
def test_overlapping_occurrences_of_a_name_are_found_from_left_to_right(spark, monkeypatch, few):
    """of occurrences of one name that overlap, every one was returned."""
    monkeypatch.setattr(matching, "FEW_NAMES", few)
    names = ["the the", "as a", "a b a", "∞∞", "!a!", "fog", "theory the"]
    texts = ["the the the", "The the the the", "bathe the the", "as as a", "a b a b a b a", "∞∞∞ ∞∞", "!a!a!", "fog the the", "theory theory the", "the\nthe the", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    got = {(r["text_id"], r["key"], r["start"], r["end"]) for r in matching.phrase_matches(df, keys_of(spark, names)).collect()}
    want = set()
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for key in names:
            at = low.find(key)
            while at >= 0:
                end = at + len(key)
                edges = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
                want |= {(i, key, at, end)} if edges else set()
                at = low.find(key, end)
    assert got == want


def test_contained_and_greedy_spans_equal_brute_force(spark, random_texts):
    df = spark.createDataFrame(list(enumerate(random_texts)), "text_id int, text string")
    m = matching.phrase_matches(df, keys_of(spark, NAMES))
    free, greedy = {}, {}
    for r in matching.drop_contained(m).collect():
        free.setdefault(r["text_id"], set()).add((r["key"], r["start"], r["end"]))
    for r in matching.greedy_spans(m).collect():
        greedy.setdefault(r["text_id"], set()).add((r["key"], r["start"], r["end"]))
    for i, text in enumerate(random_texts):
        spans = brute_matches(text, NAMES)
        assert free.get(i, set()) == {s for s in spans if not any(o[1] <= s[1] and s[2] <= o[2] and o[1:] != s[1:] for o in spans)}
        taken = []
        for s in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):
            if all(s[2] <= o[1] or s[1] >= o[2] for o in taken):
                taken.append(s)
        assert greedy.get(i, set()) == set(taken)


def test_last_row_of_a_name_wins(spark):
    cards = spark.createDataFrame([(0, "Fog", "old"), (1, "fog", "new")], "line_no long, name string, oracle_id string")
    got = matching.find_cards(spark.createDataFrame([(1, "FOG!")], "text_id int, text string"), cards).collect()
    assert [(r["key"], r["entry"]["oracle_id"]) for r in got] == [("fog", "new")]


def test_ordinary_words_need_a_capital_inside_a_sentence(spark):
    rules = spark.createDataFrame([("with vigilance and more",), ("vigilance, vigilance",), ("Vigilance once",)], "text string")
    words = matching.ordinary_words(rules)
    assert {r["word"] for r in words.collect()} == {"vigilance"}
    texts = ["my vigilance card", "does Vigilance work", "Vigilance works", "It ends. Vigilance works", "He said (“Vigilance”)"]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    m = matching.phrase_matches(df, keys_of(spark, ["Vigilance", "Other"]), with_named=True)
    assert {r["text_id"] for r in matching.drop_ordinary(m, words).collect()} == {1, 4}


RULES = [("702.1", "702", "Keywords here"), ("702.2", "702", "Strike"), ("702.3", "702", "Double Strike"), ("702.4", "702", "Raze"), ("702.4a", "702.4", "Razing is good."), ("702.4b", "702.4", "More."), ("702.5", "702", "Onward!"),
         ("702.6", "702", "Dawn and Dusk"), ("702.7", "702", "∞ (Forever)"), ("702.8", "702", "Razing")]


def test_keywords(spark):
    rules = spark.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "rule_id string, parent_id string, text string, line_no long")
    asked = ["Does DOUBLE STRIKE beat strike and razed?", "razing", "onward we go at dusk", "what is forever or ∞", "keywords here", "striking dawns", ""]
    df = spark.createDataFrame(list(enumerate(asked)), "text_id int, text string")
    got = {}
    found = matching.find_keywords(df, rules)
    for r in found.orderBy("text_id", "start").collect():
        got.setdefault(r["text_id"], []).append(r["rule_id"])
    assert got == {0: ["702.3", "702.2", "702.4"], 1: ["702.8"], 2: ["702.5", "702.6"], 3: ["702.7"], 5: ["702.2", "702.6"]}
    lines = matching.keyword_rules(found.filter("text_id = 0"), rules).orderBy("start", "line_no").collect()
    assert [r["rule_id"] for r in lines] == ["702.3", "702.2", "702.4", "702.4a", "702.4b"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2, 3, size=(60, 4)).astype(float)
    return base, spark.createDataFrame([(f"p{i:02d}", [float(x) for x in v]) for i, v in enumerate(base)], "point_id string, dense array<float>")


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / n), 6) if n else 0.0


@pytest.mark.parametrize(("block", "parts", "step"), [(4096, 1, 256), (3, 7, 4), (1, 17, 256)])
def test_dense_topk_equals_brute_force_with_ties(spark, vectors, monkeypatch, block, parts, step):
    monkeypatch.setattr(search, "STEP", step)
    base, df = vectors
    questions = df.limit(7).withColumnRenamed("point_id", "query_id")
    got = {}
    for r in search.dense_topk(df.repartition(parts), questions, 5, block=block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["point_id"], r["score"])
    for q in range(7):
        want = sorted(((f"p{i:02d}", cosine(base[q], v)) for i, v in enumerate(base)), key=lambda x: (-x[1], x[0]))[:5]
        assert [got[f"p{q:02d}"][i + 1][0] for i in range(5)] == [w[0] for w in want]
        assert [got[f"p{q:02d}"][i + 1][1] for i in range(5)] == pytest.approx([w[1] for w in want], abs=1e-6)


@pytest.mark.parametrize(("block", "parts"), [(4096, 1), (2, 9)])
def test_sparse_topk_equals_brute_force(spark, block, parts):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "point_id long, text string")
    docs = encode.sparse_vector(df, "text")
    asked = encode.sparse_vector(df.limit(6).withColumnRenamed("point_id", "query_id"), "text")
    got = {}
    for r in search.sparse_topk(docs.repartition(parts), asked, 4, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"], r["score"]))

    def weights(t):
        w = t.split()
        return {x: w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / 256)) for x in set(w)}

    for q in range(6):
        mine = weights(texts[q])
        scores = [(i, round(sum(mine[x] * w[x] for x in mine if x in w), 6)) for i, w in ((i, weights(t)) for i, t in enumerate(texts))]
        want = sorted((s for s in scores if s[1] > 0), key=lambda s: (-s[1], s[0]))[:4]
        assert [g[1] for g in sorted(got.get(q, []))] == [w[0] for w in want]


def test_no_questions_and_no_points_give_no_hits(spark, vectors):
    _base, df = vectors
    none = df.limit(0).withColumnRenamed("point_id", "query_id")
    assert search.dense_topk(df, none, 3).count() == 0
    assert search.dense_topk(df.limit(0), df.withColumnRenamed("point_id", "query_id"), 3).count() == 0


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, point_id string, score double")


def test_normalisation_and_fusion(spark):
    n = search.normalize(hits(spark, [(1, "a", 0.0), (1, "b", 5.0), (1, "c", 10.0), (2, "a", 3.0), (2, "b", 3.0), (3, "a", 7.0)]), ["query_id"])
    assert {(r["query_id"], r["point_id"]): r["norm"] for r in n.collect()} == {(1, "a"): 0.0, (1, "b"): 0.5, (1, "c"): 1.0, (2, "a"): 1.0, (2, "b"): 1.0, (3, "a"): 1.0}
    dense, sparse = hits(spark, [(1, "a", 1.0), (1, "b", 0.0)]), hits(spark, [(1, "b", 9.0), (1, "a", 1.0), (2, "z", 4.0)])
    fused = {(r["query_id"], r["point_id"]): (r["score"], r["rank"]) for r in search.fuse(dense, sparse, 0.5, 0.5, 0.0, 10).collect()}
    assert fused == {(1, "a"): (0.5, 1), (1, "b"): (0.5, 2), (2, "z"): (0.5, 1)}
    assert {r["point_id"] for r in search.fuse(dense, sparse.limit(0), 1.0, 0.0, 0.5, 10).collect()} == {"a"}


def test_topk_keeps_k_rows_per_task_before_the_shuffle(spark, vectors):
    _base, df = vectors
    plan = search.dense_topk(df, df.withColumnRenamed("point_id", "query_id"), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def full_inputs(spark):
    cards = spark.createDataFrame([(0, "o1", "Lightning Bolt", "Deals 3."), (1, "o2", "Fog", "Prevent.")], "line_no long, oracle_id string, name string, oracle_text string").withColumn("scryfall_uri", F.lit("http://c"))
    rules = spark.createDataFrame([(*r, i) for i, r in enumerate(RULES)], "rule_id string, parent_id string, text string, line_no long")
    rows = [("p1", "rule", "702.4", None, None, "raze rule"), ("p2", "ruling", None, "o1", "Lightning Bolt", "bolt ruling"), ("p3", "ruling", None, "o2", "Fog", "fog ruling"), ("p4", "oracle", None, "o2", "Fog", "fog text"),
            ("p5", "rule", "510.1", None, None, "damage step"), ("p6", "ruling", None, "o1", "Lightning Bolt", "another bolt ruling")]
    points = spark.createDataFrame(rows, "point_id string, source_type string, rule_id string, oracle_id string, card_name string, text string")
    none = F.lit(None).cast("string")
    payload = F.struct("source_type", "text", "rule_id", "card_name", "oracle_id", F.when(F.col("source_type") == "ruling", "2020-01-01").alias("published_at"), none.alias("scryfall_uri"))
    vec = encode.encode_points(encode.hashed_encoder(16))
    encoded = vec(points.withColumn("text_to_embed", F.col("text"))).select("point_id", "source_type", "dense", "sparse", payload.alias("payload"))

    def encode_questions(q):
        return vec(q.withColumn("text_to_embed", F.col("text"))).drop("text_to_embed")

    return cards, rules, encoded, encode_questions


def test_retrieval_orders_blocks_and_drops_covered_hits(spark):
    cards, rules, points, enc = full_inputs(spark)
    asked = spark.createDataFrame([(1, "Does lightning bolt raze fog text damage step?"), (2, "damage step")], "query_id long, text string")
    got = {}
    for r in retrieve.retrieve(enc(asked), cards, rules, points, retrieve.SearchSettings(card_ruling_limit=2)).orderBy("query_id", "number").collect():
        got.setdefault(r["query_id"], []).append((r["match_type"], r["title"], r["text"]))
    one = got[1]
    assert one[:2] == [("card_name_match", "Lightning Bolt", "Deals 3."), ("card_name_match", "Fog", "Prevent.")]
    assert [x[2] for x in one if x[0] == "card_ruling_match"] == ["bolt ruling", "fog ruling"]
    assert [x[1] for x in one if x[0] == "keyword_rule_match"] == ["702.4", "702.4a", "702.4b"]
    # Named cards and keyword rules cover every vector hit but the rule about damage.
    assert [x for x in one if x[0].endswith("vector_hit")] == [("vector_hit", "510.1", "damage step")]
    two = got[2]
    assert two[0][0] == "vector_hit" and ("vector_hit", "510.1", "damage step") in two
    numbered = retrieve.build_context(retrieve.retrieve(enc(asked.filter("query_id = 2")), cards, rules, points)).first()
    assert numbered["context"].startswith("[1] ") and "\n\n[2] " in numbered["context"] and "Rule 510.1: damage step" in numbered["context"]


def test_rules_only_search_can_be_turned_off(spark):
    cards, rules, points, enc = full_inputs(spark)
    asked = enc(spark.createDataFrame([(2, "damage step raze rule")], "query_id long, text string"))
    off = retrieve.retrieve(asked, cards, rules.limit(0), points, retrieve.SearchSettings(rules_top_k=0, hybrid_top_k=1))
    on = retrieve.retrieve(asked, cards, rules.limit(0), points, retrieve.SearchSettings(rules_top_k=5, hybrid_top_k=1))
    assert {r["match_type"] for r in off.collect()} == {"vector_hit"}
    assert [r["match_type"] for r in on.orderBy("number").collect()] == ["rule_vector_hit", "vector_hit"]


def test_greedy_spans_of_a_long_chain(spark):
    chain = spark.range(100_000).select(F.lit(1).alias("text_id"), F.lit("k").alias("key"), F.col("id").cast("int").alias("start"), (F.col("id") + 2 + (F.col("id") * 7919 % 5 == 0).cast("int")).cast("int").alias("end"))
    got = [(r["start"], r["end"]) for r in matching.greedy_spans(chain).orderBy("start").collect()]
    free = np.ones(100_010, bool)
    want = []
    for i in sorted(range(100_000), key=lambda i: (-(2 + (i * 7919 % 5 == 0)), i)):
        end = i + 2 + (i * 7919 % 5 == 0)
        if free[i:end].all():
            free[i:end] = False
            want.append((i, end))
    assert got == sorted(want)


def test_no_gram_is_built_for_words_that_open_no_name(spark):
    texts = spark.createDataFrame([(1, "Bolt of the fog " * 50)], "text_id int, text string")
    plan = matching.phrase_matches(texts, keys_of(spark, NAMES))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "getbit" in plan and plan.index("getbit") < plan.index("array_join")


def clustered(rng, n, dim=8, centres=12):
    base = rng.normal(size=(centres, dim)) * 5
    return base[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.2


@pytest.mark.parametrize("group", [7, 40])
def test_dense_search_visits_only_groups_that_can_matter(spark, group):
    rng = np.random.default_rng(7)
    base = clustered(rng, 600)
    base[5] = base[17] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(base)], "point_id long, dense array<float>")
    asked = df.filter("point_id % 9 = 0 or point_id in (5, 17)").withColumnRenamed("point_id", "query_id")
    hits, visits = search.dense_search(df, asked, 6, group=group, block=16, pivots=40)
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"], round(r["score"], 6)))
    exact = np.array(base, np.float32).astype(float)
    for q, rows in got.items():
        want = sorted(((i, cosine(exact[q], v)) for i, v in enumerate(exact)), key=lambda x: (-x[1], x[0]))[:6]
        assert [r[1:] for r in sorted(rows)] == [(i, pytest.approx(s, abs=1e-6)) for i, s in want]
    asked_n, seen = asked.count(), visits.distinct().count()
    groups = visits.select("_g").distinct().count()  # a question without direction visits them all
    assert len(got) == asked_n and visits.count() == seen < 0.5 * asked_n * groups


@pytest.mark.parametrize("group", [5, 30])
def test_sparse_search_visits_only_groups_that_can_matter(spark, group):
    rng = random.Random(6)
    worlds = [[f"{w}{i}" for i in range(30)] for w in "abcdefgh"]
    texts = [" ".join(rng.choice(rng.choice(worlds) if rng.random() < 0.05 else worlds[i % 8]) for _ in range(rng.randint(0, 25))) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "point_id long, text string")
    docs, asked = encode.sparse_vector(df, "text"), encode.sparse_vector(df.filter("point_id % 11 = 0").withColumnRenamed("point_id", "query_id"), "text")
    hits, visits = search.sparse_search(docs, asked, 5, group=group, block=8)
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"], r["score"]))

    def weights(t):
        w = t.split()
        return {x: w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / 256)) for x in set(w)}

    for q in range(0, 400, 11):
        mine = weights(texts[q])
        scores = [(i, round(sum(mine[x] * w[x] for x in mine if x in w), 6)) for i, w in ((i, weights(t)) for i, t in enumerate(texts))]
        want = sorted((s for s in scores if s[1] > 0), key=lambda s: (-s[1], s[0]))[:5]
        assert [g[1:] for g in sorted(got.get(q, []))] == want
    assert visits.count() < 0.6 * asked.count() * (400 / group)


def test_settings_by_question_equal_one_search_each(spark):
    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [(i, "rule" if i % 3 else "oracle", " ".join(rng.choice(words, 5)), [float(x) for x in rng.normal(size=6)]) for i in range(80)]
    points = encode.sparse_vector(spark.createDataFrame(rows, "point_id long, source_type string, text string, dense array<float>"), "text")
    asked = points.filter("point_id < 6").withColumnRenamed("point_id", "query_id")
    settings = [(q, 0.2 * q, 1 - 0.2 * q, 0.1 * q, 3 + q, 10 + 5 * q) for q in range(6)]
    table = spark.createDataFrame(settings, "query_id long, dense_weight double, sparse_weight double, threshold double, top_k int, per_branch int")
    got = sorted(map(tuple, search.hybrid_search_by(points, asked, table, "rule").select("query_id", "point_id", "score", "rank").collect()))
    want = []
    for q, d, s, t, k, n in settings:
        want += map(tuple, search.hybrid_search(points, asked.filter(F.col("query_id") == q), n, d, s, t, k, "rule").select("query_id", "point_id", "score", "rank").collect())
    assert got == sorted(want)


def test_sparse_search_makes_vectors_once_and_keeps_asked_terms(spark, monkeypatch):
    """Every vector is made in one expression, and terms that no question has are neither stored nor indexed."""
    docs = spark.createDataFrame([(1, "rare wide words here"), (2, "other"), (3, None), (4, "wide wide")], "point_id long, text string").repartition(2)
    asked = spark.createDataFrame([(9, "wide Words"), (10, None), (11, "!")], "query_id long, text string")
    written = {}

    def kept(df, name):
        written[name] = df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all"), df.collect()
        return spark.createDataFrame(written[name][1], df.schema)

    monkeypatch.setattr(search, "materialize", kept)
    hits = search.sparse_topk(encode.sparse_vector(docs, "text"), encode.sparse_vector(asked, "text"), 3).collect()
    assert {name: written[name][0] for name in ("search-points", "search-questions")} == {"search-points": 1, "search-questions": 1}
    assert {r["point_id"]: len(r["_i"]) for r in written["search-points"][1]} == {1: 2, 4: 1}
    assert [(r["query_id"], r["point_id"], r["rank"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(9, 1, 1), (9, 4, 2)]


def test_groups_of_a_sparse_search_grow_with_the_points(spark, monkeypatch):
    """groups stayed small however many points there were, and every question went to nearly each of them."""
    monkeypatch.setattr(search, "GROUP", 8)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abcdefghij") for _ in range(6))) for i in range(1600)]
    docs = encode.sparse_vector(spark.createDataFrame(texts, "point_id long, text string"), "text")
    asked = encode.sparse_vector(spark.createDataFrame(texts[:5], "query_id long, text string"), "text")
    hits, visits = search.sparse_search(docs, asked, 3)
    assert 1 < visits.select("_g").distinct().count() <= 2 * search.GROUPS
    assert hits.count() == 15


@pytest.mark.parametrize("common, cells", [(1, 64), (4, 1 << 20), (10**9, 64)])
def test_sparse_tiles_equal_brute_force_for_common_and_rare_terms(monkeypatch, common, cells):
    import pyarrow as pa

    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "COMMON", common)
    rng = np.random.default_rng(5)
    side = lambda n: [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(n)]
    table = lambda name, terms: pa.table({name: pa.array(range(len(terms)), pa.int64()), "_i": pa.array(terms, pa.list_(pa.int64())), "_v": pa.array([[float(t % 3 + 1) for t in ts] for ts in terms], pa.list_(pa.float64()))})
    asked, stored = side(9), side(40)
    top = search._TopK(len(asked), 4)
    search._score_terms(table("query_id", asked), table("point_id", stored), top, "point_id")
    rows, scores, ids = top.rows()
    want = []
    for q, terms in enumerate(asked):
        found = [(-sum(float(t % 3 + 1) ** 2 for t in set(terms) & set(p)), i) for i, p in enumerate(stored)]
        want += [(q, -s, i) for s, i in sorted(found)[:4] if s < 0]
    assert list(zip(rows.tolist(), scores.tolist(), ids.tolist())) == want


def test_texts_are_cut_once_for_their_matches(spark, random_texts):
    """A filter on the cut text was pushed below the cut, which was then made again for it."""
    df = spark.createDataFrame([(1, "the wide gate!"), (2, ""), (3, None), (4, "?!")], "text_id long, text string")
    found = matching.phrase_matches(df, keys_of(spark, ["wide gate"]))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("|[^\\p{L}\\p{N}]+") == 1
    assert [tuple(r) for r in found.collect()] == [(1, "wide gate", 4, 13)]
    symbols = matching.phrase_matches(df, keys_of(spark, ["?!"]))
    assert [tuple(r) for r in symbols.collect()] == [(4, "?!", 0, 2)]


def test_ordinary_names_are_told_in_the_dictionary(spark):
    """A name with very many matches is one row of a join, not all its matches in one task."""
    from citeweave.plans import all_queries

    texts = spark.createDataFrame([(1, "He has Vigilance now. Other"), (2, "some vigilance"), (3, "Vigilance is. Vigilance"), (4, "the Other one, other")], "text_id long, text string")
    words = spark.createDataFrame([("vigilance", 5), ("Vigilance", 1)], "word string, n long")
    keys = matching.mark_ordinary(keys_of(spark, ["Vigilance", "Other"]), words)
    assert sorted(map(tuple, keys.select("key", "ordinary").collect())) == [("other", False), ("vigilance", True)]
    got = matching.phrase_matches(texts, keys, with_named=True)
    before = matching.drop_ordinary(matching.phrase_matches(texts, keys_of(spark, ["Vigilance", "Other"]), with_named=True), words)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, before.collect()))
    assert {(r["text_id"], r["key"]) for r in got.collect()} == {(1, "vigilance"), (1, "other"), (4, "other")}
    plan = all_queries()["ordinary_word_guard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Matches meet the dictionary, and what was passed over, alone.
    assert "Join LeftOuter, (key" not in plan


def test_tiles_pass_over_questions_whose_kth_score_no_point_can_reach(monkeypatch):
    """every question of a tile was scored with every point of it, whatever its kth score."""
    import pyarrow as pa

    monkeypatch.setattr(search, "ROWS", 8)
    monkeypatch.setattr(search, "CELLS", 64)
    rng = np.random.default_rng(8)
    side = lambda n: [sorted((rng.choice(20, rng.integers(1, 8), replace=False) + 100 * (i % 5)).tolist()) for i in range(n)]
    table = lambda name, terms: pa.table({name: pa.array(range(len(terms)), pa.int64()), "_i": pa.array(terms, pa.list_(pa.int64())), "_v": pa.array([[float(t % 7 + 1) for t in ts] for ts in terms], pa.list_(pa.float64()))})
    asked, stored = side(40), side(200)
    exact = np.array([[sum(float(t % 7 + 1) ** 2 for t in set(q) & set(p)) for p in stored] for q in asked])
    kth = -np.sort(-exact, axis=1)[:, 2]
    cells, products = [], search._products
    monkeypatch.setattr(search, "_products", lambda *a: cells.append((out := products(*a)).size) or out)
    for edge in (np.where(kth > 0, kth, -np.inf), None):
        cells.clear()
        top = search._TopK(len(asked), 3, edge)
        search._score_terms(table("query_id", asked), table("point_id", stored), top, "point_id")
        want = [(q, s, i) for q in range(len(asked)) for s, i in sorted(((s, i) for i, s in enumerate(exact[q]) if s > 0), key=lambda x: (-x[0], x[1]))[:3]]
        assert list(zip(*(c.tolist() for c in top.rows()))) == want
        assert sum(cells) < 0.5 * exact.size


@pytest.mark.parametrize("groups", [1, 8])
def test_bounds_of_groups_reach_every_score_in_them(spark, monkeypatch, groups):
    """they were made by a join of the questions' terms with the groups of each, row by row."""
    monkeypatch.setattr(search, "GROUPS_OF_BOUNDS", groups)
    rng = random.Random(11)
    vector = lambda: sorted((t, rng.choice([-1.0, 0.5, 2.0])) for t in rng.sample(range(12), rng.randint(1, 5)))
    parts = lambda v: ([t for t, _ in v], [w for _, w in v])
    points, asked = [vector() for _ in range(60)], [vector() for _ in range(9)]
    grouped = spark.createDataFrame([(i, *parts(v), i % 4) for i, v in enumerate(points)], "point_id long, _i array<long>, _v array<double>, _g long")
    # The last question comes twice, and one has no id.
    rows = [(f"q{i}", *parts(v)) for i, v in enumerate(asked)] + [("q8", *parts(asked[8])), (None, *parts(asked[0]))]
    bounds = search._sparse_bounds(grouped, spark.createDataFrame(rows, "query_id string, _i array<long>, _v array<double>").coalesce(1), "query_id")
    got = search._in_order(bounds, grouped, "query_id").collect()
    assert len({(r["query_id"], r["_g"]) for r in got}) == len(got)
    for i, q in enumerate(asked):
        mine = sorted((r for r in got if r["query_id"] == f"q{i}"), key=lambda r: (-r["bound"], r["_g"]))
        assert [r["_before"] for r in mine] == [15 * n for n in range(len(mine))]
        for r in mine:
            here = [dict(p) for n, p in enumerate(points) if n % 4 == r["_g"]]
            most = sum(max(0, *(w * p[t] for p in here if t in p)) for t, w in q if any(t in p for p in here))
            assert r["bound"] == pytest.approx(most * (2 if i == 8 else 1))


def test_rules_of_a_keyword_are_dealt_over_tasks_and_only_hits_are_covered(spark):
    """the rules of all keywords found were one task's work, and were sorted out again for every removal of covered hits."""
    rules = spark.createDataFrame([("702.2", "702", "Fog", 1), *[(f"702.2r{i}", "702.2", "sub", 10 + i) for i in range(50)]], "rule_id string, parent_id string, text string, line_no long")
    found = spark.createDataFrame([(q, "702.2", 5) for q in range(200)], "query_id long, rule_id string, start int").coalesce(1)
    got = matching.keyword_rules(found, rules, "query_id")
    assert got.count() == 200 * 51 and got.distinct().count() == 200 * 51
    assert got.select(F.spark_partition_id()).distinct().count() > 4


def test_points_that_come_twice_are_two_results(spark):
    cards, rules, points, enc = full_inputs(spark)
    asked = enc(spark.createDataFrame([(2, "damage step")], "query_id long, text string"))
    twice = retrieve.retrieve(asked, cards, rules, points.unionByName(points.filter("point_id = 'p5'")), retrieve.SearchSettings(rules_top_k=1, hybrid_top_k=1)).collect()
    assert sorted((r["match_type"], r["title"]) for r in twice) == [("vector_hit", "510.1")] * 2
