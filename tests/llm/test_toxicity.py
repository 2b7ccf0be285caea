"""Toxicity: held-out accuracy, the label model against brute force, and odd rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from citeweave.llm import toxicity
from citeweave.llm.queries import QUERIES
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"
CLEAN = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "po", "ra") for b in ("den", "fix", "gor", "hal", "jin", "kos", "lum")]


def made(n, seed=1):
    """Documents of clean words; a tenth are toxic by an insult of the lexicon, or by a made-up stem with any ending."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.15
        if toxic:
            stem = rng.choice(["idiot", "moron", None])
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = stem or "zwirg" + rng.choice(["a", "olt", "ung", "ießen", "ko"])
        docs.append((i, " ".join(words).capitalize() + "."))
        if rng.random() < 0.5:
            labels.append((i, None, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_finds_held_out_toxic_documents(spark):
    docs, labels = made(3000)
    out = {r["doc_id"]: r for r in toxicity.report(*tables(spark, docs, labels)).collect()}
    assert len(out) == len(docs) and all(r["held_out"] == held(i) for i, r in out.items())
    truth = {i for i, text in docs if any(s in text.lower() for s in ("idiot", "moron", "zwirg"))}
    assert {i for i, r in out.items() if r["predicted"]} == truth
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())


def test_held_out_labels_never_matter(spark):
    docs, labels = made(800, 2)
    turned = [(i, q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    one, two = (sorted(map(tuple, toxicity.report(*tables(spark, docs, x)).collect())) for x in (labels, turned))
    assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in two] and max(abs(a[2] - b[2]) for a, b in zip(one, two)) < 1e-6


def test_real_labels(spark):
    docs, labels = spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    out = {r["doc_id"]: r for r in QUERIES["op12_toxicity"](spark, MEDIUM).collect()}
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(out) == docs.count()
    clean = [i for i, t in marked.items() if t == 0]
    assert sum(out[i]["predicted"] for i in clean) <= 0.01 * len(clean)
    insulted = [r["doc_id"] for r in docs.where("lower(text) rlike '\\\\b(idiot|moron|scum)\\\\b'").collect()]
    assert insulted and all(out[i]["predicted"] for i in insulted)


def test_forest_is_the_best_one():
    rng = np.random.default_rng(1)
    for _ in range(5):
        m, n = 5, 4000
        y = rng.random(n) < 0.4
        v = rng.random((n, m)) < 0.3
        v[:, 1] ^= v[:, 0] & (rng.random(n) < 0.8)
        v[:, 3] = np.where(rng.random(n) < 0.7, v[:, 1], v[:, 3])
        v[:, 4] = y
        pair = np.array([(v[y == k].T.astype(float) @ v[y == k]) for k in (False, True)])
        total = np.array([(~y).sum(), y.sum()], float)
        leans = toxicity.forest(total, pair)

        def information(i, j):
            out = 0.0
            for k in (False, True):
                part = v[y == k]
                for a, b in itertools.product((False, True), repeat=2):
                    both = ((part[:, i] == a) & (part[:, j] == b)).sum()
                    if both:
                        out += both * np.log(both * len(part) / ((part[:, i] == a).sum() * (part[:, j] == b).sum()))
            return out

        edges = {frozenset((i, int(a))) for i, a in enumerate(leans) if a >= 0}
        strong = {e for e in map(frozenset, itertools.combinations(range(m), 2)) if information(*e) > 3 * np.log(n)}
        best = max((c for r in range(m) for c in itertools.combinations(strong, r) if len(_groups(m, c)) == m - len(c)), key=lambda c: sum(information(*e) for e in c))
        assert edges == set(best)


def _groups(m, edges):
    name = list(range(m))
    for e in edges:
        a, b = (name[x] for x in e)
        name = [a if x == b else x for x in name]
    return set(name)


def test_log_odds_follow_the_forest():
    rng = np.random.default_rng(2)
    m, n = 6, 500
    y = rng.random(n) < 0.3
    v = rng.random((n, m)) < np.where(y, 0.5, 0.1)[:, None]
    v[:, 2] |= v[:, 0]
    pair = np.array([(v[y == k].T.astype(float) @ v[y == k]) for k in (False, True)])
    total = np.array([(~y).sum(), y.sum()], float)
    leans = np.array([-1, 0, 0, -1, 3, -1])
    added = toxicity.belief(m, 2)
    model = toxicity.maximised(total, pair, leans, added)
    for row in v[:20]:
        want = np.log((total[1] + 0.5) / (total[0] + 0.5))
        for k, sign in ((0, -1), (1, 1)):
            single = np.diag(pair[k])
            for j, a in enumerate(leans):
                rate = (single[j] + added[k, j]) / (total[k] + 1)
                if a < 0:
                    p = rate
                elif row[a]:
                    p = (pair[k, j, a] + 2 * rate) / (single[a] + 2)
                else:
                    p = (single[j] - pair[k, j, a] + added[k, j]) / (total[k] - single[a] + 1)
                want += sign * np.log(p if row[j] else 1 - p)
        assert abs(model.log_odds(row[None, :].astype(np.float32))[0] - want) < 1e-9


def test_keys_of_words(spark):
    words = ["idiot", "Idiots", "idio", "schreckschraubenhaft", "né", "a", "Ärger"]
    known = [[toxicity.key("idiot", toxicity.BEGINS)], [toxicity.key("idiot", toxicity.WHOLE)], [toxicity.key("schreckschraub", toxicity.BEGINS)], [toxicity.key("né", toxicity.WHOLE)]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(90, " ".join(words) + "! ")], "doc_id long, text string")
    got = {r["doc_id"]: r["fired"] for r in toxicity.votes(rows, known).collect()}
    assert got == {0: [1], 1: [0], 2: [], 3: [2], 4: [3], 5: [], 6: [], 90: [0, 1, 2, 3]}


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    docs, labels = made(300, 3)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (None, "You idiot"), (1003, "idiot " * 30_000), (1004, "a\x00b \x00\x00"), (5, docs[5][1]), (5, "other text")]
    labels += [(None, None, 1), (1000, None, 1), (7, None, None), (8, None, 5), (9, 1, 0), (9, 1, 1), (99_999, 0, 1)]
    rows, marks = tables(spark, docs, labels if labelled else [])
    rows = rows.selectExpr("*", "1 AS gold", "2 AS labelled", "3 AS fired", "4 AS score", "5 AS toxic", "6 AS _h")
    out = toxicity.report(rows, marks).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["predicted"] for r in out if r["doc_id"] not in (5, None)}
    assert by[1003] == 1 and by[1001] == by[1002] == 0
    assert toxicity.report(rows.limit(0), marks).collect() == []


def test_query_covers_the_table(spark):
    out = QUERIES["op12_toxicity"](spark, SMALL)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
