"""Whitening next to dense linear algebra, and its rank-one updates by themselves."""

import math

import numpy as np
import pytest

from citeweave.llm import whiten
from citeweave.llm.queries import QUERIES
from tests.conftest import SMALL


def usable(rows):
    fine = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in fine]
    common = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    return [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in fine if len(v) == common]


def check(got, rows, k=8):
    """Every property of the contract, from dense linear algebra on the same integers."""
    rows = usable(rows)
    n = len(rows)
    x = np.array([v for _, v in rows], float)
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > values[0] * 1e-12).sum())
    k = min(k, rank)
    sums = [sum(v[j] for _, v in rows) for j in range(x.shape[1])]
    deviation = {(i, tuple(v)): sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in rows}
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), d) for (i, _), d in ((key, deviation[key]) for key in [(i, tuple(v)) for i, v in rows]))
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(((str(r["vec_id"]), r["deviation"]), r["whitened"]))
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
    order = sorted(range(n), key=lambda a: (str(rows[a][0]), deviation[(rows[a][0], tuple(rows[a][1]))]))
    w = np.array([[s for _, s in sorted(by[c])] for c in range(1, k + 1)]).T
    error = np.abs(w.T @ w / n - np.eye(k)).max()
    assert error < 1e-8 and {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-8
    for c in range(k):
        apart = [values[c - 1] - values[c]] if c else []
        apart += [values[c] - values[c + 1]] if c + 1 < len(values) else []
        if min(apart) > 1e-6 * values[0]:
            mine = centred[order] @ vectors[:, c] / np.sqrt(values[c])
            assert min(np.abs(w[:, c] - mine).max(), np.abs(w[:, c] + mine).max()) < 1e-6


@pytest.mark.parametrize("case", ["random", "zero", "equal", "clusters", "aligned", "tiny", "repeated"])
def test_rank_one_updates(case):
    rng = np.random.default_rng(1)
    d = 12
    for trial in range(30):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        values = {"random": rng.uniform(0, 10, d), "zero": np.zeros(d), "equal": np.full(d, 3.0), "clusters": np.repeat([1.0, 2.0, 2.0 + 1e-15, 5.0], 3), "aligned": np.arange(d) * 1.0, "tiny": 10.0 ** -np.arange(d), "repeated": np.zeros(d)}[case]
        values = np.sort(values)
        v = {"aligned": q[:, 3] * 2, "tiny": rng.normal(size=d) * 1e-6}.get(case, rng.normal(size=d))
        s = q @ np.diag(values) @ q.T
        for _ in range(5 if case == "repeated" else 1):
            s = s + np.outer(v, v)
            values, q = whiten.rank_one(values, q, v)
        size = max(1e-300, np.abs(s).max())
        assert np.abs(q @ np.diag(values) @ q.T - s).max() < 1e-13 * d * size
        assert np.abs(q.T @ q - np.eye(d)).max() < 1e-13 * d
        assert (np.diff(values) >= 0).all()


def test_spectra_combine_to_the_scatter_of_all():
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(m, 6)) * [1, 2, 3, 4, 5, 0] + 100 for m in (1, 2, 5, 40, 300)]
    total = whiten.Spectrum.empty(6)
    for part in parts:
        own = whiten.Spectrum.empty(6)
        for at in range(0, len(part), 50):
            own.add(part[at : at + 50])
        total.combine(own) if total.n else total.__dict__.update(own.__dict__)
    x = np.concatenate(parts)
    centred = x - x.mean(axis=0)
    assert total.n == len(x) and np.abs(total.mean - x.mean(axis=0)).max() < 1e-10
    assert np.abs(total.vectors @ np.diag(total.values) @ total.vectors.T - centred.T @ centred).max() < 1e-8


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=10) * np.arange(1, 11)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[9][1]), (400, None), (401, []), (402, [1.0, None] * 5), (403, [float("nan")] * 10), (404, [float("inf")] * 10), (405, [0.5] * 3)]
    clash = table(spark, rows).repartition(9).selectExpr("*", "1 AS id", "2 AS x", "3 AS d")
    check(whiten.whiten(clash).collect(), rows)
    points = whiten.prepare(clash).cache()
    model = whiten.fit(points, 8, block=16, fan=2)
    check(whiten.whitened(points, model).collect(), rows)


def test_low_rank_few_rows_and_nothing(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 9))
    rows = [(i, v) for i, v in enumerate((np.round(flat[:, :1] * 8) / 8 * [1, 0, 2, 0, 0, 0, 0, 0, 0]).tolist())]
    check(whiten.whiten(table(spark, rows)).collect(), rows)
    few = [(i, rng.normal(size=9).tolist()) for i in range(4)]
    check(whiten.whiten(table(spark, few)).collect(), few)
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whiten.whiten(table(spark, [])).collect() == []
    assert whiten.whiten(table(spark, [(1, None)])).collect() == []


def test_large_entries_stay_exact():
    sums = [3 * 2**50 + 1, -5]
    centre = whiten.Centre(3, sums)
    x = np.array([[2**50, -1], [2**50 + 40, -2]])
    want = [sum((3 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    assert centre.deviation(x) == want
    assert centre.deviation(np.array([[-(2**52), 0]])) == [None]


def test_query_meets_its_contract(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, SMALL).collect(), rows)
