"""Personal data next to plain scans of the same patterns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from citeweave.llm import pii
from citeweave.llm.queries import QUERIES
from tests.conftest import SMALL

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in digits[::-1]]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def brute(text):
    spans = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), k, m.end(), kind))
    return sorted(spans)


def row_of(text):
    spans = brute(text)
    written = ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in spans)
    return tuple(sum(s[3] == k for s in spans) for k in PLAIN) + (hashlib.sha256(written.encode()).hexdigest(),)


def noisy(rng):
    parts = ["a@b.c", "x@y.z_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "00012.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0123", "+12", "+1 23456789012345678", "é", "😀", " ", "\n", "@", ".", "-", "9" * 15, "a" * 5, "%+", "..", "@-.-", "mail me at ", "phone 555 123 4567"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    return [None, "", "a" * 60000, "7" * 30000, "+1" + " " * 30000, "x@" * 3000, *(noisy(rng) for _ in range(400))]


def test_base_spans_are_those_of_plain_scans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:6]) + (r["base_sha256"],) for r in pii.report(docs, pii.Trees([])).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()}
    got = {k: v[:4] + v[-1:] for k, v in got.items()}
    assert got == {i: row_of(t) for i, t in enumerate(texts)}


def test_query_keeps_base_spans_and_counts_every_document(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_pii"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == row_of(docs[r["doc_id"]])
        base = {f"{kind}:{a}:{z}" for a, _, z, kind in brute(docs[r["doc_id"]])}
        assert base <= set(r["spans"].split(","))


def test_redaction_replaces_spans_and_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "é me@a.bc, +1 (555) 555-0123!", 5, "q"), (None, None, None, None), (1, "é me@a.bc, +1 (555) 555-0123!", 5, "q"), (2, "", 1, None)], "doc_id long, text string, _base int, start string")
    trees = pii.train(docs)
    rows = [tuple(r) for r in pii.redact(docs, trees).collect()]
    assert sorted(rows, key=repr) == sorted([(1, "é [email], [phone]!", 5, "q"), (None, None, None, None), (1, "é [email], [phone]!", 5, "q"), (2, "", 1, None)], key=repr)


def test_trees_learn_and_calibrate():
    base = dict.fromkeys(pii.RANGES, 0)
    cells = [base | {"plus": 1, "yes": 90, "no": 2, "held_yes": 30, "held_no": 0}, base | {"plus": 0, "yes": 3, "no": 200, "held_yes": 1, "held_no": 60}]
    trees = pii.Trees(cells)
    assert trees.trees and trees.threshold > trees.bias
    assert pii.Trees([]).trees == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(docs, pii.train(docs)).count() == 0
    assert pii.report(docs, pii.Trees([])).where(F.col("spans") != "").count() == 0


def test_clashing_names_come_back_as_they_were(spark):
    text = "write to a.b@c.org or +49 170 1234567"
    docs = spark.createDataFrame([(1, text, "x", 7, None, "s")], "doc_id long, text string, _pii string, _pii_ int, _SPANS string, _citeweave_base string")
    out = pii.redact(docs, pii.train(docs))
    row = out.first()
    assert out.columns == docs.columns and tuple(row)[2:] == ("x", 7, None, "s") and row["text"] == "write to [email] or [phone]"
    assert len(pii.report(docs, pii.train(docs)).first()["spans"].split(",")) == 2
