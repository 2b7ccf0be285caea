"""The pipeline next to its stages spelled out by hand."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from citeweave.llm import pii, quality
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components, brute_contamination
from tests.llm.test_pii import brute


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def redacted(text):
    out, at = [], 0
    for start, _, end, kind in brute(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_every_stage_does_its_work_on_what_the_last_one_kept(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stats = quality.vectors(documents)
    good = {r["doc_id"] for r in quality.score(stats, quality.fit(stats, labels)).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if r["doc_id"] in good]
    assert 0 < len(rows) < documents.count()
    first = brute_components(rows)
    rows = [(d, t) for d, t in rows if first[d][2]]
    found = brute_contamination(rows, items)
    rows = [(d, t) for d, t in rows if not found[d][0][4]]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in rows:
        ids = plain.encode(redacted(t), add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in corpus_pipeline.run(spark, SMALL).collect()} == want


def test_stages_keep_the_columns_and_take_odd_rows(spark, documents):
    odd = documents.limit(5).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], documents.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SMALL)
        assert out.columns == documents.columns, name
        assert out.count() <= odd.count()
        assert stage(spark, odd.limit(0), SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SMALL).count() == odd.count()
    assert pii.redact(odd, pii.train(odd)).count() == odd.count()
