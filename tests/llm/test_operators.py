"""The operators next to brute force, with nulls, empty and very long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeweave.llm import arrays, bpe, decontaminate, graph, licenses, near, packing, quality, recompress, suffixes, topk
from citeweave.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from verify import connect, rows

WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", " \n\t", "one", "One two", "a" * 30000, "x " * 3000, "é ́ \x1c\x85 ñandú 日本語 😀", "<|endoftext|> <|start", "a\x00b", "don't we'll"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, edited copies of one base in large number, a passage in many texts, runs, odd texts, repeated rows."""
    rng = random.Random(5)
    texts = list(ODD)
    base, passage = prose(rng, 150).split(), prose(rng, 70)
    for i in range(60):
        edited = list(base)
        for _ in range(rng.randrange(0, 14)):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    for i in range(40):
        texts.append(f"{prose(rng, rng.randrange(0, 90))} {passage}\n{prose(rng, rng.randrange(0, 90))}")
    texts += [prose(rng, 120)] * 5 + [prose(rng, rng.randrange(1, 300)) for _ in range(60)] + ["go " * 130, "Go " * 90, "ab" * 400, "ab" * 300]
    found = list(enumerate(texts))
    return found + found[20:24]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("n", F.lit(None).cast("int")).repartition(7)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, key string")


def grouped(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r[0]].append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("key", sorted(set(QUERIES) & set(ORACLE)))
def test_query_matches_its_sql(spark, key):
    df = QUERIES[key](spark, SMALL)
    cursor = connect(SMALL).execute(ORACLE[key])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_ranges_have_equal_fingerprints_only_where_equal():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    r = arrays.Rolling(1).load(data)
    got = r.ranges(np.array([0, 3, 6]), np.array([3, 6, 9]))
    assert got[0] == got[1] != got[2]


def thue_morse(order, a="a", b="b"):
    """A word of 2**order letters and its complement: their sums agree modulo 2**64 in every odd base from order 10 on."""
    bits = [0]
    for _ in range(order):
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("order", [9, 10, 12])
def test_fingerprints_of_words_that_sums_modulo_two_confuse(spark, order):
    one, two = thue_morse(order)
    data = np.frombuffer((one + two).encode(), np.uint8)
    for seed in range(10):
        got = arrays.Rolling(seed).load(data).ranges(np.array([0, len(one)]), np.array([len(one), len(data)]))
        assert got[0] != got[1]
    texts = [(1, one), (2, two), (3, f"{'go ' * 49}{one}"), (4, f"{'go ' * 49}{two}"), (5, " ".join(one)), (6, " ".join(two)), (7, f"x {' '.join(one)}")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    assert {r[0]: r[1] for r in bpe.encode(frame, path).collect()} == {d: plain.encode(t, add_special_tokens=False).ids for d, t in texts}
    assert {r[0]: tuple(r)[1:] for r in near.near_duplicates(frame).collect()} == brute_components(texts)
    assert grouped(recompress.dedup_words(frame)) == repeated_words(texts, 50)
    assert grouped(suffixes.dedup_bytes(frame)) == repeated_bytes(texts, 200)


# --- coding ---------------------------------------------------------------------------------------------------------


def test_coding_is_the_tokenizers(spark, docs, corpus):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    want = defaultdict(list)
    for d, t in corpus:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want[d].append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert grouped(bpe.digest(docs, path)) == {k: sorted(v) for k, v in want.items()}


def test_chunks_are_reused_and_joined(corpus):
    coder = bpe.Coder(public_tokenizers.path("word_bpe_49k.json"))
    text = prose(random.Random(1), 4000)
    (first, _), (second, _) = coder.batch(pa.array([text, "odd start " + text]))
    before = len(coder.chunks)
    coder.batch(pa.array(["another start " + text]))
    assert len(coder.chunks) <= before + 2 and second[-len(first) :].tolist() == first.tolist()


def test_coding_of_no_rows(spark, nothing):
    assert bpe.encode(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing_loses_nothing(spark, docs, corpus):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    distinct = docs.dropDuplicates(["doc_id"])
    packed = packing.pack_documents(distinct, path, row=64, pool_tokens=5000)
    for r in packed.collect():
        cu, positions = r["cu_seqlens"], np.frombuffer(r["position_ids"], np.uint16)
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64 == len(positions) and len(np.frombuffer(r["input_ids"], np.uint16)) == 64
        assert all(positions[a] == 0 and positions[z - 1] == z - a - 1 for a, z in zip(cu, cu[1:])) and len(r["doc_ids"]) == len(cu) - 1
    assert {r[0]: r[1] for r in packing.unpack(packed, path).collect()} == {d: t or "" for d, t in corpus}


def test_best_fit_decreasing_is_that_of_a_plain_search():
    rng = random.Random(2)
    for _ in range(50):
        lengths = np.array([rng.randrange(1, 33) for _ in range(rng.randrange(1, 80))])
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(32 - n)
        row_of, n = packing.pack(lengths, 32)
        used = np.bincount(row_of, lengths, n)
        assert n == len(free) and sorted(used) == sorted(32 - f for f in free)


# --- repeats --------------------------------------------------------------------------------------------------------


def repeated_bytes(corpus, length):
    seen = Counter(b[i : i + length] for _, t in corpus for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = defaultdict(list)
    for d, t in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d].append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_repeated_bytes(docs, corpus):
    assert grouped(suffixes.dedup_bytes(docs)) == repeated_bytes(corpus, 200)


def test_repeated_bytes_with_distinct_and_null_ids(spark, corpus):
    some = corpus[:110] + [(None, corpus[50][1]), (3, "other text " * 30)]
    frame = spark.createDataFrame(some, "doc_id long, text string")
    assert grouped(suffixes.dedup_bytes(frame)) == repeated_bytes(some, 200)


def repeated_words(corpus, length):
    first = {}
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in corpus]
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(d, first.get(k, d))
    out = defaultdict(list)
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d].append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_repeated_passages(docs, corpus):
    assert grouped(recompress.dedup_words(docs)) == repeated_words(corpus, 50)


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(19)
    p, tail, other = prose(rng, 60), prose(rng, 9), prose(rng, 70)
    some = [(5, p), (7, f"{p} {tail}"), (7, other), (7, f"x {p} y {p}"), (9, other), (9, f"{other} {tail}"), (9, f"{p} {other}"), (None, p), (None, other), (5, p), (9, other), (3, tail)]
    some += [(d, prose(rng, 40) + f" {q} " + prose(rng, 10)) for q in (prose(rng, 120), prose(rng, 55)) for d in (20, 20, 20, 21, 22, 22)]
    want = repeated_words([r for r in some if r[0] is not None], 50) | {None: sorted((len(t.split()), 0, hashlib.sha256(t.encode()).hexdigest()) for d, t in some if d is None)}
    assert grouped(recompress.dedup_words(spark.createDataFrame(some, "doc_id long, text string"))) == want


def test_passages_at_either_end_of_documents(spark):
    rng = random.Random(23)
    some = []
    for i in range(0, 400, 4):
        p = prose(rng, rng.randrange(50, 58))
        a, b = prose(rng, rng.randrange(0, 4)), prose(rng, rng.randrange(0, 4))
        some += [(i, f"{a} {p} {b}"), (i + 1, f"{p} {prose(rng, 2)}"), (i + 2, f"{prose(rng, 2)} {p}"), (i + 3, p)]
    assert grouped(recompress.dedup_words(spark.createDataFrame(some, "doc_id long, text string"))) == repeated_words(some, 50)
    texts = [(d, t) for d, t in some]
    assert grouped(suffixes.dedup_bytes(spark.createDataFrame(texts, "doc_id long, text string"))) == repeated_bytes(texts, 200)


def test_passages_within_one_document_stay(spark):
    rng = random.Random(9)
    p, q = prose(rng, 60), prose(rng, 80)
    some = [(7, f"{p} x {q} y {p}"), (9, f"{q} {p} z {p}"), (11, f"{p} x {p}")]
    assert grouped(recompress.dedup_words(spark.createDataFrame(some, "doc_id long, text string"))) == repeated_words(some, 50)


@pytest.mark.parametrize("seed", range(40))
def test_borders_inside_equal_passages_are_equal(seed):
    rng = random.Random(seed)
    middle = prose(rng, 300)
    parsed = recompress.parse(pa.array([f"{prose(rng, 40)} {middle} {prose(rng, 30)}", f"{middle} tail", middle]))
    for level in parsed.levels:
        inside = []
        for a, z in ((40, 340), (370, 670), (671, 971)):
            mine = (level.low >= a) & (level.high <= z)
            inside.append([(int(x - a), int(lo - a), int(hi - a)) for x, lo, hi in zip(level.at[mine], level.low[mine], level.high[mine])])
        assert inside[0] == inside[1] == inside[2] and inside[0]


def test_repeats_of_no_rows(nothing):
    assert suffixes.dedup_bytes(nothing).count() == 0 and recompress.dedup_words(nothing).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------


def brute_components(corpus):
    sets = {}
    for d, t in corpus:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}).encode())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {d: (len(s), find(d), d == find(d)) for d, s in sets.items()}


def test_near_duplicates(docs, corpus):
    got = {r[0]: tuple(r)[1:] for r in near.near_duplicates(docs).collect()}
    assert got == brute_components(corpus)


def test_first_of_each_component_stays(spark, docs, corpus):
    want = Counter(d for d, _ in corpus if brute_components(corpus)[d][2])
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns and Counter(r[0] for r in kept.select("doc_id").collect()) == want


def test_null_ids_and_two_texts_of_one_id(spark):
    rng = random.Random(4)
    p, q = prose(rng, 40), prose(rng, 40)
    rows_ = [(None, p), (5, p), (5, q), (8, q), (None, None), (9, "")]
    got = grouped(near.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")))
    assert got == {None: [(0, None, True), (36, None, True)], 5: [(36, 5, True)] * 2, 8: [(36, 5, False)], 9: [(0, 9, True)]}


def test_texts_of_one_id_keep_their_links(spark):
    rng = random.Random(14)
    x, y = prose(rng, 40), prose(rng, 40)
    rows_ = [(5, x), (5, y), (8, f"{y} k"), (9, f"{x} k"), (3, prose(rng, 40)), (4, f"{y} l"), (4, x + " m"), (4, ""), (2, None)]
    got = grouped(near.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")))
    assert got == {5: [(36, 4, False)] * 2, 8: [(37, 4, False)], 9: [(37, 4, False)], 3: [(36, 3, True)], 4: [(0, 4, True), (37, 4, True), (37, 4, True)], 2: [(0, 2, True)]}


def test_near_duplicates_of_no_rows(nothing):
    assert near.near_duplicates(nothing).count() == 0


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300, 300), (5, 3), (3, 5)]
    got = {r[0]: r[1] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 260)}, 7: 7, 5: 3, 3: 3}


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_contamination(corpus, items, window=13):
    def split(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}).encode())

    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = defaultdict(list)
    for d, t in corpus:
        w = split(t)
        hit, named = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        out[d].append((len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return {k: sorted(v) for k, v in out.items()}


def test_contamination(spark, docs, corpus):
    items = [(1, corpus[80][1]), (2, "One two"), (3, None), (10, "..."), (11, " ".join(corpus[20][1].split()[5:30])), (12, corpus[80][1]), (12, corpus[80][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(corpus, items)
    assert grouped(decontaminate.contamination(decontaminate.scan(docs, benchmark))) == want
    blocks = grouped(decontaminate.contamination(decontaminate.scan(docs.dropDuplicates(["doc_id"]), benchmark, block_words=300)))
    assert blocks == {k: v[:1] for k, v in want.items()}
    docs = docs.withColumnsRenamed({"n": "key_"}).withColumn("hit_spans", F.lit(1)).withColumn("_n_words_0_decontaminate", F.lit("x"))
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and Counter(r[0] for r in kept.select("doc_id").collect()) == Counter(d for d, _ in corpus if not want[d][0][4])
    several = decontaminate.clean(docs, benchmark, block_words=300)
    assert several.columns == docs.columns and Counter(map(repr, several.collect())) == Counter(map(repr, kept.collect()))


def test_several_blocks_keep_rows_of_null_and_repeated_ids_apart(spark, corpus):
    items = [(i, corpus[k][1]) for i, k in enumerate((20, 80, 81, 82, 83, 115))]
    some = corpus + [(None, corpus[80][1]), (None, corpus[81][1]), (None, None), (80, corpus[115][1]), (80, "clean"), (81, corpus[82][1] + " " + corpus[20][1])]
    frame, benchmark = spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate._count_blocks(decontaminate._items(benchmark), 300) > 3
    assert grouped(decontaminate.contamination(decontaminate.scan(frame, benchmark, block_words=300))) == brute_contamination(some, items)
    one, several = decontaminate.scan(frame, benchmark), decontaminate.scan(frame, benchmark, block_words=300)
    assert one.schema == several.schema and Counter(map(repr, one.collect())) == Counter(map(repr, several.collect()))


def test_spans_are_removed():
    assert decontaminate.without_spans("A, b c! d", [(1, 3)]) == "A, ! d" and decontaminate.without_spans(None, [(0, 1)]) is None


def test_contamination_of_no_rows(spark, nothing, docs):
    empty = nothing.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.scan(nothing, empty).count() == 0 and decontaminate.clean(docs, empty).count() == docs.count()


# --- quality ----------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    directory = SMALL.replace("0.001", "0.01")
    marks = spark.read.parquet(f"{directory}/labels.parquet")
    rows_ = QUERIES["op7_quality"](spark, directory).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows_]) >= 0.95
    assert np.mean([r["predicted"] for r in rows_ if r["quality"] == 1]) >= 0.97


def test_scores_do_not_depend_on_other_columns(spark, docs):
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(11, 90)] + [(None, 1, 0), (12, None, 0), (13, 5, 0)], "doc_id long, quality int, toxic int")
    stats = quality.vectors(docs)
    model = quality.fit(stats, labels)
    scores = grouped(quality.score(stats, model).select("doc_id", "score", "predicted"))
    assert len(scores) == docs.select("doc_id").distinct().count() and all(0 <= s <= 1 and p == (s >= 0.7) for v in scores.values() for s, p in v)
    kept = quality.keep_good(docs.withColumn("_quality_score", F.lit(1)), model)
    assert kept.columns == [*docs.columns, "_quality_score"] and kept.count() == sum(p for v in scores.values() for _, p in v)


def test_one_class_and_no_labels(spark, docs, nothing):
    for rows_ in ([], [(20, 1), (21, 1)]):
        model = quality.train(docs, spark.createDataFrame(rows_, "doc_id long, quality int"))
        assert quality.score(quality.vectors(docs), model).where("score is null").count() == 0
    assert quality.score(quality.vectors(nothing), model).count() == 0
    assert np.isfinite(quality.statistics(pa.array(ODD))).all()


# --- licences -----------------------------------------------------------------------------------------------------------


def test_licence_lines(spark):
    texts = ["Text.\n RELEASED   under the MIT license!\nmore", "Permission is hereby granted", None, "", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "mit license " * 5000]
    rows_ = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license"] for r in rows_] == ["MIT", None, None, None, "CC-BY-NC-4.0", None]
    assert [r["n_matches"] for r in rows_] == [1, 0, 0, 0, 3, 0] and rows_[0]["dice"] == 1.0


def test_a_notice_with_a_word_changed_matches_by_dice(spark):
    text = "This work is licensed under the GNU General Public License, version two"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    mine, other = set(licenses.bigrams_of(text)), set(licenses.bigrams_of(licenses.TEMPLATES["GPL-3.0"][0]))
    assert row["license"] == "GPL-3.0" and row["dice"] == round(2 * len(mine & other) / (len(mine) + len(other)), 9)


def test_wrapped_embedded_and_full_licences(spark):
    full = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "texts").glob("*.txt")}
    cases = [
        ("MIT", "# Copyright\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction\nx = 1\n" + "y = f(x)\n" * 40),
        ("MIT", "This project is licensed under the MIT License. Copyright (c) 2020 ACME Corp."),
        ("Apache-2.0", 'Copyright 2020 The Authors. Licensed under the Apache License, Version 2.0 (the "License");'),
        ("MIT", "Some words before. Released under\nthe MIT\nLicense. " + prose(random.Random(1), 2000)),
        ("GPL-2.0", "A tool. It is licensed under the GNU General Public License, version 2. See below."),
        *((n, f"Copyright (c) 2020 ACME\n\n{t}") for n, t in full.items()),
        *((n, f"{prose(random.Random(2), 700)}\n{' '.join(full[n].split())} {prose(random.Random(3), 700)}") for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")),
        (None, "Permission is hereby granted to the mit of the license. " + prose(random.Random(4), 500)),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["license"], r["n_matches"]) for r in got] == [(n, 1 if n else 0) for n, _ in cases]


def test_windows_apart_count_each_and_lines_are_not_counted_again(spark):
    text = "We say: released under the MIT License. " + prose(random.Random(5), 30) + " Here: released under the MIT\nLicense, and there: licensed under CC BY 4.0, as said.\nLicensed under CC BY-NC 4.0.\nend"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_matches"], row["licenses"]) == (4, "CC-BY-4.0,CC-BY-NC-4.0,MIT")


# --- top k -------------------------------------------------------------------------------------------------------------


def test_top_k_with_ties_odd_vectors_and_many_tiles(spark):
    rng = random.Random(8)
    vectors = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [math.nan, 0.0, 0.0, 0.0]), (1003, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1004, [1.0, 2.0]), (1050, [])]
    again = [*vectors[:5], (100, vectors[7][1]), (50, vectors[3][1])]
    frame = spark.createDataFrame(vectors + odd + again, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("key", F.lit("x"))
    points = topk.prepare(frame).cache()
    got = sorted(map(tuple, topk.search(points, points.where("id % 50 = 0"), 5, group=40, block=3, buckets=16).collect()))
    want = []
    floored = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors + again]
    for at, (q, mine) in enumerate(floored):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for j, (i, v) in enumerate(floored) if j != at)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_fewer_candidates_than_k_and_no_rows(spark):
    points = topk.prepare(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in topk.search(points, points.where("id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    none = points.where("false")
    assert topk.search(none, none, 5).count() == 0
