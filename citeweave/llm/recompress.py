"""Repeated word passages by recompression.

Words get names; then rounds rename the whole corpus alike. In every fourth round, each run of one symbol becomes one symbol named by the symbol and the run's length; in every round the names are split in two halves by one bit of a hash that changes with the round, and
every pair of a left and a right symbol becomes one symbol named by both. Names are fingerprints of what they
stand for, so all tasks give the same name to the same thing without asking each other. A border between symbols that
survives a round does so because of the symbols beside it alone; each border therefore carries the stretch of words that
it has depended on so far, and within any occurrence of that stretch the same border stands: equal passages have equal
symbols inside.

Borders of a high level are anchors: those whose stretches occur in several documents reveal long repeats, which are then verified
window by window (see ``repeats``). Windows without such a border inside use a lower level, windows without any (long
runs of a word) stand for themselves.

Defined results: a null or empty text has no words and keeps none; a passage is kept in the document with the smallest
id that has it, so repeats within one document stay, and so do passages of rows that share a ``doc_id``; rows with a null
``doc_id`` take no part and are kept whole. Rows that share a ``doc_id`` are judged each by its own text against the rows of
smaller ids. Other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from .arrays import Rolling, flat, mix, per_document, slices, words

LENGTH = 50
ROUNDS = 7
#: Runs are named in every so many rounds; pairs of equal symbols wait until then.
RUN_EVERY = 4
#: Rounds after which borders serve as anchors, best first.
LEVELS = (7, 4, 2, 1)

_FAR = 1 << 60
ROUND_SALT = mix(np.arange(1, 65, dtype=np.uint64))


def rounds(names: np.ndarray, place: np.ndarray, n_rounds: int = ROUNDS):
    """After each round: the borders (word indexes), and the stretch [low, high) that each depends on. Borders of documents depend on what lies outside."""
    n = len(names)
    at = np.arange(n)
    fixed = np.zeros(n, bool)
    fixed[place[:-1][place[:-1] < n]] = True
    # Where a document begins, its first word stands for itself, as it does inside a longer text.
    low, high = at.copy(), at.copy()
    for r in range(n_rounds):
        if not len(names):
            break
        if r % RUN_EVERY == 0:
            # A border stands between different symbols: it depends on both.
            new = fixed.copy()
            new[1:] |= names[1:] != names[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(names)))
            names = np.where(count > 1, mix(names[first] * np.uint64(3) + count.astype(np.uint64)), names[first])
            low, high = np.minimum(low, np.append(-_FAR, low[:-1])), np.maximum(high, np.append(high[1:], _FAR if r else n))
            at, low, high, fixed = at[new], low[new], high[new], fixed[new]
            high[fixed] = _FAR
        right = (mix(names + ROUND_SALT[r]) >> np.uint64(63)).astype(bool)
        gone = ~np.append(True, right[:-1]) & right & ~fixed
        # Before a left symbol a border always stands; before a right one that depends on the symbol to the left, too.
        low, high = np.where(right, np.minimum(low, np.append(-_FAR, low[:-1])), low), np.maximum(high, np.append(high[1:], _FAR))
        absorbs = np.append(gone[1:], False)
        names = np.where(absorbs, mix(names * np.uint64(5) + mix(np.append(names[1:], np.uint64(0)) + np.uint64(7))), names)
        stays = ~gone
        names, at, low, high, fixed = names[stays], at[stays], low[stays], high[stays], fixed[stays]
        yield at, low, high, fixed


def parse(column: pa.Array) -> repeats.Parsed:
    """Words as units, and the borders of several rounds."""
    data, offsets = flat(column)
    starts, ends, doc = words(data, offsets)
    place = per_document(doc, len(offsets) - 1)
    prints = Rolling(1).load(data).ranges(starts, ends)
    found = {}
    for r, (at, low, high, _) in enumerate(rounds(prints, place), 1):
        if r in LEVELS:
            owner = np.searchsorted(place, at, "right") - 1
            inside = (low >= place[owner]) & (high <= place[owner + 1])
            found[r] = repeats.Level(at[inside], low[inside], high[inside])
    none = np.zeros(0, np.int64)
    # Names of words are compared in place of the words: a second name, independent of the first, makes 122 bits.
    return repeats.Parsed(place, prints, [found.get(r, repeats.Level(none, none, none)) for r in LEVELS], lambda: Rolling(3).load(data).ranges(starts, ends))


def _kept(column: pa.Array, removed: np.ndarray | None) -> list[tuple[int, int, bytes]]:
    """Of each text: number of words, of removed ones, and the kept ones joined by a space."""
    data, offsets = flat(column)
    starts, ends, doc = words(data, offsets)
    place, raw = per_document(doc, len(offsets) - 1), data.tobytes()
    out = []
    for a, z in zip(place[:-1].tolist(), place[1:].tolist()):
        if removed is None:
            kept = raw[starts[a] : ends[z - 1]].split() if z > a else []
        else:
            kept = [raw[starts[i] : ends[i]] for i in a + np.flatnonzero(~removed[a:z])]
        out.append((z - a, z - a - len(kept), b" ".join(kept)))
    return out


def _rows(batch: pa.RecordBatch, names: list[str], out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string())]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "n_words", "n_removed", "kept_sha256"])


def dedup_words(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several = rows.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).count() > 0
    if several:  # rows are told apart by their texts, and compared by their ids
        rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
        plain = rows.where("doc_id is not null").select("key", F.col("doc_id").alias("rank"), "text").dropDuplicates(["key"])
    else:
        rows = rows.withColumn("key", F.col("doc_id"))
        plain = rows.where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")
    found = repeats.repeated_windows(plain, parse, length, "first")

    def cut(batches):
        for batch in repeats._texts(batches):
            _, removed = repeats.marks(batch, parse, length, "first")
            yield _rows(batch, ["key"], _kept(batch.column("text"), removed))

    def uncut(batches):
        for batch in slices(batches):
            yield _rows(batch, ["doc_id", "key"], _kept(batch.column("text"), None))

    lost = found.mapInArrow(cut, "key long, n_words long, n_removed long, kept_sha256 string").where("n_removed > 0")
    lost = lost.select("key", F.col("n_removed").alias("lost"), F.col("kept_sha256").alias("rest"))
    base = rows.mapInArrow(uncut, "doc_id long, key long, n_words long, n_removed long, kept_sha256 string")
    return base.join(lost, "key", "left").select("doc_id", "n_words", F.coalesce("lost", "n_removed").alias("n_removed"), F.coalesce("rest", "kept_sha256").alias("kept_sha256"))
