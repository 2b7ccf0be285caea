"""Repeated byte strings by prefix-free parsing.

A hash of the ``WINDOW`` = 8 bytes at hand, rolled along the text, triggers a phrase border where it is smaller than at all ``REACH`` places on either
side. A phrase runs from the trigger's neighbourhood to the next one's, overlapping it, so that no phrase is a prefix of another and
a border shows wherever its neighbourhood occurs; where triggers lie too far apart, denser ones of a shorter reach
stand in. Distinct phrases with what follows them are the dictionary, the sequence of phrases in a text is the parse.

A suffix of the corpus is a suffix of a dictionary phrase followed by a suffix of the parse, and corpus order is the
order of such pairs. Whether a string of ``LENGTH`` bytes starts twice needs no more of that order than which suffixes
share their first ``LENGTH`` bytes, that is, which are neighbours in it. The pairs are therefore named by fingerprints
(phrase border, suffix cut at ``LENGTH`` bytes) and sorted by Spark by those names, which puts equal prefixes side by
side as lexicographic order does; text that repeats is represented once per dictionary entry, however often it occurs.

Defined results: a null or empty text has no bytes and keeps none; matches never cross documents, within a document
they count; repeated rows repeat each other's strings; rows with a null ``doc_id`` take part like others; rows that
share a ``doc_id`` are told apart by their texts. Removed bytes may leave parts of characters, so kept text is bytes.
Other columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from .arrays import flat, slices

LENGTH = 200
WINDOW = 8
REACH = (24, 6, 2)


def _least_after(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of the next ``reach`` values at each place (nothing beyond the end)."""
    n = len(values)
    least = np.full(n + reach + 1, ~np.uint32(0))
    least[:n] = values
    size = 1
    while size * 2 <= reach:
        np.minimum(least[:-size], least[size:], out=least[:-size])
        size *= 2
    return np.minimum(least[1 : n + 1], least[1 + reach - size : n + 1 + reach - size])


def _triggers(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Places whose hash is smaller than all others within reach on either side."""
    return np.flatnonzero((hashes < _least_after(hashes, reach)) & (hashes < _least_after(hashes[::-1], reach)[::-1]))


def parse(column: pa.Array) -> repeats.Parsed:
    """Bytes as units, and trigger borders at two densities."""
    data, offsets = flat(column)
    n = len(data)
    hashes = np.zeros(0, np.uint32)
    if n >= WINDOW:
        # The eight bytes from each place on as one number, multiplied; the upper half is the hash.
        eight = np.ndarray(n - WINDOW + 1, np.uint64, np.ascontiguousarray(data), strides=(1,))
        hashes = ((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    levels = []
    for reach in REACH:
        borders = _triggers(hashes, reach)
        doc = np.searchsorted(offsets, borders, "right") - 1
        whole = (borders - reach >= offsets[doc]) & (borders + reach + WINDOW <= offsets[doc + 1])
        borders = borders[whole]
        levels.append(repeats.Level(borders, borders - reach, borders + reach + WINDOW))
    return repeats.Parsed(offsets, data, levels)


def _digest(data: np.ndarray, removed: np.ndarray) -> tuple[int, int, int, str]:
    kept = data[~removed].tobytes()
    spans = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
    return len(data), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()


def removed_bytes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, spans (start, end of removed runs of bytes), n_bytes, n_removed, n_spans, kept_sha256 of the documents (key, text) that lose bytes or may."""
    rows = repeats.repeated_windows(documents, parse, length, "count")

    def run(batches):
        for batch in repeats._texts(batches):
            parsed, removed = repeats.marks(batch, parse, length, "count")
            out = [_digest(parsed.units[a:z], removed[a:z]) for a, z in zip(parsed.place[:-1], parsed.place[1:])]
            spans = []
            for a, z in zip(parsed.place[:-1], parsed.place[1:]):
                edge = np.diff(np.concatenate(([0], removed[a:z].astype(np.int8), [0])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind), *(pa.array(list(c)) for c in zip(*out))], ["key", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "key long, spans array<struct<start:int,end:int>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a key: the id where ids are distinct, else a fingerprint of id and text."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
    clash = ids.where("doc_id is null").limit(1).count() + ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    key = F.xxhash64("doc_id", "text") if clash else F.col("doc_id")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", key)


def dedup_bytes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows = keyed(documents)
    found = removed_bytes(rows, length).where("n_removed > 0").drop("spans").dropDuplicates(["key"])

    def whole(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            out = [(int(z - a), hashlib.sha256(data[a:z].tobytes()).hexdigest()) for a, z in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out])], ["doc_id", "key", "size", "digest"])

    return rows.select("doc_id", "key", "text").mapInArrow(whole, "doc_id long, key long, size long, digest string").join(found, "key", "left").select(
        "doc_id", F.col("size").alias("n_bytes"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "digest").alias("kept_sha256")
    )
