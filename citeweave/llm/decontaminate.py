"""Benchmark decontamination: runs of benchmark words that occur in training documents.

The windows of the benchmark items (13 words; the whole item where it has fewer) become a set of fingerprints that
every task gets as a broadcast; a document's words are numbered by the benchmark's vocabulary, its windows are looked
up in the set, and each hit is compared word by word before it counts.

The benchmark side is bounded: its distinct items are measured first and, where they exceed ``block_words`` bytes, dealt
into blocks of about half that size by a hash. Blocks are collected, broadcast and dropped one after the other; each pass
over the texts writes its hits by row, and the hits of a row are united at the end.

Defined results: a null or empty text has no words and is clean; null items and items without words give no window;
repeated items and repeated documents each count for themselves by row, equal ``item_id`` counts once; a null
``doc_id`` or ``item_id`` stays null (a null ``item_id`` is left out of the list of items). Columns beside the id
and the text are ignored by ``scan`` and carried through by ``clean``, whatever their names."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .arrays import LOWER, Rolling, flat, per_document, slices, words

WINDOW = 13
#: Most words of benchmark items in one broadcast.
BLOCK_WORDS = 2_000_000

#: Everything that is not a digit, an ASCII letter or part of a longer UTF-8 sequence parts words.
BREAK = np.ones(256, bool)
BREAK[ord("0") : ord("9") + 1] = BREAK[ord("A") : ord("Z") + 1] = BREAK[ord("a") : ord("z") + 1] = BREAK[128:] = False

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SCANNED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
)


def _item_words(text: str | None) -> list[bytes]:
    data, offsets = flat(pa.array([text], pa.string()))
    data = LOWER[data]
    starts, ends, _ = words(data, offsets, BREAK)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


class WindowSet:
    """The windows of some items: fingerprints by length, and for each the words and the items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in _item_words(text)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.tables = []
        for n, windows in sorted(by_length.items()):
            keys = np.array(list(windows), np.int64)
            prints = self.prints(keys.reshape(-1), np.arange(0, keys.size, n), n)
            order = np.argsort(prints, kind="stable")
            self.tables.append((n, prints[order], keys[order], [tuple(sorted(s)) for s in np.array(list(windows.values()), object)[order]]))

    @staticmethod
    def prints(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        return Rolling(13).load(ids.astype(np.uint64) + np.uint64(1)).ranges(starts, starts + n)

    def occurrences(self, ids: np.ndarray, last: np.ndarray):
        """Of words given as numbers (-1: not in any item), with each one's end of document: start, length and items of the windows."""
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n, prints, keys, items in self.tables:
            if len(ids) < n:
                continue
            at = np.arange(len(ids) - n + 1)
            at = at[(known[at + n] - known[at] == n) & (at + n <= last[at])]
            if not len(at):
                continue
            found = self.prints(ids, at, n)
            place = np.searchsorted(prints, found)
            for i, p in zip(at, place):
                while p < len(prints) and prints[p] == found[np.searchsorted(at, i)]:
                    if (keys[p] == ids[i : i + n]).all():
                        yield int(i), n, items[p]
                        break
                    p += 1


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("item is not null and body is not null").distinct()


def _count_blocks(items: DataFrame, block_words: int) -> int:
    """How many blocks the items need, a word having one byte at least."""
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return 1 if size <= block_words else -(-2 * size // block_words)


def _block(items: DataFrame, n: int, b: int) -> list[tuple[str, str]]:
    part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == b)
    return [(r["item"], r["body"]) for r in part.collect()]


def _scan_block(documents: DataFrame, shared, key: str) -> DataFrame:
    """The key, n_words, hit_spans and items of every row, for the windows of one broadcast block."""

    def run(batches):
        table = shared.value
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            data = LOWER[data]
            starts, ends, doc = words(data, offsets, BREAK)
            raw = data.tobytes()
            ids = np.fromiter((table.number.get(raw[s:e], -1) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
            place = per_document(doc, batch.num_rows)
            spans: dict[int, list] = {}
            names_of: dict[int, set] = {}
            for i, n, found in table.occurrences(ids, place[doc + 1]):
                d = int(doc[i])
                spans.setdefault(d, []).append((i, i + n))
                names_of.setdefault(d, set()).update(found)
            out_spans = [[{"start": a - int(place[d]), "end": z - int(place[d])} for a, z in _joined(spans.get(d, ()))] for d in range(batch.num_rows)]
            span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(key), pa.array(np.diff(place), pa.int64()), pa.array(out_spans, span_type), pa.array([sorted(names_of.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [key, *SCANNED.names[1:]])

    return documents.select(key, "text").mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), *SCANNED.fields[1:]]))


def _joined(spans) -> list[list[int]]:
    """Spans united where they touch, in order."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return out


def _united(batches):
    """Rows of key, n_words, several lists of spans and of items: one list of each."""
    for batch in batches:
        spans = [[{"start": a, "end": z} for a, z in _joined((s["start"], s["end"]) for s in row)] for row in batch.column("hit_spans").to_pylist()]
        items = [sorted(set(row)) for row in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], ["key", *SCANNED.names[1:]])


def _hits(rows: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """key, n_words, hit_spans, items of every row (key, text), one block of the benchmark after the other."""
    spark, found = rows.sparkSession, None
    for b in range(n):
        shared = spark.sparkContext.broadcast(WindowSet(_block(items, n, b), window))
        part = _scan_block(rows, shared, "key")
        part = materialize(part if b == 0 else part.where(F.size("hit_spans") > 0), "decontaminate-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    together = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items"))
    return together.mapInArrow(_united, T.StructType([T.StructField("key", T.LongType()), *SCANNED.fields[1:]]))


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, hit_spans (of words, end exclusive, joined), items."""
    rows, items = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _items(benchmark)
    n = _count_blocks(items, block_words)
    if n == 1:
        return _scan_block(rows, documents.sparkSession.sparkContext.broadcast(WindowSet(_block(items, 1, 0), window)), "doc_id")
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "decontaminate-rows")
    return rows.select("key", "doc_id").join(_hits(rows, items, n, window), "key").select(*SCANNED.names)


def contamination(scanned: DataFrame) -> DataFrame:
    """Counts and the verdict: at least a twentieth of the words hit."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return scanned.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    ).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the given runs of words; what stood between two removed runs stays."""
    if not text or not spans:
        return text
    data, offsets = flat(pa.array([text]))
    starts, ends, _ = words(LOWER[data], offsets, BREAK)
    raw, kept, at = text.encode(), [], 0
    for a, z in spans:
        kept.append(raw[at : starts[a]])
        at = int(ends[z - 1])
    return b"".join([*kept, raw[at:]]).decode()


def _is_contaminated() -> Column:
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return (hit > 0) & (20 * hit >= F.col("n_words"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of documents that are not contaminated, with their columns as they were."""
    items = _items(benchmark)
    n = _count_blocks(items, block_words)
    key = "key"
    while key in {c.lower() for c in documents.columns}:
        key += "_"
    if n == 1:
        shared = documents.sparkSession.sparkContext.broadcast(WindowSet(_block(items, 1, 0), window))
        return _kept(documents, shared)
    rows = materialize(documents.withColumn(key, F.monotonically_increasing_id()), "decontaminate-rows")
    bad = _hits(rows.select(F.col(key).alias("key"), "text"), items, n, window).where(_is_contaminated()).select(F.col("key").alias(key))
    return rows.join(bad, key, "left_anti").select(*documents.columns)


def _kept(documents: DataFrame, shared) -> DataFrame:
    """The rows that the windows of one broadcast block leave clean."""

    def run(batches):
        table = shared.value
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            data = LOWER[data]
            starts, ends, doc = words(data, offsets, BREAK)
            raw = data.tobytes()
            ids = np.fromiter((table.number.get(raw[s:e], -1) for s, e in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
            place = per_document(doc, batch.num_rows)
            edge = np.zeros(len(ids) + 1, np.int64)
            for i, n, _ in table.occurrences(ids, place[doc + 1]):
                edge[i] += 1
                edge[i + n] -= 1
            hit = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=batch.num_rows)
            yield batch.filter(pa.array((hit == 0) | (20 * hit < np.diff(place))))

    return documents.mapInArrow(run, documents.schema)
