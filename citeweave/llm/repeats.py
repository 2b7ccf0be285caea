"""Repeated windows of fixed length in a corpus of sequences, found from content-defined anchors.

The units of a document (bytes, words) are parsed into phrases whose borders depend on nearby units only. A border with
the stretch it depends on is an anchor; a window that holds the whole stretch sees the same anchor wherever the window
occurs. Each window belongs to the first anchor in it, so equal windows belong to equal anchors at equal distance:

1. ``anchors``: every anchor's name (a fingerprint of its stretch), and which of them occur more than once.
2. ``candidates``: the documents with shared anchors, each with the list of them; a window stays only if all anchors in
   it are shared. All later steps read these documents alone.
3. ``contexts``: an anchor with all windows that belong to it is one stretch of text, the dictionary entry. Equal
   entries are counted once: in copied text this settles every window without looking at any.
4. ``windows``: where one anchor has several entries - at the edges of repeats - the windows of one example of each
   entry are compared by fingerprint.

A window's identity is the pair of its anchor's name and its own fingerprint, 128 bits together. Texts travel
compressed. Groups by anchor name are aggregated before and after the shuffle; the windows of one name are dealt out by
distance from the anchor.

Two questions can be asked of equal windows: ``"count"`` - does it start anywhere else? - and ``"first"`` - does it start in
a document with a smaller id?"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .arrays import Rolling, mix, signed, slices

#: Windows of one anchor that travel together.
BLOCK = 16


@dataclass
class Level:
    """Anchors of one level in a slice: the border, and the stretch of units [low, high) that it depends on, sorted."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Parsed:
    """A slice of documents: where each document's units begin (n + 1 places), the units, and levels, best first. Where
    units are names, ``others`` gives them names that are independent of the first."""

    place: np.ndarray
    units: np.ndarray
    levels: list[Level]
    others: Callable[[], np.ndarray] | None = None


Parser = Callable[[pa.Array], Parsed]


class Owned:
    """Which anchor each window of a slice belongs to."""

    def __init__(self, parsed: Parsed, length: int):
        self.parsed, self.length = parsed, length
        place, n, best = parsed.place, len(parsed.units), parsed.levels[0]
        # Of the best level, each anchor has a run of windows: from behind the anchor before to its own stretch, inside its document.
        doc = np.searchsorted(place, best.low, "right") - 1
        behind = np.append(-1, best.low[:-1]) + 1 if len(best.low) else best.low
        #: First and last window of each anchor of the best level (none where the first lies behind the last).
        self.begin = np.maximum(np.maximum(behind, best.high - length), place[doc])
        self.end = np.minimum(best.low, place[doc + 1] - length)
        runs = self.begin <= self.end
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, self.begin[runs], 1)
        np.add.at(edge, self.end[runs] + 1, -1)
        # Windows that end within their document and have no anchor yet.
        open_ = np.cumsum(edge[:n], dtype=np.int32) == 0
        for back in place[1:]:
            open_[max(0, back - length + 1) : back] = False
        rest = np.flatnonzero(open_)
        #: For every further level: windows, and the index of each one's first anchor.
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        for level in parsed.levels[1:]:
            first = np.searchsorted(level.low, rest, "left")
            mine = first < np.searchsorted(level.high, rest + length, "right")
            self.groups.append((rest[mine], first[mine]))
            rest = rest[~mine]
        # A window without an anchor is its own anchor.
        self.levels = [*parsed.levels, Level(rest, rest, rest + length)]
        self.groups.append((rest, np.arange(len(rest))))

    @cached_property
    def one(self) -> Rolling:
        return Rolling(21).load(self.parsed.units)

    @cached_property
    def two(self) -> Rolling:
        """A second, independent fingerprint."""
        return Rolling(22).load(self.parsed.others() if self.parsed.others else self.parsed.units)

    def names(self, k: int, which: np.ndarray) -> np.ndarray:
        level = self.levels[k]
        low, at = level.low[which], level.at[which]
        return signed(mix(self.one.ranges(low, level.high[which]) + (at - low).astype(np.uint64) * np.uint64(8) + np.uint64(k)))

    def places(self, k: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of each anchor, and the anchor's number in it."""
        level = self.levels[k]
        doc = np.searchsorted(self.parsed.place, level.low[which], "right") - 1
        return doc, (level.at[which] - self.parsed.place[doc]) * 8 + k

    def emitted(self):
        """The anchors that are named: all of the best level, of the others those with windows."""
        yield 0, np.arange(len(self.levels[0].at))
        for k, (_, first) in enumerate(self.groups, 1):
            yield k, np.unique(first)

    def entries(self, shared: list[np.ndarray]):
        """For each level the anchors that have windows left when only shared anchors count: level, anchor, first and last window.
        ``shared``: for each document the numbers of its shared anchors."""
        keys = np.concatenate([np.zeros(0, np.int64), *shared])
        docs = np.repeat(np.arange(len(shared)), [len(s) for s in shared])
        wanted = np.sort(docs.astype(np.int64) << np.int64(40) | keys)

        def good(k: int, which: np.ndarray) -> np.ndarray:
            doc, number = self.places(k, which)
            mine = doc.astype(np.int64) << np.int64(40) | number
            spot = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
            return wanted[spot] == mine if len(wanted) else np.zeros(len(mine), bool)

        best = self.levels[0]
        m = len(best.at)
        if m:
            # A window stays while it ends before the stretch of the next anchor that is not shared.
            bad = np.minimum.accumulate(np.where(good(0, np.arange(m)), m, np.arange(m))[::-1])[::-1]
            end = np.minimum(self.end, np.append(best.high, np.iinfo(np.int64).max)[bad] - self.length - 1)
            which = np.flatnonzero(self.begin <= end)
            if len(which):
                yield 0, which, self.begin[which], end[which]
        for k, (windows, first) in enumerate(self.groups, 1):
            if not len(windows):
                continue
            keep = good(k, first)
            windows, first = windows[keep], first[keep]
            if not len(windows):
                continue
            begin = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            end = np.append(begin[1:], len(first)) - 1
            yield k, first[begin], windows[begin], windows[end]


def _packed(documents: DataFrame) -> DataFrame:
    """key, z (and rank, where the documents have it): the texts, compressed one by one."""
    names = [c for c in documents.columns if c != "text"]

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            raw = batch.column("text").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([squeeze.compress(t or b"") for t in raw], pa.binary())], [*names, "z"])

    return documents.select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", z binary")


def _texts(batches, limit: int = 400_000):
    """Batches with their z turned back to text, so many compressed bytes or one document at a time."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("z")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")) - at)
            part = batch.slice(at, n)
            text = pa.array([expand.decompress(z) for z in part.column("z").to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, text], [*part.schema.names, "text"])
            at += n


def _ints(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x if x is not None else [], np.int64) for x in column.to_pylist()]


def _entry_columns(batch: pa.RecordBatch, parse: Parser, length: int):
    """The dictionary entries of a slice: document, number, level, anchor, name, first window, last window and its Owned."""
    owned = Owned(parse(batch.column("text")), length)
    for k, which, begin, end in owned.entries(_ints(batch.column("shared"))):
        doc, number = owned.places(k, which)
        yield owned, k, which, doc, number, owned.names(k, which), begin, end


def _prints(owned: Owned, k: int, which: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offset = (owned.levels[k].at[which] - begin).astype(np.uint64)
    return tuple(signed(mix(r.ranges(begin, end + owned.length) + offset)) for r in (owned.one, owned.two))


def repeated_windows(documents: DataFrame, parse: Parser, length: int, question: str) -> DataFrame:
    """key, z, shared, settled_not, starts: the documents (key long, text) that may hold repeated windows. ``starts`` are
    the starts of repeated windows among the entries in ``settled_not`` (numbers of anchors); of all other entries over
    ``shared`` anchors, every window is repeated. ``marks`` turns such a row into units to remove.

    Documents may have a column rank (long), the id that ``"first"`` compares, where several keys share an id; else the
    key is the id."""
    ranked = question == "first" and "rank" in documents.columns
    ids = ["key", "rank"] if ranked else ["key"]
    rank = ids[-1]
    documents = documents.select(*ids, "text")
    longs = ", ".join(f"{c} long" for c in ids)

    def name_anchors(batches):
        for batch in slices(batches):
            owned = Owned(parse(batch.column("text")), length)
            keys = [np.asarray(batch.column(c)) for c in ids]
            for k, which in owned.emitted():
                doc, number = owned.places(k, which)
                yield pa.RecordBatch.from_arrays([pa.array(owned.names(k, which)), *(pa.array(c[doc]) for c in keys), pa.array(number)], ["f", *ids, "a"])

    anchors = documents.mapInArrow(name_anchors, f"f long, {longs}, a long")
    if question == "count":
        shared = anchors.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    else:
        shared = anchors.groupBy("f").agg(F.min(rank).alias("low"), F.max(rank).alias("high")).where("low < high").select("f")
    # Written first: a join of two plain exchanges is one that Spark can split where a name is very common.
    lists = anchors.join(materialize(shared, "repeats-shared"), "f").groupBy("key").agg(F.collect_set("a").alias("shared"))
    found = materialize(_packed(documents).join(lists, "key"), "repeats-candidates")

    def list_entries(batches):
        for batch in _texts(batches):
            keys = [np.asarray(batch.column(c)) for c in ids]
            for owned, k, which, doc, number, names, begin, end in _entry_columns(batch, parse, length):
                c1, c2 = _prints(owned, k, which, begin, end)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(c1), pa.array(c2), *(pa.array(c[doc]) for c in keys), pa.array(number)], ["f", "c1", "c2", *ids, "a"])

    entries = found.mapInArrow(list_entries, f"f long, c1 long, c2 long, {longs}, a long")
    # One row per dictionary entry: how often it occurs, and its first place.
    by = ["f", "c1", "c2"]
    if ranked:  # the first places of all documents with the smallest id
        placed = materialize(entries.groupBy(*by, *ids).agg(F.min("a").alias("a")), "repeats-places")
        lowest = placed.groupBy(*by).agg(F.min("rank").alias("rank"))
        dictionary = materialize(placed.join(lowest, [*by, "rank"]).select(*by, F.lit(1).alias("n"), F.struct("key", "a").alias("first")), "repeats-dictionary")
        kinds = F.count_distinct("c1", "c2")
    else:
        dictionary = materialize(entries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a")).alias("first")), "repeats-dictionary")
        kinds = F.count(F.lit(1))
    several = dictionary.groupBy("f").agg(kinds.alias("kinds")).where("kinds > 1").select("f", F.lit(True).alias("several"))
    judged = dictionary.join(several, "f", "left").select("first", "n", F.coalesce("several", F.lit(False)).alias("several"))
    if question == "count":  # entries that occur once are open, or unique; examples of the others stand for two occurrences
        judged = judged.select(F.col("first.key").alias("key"), F.col("first.a").alias("a"), (F.col("n") == 1).alias("open"), "several").where("open or several")
    else:  # every entry is open in its first document
        judged = judged.select(F.col("first.key").alias("key"), F.col("first.a").alias("a"), F.lit(True).alias("open"), "several")
    state = judged.groupBy("key").agg(
        F.collect_list(F.when(F.col("open"), F.col("a"))).alias("settled_not"), F.collect_list(F.when(F.col("several"), F.col("a"))).alias("compared")
    )
    state = materialize(state, "repeats-state")

    def list_windows(batches):
        for batch in _texts(batches):
            keys, ranks = np.asarray(batch.column("key")), np.asarray(batch.column(rank))
            compared, unsettled = _ints(batch.column("compared")), [set(x.tolist()) for x in _ints(batch.column("settled_not"))]
            chosen = {(d, a) for d, x in enumerate(compared) for a in x.tolist()}
            out: list[tuple] = []
            for owned, k, which, doc, number, names, begin, end in _entry_columns(batch, parse, length):
                for i in [i for i, pair in enumerate(zip(doc.tolist(), number.tolist())) if pair in chosen]:
                    w = np.arange(begin[i], end[i] + 1)
                    prints = signed(owned.two.ranges(w, w + length))
                    away = owned.levels[k].at[which[i]] - w
                    for block in np.unique(away // BLOCK):
                        part = away // BLOCK == block
                        out.append((names[i], int(block), int(keys[doc[i]]), int(ranks[doc[i]]), number[i] in unsettled[doc[i]], int(w[part][0] - owned.parsed.place[doc[i]]), int(away[part][0]), prints[part]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)], ["f", "block", "key", "rank", "open", "start", "away", "prints"])

    rows = found.join(state.where(F.size("compared") > 0), "key").mapInArrow(list_windows, "f long, block long, key long, rank long, open boolean, start long, away long, prints array<long>")
    rows = rows.repartition("f", "block").select("f", "block", "key", "rank", "open", "start", "away", F.posexplode("prints").alias("i", "w"))
    rows = rows.withColumn("away", F.col("away") - F.col("i")).withColumn("start", F.col("start") + F.col("i"))
    same = Window.partitionBy("f", "block", "away", "w")
    if question == "count":
        rows = rows.withColumn("total", F.sum(F.when(F.col("open"), 1).otherwise(2)).over(same)).where("open and total > 1")
    else:
        rows = rows.withColumn("first", F.min("rank").over(same)).where("rank > first")
    starts = rows.groupBy("key").agg(F.collect_list("start").alias("starts"))
    return found.join(state.select("key", "settled_not"), "key", "left").join(starts, "key", "left").select("key", "z", "shared", "settled_not", "starts")


def marks(batch: pa.RecordBatch, parse: Parser, length: int, question: str) -> tuple[Parsed, np.ndarray]:
    """A slice of rows of ``repeated_windows`` with their text: the parsed slice, and which of its units lie in a repeated window."""
    owned = Owned(parse(batch.column("text")), length)
    place, n = owned.parsed.place, len(owned.parsed.units)
    edge = np.zeros(n + 1, np.int64)
    unsettled = {(d, a) for d, x in enumerate(_ints(batch.column("settled_not"))) for a in x.tolist()}
    starts = _ints(batch.column("starts"))
    known = np.zeros(n + 1, bool)
    for d, x in enumerate(starts):
        known[place[d] + x] = True
    at = np.flatnonzero(known)
    edge[at] += 1
    edge[at + length] -= 1
    for k, which, begin, end in owned.entries(_ints(batch.column("shared"))):
        doc, number = owned.places(k, which)
        firsts: dict[tuple[int, int, int], int] = {}
        c1, c2 = _prints(owned, k, which, begin, end) if question == "first" else (doc, doc)
        for i, pair in enumerate(zip(doc.tolist(), number.tolist())):
            if pair not in unsettled:
                alias = firsts.get((pair[0], int(c1[i]), int(c2[i]))) if question == "first" else None
                if alias is None:
                    edge[begin[i]] += 1
                    edge[end[i] + length] -= 1
                else:  # the same entry again in its first document: what holds for the first holds here
                    for s in np.flatnonzero(known[begin[alias] : end[alias] + 1]):
                        edge[begin[i] + s] += 1
                        edge[begin[i] + s + length] -= 1
            elif question == "first":
                firsts.setdefault((pair[0], int(c1[i]), int(c2[i])), i)
    return owned.parsed, np.cumsum(edge)[:n] > 0
