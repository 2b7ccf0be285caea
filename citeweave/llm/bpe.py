"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 bytes cuts every text into chunks (about 1,024 bytes) at places that depend on the bytes alone,
so copies and shared passages give equal chunks wherever they stand. A task encodes each distinct chunk once and keeps
its ids and its decoded form by the chunk's bytes. A cut may tear a word; the loose ends of neighbouring
chunks are then joined again: the torn word is re-encoded together with whole words on either side, and the window is
widened until those come out exactly as they stand in the chunks; where they never do, the whole text is encoded.

The chunk table belongs to a task, not to the cluster: a global table needs every text to be shuffled at
least once, which costs more than encoding a chunk again in each task. It also starts anew beyond ``CACHE_BYTES``.

This holds for tokenizers whose words end at ASCII white space and that drop it, as the given one does: between words
the result never depends on what stands around. Words are separated here at space, tab and line ends only; all other
characters, special tokens among them, stay inside words and are the tokenizer's business.

Defined results: a null text counts as empty, an empty text has no ids and decodes to the empty string; repeated rows
are encoded each; other columns are ignored by ``encode`` and ``digest``."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .arrays import flat, release, slices
from .wordids import WordIds

CHUNK_BITS = 10
WINDOW = 16
LONGEST_CHUNK = 1 << 14
CACHE_BYTES = 96 << 20
#: Words whose ids and decoded forms are kept, and words in one call of the tokenizer, whose results are large.
MOST_WORDS = 600_000
AT_ONCE = 8_000
#: Most words on either side of a torn one that are re-encoded with it; beyond, the whole text is encoded.
FLANK = 8
#: Bytes of text worked on at once.
SLICE = 1 << 20

_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)

_ONE_SPACE = bytes.maketrans(b"\t\n\r", b"   ")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, and the end of the data. Documents begin chunks; a chunk begins at a whole character."""
    n = len(data)
    marked = np.zeros(n + 1, bool)
    if n > WINDOW:
        # The sixteen bytes before a place as two numbers.
        eight = np.ndarray(n - 7, np.uint64, np.ascontiguousarray(data), strides=(1,))
        prints = (eight[: n - WINDOW] * _ODD[0] + (eight[8 : n - WINDOW + 8] ^ (eight[: n - WINDOW] >> np.uint64(29)))) * _ODD[1]
        hits = np.flatnonzero((prints >> np.uint64(64 - CHUNK_BITS)) == 0) + WINDOW
        hits = hits[(data[hits] & 0xC0) != 0x80]
        # The hashed window must lie within the document.
        hits = hits[hits - WINDOW >= offsets[np.searchsorted(offsets, hits, "right") - 1]]
        marked[hits] = True
    marked[offsets] = True
    marked[n] = True
    places = np.flatnonzero(marked)
    long = np.flatnonzero(np.diff(places) > LONGEST_CHUNK)
    if len(long):
        extra = []
        for i in long:
            at = int(places[i]) + LONGEST_CHUNK
            while at < places[i + 1]:
                while at < places[i + 1] and (data[at] & 0xC0) == 0x80:
                    at += 1
                if at < places[i + 1]:
                    extra.append(at)
                at += LONGEST_CHUNK
        places = np.union1d(places, extra)
    return places


class Chunk:
    """A chunk's loose first and last part (``tail`` is None where no separator stands in it) and what lies between."""

    __slots__ = ("head", "tail", "words", "ids", "shown", "first", "last")

    def __init__(self, text: str):
        parts = text.split(" ")
        self.head, self.tail = parts[0], parts[-1] if len(parts) > 1 else None
        self.words = [w for w in parts[1:-1] if w]


class Coder:
    """Encodes batches of texts with one tokenizer, keeping chunks and words between batches."""

    def __init__(self, path: str, words: int = MOST_WORDS, chunk_bytes: int = CACHE_BYTES):
        self.chunk_bytes = chunk_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.joinable = tokenizer.decoder is None  # then decoding puts a space between tokens, and nothing else
        self.table = WordIds(
            lambda words: [e.ids for at in range(0, len(words), AT_ONCE) for e in tokenizer.encode_batch_fast(words[at : at + AT_ONCE], add_special_tokens=False)],
            lambda ids: tokenizer.decode_batch(ids, skip_special_tokens=False),
            words,
        )
        self.forget()

    def forget(self) -> None:
        """Drop all chunks and words; a worker lives on when its task is done, and others need the memory."""
        self.chunks: dict[bytes, Chunk] = {}
        self.held = 0
        self.checked: set[str] = set()
        self.table.clear()
        release()

    def _finish(self, chunks: list[Chunk]) -> None:
        numbers = self.table.numbers([w for c in chunks for w in c.words])
        ids, lengths = self.table.expand(numbers)
        words = np.cumsum([0, *(len(c.words) for c in chunks)])
        places = np.concatenate(([0], np.cumsum(lengths)))[words].tolist()
        shown = list(map(self.table.shown.__getitem__, numbers.tolist()))
        for i, chunk in enumerate(chunks):
            chunk.ids = ids[places[i] : places[i + 1]].copy()
            chunk.shown = " ".join(filter(None, shown[words[i] : words[i + 1]]))
            chunk.first, chunk.last = chunk.words[:FLANK], chunk.words[-FLANK:]
            self.held += 8 * len(chunk.ids) + 400
            chunk.words = None

    def _join(self, before: Chunk | None, torn: str, after: Chunk | None) -> tuple[np.ndarray, str] | None:
        """The ids of the torn word between the chunks' whole words: a window of it and its neighbours is re-encoded,
        wider each time, until the neighbours' ids come out as they stand in the chunks. None if they never do."""
        for reach in (1, 2, FLANK):
            left, right = (before.last[-reach:] if before else []), (after.first[:reach] if after else [])
            window = self.tokenizer.encode(" ".join([*left, torn, *right]), add_special_tokens=False).ids
            lead, trail = self._word(left), self._word(right)
            stop = len(window) - len(trail)
            if stop >= len(lead) and window[: len(lead)] == lead and window[stop:] == trail:
                inner = window[len(lead) : stop]
                return np.array(inner, np.uint32), self.tokenizer.decode(inner, skip_special_tokens=False)
        return None

    def _word(self, words: list[str]) -> list[int]:
        self.table.learn(set(words))
        return self.table.expand(self.table.numbers(words))[0].tolist()

    def batch(self, column: pa.Array) -> list[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        if self.held > self.chunk_bytes or self.table.full():
            self.forget()
        data, offsets = flat(column)
        places = cuts(data, offsets)
        starts, ends = places[:-1], places[1:]
        raw, fresh = data.tobytes(), {}
        names = [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist())]
        for name in names:
            if name not in self.chunks:
                fresh[name] = self.chunks[name] = Chunk(name.translate(_ONE_SPACE).decode())
                self.held += len(name)
        self.table.learn({w for c in fresh.values() for w in c.words})
        self._finish(list(fresh.values()))
        bounds = np.searchsorted(starts, offsets)
        # Torn words of the batch, learned in one call; a join then looks at what stands beside them.
        plans = []
        for d in range(len(offsets) - 1):
            plan: list = []
            torn, before = [], None
            for name in names[bounds[d] : bounds[d + 1]]:
                chunk = self.chunks[name]
                torn.append(chunk.head)
                if chunk.tail is not None:
                    plan.append((before, "".join(torn), chunk))
                    torn, before = [chunk.tail], chunk
            plan.append((before, "".join(torn), None))
            plans.append(plan)
        self.table.learn({w for plan in plans for _, w, _ in plan if w})
        self._check(plans)
        out = []
        for d, plan in enumerate(plans):
            ids, shown = [], []
            for before, torn, after in plan:
                if torn:
                    joined = self._agreed(before, torn, after)
                    if joined is None:
                        whole = self.tokenizer.encode(raw[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids
                        ids, shown = [np.array(whole, np.uint32)], [self.tokenizer.decode(whole, skip_special_tokens=False)]
                        break
                    part, text = joined
                    ids.append(part)
                    if text:
                        shown.append(text)
                if after is not None:
                    ids.append(after.ids)
                    if after.shown:
                        shown.append(after.shown)
            all_ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            out.append((all_ids, " ".join(shown) if self.joinable else self.tokenizer.decode(all_ids.tolist(), skip_special_tokens=False)))
        return out

    def _check(self, plans: list[list]) -> None:
        """Re-encode the batch's new torn words between their next whole words, all in one call, and note those that
        come out, with their neighbours, as they stand in the table."""
        if len(self.checked) > 50_000:
            self.checked.clear()
        windows: dict[str, list[str]] = {}
        for plan in plans:
            for before, torn, after in plan:
                if torn and torn not in self.checked and torn not in windows:
                    windows[torn] = [*(before.last[-1:] if before else []), torn, *(after.first[:1] if after else [])]
        if not windows:
            return
        ids, lengths = self.table.expand(self.table.numbers([w for x in windows.values() for w in x]))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *map(len, windows.values())])].tolist()
        coded = self.tokenizer.encode_batch_fast([" ".join(x) for x in windows.values()], add_special_tokens=False)
        for i, (torn, window) in enumerate(zip(windows, coded)):
            if window.ids == ids[ends[i] : ends[i + 1]].tolist():
                self.checked.add(torn)

    def _agreed(self, before: Chunk | None, torn: str, after: Chunk | None) -> tuple[np.ndarray, str] | None:
        """The torn word's ids: the table's where it has come out between neighbours as it does alone."""
        if torn not in self.checked:
            return self._join(before, torn, after)
        number = self.table.place[torn]
        return self.table.flat[self.table.starts[number] : self.table.starts[number + 1]], self.table.shown[number]


_coders: dict[tuple, Coder] = {}


def coder(path: str, words: int = MOST_WORDS, chunk_bytes: int = CACHE_BYTES) -> Coder:
    key = (path, words, chunk_bytes)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def _coded(batches, path: str, words: int = MOST_WORDS, chunk_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE):
    """Slices of a task with the ids and the decoded form of their texts."""
    own = coder(path, words, chunk_bytes)
    try:
        for batch in slices(batches, limit=slice_bytes):
            yield batch, own.batch(batch.column("text"))
    finally:
        own.forget()


def encode(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, decoded for every row. ``tokenizer_path`` is the file's place on every executor."""

    def run(batches):
        for batch, coded in _coded(batches, tokenizer_path):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([i.astype(np.int32) for i, _ in coded], pa.list_(pa.int32())), pa.array([s for _, s in coded], pa.string())], ["doc_id", "ids", "decoded"]
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(documents: DataFrame, tokenizer_path: str, words: int = MOST_WORDS, chunk_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, without the ids leaving the task. The last three
    bound a worker's memory, at the price of encoding words again; they never change a result."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        for batch, coded in _coded(batches, tokenizer_path, words, chunk_bytes, slice_bytes):
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(i) for i, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i, _ in coded]),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
