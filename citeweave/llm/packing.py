"""Token ids packed into rows of one length, written as binary.

Documents become token ids (byte-level ranks, so that the ids of a text turn back into the very same bytes), each
followed by an end mark. A document longer than a row is split into full rows and a rest without losing an id. Pieces
are packed by best fit decreasing: longest first, each into the row whose free space is the smallest that still holds
it. Free spaces are indexed by size in a segment tree, which finds that row in logarithmic time.

Packing works on ``pool_tokens`` ids at a time, within a task and without any shuffle; a pool loses at most part of its
last rows, so its size, not the corpus, bounds memory. A packed row has its ids (padded with the end mark), the
cumulative lengths of its segments (cu_seqlens, from 0), the positions, which start anew in each segment, and for each
segment the document and the offset of the piece within it.

Defined results: a null or empty text is a piece of one end mark; a null ``doc_id`` stays null; repeated rows are
packed once each; other columns are ignored. Rows are numbered within their input partition."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import slices
from .wordids import WordIds

_DOUBLE = re.compile(r"\s ")
_AFTER_WORD = re.compile(r"(?<=\S) ")

ROW = 2_048
POOL_TOKENS = 4_000_000

PACKED = T.StructType(
    [
        T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("input_ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_ids", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.IntegerType())),
    ]
)


class BestFit:
    """Open rows by free space: a segment tree over the sizes 0..capacity that counts rows."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, size: int, by: int) -> None:
        at = size + self.base
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least free space that is at least ``need``, and that space."""
        at = need + self.base
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        size = at - self.base
        self._add(size, -1)
        return self.rows[size].pop(), size


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The row of each piece by best fit decreasing (ties: in the given order), and the number of rows."""
    open_rows, row_of, n = BestFit(capacity), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_rows.take(need) if need < capacity else None
        row, free = found or (n, capacity)
        n += found is None
        row_of[i] = row
        if free > need:
            open_rows.put(row, free - need)
    return row_of, n


def byte_ranks(path: str):
    """An encoder of many words and the end mark's id, from a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, len(ranks)


class Encoder:
    """Ids of whole texts. A space after a character that is no white space always begins a new word of the pattern, so
    texts are taken apart there and every distinct piece is encoded once."""

    def __init__(self, path: str):
        self.encoding, self.end = byte_ranks(path)
        self.table = WordIds(lambda words: [self.encoding.encode_ordinary(w) for w in words])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        if self.table.full():
            self.table.clear()
        pieces = []
        for text in texts:
            first, *rest = _AFTER_WORD.split(text) if _DOUBLE.search(text) else text.split(" ")
            pieces.append([first, *(" " + w for w in rest)])
        self.table.learn({p for x in pieces for p in x if p})
        numbers = self.table.numbers([p for x in pieces for p in x if p])
        ids, lengths = self.table.expand(numbers)
        per_word = np.concatenate(([0], np.cumsum(lengths)))
        ends = per_word[np.cumsum([sum(map(bool, x)) for x in pieces])] if pieces else []
        return np.split(ids, ends[:-1]) if pieces else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_documents(documents: DataFrame, ranks_path: str, row: int = ROW, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Rows of ``PACKED``. ``ranks_path`` is the place of the rank file on every executor."""

    def flush(part: int, first_row: int, docs: list, ids: list[np.ndarray], end: int):
        piece_doc, piece_at, piece_len = [], [], []
        for d, x in enumerate(ids):
            for at in range(0, len(x), row):
                piece_doc.append(d)
                piece_at.append(at)
                piece_len.append(min(row, len(x) - at))
        row_of, n = pack(np.array(piece_len, np.int64), row)
        members: list[list[int]] = [[] for _ in range(n)]
        for i, r in enumerate(row_of.tolist()):
            members[r].append(i)
        for at in range(0, n, 512):
            out: dict[str, list] = {name: [] for name in PACKED.names}
            for r in range(at, min(n, at + 512)):
                parts = [ids[piece_doc[i]][piece_at[i] : piece_at[i] + piece_len[i]] for i in members[r]]
                sizes = [len(p) for p in parts]
                used = sum(sizes)
                matrix = np.full(row, end, np.uint16 if end < 1 << 16 else np.uint32)
                matrix[:used] = np.concatenate(parts)
                positions = np.concatenate([np.arange(s, dtype=np.uint16 if row < 1 << 16 else np.uint32) for s in [*sizes, row - used]])
                values = (part, first_row + r, used, matrix.tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist(), positions.tobytes(), [docs[piece_doc[i]] for i in members[r]], [piece_at[i] for i in members[r]])
                for name, value in zip(PACKED.names, values):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, ARROW)
        return n

    def run(batches):
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(ranks_path)
        docs, ids, held, first_row = [], [], 0, 0
        for batch in slices(batches):
            coded = coder.batch([t or "" for t in batch.column("text").to_pylist()])
            docs += batch.column("doc_id").to_pylist()
            ids += [np.append(x, np.uint32(coder.end)) for x in coded]
            held += sum(map(len, coded)) + len(coded)
            if held >= pool_tokens:
                first_row += yield from flush(part, first_row, docs, ids, coder.end)
                docs, ids, held = [], [], 0
        if docs:
            yield from flush(part, first_row, docs, ids, coder.end)
        coder.table.clear()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)


ARROW = pa.schema(
    [("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32()))]
)


def write_packed(packed: DataFrame, folder: str) -> str:
    """Write the packed rows as Parquet under a folder that all executors reach; returns the folder."""
    packed.write.mode("overwrite").parquet(folder)
    return folder


def unpack(packed: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text again, from packed rows (for documents with distinct ids)."""
    pieces = packed.select("input_ids", F.posexplode(F.arrays_zip("doc_ids", "offsets", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("a"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("z"))).alias("i", "s"))
    wide = F.when(F.lit(byte_ranks(ranks_path)[1] < 1 << 16), 2).otherwise(4)
    cut = pieces.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.offsets").alias("offset"), F.substring(F.col("input_ids"), F.col("s.a") * wide + 1, (F.col("s.z") - F.col("s.a")) * wide).alias("ids"))
    whole = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))

    def run(batches):
        coding, end = byte_ranks(ranks_path)
        kind = np.uint16 if end < 1 << 16 else np.uint32
        for batch in batches:
            texts = [coding.decode(np.frombuffer(b"".join(p["ids"] for p in row), kind)[:-1].tolist()) for row in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(run, "doc_id long, text string")
