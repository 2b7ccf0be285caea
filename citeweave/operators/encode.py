"""Dense and sparse encoders. The sparse one is array expressions; the dense one is a
user-supplied callable in Arrow batches, with a hashed stand-in that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.tokens import words

K1, B, AVG_LEN = 1.2, 0.75, 256.0
#: Trigrams of a text that are hashed at once.
RUN = 1 << 16


def _weighted(tokens: Column, k1: float = K1, b: float = B, avg_len: float = AVG_LEN) -> Column:
    """struct(terms, weights) of an array of words: distinct and sorted, with saturated frequencies. Words are sorted inside
    the row and runs of equal ones counted: no explode and no shuffle, and the cost is linear after the sort."""
    last = lambda w: F.filter(F.transform(w, lambda x, i: F.when(~x.eqNullSafe(F.get(w, i + 1)), i)), lambda i: i.isNotNull())
    count = lambda ends, i, j: (i - F.coalesce(F.get(ends, j - 1), F.lit(-1))).cast("double")
    norm = lambda w: F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.size(w) / F.lit(avg_len))
    weight = lambda tf, n: tf * F.lit(k1 + 1) / (tf + n)
    return let(F.sort_array(tokens), lambda w: let(last(w), lambda ends: let(norm(w), lambda n: F.struct(
        F.transform(ends, lambda i: F.get(w, i)).alias("terms"),
        F.transform(ends, lambda i, j: weight(count(ends, i, j), n)).alias("weights")))))


def _tokens(text: str, stop_words: tuple[str, ...]) -> Column:
    tokens = words(F.col(text))
    return F.filter(tokens, lambda w: ~w.isin(*stop_words)) if stop_words else tokens


def sparse_terms(df: DataFrame, text: str, stop_words: tuple[str, ...] = (), **params) -> DataFrame:
    """Add ``terms`` (distinct, sorted) and ``weights`` (saturated term frequencies, no IDF)."""
    return df.withColumn("_v", _weighted(_tokens(text, stop_words), **params)).select("*", "_v.terms", "_v.weights").drop("_v")


def sparse_vector(df: DataFrame, text: str, out: str = "sparse", stop_words: tuple[str, ...] = (), **params) -> DataFrame:
    """Add struct(indices, values) with 64-bit term ids, by rising id. Words become ids before they are sorted: numbers are
    compared in a fraction of the time of strings."""
    d = df.withColumn("_v", _weighted(F.transform(_tokens(text, stop_words), lambda w: F.xxhash64(w)), **params))
    vector = F.struct(F.col("_v.terms").alias("indices"), F.col("_v.weights").alias("values"))
    return d.withColumn(out, F.when(F.col(text).isNotNull(), vector)).drop("_v")


def postings(df: DataFrame, point_id: str, text: str, **params) -> DataFrame:
    """The exploded form: term, point, weight."""
    d = sparse_terms(df, text, **params)
    return d.select(point_id, F.inline(F.arrays_zip("terms", "weights"))).withColumnsRenamed({"terms": "term", "weights": "weight"})


def hashed_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Factory of a deterministic encoder: signed hashed character trigrams, unit length. A trigram of code points
    a, b, c has the hash (961 a + 31 b + c) * 2654435761 modulo 2**32; its upper bit is the sign, the rest gives the place."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                text = f"  {text.lower()} "
                # Neighbouring runs share two characters. The counts are whole numbers, so their sum is exact.
                for at in range(0, len(text) - 2, RUN):
                    points = np.frombuffer(text[at:at + RUN + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                    hashes = (points[:-2] * np.uint64(961) + points[1:-1] * np.uint64(31) + points[2:]) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)
                    out[row] += np.bincount((hashes >> np.uint64(8) & np.uint64(0x7FFFFF)).astype(np.int64) % dim, np.where(hashes >> np.uint64(31), 1.0, -1.0), dim)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.where(norm == 0, 1, norm)

        return encode

    return load


def dense_vector(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "dense", batch: int = 32) -> DataFrame:
    """Add a dense vector per row, null for a null text. ``load`` builds the model once per task. Texts stay in Arrow and
    become Python strings in small batches. A filter on the vector is not pushed below it: that would encode every text twice."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for part in parts:
            present = part.drop_null()
            vectors = iter([v for at in range(0, len(present), batch) for v in np.asarray(encode(present.slice(at, batch).to_pylist()), dtype=np.float32)])
            yield pa.array([next(vectors) if there else None for there in part.is_valid().to_pylist()], pa.list_(pa.float32()))

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def encode_points(load: Callable[[], Callable[[list[str]], np.ndarray]], **sparse_params) -> Callable[[DataFrame], DataFrame]:
    """The encoder of a sync: adds both vectors from ``text_to_embed``, null for null."""

    def encode(changed: DataFrame) -> DataFrame:
        return dense_vector(sparse_vector(changed, "text_to_embed", **sparse_params), "text_to_embed", load)

    return encode
