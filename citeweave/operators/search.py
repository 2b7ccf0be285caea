"""Exact top-k search for a whole table of questions at once, table to table, reading only groups that can matter.

Points are written in groups of bounded size that hold similar points, and every (question, group) pair gets an upper
bound of the scores in it. Dense points lie around pivots: by the triangle inequality for angles, no point of a group
scores more than the cosine of (angle to the pivot - radius of the group). Sparse points lie in the order of a signature of
their terms, and the index is the inverted list of the groups: per term the groups that hold it with their extreme
weights, so that a question's bound is the sum over its terms. A question first visits its most promising groups until
they hold k points, which gives it a kth score; then it visits the groups whose bound reaches that score, and no others.

A visit is a tile, one block of questions next to one group, scored with matrix products in Arrow tables; k rows per question
leave it. Neither side passes the driver or is broadcast; the pivots are at most ``PIVOTS`` vectors. What travels is
each visited group once per block of questions, each question once per visited group, and k hits per visit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import free_shuffles, materialize
from .encode import sparse_vector

#: Questions and points of a tile in small searches, and vectors that are scored at once.
BLOCK = 4096
GROUP = 1024
STEP = 256
#: Most vectors that dense points are grouped around.
PIVOTS = 512
#: How many times as many points the pivots are chosen from.
SPREAD = 8
#: Bounds this far below a kth score still count: scores are rounded, angles are computed.
SLACK = 1e-5
#: Terms of the questions and of the points of a tile, and the most rows of either side, in a sparse search. The larger a
#: tile, the less often either side is sent, and the more memory it takes.
TERMS, TERMS_OF_POINTS = 2_000_000, 1_200_000
LARGEST_BLOCK, LARGEST_GROUP = 1 << 18, 16384
#: Groups from which on they grow.
GROUPS = 32
#: Questions that a tile scores at once, and scores that it computes at once.
ROWS = 2048
CELLS = 1 << 20
#: A term is scored by matrix products where one in so many pairs of question and point share it, at most HEAVY terms.
COMMON = 200
HEAVY = 512
#: A term that fewer pairs share is scored together with others.
FEW = 512
#: Questions and groups whose bounds are summed by one task.
BLOCK_OF_BOUNDS = 1 << 16
GROUPS_OF_BOUNDS = 8
#: 64-bit words of the bitmap of the questions' terms.
ASKED_WORDS = 1 << 14
#: Pairs of a point's term and a question with that term that are spelled out at once.
PAIRS = 500_000
SCORE_DIGITS = 6


class _TopK:
    """Best k (score, id) pairs per question over the batches of one task; scores below ``edge`` are not among them."""

    def __init__(self, n: int, k: int, edge: np.ndarray | None = None):
        self.k, self.edge, self.held, self.new = k, np.full(n, -np.inf) if edge is None else edge, None, []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] > self.k and np.isneginf(self.edge).any():
            # Cut by score alone; ties at the edge stay in for the exact order below.
            edge = np.maximum(self.edge, np.partition(scores, -self.k, axis=1)[:, -self.k])
        else:
            edge = self.edge
        rows, places = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        self.found(rows, scores[rows, places], ids[places])

    def found(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores that may be among the best. They are put in order when there are as many as are held."""
        if len(rows):
            self.new.append([rows, scores, ids])
        if sum(len(x[0]) for x in self.new) > (len(self.held[0]) if self.held else 0):
            self._settle()

    def _settle(self) -> None:
        if not self.new:
            return
        found = [np.concatenate(parts) for parts in zip(*([self.held] if self.held else []), *self.new)]
        # Score first, then the smaller id: same order as the final ranking.
        order = np.lexsort((found[2], -found[1], found[0]))
        rows = found[0][order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = order[place < self.k]
        self.held, self.new = [column[kept] for column in found], []
        last = order[place == self.k - 1]
        self.edge[found[0][last]] = found[1][last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._settle()
        return self.held or (np.empty(0, int), np.empty(0), np.empty(0))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row each belongs to."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(int)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def _ids(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _tiles(points: DataFrame, questions: DataFrame, visits: DataFrame, point_id: str, query_id: str, k: int, schema: T.StructType, score: Callable[[pa.Table, pa.Table, _TopK], None], blocks: int) -> DataFrame:
    """Top-k rows of every tile of ``visits`` (query_id, _g, _kth: a score below which nothing counts). ``score`` feeds one
    tile's points to a top-k list."""
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("_b")
    asked = questions.select("*", block).join(visits.select(query_id, "_g", "_kth"), query_id)
    # Written first, as a table of known and small size: else the points would be shuffled to meet it.
    stored = points.join(materialize(visits.select("_g", block).distinct(), "search-tiles"), "_g")
    # Both sides may come from one table.
    asked, stored = asked.toDF(*asked.columns), stored.toDF(*stored.columns)
    out_schema = to_arrow_schema(schema)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        kth = left.column("_kth").to_numpy().astype(float)
        top = _TopK(left.num_rows, k, np.where(np.isnan(kth), -np.inf, kth))
        if left.num_rows and right.num_rows:
            score(left, right, top)
        q, scores, ids = top.rows()
        return pa.table([left.column(query_id).combine_chunks().take(pa.array(q)), pa.array(ids.tolist(), type=out_schema.field(1).type), pa.array(scores, type=pa.float64())], schema=out_schema)

    return asked.groupBy("_g", "_b").cogroup(stored.groupBy("_g", "_b")).applyInArrow(tile, schema)


def _in_order(bounds: DataFrame, points: DataFrame, query_id: str) -> DataFrame:
    """``bounds`` with _before: the points in the better groups of the question."""
    sizes = points.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    best_first = Window.partitionBy(query_id).orderBy(F.desc("bound"), "_g").rowsBetween(Window.unboundedPreceding, -1)
    return bounds.join(sizes, "_g").withColumn("_before", F.coalesce(F.sum("_n").over(best_first), F.lit(0)))


def _search(points: DataFrame, questions: DataFrame, bounds: DataFrame, point_id: str, query_id: str, k: int, schema: T.StructType, score, block: int) -> tuple[DataFrame, DataFrame]:
    """(ranked hits, visited pairs of question and group). ``points`` carry their group _g, ``bounds`` are query_id, _g,
    bound, _before."""
    pairs = materialize(bounds, "search-bounds")
    free_shuffles(points.sparkSession)
    first = pairs.filter(F.col("_before") < k).withColumn("_kth", F.lit(None).cast("double"))
    # Few questions begin with the same group.
    largest = first.groupBy("_g").count().agg(F.max("count")).first()[0] or 1
    hits = materialize(_tiles(points, questions, first, point_id, query_id, k, schema, score, -(-largest // block)), "search-hits")
    free_shuffles(points.sparkSession)
    kth = _rank(hits, query_id, point_id, k).filter(F.col("rank") == k).select(query_id, F.col("score").alias("_kth"))
    rest = pairs.filter(F.col("_before") >= k).join(kth, query_id, "left").filter(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - SLACK))
    rest = materialize(rest, "search-visits")
    free_shuffles(points.sparkSession)
    more = _tiles(points, questions, rest, point_id, query_id, k, schema, score, max(1, -(-questions.count() // block)))
    return _rank(hits.unionByName(more), query_id, point_id, k), first.unionByName(rest)


def _rank(hits: DataFrame, query_id: str, point_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(point_id))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _schema(points: DataFrame, questions: DataFrame, query_id: str, point_id: str) -> T.StructType:
    return T.StructType([
        T.StructField(query_id, questions.schema[query_id].dataType), T.StructField(point_id, points.schema[point_id].dataType),
        T.StructField("score", T.DoubleType())])


def _unit(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1 if rows else 0)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size == 0, 1, size)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros((len(units), 0))
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def _far_apart(units: np.ndarray, number: int) -> np.ndarray:
    """So many of the vectors, each the farthest from those before it."""
    chosen = [0] if len(units) else []
    nearest = units @ units[0] if len(units) else np.zeros(0)
    while len(chosen) < min(number, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _around_pivots(stored: DataFrame, asked: DataFrame, point_id: str, query_id: str, group: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(points with their group, bounds): points go to the nearest pivot; pivots are far apart among the points with the
    smallest hashes, and one with many points has several groups of equal radius."""
    number = min(pivots, -(-stored.count() // group))
    sample = stored.withColumn("_h", F.xxhash64(point_id)).orderBy("_h", point_id).limit(SPREAD * max(1, number)).select("_v").toArrow()
    centres = _far_apart(_unit(sample.column("_v"), sample.num_rows), number)
    placed_schema = T.StructType([*stored.schema, T.StructField("_c", T.IntegerType()), T.StructField("_a", T.DoubleType())])

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_unit(batch.column("_v"), batch.num_rows), centres)
                nearest = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32()), pa.array(angles[np.arange(len(nearest)), nearest])], placed_schema.names)

    placed = materialize(stored.mapInArrow(place, placed_schema), "search-placed")
    # At most ``pivots`` rows.
    found = {r["_c"]: (r["n"], r["radius"]) for r in placed.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.max("_a").alias("radius")).collect()}
    parts = [-(-found[c][0] // group) if c in found else 0 for c in range(number)]
    starts = np.cumsum([0, *parts])[:-1]
    of = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), F.col("_c"))
    grouped = placed.select(point_id, "_v", (of(starts) + F.pmod(F.xxhash64(point_id, F.lit(3)), of([max(1, n) for n in parts]))).cast("bigint").alias("_g"))
    owner = np.repeat(np.arange(number), np.array(parts, int))
    radius = np.array([found[c][1] if c in found else 0.0 for c in range(number)], float)
    bound_schema = T.StructType([asked.schema[query_id], T.StructField("_g", T.LongType()), T.StructField("bound", T.DoubleType())])

    def bound(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                most = np.cos(np.maximum(_angles(_unit(part.column("_v"), part.num_rows), centres) - radius, 0))[:, owner]
                ids = part.column(query_id).take(pa.array(np.repeat(np.arange(part.num_rows), len(owner))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(len(owner)), part.num_rows)), pa.array(most.ravel())], bound_schema.names)

    return grouped, asked.mapInArrow(bound, bound_schema)


def dense_search(points: DataFrame, questions: DataFrame, k: int, point_id: str = "point_id", query_id: str = "query_id",
                 vector: str = "dense", query_vector: str = "dense", group: int | None = None, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(the k points with the highest cosine per question: query_id, point_id, score, rank; the pairs of question and
    group that were scored)."""

    def score(left: pa.Table, right: pa.Table, top: _TopK) -> None:
        queries = _unit(left.column("_v"), left.num_rows)
        for at in range(0, right.num_rows, STEP):
            part = right.slice(at, STEP)
            top.add(np.round(queries @ _unit(part.column("_v"), part.num_rows).T, SCORE_DIGITS), _ids(part.column(point_id).combine_chunks()))

    stored = points.filter(F.col(vector).isNotNull()).select(point_id, F.col(vector).alias("_v"))
    asked = questions.filter(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).alias("_v"))
    # Vectors may be costly to make, and are read several times.
    stored, asked = materialize(stored, "search-points"), materialize(asked, "search-questions")
    grouped, bounds = _around_pivots(stored, asked, point_id, query_id, group or GROUP, pivots)
    return _search(grouped, asked, _in_order(bounds, grouped, query_id), point_id, query_id, k, _schema(points, questions, query_id, point_id), score, block)


def dense_topk(points: DataFrame, questions: DataFrame, k: int, point_id: str = "point_id", query_id: str = "query_id", vector: str = "dense", query_vector: str = "dense", **sizes) -> DataFrame:
    """The hits of ``dense_search``. Filter the points before calling; a filter does not commute with top-k."""
    return dense_search(points, questions, k, point_id, query_id, vector, query_vector, **sizes)[0]


def _by_signature(stored: DataFrame, point_id: str, group: int) -> DataFrame:
    """Points with their group: neighbours in the order of the least hashes of their terms, so that points with common
    terms lie together."""
    groups = max(1, -(-stored.count() // group))
    least = lambda seed: F.array_min(F.transform("_i", lambda t: F.xxhash64(t, F.lit(seed))))
    signed = stored.select("*", least(1).alias("_s"), least(2).alias("_t"))
    dealt = signed.repartitionByRange(groups, "_s", "_t", point_id) if groups > 1 else signed.coalesce(1)
    return materialize(dealt.select(point_id, "_i", "_v", F.spark_partition_id().cast("bigint").alias("_g")), "search-groups")


def _rows_of_terms(vectors: DataFrame, terms: int) -> int:
    """How many of the vectors have so many terms."""
    mean = vectors.agg(F.avg(F.size("_i"))).first()[0] or 1
    return max(1, int(terms / max(1, mean)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of every run i, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def group_index(grouped: DataFrame) -> DataFrame:
    """The inverted index of groups: term, _g, low, high (extreme weights of the term in the group)."""
    postings = grouped.select("_g", F.inline(F.arrays_zip(F.col("_i").alias("term"), F.col("_v").alias("weight"))))
    return postings.groupBy("term", "_g").agg(F.min("weight").alias("low"), F.max("weight").alias("high"))


def _sparse_bounds(grouped: DataFrame, asked: DataFrame, query_id: str) -> DataFrame:
    """query_id, _g, bound of the groups that share a term with a question. A point of the group may have the term
    or not, so a term adds the largest of nothing and its extreme weights."""
    blocks = max(1, -(-asked.count() // BLOCK_OF_BOUNDS))
    some = F.floor(F.col("_g") / GROUPS_OF_BOUNDS).alias("_p")
    index = group_index(grouped).select("*", some, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    schema = T.StructType([asked.schema[query_id], T.StructField("_g", T.LongType()), T.StructField("bound", T.DoubleType())])
    out_schema = to_arrow_schema(schema)

    def bound(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [right.column(c).to_numpy() for c in ("term", "_g", "low", "high")]
        order = np.argsort(columns[0])
        stored, of, low, high = (c[order] for c in columns)
        groups, of = np.unique(of, return_inverse=True)
        # Rows of one id are one question.
        ids = left.column(query_id).combine_chunks().dictionary_encode()
        terms, rows = _flat(left.column("_i").combine_chunks())
        weights, _rows = _flat(left.column("_v").combine_chunks())
        rows = ids.indices.fill_null(-1).to_numpy()[rows]
        order = np.argsort(rows, kind="stable")[np.count_nonzero(rows < 0):]
        terms, weights, rows, questions = terms[order], weights[order], rows[order], len(ids.dictionary)
        starts = np.searchsorted(stored, terms)
        counts = np.searchsorted(stored, terms, "right") - starts
        firsts = np.searchsorted(rows, np.arange(questions + 1))
        pairs = np.concatenate([[0], np.cumsum(counts)])[firsts]
        found, begin = [], 0
        while begin < questions:
            # So many questions that neither what is spelled out nor the sums grow with the block.
            end = min(max(begin + 1, int(np.searchsorted(pairs, pairs[begin] + PAIRS, "right")) - 1), begin + max(1, PAIRS // max(1, len(groups))), left.num_rows)
            here = slice(firsts[begin], firsts[end])
            e, w = _ranges(starts[here], counts[here]), np.repeat(weights[here], counts[here])
            cell = np.repeat(rows[here] - begin, counts[here]) * len(groups) + of[e]
            cells = (end - begin) * len(groups)
            most = np.bincount(cell, np.maximum(np.maximum(w * low[e], w * high[e]), 0), minlength=cells)
            met = np.flatnonzero(np.bincount(cell, minlength=cells))
            found.append((met // max(1, len(groups)) + begin, groups[met % max(1, len(groups))], most[met]))
            begin = end
        row, group, most = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table([ids.dictionary.take(pa.array(row)), pa.array(group), pa.array(most)], schema=out_schema)

    parts = grouped.select(some).distinct()
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_b")
    dealt = asked.select("*", block).crossJoin(materialize(parts, "search-parts"))
    return dealt.groupBy("_b", "_p").cogroup(index.groupBy("_b", "_p")).applyInArrow(bound, schema)


def _bit(term: Column) -> Column:
    """The place of a term in the bitmap; term ids are hashes."""
    return F.pmod(term, F.lit(64 * ASKED_WORDS))


def asked_terms(asked: DataFrame) -> Column:
    """An array of ASKED_WORDS numbers whose bits say which terms the questions have, as a subquery of fixed size. More
    questions let more other terms through, which add nothing to a score."""
    bits = asked.select(F.explode("_i").alias("t")).select(_bit(F.col("t")).alias("s")).groupBy(F.shiftright("s", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    every = asked.sparkSession.range(ASKED_WORDS).join(bits, F.col("id") == F.col("i"), "left").select("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x.b).alias("bits")).scalar()


def _parts(df: DataFrame, id_: str, vector: str, asked: DataFrame | None = None) -> DataFrame:
    """The terms _i and weights _v of the vectors that are not null; next to ``asked`` only the terms that some question may
    have, and only vectors with such terms. A vector is used in one expression, with no filter that is pushed below it:
    vectors may be costly to make, and would be made once for each use."""
    if asked is None:
        entries = F.filter(F.array(vector), lambda v: v.isNotNull())
        return df.select(id_, F.inline(entries)).select(id_, F.col("indices").alias("_i"), F.col("values").alias("_v"))
    place = lambda x: _bit(x["indices"])
    met = lambda x: F.getbit(F.get(F.col("_bits"), F.shiftright(place(x), 6).cast("int")), place(x).bitwiseAND(F.lit(63)).cast("int")) == 1
    kept = F.transform(F.array(vector), lambda v: F.filter(F.arrays_zip(v["indices"], v["values"]), met))
    entries = F.transform(F.filter(kept, lambda p: F.size(p) > 0), lambda p: F.struct(p["indices"].alias("_i"), p["values"].alias("_v")))
    return df.withColumn("_bits", asked_terms(asked)).select(id_, F.inline(entries))


class _Entries:
    """The vectors of one side of a tile; ``place`` are places in the vocabulary of the questions, -1 for other terms."""

    def __init__(self, table: pa.Table, place: np.ndarray, terms: int):
        sizes = np.nan_to_num(table.column("_i").combine_chunks().value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
        self.place, self.terms, self.size = place, terms, sizes
        self.start, self.weights = np.cumsum(sizes) - sizes, table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def alike(self, rank: np.ndarray) -> np.ndarray:
        """Rows in the order of their most common term, long ones last: neighbours share terms, and lack the same ones."""
        first, some = np.full(len(self.size), self.terms), np.flatnonzero(self.size)
        if len(some):
            first[some] = np.minimum.reduceat(np.append(rank, self.terms)[self.place], self.start[some])
        return np.lexsort((self.size, first))

    def run(self, rows: np.ndarray) -> _Run:
        return _Run(self, rows)


class _Run:
    """Some rows of a side by term: the n-th of ``terms`` has the entries ``start`` to ``start + size`` of ``rows`` and
    ``weights``."""

    def __init__(self, side: _Entries, rows: np.ndarray):
        e = _ranges(side.start[rows], side.size[rows])
        place, row = side.place[e], np.repeat(np.arange(len(rows), dtype=np.int32), side.size[rows])
        order = np.argsort(place)
        order = order[np.searchsorted(place[order], 0):]
        place = place[order]
        self.n, self.rows, self.weights = len(rows), row[order], side.weights[e[order]]
        self.start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, int)
        self.size, self.terms = np.diff(np.append(self.start, len(place))), place[self.start]


def _places(terms: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places of terms in a sorted vocabulary, -1 where it lacks them, made in parts: tiles are large."""
    place = np.empty(len(terms), np.int32)
    for begin in range(0, len(terms), PAIRS):
        part = terms[begin:begin + PAIRS]
        near = np.minimum(np.searchsorted(vocabulary, part), len(vocabulary) - 1)
        place[begin:begin + PAIRS] = np.where(vocabulary[near] == part, near, -1)
    return place


def _score_terms(left: pa.Table, right: pa.Table, top: _TopK, point_id: str) -> None:
    """The dot products of a tile: runs of similar questions next to runs of similar points. Terms that many pairs of a run
    share are scored by matrix products, others pair by pair; questions whose kth score no point of a run can reach pass it over."""
    terms = left.column("_i").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if not len(terms):
        return
    vocabulary = np.unique(terms)
    count, place = len(vocabulary), _places(terms, vocabulary)
    rank = np.empty(count, np.int32)
    rank[np.argsort(-np.bincount(place, minlength=count), kind="stable")] = np.arange(count)
    asked = _Entries(left, place, count)
    of_question = asked.alike(rank)
    runs = [(rows, asked.run(rows)) for rows in np.split(of_question, range(ROWS, len(of_question), ROWS))]
    terms = right.column("_i").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    place = _places(terms, vocabulary)
    stored = _Entries(right, place, count)
    of_point, ids = stored.alike(rank), _ids(right.column(point_id).combine_chunks())
    step, at = max(1, CELLS // min(ROWS, left.num_rows)), np.full(count, -1)
    for rows in np.split(of_point, range(step, len(of_point), step)):
        points = stored.run(rows)
        if not len(points.terms):
            continue
        low, high = np.minimum.reduceat(points.weights, points.start), np.maximum.reduceat(points.weights, points.start)
        at[points.terms] = np.arange(len(points.terms))
        for whose, questions in runs:
            known = at[questions.terms]
            met = np.flatnonzero(known >= 0)
            known = known[met]
            # What a question can score here at most.
            e, w = _ranges(questions.start[met], questions.size[met]), np.repeat(known, questions.size[met])
            most = np.bincount(questions.rows[e], np.maximum(np.maximum(questions.weights[e] * low[w], questions.weights[e] * high[w]), 0), minlength=questions.n)
            wanted = np.flatnonzero((most > 0) & (most >= top.edge[whose] - SLACK))
            if len(wanted):
                _add(top, _products(questions, met, wanted, points, known), whose[wanted], ids[rows])
        at[points.terms] = -1


def _products(asked: _Run, met: np.ndarray, wanted: np.ndarray, stored: _Run, known: np.ndarray) -> np.ndarray:
    """The dot products of the ``wanted`` questions of a run and the points of a run: the terms ``met`` of the questions are
    the terms ``known`` of the points."""
    questions, points, line = len(wanted), stored.n, np.full(asked.n, -1)
    line[wanted] = np.arange(questions)
    e, sizes = _ranges(asked.start[met], asked.size[met]), asked.size[met]
    row = line[asked.rows[e]]
    owner = np.repeat(np.arange(len(met)), sizes)[row >= 0]
    weights, row = asked.weights[e][row >= 0], row[row >= 0]
    sizes = np.bincount(owner, minlength=len(met))
    starts = np.cumsum(sizes) - sizes
    shared = sizes * stored.size[known]
    heavy = np.argsort(-shared, kind="stable")[:HEAVY]
    heavy = heavy[(shared[heavy] > 0) & (shared[heavy] * COMMON >= questions * points)]
    mine, theirs = np.zeros((questions, len(heavy))), np.zeros((len(heavy), points))
    e = _ranges(starts[heavy], sizes[heavy])
    mine[row[e], np.repeat(np.arange(len(heavy)), sizes[heavy])] = weights[e]
    e = _ranges(stored.start[known[heavy]], stored.size[known[heavy]])
    theirs[np.repeat(np.arange(len(heavy)), stored.size[known[heavy]]), stored.rows[e]] = stored.weights[e]
    scores = mine @ theirs
    flat = scores.reshape(-1)
    shared[heavy] = 0
    own, other = starts, stored.start[known]
    some = np.flatnonzero(shared >= FEW)
    for a, n, b, m in zip(own[some].tolist(), sizes[some].tolist(), other[some].tolist(), stored.size[known[some]].tolist()):
        np.add.at(flat, (row[a:a + n, None] * points + stored.rows[b:b + m]).ravel(), (weights[a:a + n, None] * stored.weights[b:b + m]).ravel())
    # Every other (entry of a question, entry of a point) pair, so many pairs at a time.
    rare = np.flatnonzero((shared > 0) & (shared < FEW))
    e = _ranges(own[rare], sizes[rare])
    n, begin = np.repeat(stored.size[known[rare]], sizes[rare]), np.repeat(other[rare], sizes[rare])
    step = max(1, PAIRS // FEW)
    for at in range(0, len(e), step):
        here, many = e[at:at + step], n[at:at + step]
        d = _ranges(begin[at:at + step], many)
        np.add.at(flat, np.repeat(row[here] * points, many) + stored.rows[d], np.repeat(weights[here], many) * stored.weights[d])
    return scores


def _add(top: _TopK, scores: np.ndarray, questions: np.ndarray, ids: np.ndarray) -> None:
    """The scores above zero that may be among the best of their questions."""
    edge = top.edge[questions]
    if scores.shape[1] > top.k and len(none := np.flatnonzero(np.isneginf(edge))):
        # Cut by score alone, where there are more than k.
        none = none[np.count_nonzero(scores[none] > 0, axis=1) > top.k]
        edge[none] = np.partition(scores[none], -top.k, axis=1)[:, -top.k]
    # Ties of rounded scores at the edge stay in.
    found = np.flatnonzero(scores >= np.maximum(edge - 2 * 10.0**-SCORE_DIGITS, 0)[:, None])
    best = np.round(scores.reshape(-1)[found], SCORE_DIGITS)
    row = found // scores.shape[1]
    kept = (best > 0) & (best >= top.edge[questions][row])
    top.found(questions[row[kept]], best[kept], ids[found[kept] % scores.shape[1]])


def sparse_search(points: DataFrame, questions: DataFrame, k: int, point_id: str = "point_id", query_id: str = "query_id",
                  vector: str = "sparse", query_vector: str = "sparse", group: int | None = None, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the k points with the highest dot product of term weights per question, the pairs of question and group that
    were scored). Points that share no term with a question are no hits."""

    def score(left: pa.Table, right: pa.Table, top: _TopK) -> None:
        _score_terms(left, right, top, point_id)

    asked = materialize(_parts(questions, query_id, query_vector), "search-questions")
    stored = materialize(_parts(points, point_id, vector, asked), "search-points")
    group = group or max(GROUP, min(LARGEST_GROUP, _rows_of_terms(stored, TERMS_OF_POINTS), stored.count() // GROUPS))
    grouped = _by_signature(stored, point_id, group)
    bounds = _in_order(_sparse_bounds(grouped, asked, query_id), grouped, query_id)
    return _search(grouped, asked, bounds, point_id, query_id, k, _schema(points, questions, query_id, point_id), score, block or min(LARGEST_BLOCK, _rows_of_terms(asked, TERMS)))


def sparse_topk(points: DataFrame, questions: DataFrame, k: int, point_id: str = "point_id", query_id: str = "query_id", vector: str = "sparse", query_vector: str = "sparse", **sizes) -> DataFrame:
    """The hits of ``sparse_search``."""
    return sparse_search(points, questions, k, point_id, query_id, vector, query_vector, **sizes)[0]


def normalize(hits: DataFrame, by: list[str], score: str = "score", out: str = "norm") -> DataFrame:
    """Min-max scores per group; equal scores all become 1. Groups are top-k lists."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("_lo", low).withColumn("_hi", high).withColumn(
        out, F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    ).drop("_lo", "_hi")


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, dense_weight: float, sparse_weight: float, threshold: float, top_k: int,
         point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """Weighted sum of the normalised branches; a point missing from a branch gets 0 there.
    The branches are stacked and grouped by (question, point): one exchange, no full join."""
    lit = lambda v: F.lit(float(v))
    return _fused(dense_hits, sparse_hits, lit(dense_weight), lit(sparse_weight), lit(threshold), F.lit(top_k), None, point_id, query_id)


def fuse_by(dense_hits: DataFrame, sparse_hits: DataFrame, settings: DataFrame, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """``fuse`` with each question's own dense_weight, sparse_weight, threshold, top_k and per_branch: the hits are those of
    a search at the largest ``per_branch``, of which a question takes its own."""
    own = [F.max(c) for c in ("dense_weight", "sparse_weight", "threshold", "top_k")]
    cut = lambda hits: hits.join(settings, query_id).filter(F.col("rank") <= F.col("per_branch"))
    return _fused(cut(dense_hits), cut(sparse_hits), *own, ["dense_weight", "sparse_weight", "threshold", "top_k"], point_id, query_id)


def _fused(dense_hits: DataFrame, sparse_hits: DataFrame, dense_weight, sparse_weight, threshold, top_k, carried: list[str] | None, point_id: str, query_id: str) -> DataFrame:
    names = [query_id, point_id, "score", *(carried or [])]
    both = dense_hits.select(*names, F.lit("dense").alias("branch")).unionByName(sparse_hits.select(*names, F.lit("sparse").alias("branch")))
    norm = normalize(both, [query_id, "branch"])
    part = lambda name: F.coalesce(F.max(F.when(F.col("branch") == name, F.col("norm"))), F.lit(0.0))
    total = F.round(dense_weight * part("dense") + sparse_weight * part("sparse"), SCORE_DIGITS)
    fused = norm.groupBy(query_id, point_id).agg(total.alias("score"), threshold.alias("_threshold"), top_k.alias("_top_k")).filter(F.col("score") >= F.col("_threshold"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(point_id))
    ranked = fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("_top_k"))
    return ranked.drop("_threshold", "_top_k")


def hybrid_search(points: DataFrame, questions: DataFrame, per_branch: int = 50, dense_weight: float = 0.5, sparse_weight: float = 0.5,
                  threshold: float = 0.0, top_k: int = 10, source_type: str | None = None,
                  point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """Dense and sparse top-k fused. ``points`` and ``questions`` carry ``dense`` and
    ``sparse``; a source type filters both branches before their top-k."""
    pool = points if source_type is None else points.filter(F.col("source_type") == source_type)
    return fuse(
        dense_topk(pool, questions, per_branch, point_id, query_id), sparse_topk(pool, questions, per_branch, point_id, query_id),
        dense_weight, sparse_weight, threshold, top_k, point_id, query_id)


def hybrid_search_by(points: DataFrame, questions: DataFrame, settings: DataFrame, source_type: str | None = None, point_id: str = "point_id", query_id: str = "query_id") -> DataFrame:
    """``hybrid_search`` with settings as a table: query_id and the columns that ``fuse_by`` reads. One search at the
    largest ``per_branch`` serves all questions, however many settings there are."""
    most = settings.agg(F.max("per_branch")).first()[0] or 1
    pool = points if source_type is None else points.filter(F.col("source_type") == source_type)
    return fuse_by(dense_topk(pool, questions, most, point_id, query_id), sparse_topk(pool, questions, most, point_id, query_id), settings, point_id, query_id)


def encode_questions(questions: DataFrame, text: str = "text", **params) -> DataFrame:
    """Questions go through the document encoder."""
    return sparse_vector(questions, text, **params)
