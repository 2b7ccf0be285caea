"""Exact top-k search by histogram selection.

Scores are integer inner products of vectors floored to 1/256 steps. Vectors and queries are dealt into tiles (a group of candidates by
a block of queries), so that a task holds a bounded matrix of each and nobody holds all of either. Every round scores
every tile; instead of scores it sends, for each query, a histogram of the interval in which that query's kth value
must lie, cut below the tile's own kth value. Summed histograms narrow the interval until it is one value wide: the
kth score. A last pass keeps what lies at or above it, ties by smaller id, k rows a tile at most, and ranks those.

Defined results: rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part;
rows that repeat an id are candidates and queries each, and candidates of each other (a query's own row is left out, not its
id); their order among equal scores and ids is that of their keys; empty vectors score 0 with each other; vectors of different lengths are
not compared. A query with fewer than k candidates gets all of them. Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

GROUP = 16_384
BLOCK = 2_048
BUCKETS = 4_096


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point only while every partial sum fits its mantissa."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    bound = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries @ candidates.T


def prepare(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, key (a number of the row), dim and the floored components of every vector that takes part. Write the result
    before it is searched, so that keys stay as they are."""
    parts = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    steps = F.transform("vec", lambda x: F.floor(x * 256.0).cast("long"))
    return parts.where(usable).select("id", F.monotonically_increasing_id().alias("key"), steps.alias("v")).withColumn("dim", F.size("v"))


def _narrowed(k: int, buckets: int):
    """A tile's histograms: query, bucket of the query's interval, count."""

    def run(key, left, right):
        q, c = _matrix(left, "v"), _matrix(right, "v")
        ids, mine = right.column("key").to_numpy(), left.column("key").to_numpy()
        low, width = left.column("low").to_numpy(), left.column("width").to_numpy()
        out = ([], [], [])
        for at in range(0, len(q), 256):
            s = _scores(q[at : at + 256], c)
            own = mine[at : at + 256, None] == ids[None, :]
            for row in range(len(s)):
                r = s[row][~own[row]]
                i = at + row
                r = np.partition(r, len(r) - k)[len(r) - k :] if len(r) > k else r
                r = r[(r >= low[i])]
                b, n = np.unique(np.minimum((r - low[i]) // width[i], buckets), return_counts=True)
                out[0].append(np.full(len(b), mine[i]))
                out[1].append(b)
                out[2].append(n)
        return pa.table({n: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for n, x in zip(("key", "bucket", "n"), out)})

    return run


def _kept(k: int):
    """A tile's best rows at or above each query's kth score."""

    def run(key, left, right):
        q, c = _matrix(left, "v"), _matrix(right, "v")
        ids, keys, mine, low = right.column("id").to_numpy(), right.column("key").to_numpy(), left.column("key").to_numpy(), left.column("low").to_numpy()
        asked = left.column("id").to_numpy()
        out = ([], [], [], [], [])
        for at in range(0, len(q), 256):
            s = _scores(q[at : at + 256], c)
            s_ok = (s >= low[at : at + 256, None]) & (mine[at : at + 256, None] != keys[None, :])
            for row in range(len(s)):
                found = np.flatnonzero(s_ok[row])
                best = found[np.lexsort((keys[found], ids[found], -s[row][found]))[:k]]
                for column, values in zip(out, (np.full(len(best), mine[at + row]), np.full(len(best), asked[at + row]), ids[best], keys[best], s[row][best])):
                    column.append(values)
        return pa.table({n: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for n, x in zip(("query", "query_id", "vec_id", "key", "score"), out)})

    return run


def search(points: DataFrame, queries: DataFrame, k: int = 5, group: int = GROUP, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """query_id, rank, vec_id, score; both sides as ``prepare`` returns them."""
    spark = points.sparkSession
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm")).first()
    groups, blocks = max(1, -(-size["n"] // group)), max(1, -(-asked["n"] // block))
    # Every product lies within plus and minus the largest norms' product.
    reach = int(min(2.0**62, np.sqrt((size["norm"] or 0.0) * (asked["norm"] or 0.0)) * 1.001 + 2))
    candidates = points.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    base = queries.withColumn("b", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def tiles(bounds: DataFrame, run, schema: str) -> DataFrame:
        left = base.join(bounds, "key")
        left, right = left.toDF(*left.columns), candidates.toDF(*candidates.columns)  # the sides come from one table
        return left.groupBy("dim", "g", "b").cogroup(right.groupBy("dim", "g", "b")).applyInArrow(run, schema)

    width = max(1, -(-2 * reach // buckets))
    bounds = queries.select("key", F.lit(-reach).cast("long").alias("low"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("want"))
    while True:
        histogram = tiles(bounds, _narrowed(k, buckets), "key long, bucket long, n long").groupBy("key", "bucket").agg(F.sum("n").alias("n"))
        ordered = F.sort_array(F.collect_list(F.struct("bucket", "n")), asc=False)
        # The bucket in which the counts from the top reach k; with fewer rows than k, everything is kept.
        walk = F.aggregate(
            "h",
            F.struct(F.lit(0).cast("long").alias("above"), F.lit(-1).cast("long").alias("bucket")),
            lambda a, x: F.when(a["above"] >= k, a).otherwise(F.struct((a["above"] + x["n"]).alias("above"), x["bucket"].alias("bucket"))),
        )
        found = histogram.groupBy("key").agg(ordered.alias("h")).select("key", walk.alias("at"))
        low = F.when((F.col("at")["above"] >= k), F.col("low") + F.col("at")["bucket"] * F.col("width")).otherwise(F.lit(-reach))
        bounds = materialize(
            bounds.join(found, "key", "left").select("key", F.coalesce(low, F.lit(-reach)).cast("long").alias("low"), F.lit(max(1, -(-width // buckets))).cast("long").alias("width"), "want"), "topk-bounds"
        )
        if width == 1:
            break
        width = max(1, -(-width // buckets))
    kept = tiles(bounds, _kept(k), "query long, query_id long, vec_id long, key long, score long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "key"))), 1, k)
    ranked = kept.groupBy("query", "query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit")["vec_id"].alias("vec_id"), (-F.col("hit")["s"]).alias("score"))
