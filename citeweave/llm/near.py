"""Near-duplicate documents by bottom-k sketches, exact at the end.

A document's set are its distinct five-word shingles (lower-cased A-Z; a shorter text is one shingle), named by 64-bit
hashes. One hash function serves all: the sketch is the ``K`` smallest names. Documents with equal sets form a class
first, and only the class's smallest document goes on.

Candidates. Two sets of similarity 0.75 share each of the K smallest names of their union with probability 0.75 at
least, so they share fewer than ``SHARED`` = 24 of 64 retained names with a probability below 1e-10 (and none is lost
where both sets are retained whole). Hence it is enough to list a document under its rarest retained names, all but the
``SHARED`` - 1 most frequent: linked documents still meet in one inverted list. Passages and lines that many documents
share never make long lists that way, unless they dominate the documents.

Short lists give their pairs. Documents in a list longer than ``SHORT`` - large groups of near copies - are listed
again, now by their full sets: rarest shingles first, only the places that a linked pair must share (a pair of sizes x, y has to share
3/7 (x + y), so a shingle at place p admits partners of up to (4x - 7p) / 3). Each such list first meets its most
typical member, which settles nearly all of a group in as many checks as it has members; what is still apart then
meets pair by pair, except that members of a list's largest component need not meet each other. No pair is dropped and
none within a settled group is formed.

Checks. A pair's union sketch must show ``SHARED`` common names of the K smallest, then the full sets decide: 100 *
common >= 75 * united. Components follow from the links; the smallest document id names a component.

Defined results: a null or empty text, or one of white space, has an empty set, links with nothing and is kept. Rows
with a null ``doc_id`` take no part: component null, kept true. Rows that repeat a ``doc_id`` are one document with the
links of all its texts. Other columns are ignored, and ``keep_first`` carries them through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .arrays import LOWER, Rolling, flat, per_document, signed, slices, words
from .graph import components

WIDTH = 5
K = 64
SHARED = 24
SHORT = 16


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle names of each text."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, doc = words(data, offsets)
    place = per_document(doc, len(offsets) - 1)
    rolling = Rolling(2).load(Rolling(1).load(data).ranges(starts, ends))
    at = np.arange(max(0, len(starts) - width + 1))
    full = signed(rolling.ranges(at, at + width))
    out = []
    for a, z in zip(place[:-1].tolist(), place[1:].tolist()):
        if z - a >= width:
            out.append(np.unique(full[a : z - width + 1]))
        else:
            out.append(signed(rolling.ranges(np.array([a]), np.array([z]))) if z > a else np.zeros(0, np.int64))
    return out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    return pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum([len(s) for s in sets]))), np.concatenate([*sets, np.zeros(0, np.int64)])).cast(pa.list_(pa.int64()))


def sketches(documents: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """The ids (long columns beside text), n (size of the set), s1, s2 (a digest of the set), sketch."""

    names = [c for c in documents.columns if c != "text"]

    def run(batches):
        for batch in slices(batches):
            sets = _sets(batch.column("text"), width)
            joined = np.concatenate([*sets, np.zeros(0, np.int64)]).view(np.uint64)
            ends = np.cumsum([len(s) for s in sets])
            digests = [pa.array(signed(Rolling(seed).load(joined).ranges(ends - [len(s) for s in sets], ends))) for seed in (8, 9)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(s) for s in sets], pa.int64()), *digests, _lists([s[:k] for s in sets])], [*names, "n", "s1", "s2", "sketch"])

    return documents.select(*names, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n long, s1 long, s2 long, sketch array<long>")


def _full_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc, n, names of the documents whose key is in ``ids`` (doc)."""
    rows = documents.select(F.col("key").alias("doc"), "text").join(ids, "doc", "left_semi")

    def run(batches):
        for batch in slices(batches):
            sets = _sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["doc", "n", "names"])

    return rows.mapInArrow(run, "doc long, n long, names array<long>")


def _rarest(postings: DataFrame, counts: Column, keep: Column) -> DataFrame:
    """Postings (doc, n, v, ...) that are shared, with their place among the document's names, rarest first.
    ``counts``: how many names the document has; ``keep``: how many places count."""
    shared = postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    mine = postings.join(shared, "v").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("names"), F.sum("c").alias("total"))
    mine = mine.withColumn("alone", counts - F.size("names"))
    placed = mine.select("doc", "n", (F.col("total") / F.col("n")).alias("typical"), "alone", F.posexplode(F.slice("names", 1, F.greatest(F.lit(0), (keep - F.col("alone"))).cast("int"))).alias("i", "name"))
    return placed.select("doc", "n", "typical", (F.col("alone") + F.col("i")).alias("place"), F.col("name.v").alias("v"))


def _check(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs a, b."""
    left, right = sets.select(F.col("doc").alias("a"), F.col("names").alias("x")), sets.select(F.col("doc").alias("b"), F.col("names").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    united = F.slice(F.array_sort(F.array_union(F.slice("x", 1, K), F.slice("y", 1, K))), 1, K)
    seen = F.size(F.array_intersect(F.array_intersect(F.slice("x", 1, K), F.slice("y", 1, K)), united))
    likely = seen >= F.least(F.lit(SHARED), F.ceil(0.75 * F.size(united)))
    common = F.when(likely, F.size(F.array_intersect("x", "y"))).otherwise(0)
    return both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("sizes")).where("100 * common >= 75 * (sizes - common) and common > 0").select("a", "b")


def _similar_sizes(x: str, y: str) -> Column:
    return (100 * F.col(x) >= 75 * F.col(y)) & (100 * F.col(y) >= 75 * F.col(x))


def links(documents: DataFrame, leaders: DataFrame, width: int = WIDTH) -> DataFrame:
    """Links a, b between documents of ``leaders`` (doc, n, sketch), enough to connect every component."""
    sizes = F.least("n", F.lit(K))
    postings = leaders.select("doc", "n", F.explode("sketch").alias("v"))
    lists = materialize(_rarest(postings, sizes, sizes - F.least(F.lit(SHARED), F.ceil(0.75 * F.col("n"))) + 1).select("doc", "n", "v"), "near-lists")
    lengths = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m"))
    short = lists.join(lengths.where(f"m between 2 and {SHORT}").select("v"), "v")
    one, two = short.select("v", F.col("doc").alias("a"), F.col("n").alias("x")), short.select("v", F.col("doc").alias("b"), F.col("n").alias("y"))
    pairs = one.join(two, "v").where((F.col("a") < F.col("b")) & _similar_sizes("x", "y")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    pairs = materialize(pairs, "near-pairs")
    crowded = materialize(lists.join(lengths.where(f"m > {SHORT}").select("v"), "v", "left_semi").select("doc").distinct(), "near-crowded")
    # Written first: its size is known then, and where it is small the texts need not be shuffled to it.
    wanted = materialize(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).unionByName(crowded).distinct(), "near-wanted")
    sets = materialize(_full_sets(documents, wanted, width), "near-sets")
    found = materialize(_check(pairs, sets), "near-links")
    if crowded.isEmpty():
        return found
    return found.unionByName(_crowded(materialize(sets.join(crowded, "doc", "left_semi"), "near-crowded-sets")))


def _crowded(sets: DataFrame) -> DataFrame:
    """Links among documents of which many share the same names."""
    postings = sets.select("doc", "n", F.explode("names").alias("v"))
    reach = F.floor((4 * F.col("n") - 7 * F.col("place")) / 3)
    lists = _rarest(postings, F.col("n"), F.floor(F.col("n") / 4) + 1).withColumn("reach", reach)
    lists = materialize(lists.where("4 * reach >= 3 * n"), "near-crowded-lists")
    typical = lists.groupBy("v").agg(F.max(F.struct("typical", "doc", "n", "reach")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    met = lists.join(typical.select("v", F.col("p.doc").alias("p"), F.col("p.n").alias("p_n"), F.col("p.reach").alias("p_reach")), "v").where("doc <> p and n <= p_reach and p_n <= reach")
    first = materialize(_check(met.select(F.least("doc", "p").alias("a"), F.greatest("doc", "p").alias("b")).distinct(), sets), "near-links")
    # What is still apart in a list: everything outside its largest component meets everything else.
    label = components(first)
    named = lists.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    least = named.groupBy("v").agg(F.min("n").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    named = materialize(named.join(least.select("v", "least"), "v").where("reach >= least").select("v", "doc", "n", "reach", "component"), "near-apart")
    parts = named.groupBy("v", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("v").agg(F.max(F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rest = named.join(largest.select("v", F.col("most.component").alias("main")), "v").where("component <> main")
    rest = rest.select("v", F.col("doc").alias("d"), F.col("n").alias("d_n"), F.col("reach").alias("d_reach"), F.col("component").alias("d_component"))
    apart = rest.join(named, "v").where("component <> d_component and n <= d_reach and d_n <= reach")
    second = _check(materialize(apart.select(F.least("doc", "d").alias("a"), F.greatest("doc", "d").alias("b")).distinct(), "near-pairs"), sets)
    return first.unionByName(second)


def _keyed(documents: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, key, text, and whether ids repeat: the key is the id where ids are distinct, else a number of the row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return materialize(rows.withColumn("key", F.monotonically_increasing_id()), "near-keyed"), True
    return rows.withColumn("key", F.col("doc_id")), False


def near_duplicates(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows, repeated = _keyed(documents)
    found = materialize(sketches(rows, width), "near-sketches")
    filled = found.where("n > 0 and doc_id is not null")
    # Equal sets are one class, which its smallest document stands for.
    smallest = F.min(F.struct("doc_id", "key"))
    classes = materialize(filled.groupBy("n", "s1", "s2").agg(smallest.alias("p")).select("n", "s1", "s2", F.col("p.doc_id").alias("first"), F.col("p.key").alias("leader")), "near-classes")
    leaders = filled.join(classes.select(F.col("leader").alias("key")), "key").select(F.col("key").alias("doc"), "n", "sketch")
    pairs = links(rows, leaders, width)
    if repeated:  # the texts of one id belong together, whatever they say
        mine = filled.join(classes.select("n", "s1", "s2", "leader"), ["n", "s1", "s2"]).select("doc_id", "leader")
        pairs = pairs.unionByName(mine.join(mine.groupBy("doc_id").agg(F.min("leader").alias("b")), "doc_id").select(F.col("leader").alias("a"), "b").where("a <> b"))
    label = components(pairs).withColumnRenamed("node", "leader")
    named = classes.join(label, "leader", "left").withColumn("component_id", F.coalesce("component", "leader"))
    if repeated:  # components are named by keys so far; their smallest ids name them for good
        named = materialize(named.withColumnRenamed("component_id", "by"), "near-named")
        named = named.join(named.groupBy("by").agg(F.min("first").alias("component_id")), "by")
    named = named.select("n", "s1", "s2", "component_id")
    out = found.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of all but the documents that are not their component's first, with their columns as they were."""
    gone = materialize(near_duplicates(documents, width).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    return documents.join(gone, documents["doc_id"] == gone["gone"], "left_anti")
