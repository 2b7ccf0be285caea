"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier.

Voters look at a text and fire or abstain. Lexicon voters know an insult or its beginning; pattern voters know whole words, or
beginnings of longer words, of three to ``LONGEST`` bytes that are significantly more frequent in toxic texts than in
clean ones of a bounded sample of labelled documents (``SAMPLE`` of either class), and ways of writing. A beginning fits into
two 64-bit numbers, whose hash meets all voters in one sorted search.

The label model explains all votes over all documents by a hidden class: a prior, how often each voter fires in either
class, and how voters depend on each other. Dependences form a forest: the pairs with the most information about each
other within the classes (Chow-Liu), as far as it is significant; a voter's odds are then those given its neighbour's vote,
so that voters that say the same thing do not count twice. Expectation and maximisation alternate; Spark adds up the
expected counts of votes and pairs over distinct vote patterns, and labels of the training part fix the class of their
documents. What reaches the driver are counts by pair of voters, bounded by the number of voters.

The posterior classes, not the labels, train a logistic classifier on votes and a few statistics of the text, over at
most ``FIT`` documents of either side, weighted back to all. The classifier gives the score.

Defined results: a null or empty text fires nothing and is scored like any other; labels that are null or not 0 or 1 are
ignored, of repeated label rows the mean counts; a null ``doc_id`` is scored and never labelled; without labels the
lexicon voters alone start the model. Repeated rows are scored each; other columns are ignored. An empty table gives an
empty result. Only the text enters a score."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .arrays import LOWER, flat, mix, per_document, signed, slices, words

THRESHOLD = 0.5
#: Labelled documents of either class that pattern voters are drawn from, and documents of either side in the classifier's fit.
SAMPLE = 20_000
FIT = 20_000
#: Pattern voters of the model.
PATTERNS = 160
#: How many times as frequent in toxic texts a pattern must be.
LIFT = 4.0
SHORTEST, LONGEST = 3, 14
ROUNDS = 4
#: Weight of all documents without a label together, in weights of those with one.
TRUST = 0.5
RIDGE = 0.002

#: Insults; an entry ending in a space is a whole word, others are words and beginnings.
LEXICON = (
    "arsehole", "asshole", "bastard", "bitch", "clown", "coward", "cretin", "crap ", "dickhead", "disgusting", "dumb ", "dumbass", "fool ", "freak ", "fuck", "garbage", "idiot", "imbecile", "jerk ", "loser",
    "lunatic", "maggot", "moron", "parasite", "pathetic", "pervert", "pig ", "retard", "rubbish", "scum", "shit", "slut", "stupid", "subhuman", "swine", "trash", "ugly ", "useless", "vermin", "whore", "worthless",
    "abruti", "arschloch", "cabrón", "connard", "débile", "dummkopf", "estúpido", "imbécil", "merde", "mierda", "pendejo", "salaud", "scheiß", "trottel", "wichser",
)
#: Ways of writing that vote besides.
HABITS = ("shouts", "exclaims")

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: What the last of the sixteen bytes says.
BEGINS, WHOLE = 1, 2


def key(word: str, kind: int) -> tuple[int, int]:
    """The two numbers of a whole word or of the beginning of a longer one."""
    raw = word.lower().encode()[: LONGEST + 1 if kind == WHOLE else LONGEST].ljust(15, b"\0")
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:] + bytes([kind]), "little")


def _hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(low + mix(high))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word, and its first sixteen bytes in lower case (what lies beyond its end too)."""
    starts, ends, doc = words(data, offsets, ~_LETTER)
    padded = np.append(LOWER[data], np.zeros(16, np.uint8))
    eight = np.ndarray(len(data) + 9, np.uint64, padded, strides=(1,))
    return starts, ends, doc, eight[starts], eight[starts + 8]


def _beginnings(low: np.ndarray, high: np.ndarray, lengths: np.ndarray):
    """The words (indexes) that have such a beginning or are such, and its two numbers."""
    for n in range(SHORTEST, LONGEST + 1):
        which = np.flatnonzero(lengths > n)
        yield which, low[which] & _MASK[min(n, 8)], (high[which] & _MASK[max(n - 8, 0)]) | np.uint64(BEGINS << 56)
    which = np.flatnonzero((lengths >= SHORTEST) & (lengths <= LONGEST + 1))
    n = lengths[which]
    yield which, low[which] & _MASK[np.minimum(n, 8)], (high[which] & _MASK[np.maximum(n - 8, 0)]) | np.uint64(WHOLE << 56)


def _held_out(name: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def gold(labels: DataFrame) -> DataFrame:
    """labelled, gold (share of label 1) of the training part."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled"), "toxic").where(~_held_out("labelled"))
    return rows.groupBy("labelled").agg(F.avg("toxic").alias("gold"))


def _some(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those with the smallest hashes."""
    return rows.withColumn("_h", F.xxhash64(*keys)).orderBy("_h", *keys).limit(n).drop("_h")


def patterns(documents: DataFrame, marks: DataFrame, lexicon: tuple[str, ...] = LEXICON, sample: int = SAMPLE, most: int = PATTERNS) -> list[tuple[int, int]]:
    """Keys of words and beginnings that mark toxic texts in a sample of the labelled ones and that the lexicon does not hold."""
    chosen = materialize(_some(marks.where("gold > 0.5"), sample, "labelled").unionByName(_some(marks.where("gold < 0.5"), sample, "labelled")), "toxicity-sample")
    # At most 2 * sample ids.
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", (F.col("gold") > 0.5).alias("toxic"))

    def run(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            starts, ends, doc, low, high = _words(data, offsets)
            parts = [(a, b, doc[which]) for which, a, b in _beginnings(low, high, ends - starts)]
            low, high, owner = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((owner, high, low))
            low, high, owner = low[order], high[order], owner[order]
            other = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            fresh, again = np.append(True, other)[: len(low)], np.append(True, other | (owner[1:] != owner[:-1]))[: len(low)]
            kind = np.cumsum(fresh)[again] - 1
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            n = int(fresh.sum())
            yes = np.bincount(kind, toxic[owner[again]], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(low[fresh])), pa.array(signed(high[fresh])), pa.array(yes), pa.array(np.bincount(kind, minlength=n) - yes)], ["low", "high", "yes", "no"])

    counts = materialize(texts.mapInArrow(run, "low long, high long, yes long, no long").groupBy("low", "high").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "toxicity-counts")
    sizes = texts.agg(F.count_if("toxic").alias("yes"), F.count_if(~F.col("toxic")).alias("no")).first()
    kinds = counts.count()
    if not sizes["yes"] or not sizes["no"] or not kinds:
        return []

    def part(seen: Column, whole: float, share: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (F.lit(float(whole)) * share))).otherwise(0.0)

    yes, no = F.col("yes").cast("double"), F.col("no").cast("double")
    share = (yes + no) / float(sizes["yes"] + sizes["no"])
    rest = F.greatest(1 - share, F.lit(1e-12))
    gain = 2 * (part(yes, sizes["yes"], share) + part(no, sizes["no"], share) + part(sizes["yes"] - yes, sizes["yes"], rest) + part(sizes["no"] - no, sizes["no"], rest))
    marked = counts.where(yes / float(sizes["yes"]) >= LIFT * (no + 0.5) / float(sizes["no"])).withColumn("gain", F.round(gain, 6)).where(F.col("gain") > 2 * float(np.log(kinds)))
    best = [(r["gain"], _bytes(r["low"], r["high"])) for r in marked.orderBy(F.desc("gain"), "high", "low").limit(40 * most).collect()]
    held = [w.lower().strip().encode()[:LONGEST] for w in lexicon]
    out: list[tuple[bytes, int]] = []
    # Of beginnings that say the same, the longest; nothing that lies within a chosen one or around it.
    for _, (own, kind) in sorted(best, key=lambda x: (-x[0], -len(x[1][0]), x[1])):
        if len(out) < most and not any(o.startswith(own) or own.startswith(o) for o in (*held, *(o for o, _ in out))):
            out.append((own, kind))
    return [(int.from_bytes(o.ljust(8, b"\0")[:8], "little"), int.from_bytes(o.ljust(15, b"\0")[8:15] + bytes([k]), "little")) for o, k in out]


def _bytes(low: int, high: int) -> tuple[bytes, int]:
    raw = (low & (1 << 64) - 1).to_bytes(8, "little") + high.to_bytes(8, "little")
    return raw[:15].rstrip(b"\0"), raw[15]


def voters(documents: DataFrame, marks: DataFrame, lexicon: tuple[str, ...] = LEXICON) -> list[list[tuple[int, int]]]:
    """The keys of every voter that knows words: the lexicon's, then the patterns."""
    known = [[key(w[:-1], WHOLE)] if w.endswith(" ") else [key(w, BEGINS), key(w, WHOLE)] for w in lexicon]
    return known + [[k] for k in patterns(documents, marks, lexicon)]


STATISTICS = ("log_words", "log_hits", "hits", "upper", "exclaimed")


def votes(documents: DataFrame, known: list[list[tuple[int, int]]]) -> DataFrame:
    """doc_id, fired (numbers of the voters that fire), and the statistics of the text."""
    keys = np.array([k for ks in known for k in ks], np.uint64).reshape(-1, 2)
    owner = np.repeat(np.arange(len(known)), [len(ks) for ks in known])
    table = _hash(keys[:, 0], keys[:, 1])
    order = np.argsort(table, kind="stable")
    table, owner = table[order], owner[order]
    m = len(known) + len(HABITS)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fired", T.ArrayType(T.IntegerType())), *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def run(batches):
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            n = len(offsets) - 1
            starts, ends, doc, low, high = _words(data, offsets)
            pairs, hit = [np.zeros(0, np.int64)], np.zeros(len(starts), bool)
            for which, a, b in _beginnings(low, high, ends - starts):
                found = _hash(a, b)
                at = np.minimum(np.searchsorted(table, found), len(table) - 1)
                good = table[at] == found
                hit[which[good]] = True
                pairs.append(doc[which[good]] * m + owner[at[good]])
            n_words = np.diff(per_document(doc, n))
            upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
            exclaimed = np.concatenate(([0], np.cumsum(data == ord("!"))))
            loud = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 2)
            shouted = np.bincount(doc[loud], minlength=n)
            size = np.maximum(np.diff(offsets), 1)
            marks_ = np.diff(exclaimed[offsets])
            pairs.append(np.flatnonzero((shouted > 4) & (shouted * 4 > n_words)) * m + len(known))
            pairs.append(np.flatnonzero((marks_ > 2) & (marks_ * 100 > size)) * m + len(known) + 1)
            fired = np.unique(np.concatenate(pairs))
            ends_of = np.searchsorted(fired // m, np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(fired % m, pa.int32()))
            hits = np.bincount(doc[hit], minlength=n)
            stats = [np.log1p(n_words), np.log1p(hits), hits / np.maximum(n_words, 1), np.diff(upper[offsets]) / size, marks_ / size]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, *(pa.array(s.astype(float)) for s in stats)], schema.names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _dense(column: pa.Array, m: int) -> np.ndarray:
    """A row of zeros and ones for each list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), m), np.float32)
    lengths = np.diff(column.offsets.to_numpy())
    out[np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy()] = 1
    return out


@dataclass
class LabelModel:
    """Log-odds of the prior and of each vote given the vote of the voter it leans on (-1: none)."""

    prior: float
    odds: np.ndarray  # [voter, 2 * neighbour's vote + own vote]
    leans: np.ndarray
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))

    def log_odds(self, fired: np.ndarray) -> np.ndarray:
        with_none = np.column_stack([fired, np.zeros(len(fired), fired.dtype)])
        at = (fired + 2 * with_none[:, self.leans]).astype(np.int64)
        return self.prior + self.odds[np.arange(fired.shape[1])[None, :], at].sum(axis=1)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(fired), -40, 40)))


def _start(m: int, lexicon: int) -> LabelModel:
    """Before any count: a tenth is toxic, lexicon voters are right, others say nothing."""
    odds = np.zeros((m, 4))
    odds[:lexicon, 0] = odds[:lexicon, 2] = np.log((1 - 0.01) / (1 - 0.0001))
    odds[:lexicon, 1] = odds[:lexicon, 3] = np.log(0.01 / 0.0001)
    return LabelModel(float(np.log(0.1 / 0.9)), odds, np.full(m, -1))


def expected(kinds: DataFrame, model: LabelModel, open_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Expected numbers of documents by class, and by class and pair of voters that both fire. ``kinds``: fired, gold, n.
    Documents without a label count ``open_weight``."""
    m = len(model.odds)

    def run(batches):
        total, pair = np.zeros(2), np.zeros((2, m, m))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                v = _dense(part.column("fired"), m)
                fixed = part.column("gold").to_numpy(zero_copy_only=False).astype(float)
                p = np.where(np.isnan(fixed), model.posterior(v), fixed)
                n = part.column("n").to_numpy() * np.where(np.isnan(fixed), open_weight, 1.0)
                for y, w in ((0, n * (1 - p)), (1, n * p)):
                    total[y] += w.sum()
                    pair[y] += v.T @ (v * w[:, None].astype(np.float32))
        y, i, j = np.nonzero(np.triu(pair))
        y, i, j, s = np.append(y, [0, 1]), np.append(i, [-1, -1]), np.append(j, [-1, -1]), np.append(pair[y, i, j], total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (y, i, j)] + [pa.array(s)], ["y", "i", "j", "s"])

    rows = kinds.mapInArrow(run, "y int, i int, j int, s double").groupBy("y", "i", "j").agg(F.sum("s").alias("s")).collect()
    total, pair = np.zeros(2), np.zeros((2, m, m))
    for r in rows:
        if r["i"] < 0:
            total[r["y"]] = r["s"]
        else:
            pair[r["y"], r["i"], r["j"]] = pair[r["y"], r["j"], r["i"]] = r["s"]
    return total, pair


def forest(total: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """For each voter the one it leans on: a maximum spanning forest of information within the classes."""
    m = pair.shape[1]
    gain = np.zeros((m, m))
    for y in (0, 1):
        n = total[y] + 2.0
        single = np.diag(pair[y])
        both = pair[y] + 0.02
        a, b = single[:, None] + 0.1, single[None, :] + 0.1
        for seen, p, q in ((both, a, b), (a - both, a, n - b), (b - both, n - a, b), (n - a - b + both, n - a, n - b)):
            seen, p, q = (np.maximum(x, 1e-9) for x in (seen, p, q))
            gain += seen * np.log(seen * n / (p * q))
    np.fill_diagonal(gain, 0)
    needed = np.log(max(total.sum(), 2)) + np.log(max(m, 2))
    leans, reached = np.full(m, -1), np.zeros(m, bool)
    best, source = np.full(m, -np.inf), np.full(m, -1)
    for _ in range(m):
        free = np.flatnonzero(~reached)
        i = int(free[np.argmax(best[free])])
        reached[i] = True
        if best[i] > needed:
            leans[i] = source[i]
        better = ~reached & (gain[i] > best)
        best[better], source[better] = gain[i][better], i
    return leans


def belief(m: int, lexicon: int) -> np.ndarray:
    """Votes added to those counted, by class and voter: lexicon voters are thought right until they are seen to err."""
    out = np.full((2, m), 0.05)
    out[:, :lexicon] = [[0.001], [0.1]]
    return out


def maximised(total: np.ndarray, pair: np.ndarray, leans: np.ndarray, added: np.ndarray) -> LabelModel:
    m = len(leans)
    odds, rates = np.zeros((m, 4)), np.zeros((2, m))
    for y, sign in ((0, -1), (1, 1)):
        single = np.diag(pair[y])
        rates[y] = (single + added[y]) / (total[y] + 1)
        for j in range(m):
            a = leans[j]
            if a < 0:
                p = np.array([rates[y, j]] * 2)
            else:
                none = (single[j] - pair[y, j, a] + added[y, j]) / (total[y] - single[a] + 1)
                p = np.array([none, (pair[y, j, a] + 2 * rates[y, j]) / (single[a] + 2)])
            p = np.clip(p, 1e-9, 1 - 1e-9)
            odds[j] += sign * np.log(np.array([1 - p[0], p[0], 1 - p[1], p[1]]))
    prior = float(np.log((total[1] + 0.5) / (total[0] + 0.5)))
    return LabelModel(prior, odds, leans, rates)


def label_model(kinds: DataFrame, m: int, lexicon: int, rounds: int = ROUNDS, trust: float = TRUST) -> LabelModel:
    """The model after some rounds. ``kinds``: fired, gold, n (distinct vote patterns). Labelled documents start it and
    find the dependences; all others together weigh ``trust`` times as much as they. Without labels the lexicon starts it."""
    sizes = {r["known"]: r["n"] for r in kinds.groupBy(F.col("gold").isNotNull().alias("known")).agg(F.sum("n").alias("n")).collect()}
    total, pair = expected(kinds.where("gold is not null"), _start(m, lexicon))
    weight = min(1.0, trust * sizes.get(True, 0) / max(sizes.get(False, 0), 1))
    if total.min() < 1:
        weight = 1.0
        total, pair = expected(kinds, _start(m, lexicon))
    model = maximised(total, pair, forest(total, pair), belief(m, lexicon))
    for _ in range(rounds):
        total, pair = expected(kinds, model, weight)
        model = maximised(total, pair, forest(total, pair), belief(m, lexicon))
    return model


@dataclass
class Classifier:
    """A logistic classifier on votes and standardised statistics, within three deviations."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    voters: int

    def features(self, batch) -> np.ndarray:
        x = np.column_stack([batch.column(s).to_numpy() for s in STATISTICS]) if batch.num_rows else np.zeros((0, len(STATISTICS)))
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.spread, -3, 3), _dense(batch.column("fired"), self.voters)])

    def score(self, batch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(batch) @ self.weights, -40, 40)))


def classifier(cast: DataFrame, model: LabelModel, fit: int = FIT, ridge: float = RIDGE) -> Classifier:
    """Trained on posterior classes. ``cast``: votes with gold."""
    m = len(model.odds)
    schema = T.StructType([*cast.schema, T.StructField("p", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                fixed = part.column("gold").to_numpy(zero_copy_only=False).astype(float)
                p = np.where(np.isnan(fixed), model.posterior(_dense(part.column("fired"), m)), fixed)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], schema.names)

    rows = materialize(cast.mapInArrow(run, schema), "toxicity-posterior")
    sides = {r["side"]: r["n"] for r in rows.groupBy((F.col("p") >= 0.5).alias("side")).agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [_some(rows.where((F.col("p") >= 0.5) == F.lit(s)), fit, "doc_id", "p", "log_words").toArrow() for s in (True, False)]
    weight = np.concatenate([np.full(t.num_rows, sides.get(s, 0) / max(t.num_rows, 1)) for t, s in zip(some, (True, False))])
    found = pa.concat_tables(some)
    x = np.column_stack([found.column(s).to_numpy() for s in STATISTICS]) if found.num_rows else np.zeros((0, len(STATISTICS)))
    mean = x.mean(axis=0) if len(x) else np.zeros(len(STATISTICS))
    spread = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(len(STATISTICS))
    out = Classifier(mean, spread, np.zeros(1 + len(STATISTICS) + m), m)
    out.weights[0] = model.prior
    if not len(x):
        return out
    f, target = out.features(found), found.column("p").to_numpy()
    weight = weight * (len(x) / weight.sum())
    penalty = np.full(f.shape[1], ridge)
    penalty[0] = 0
    w = out.weights
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -40, 40)))
        gradient = f.T @ (weight * (p - target)) + penalty * w
        curve = (f * (weight * p * (1 - p))[:, None]).T @ f + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    out.weights = w
    return out


@dataclass
class Judge:
    """All that is needed to score texts."""

    voters: list[list[tuple[int, int]]]
    labels: LabelModel
    classifier: Classifier


def train(documents: DataFrame, labels: DataFrame) -> tuple[Judge, DataFrame]:
    """The trained judge, and the votes on all documents."""
    marks = materialize(gold(labels), "toxicity-gold")
    known = voters(documents, marks)
    m = len(known) + len(HABITS)
    found = materialize(votes(documents, known), "toxicity-votes")
    cast = found.join(marks, found["doc_id"] == marks["labelled"], "left").drop("labelled")
    kinds = materialize(cast.groupBy("fired", "gold").agg(F.count(F.lit(1)).alias("n")), "toxicity-kinds")
    model = label_model(kinds, m, len(LEXICON))
    return Judge(known, model, classifier(cast, model)), found


def scored(found: DataFrame, judge: Judge, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of votes."""
    classifier_ = judge.classifier

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(classifier_.score(part), 9))], ["doc_id", "score"])

    rows = found.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    judge, found = train(documents, labels)
    return scored(found, judge)
