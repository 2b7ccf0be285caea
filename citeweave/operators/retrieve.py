"""The full retrieval of a table of questions: name matches, their rulings, keyword rules,
rules-only hits and mixed hits, in context order; then numbered contexts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.results import source_label
from ..functions.text import image_variant
from ..session import materialize
from .matching import find_cards, find_keywords, keyword_rules
from .outline import heading, with_ancestors
from .search import hybrid_search, hybrid_search_by

RESULT_FIELDS = ("source", "title", "text", "score", "match_type", "oracle_id", "rule_id", "card_name", "published_at", "scryfall_uri")


@dataclass(frozen=True)
class SearchSettings:
    """Parameters of one retrieval run."""

    hybrid_dense_weight: float = 0.5
    hybrid_sparse_weight: float = 0.5
    hybrid_top_k: int = 10
    hybrid_per_branch_limit: int = 50
    hybrid_score_threshold: float = 0.0
    rules_top_k: int = 5
    card_ruling_limit: int = 20


def ruling_hits(matched: DataFrame, points: DataFrame, limit: int | DataFrame, query_id: str = "query_id") -> DataFrame:
    """Rulings of the cards matched per question, the first ``limit`` by point id. A question's first ``limit`` lie
    among the first ``limit`` of each of its cards, so cards are cut before they meet questions. ``limit`` may be a table
    of query_id and card_ruling_limit."""
    pairs = matched.select(query_id, F.col("oracle_id").alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    most = limit if isinstance(limit, int) else limit.agg(F.max("card_ruling_limit")).first()[0] or 0
    rulings = points.filter(F.col("source_type") == "ruling").select("point_id", "payload")
    per_card = Window.partitionBy("payload.oracle_id").orderBy("point_id")
    rulings = rulings.withColumn("_c", F.row_number().over(per_card)).filter(F.col("_c") <= most).drop("_c")
    w = Window.partitionBy(query_id).orderBy("point_id")
    hits = rulings.join(pairs, F.col("payload.oracle_id") == F.col("_id")).drop("_id").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    if not isinstance(limit, int):
        hits = hits.join(limit.select(query_id, "card_ruling_limit"), query_id).filter(F.col("_n") <= F.col("card_ruling_limit")).drop("card_ruling_limit")
    return hits.drop("_n")


def drop_covered(hits: DataFrame, matched: DataFrame, keywords: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Drop hits already covered by an exact match: the card (and so its rulings) was named
    or the rule came with a keyword. A null id covers nothing."""
    cards = matched.filter(F.col("oracle_id").isNotNull()).select(query_id, "oracle_id").distinct()
    rules = keywords.filter(F.col("rule_id").isNotNull()).select(query_id, "rule_id").distinct()
    return hits.join(cards, [query_id, "oracle_id"], "left_anti").join(rules, [query_id, "rule_id"], "left_anti")


def result_block(df: DataFrame, query_id: str, block: int, order: list, **values) -> DataFrame:
    """Rows in the shape of results, with the place of their block and their order in it."""
    cols = [values.get(name, F.lit(None)) for name in RESULT_FIELDS]
    return df.select(query_id, F.lit(block).alias("_block"), F.struct(*order).alias("_order"), *[
        c.cast("double" if name == "score" else "string").alias(name) for name, c in zip(RESULT_FIELDS, cols)])


def number_results(blocks: list[DataFrame], query_id: str = "query_id") -> DataFrame:
    """Stack result blocks and number them 1..N per question. Every block is bounded by its
    own limit, so a question is a short list."""
    keyed = []
    for b in blocks:
        o = b.schema["_order"].dataType.names
        keyed.append(b.withColumn("_a", F.col(f"_order.{o[0]}").cast("double")).withColumn("_b", F.col(f"_order.{o[1]}").cast("string")).drop("_order"))
    w = Window.partitionBy(query_id).orderBy("_block", "_a", "_b")
    stacked = reduce(DataFrame.unionByName, keyed)
    return stacked.withColumn("number", F.row_number().over(w)).select(query_id, "number", *RESULT_FIELDS)


def retrieve(questions: DataFrame, cards: DataFrame, rules: DataFrame, points: DataFrame, s: SearchSettings = SearchSettings(),
             ordinary: DataFrame | None = None, query_id: str = "query_id", text: str = "text", settings: DataFrame | None = None) -> DataFrame:
    """Ranked results per question. ``questions`` carries the text and its dense and sparse
    vectors; ``cards`` and ``rules`` carry a line number for file order. ``settings`` gives every question its own
    parameters (query_id and the fields of SearchSettings); without it, all have those of ``s``."""
    # Each of these feeds a result block and the removal of covered hits.
    named = materialize(find_cards(questions, cards, ordinary, query_id, text).select(query_id, "start", "key", "entry.*"), "names")
    card_block = result_block(named, query_id, 0, [F.col("start"), F.col("key")], source=F.lit("card"), title=F.col("name"), text=F.coalesce("oracle_text", F.lit("")),
                         score=F.lit(1.0), match_type=F.lit("card_name_match"), oracle_id=F.col("oracle_id"), card_name=F.col("name"), scryfall_uri=F.col("scryfall_uri"))
    rulings = ruling_hits(named, points, s.card_ruling_limit if settings is None else settings, query_id).select(query_id, "point_id", "payload.*")
    ruling_block = result_block(rulings, query_id, 1, [F.lit(0).alias("z"), F.col("point_id")], source=F.col("source_type"), title=F.coalesce("card_name", F.lit("")),
                           text=F.col("text"), score=F.lit(1.0), match_type=F.lit("card_ruling_match"), oracle_id=F.col("oracle_id"),
                           card_name=F.col("card_name"), published_at=F.col("published_at"), scryfall_uri=F.col("scryfall_uri"))
    # Rules of earlier keywords first; within one keyword, file order.
    keywords = materialize(find_keywords(questions, rules, query_id, text), "keywords")
    keyword_block = result_block(keyword_rules(keywords, rules, query_id), query_id, 2, [F.col("start"), F.lpad(F.col("line_no").cast("string"), 20, "0").alias("l")], source=F.lit("rule"),
                            title=F.col("rule_id"), text=F.col("text"), score=F.lit(1.0), match_type=F.lit("keyword_rule_match"), rule_id=F.col("rule_id"))

    def search(top_k: str, source_type: str | None) -> DataFrame:
        if settings is None:
            hits = hybrid_search(points, questions, s.hybrid_per_branch_limit, s.hybrid_dense_weight, s.hybrid_sparse_weight,
                                 s.hybrid_score_threshold, getattr(s, top_k), source_type, query_id=query_id)
        else:
            own = settings.select(query_id, F.col("hybrid_dense_weight").alias("dense_weight"), F.col("hybrid_sparse_weight").alias("sparse_weight"), F.col("hybrid_score_threshold").alias("threshold"),
                                  F.col(top_k).alias("top_k"), F.col("hybrid_per_branch_limit").alias("per_branch"))
            hits = hybrid_search_by(points, questions, own, source_type, query_id=query_id)
        return hits.select(query_id, "point_id", "score", "rank")

    def with_payload(kept: DataFrame, ids: list[str]) -> DataFrame:
        same = [F.col("point_id") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"payload.{c}")) for c in ids]]
        return kept.join(points.select(F.col("point_id").alias("_p"), "payload"), reduce(Column.__and__, same)).select(query_id, "point_id", "score", "rank", "payload.*")

    # Small (questions * top_k) and used twice: written once, so the corpus is not searched again. Texts are not written.
    # A point that comes twice is dealt with once here, and is two results as before.
    hits = materialize(search("hybrid_top_k", None).join(points.select("point_id", "payload.oracle_id", "payload.rule_id"), "point_id").distinct(), "mixed-hits")
    # A keyword may have very many rules: only those that are hits can cover any.
    hit_rules = rules.join(hits.select("rule_id").distinct(), "rule_id", "left_semi")
    kept = materialize(drop_covered(hits, named, keyword_rules(keywords, hit_rules, query_id), query_id), "mixed-kept")
    mixed_block = result_block(with_payload(kept, ["oracle_id", "rule_id"]), query_id, 4, [F.col("rank"), F.col("point_id")], source=F.col("source_type"), title=F.coalesce("card_name", "rule_id", F.lit("")),
                          text=F.col("text"), score=F.col("score"), match_type=F.lit("vector_hit"), oracle_id=F.col("oracle_id"), rule_id=F.col("rule_id"),
                          card_name=F.col("card_name"), published_at=F.col("published_at"), scryfall_uri=F.col("scryfall_uri"))
    blocks = [card_block, ruling_block, keyword_block, mixed_block]
    if settings is not None or s.rules_top_k > 0:
        more = materialize(search("rules_top_k", "rule").join(points.select("point_id", "payload.rule_id"), "point_id").distinct(), "rule-hits")
        more_rules = rules.join(more.select("rule_id").distinct(), "rule_id", "left_semi")
        seen = keyword_rules(keywords, more_rules, query_id).select(query_id, "rule_id").unionByName(kept.select(query_id, "rule_id")).filter(F.col("rule_id").isNotNull()).distinct()
        only = with_payload(more.join(seen, [query_id, "rule_id"], "left_anti"), ["rule_id"])
        blocks.append(result_block(only, query_id, 3, [F.col("rank"), F.col("point_id")], source=F.lit("rule"), title=F.coalesce("rule_id", F.lit("")), text=F.col("text"),
                              score=F.col("score"), match_type=F.lit("rule_vector_hit"), rule_id=F.col("rule_id")))
    return number_results(blocks, query_id)


def label(r: DataFrame) -> DataFrame:
    return r.withColumn("label", source_label(F.col("source"), F.col("title"), F.col("rule_id"), F.col("card_name"), F.col("published_at")))


def build_context(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One numbered context per question and its hash. Hits and rulings of a question are bounded by its settings; the
    subrules of the keywords it names are not, and a context holds them all."""
    block = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("label"), F.lit(": "), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("number", block.alias("b"))))
    joined = F.array_join(F.transform(parts, lambda p: p.b), "\n\n")
    return label(results).groupBy(query_id).agg(joined.alias("context"), F.count("*").alias("sources")).withColumn("context_hash", F.sha2("context", 256))


def user_message(query, context):
    """The message a generator gets: context, then the question."""
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), query)


def prompt_chars(query, context, system_chars: int):
    """Characters sent to the generator, the basis of a token estimate."""
    return F.lit(system_chars) + F.length(user_message(query, context))


def enrich(items: DataFrame, cards: DataFrame, rules: DataFrame, source: str = "source") -> DataFrame:
    """Attach the card of a card or ruling and the heading of a rule. Display only: runs
    after the context is built."""
    face = cards.select(F.col("oracle_id").alias("_id"), F.struct(
        F.col("name"), F.coalesce("type_line", F.lit("")).alias("type_line"), F.col("mana_cost"), F.col("power"), F.col("toughness"), F.col("loyalty"),
        image_variant(F.col("image_uri"), "small").alias("image_small"), F.col("image_uri").alias("image_normal"),
        image_variant(F.col("image_uri"), "large").alias("image_large")).alias("card"))
    titled = with_ancestors(rules.select("rule_id", "parent_id", "text")).select(
        F.col("rule_id").alias("_rule"), heading(F.col("text"), F.col("ancestors")).alias("heading"))
    of_card = F.col(source).isin("card", "oracle", "ruling")
    wanted_rule = F.when(F.col(source) == "rule", F.coalesce(F.nullif("rule_id", F.lit("")), "title"))
    return (
        items.join(face, F.when(of_card, F.col("oracle_id")) == F.col("_id"), "left")
        .join(titled, wanted_rule == F.col("_rule"), "left").drop("_id", "_rule")
    )
