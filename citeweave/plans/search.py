"""Queries on sparse, dense and hybrid search, retrieval and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.results import source_label
from ..functions.text import image_variant
from ..operators import encode, evaluation, retrieve, search
from ..session import materialize
from .matching import CONTAINED, KEYWORDS, MATCHES, NAMES
from .registry import Tables, query


def user_turns(t: Tables) -> DataFrame:
    return t.conversations.filter(F.col("role") == "user").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def vectors(t: Tables) -> DataFrame:
    """Every vector as a point; its label decides the source type."""
    kind = F.when(F.col("label") == 0, "rule").when(F.col("label") < 4, "ruling").otherwise("oracle")
    return t.embeddings.select(F.col("vec_id").alias("point_id"), kind.alias("source_type"), F.col("embedding").alias("dense"))


def vector_questions(t: Tables) -> DataFrame:
    """The vectors that ask: every twentieth id, against all vectors."""
    return vectors(t).filter(F.col("point_id") % 20 == 0).withColumnRenamed("point_id", "query_id")


def points(t: Tables) -> DataFrame:
    """All documents as points; those without a vector are found by their words alone."""
    docs = t.spread("documents", "doc_id").join(vectors(t), F.col("doc_id") == F.col("point_id"), "left")
    docs = docs.select(F.col("doc_id").alias("point_id"), F.coalesce("source_type", F.lit("oracle")).alias("source_type"), "dense", "text", "source", "lang")
    return encode.sparse_vector(docs, "text")


def questions(t: Tables) -> DataFrame:
    """All benchmark texts as questions, with a vector where the table of vectors has one of that number."""
    q = t.benchmark.join(t.embeddings, F.col("item_id") == F.col("vec_id"), "left").select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("dense"))
    return encode.sparse_vector(q, "text")


def weights_sql(name: str, source: str) -> str:
    """SQL for term weights of a table of (id, text)."""
    return rf"""{name}_tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM ({source})),
{name}_len AS (SELECT id, count(*) AS n FROM {name}_tok GROUP BY id),
{name} AS (SELECT id, term, count(*)::DOUBLE * 2.2::DOUBLE / (count(*)::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * any_value(n) / 256.0::DOUBLE)) AS w FROM {name}_tok JOIN {name}_len USING (id) GROUP BY id, term)"""


def top_sql(k: int, source: str) -> str:
    return f"SELECT query_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM ({source})) WHERE rank <= {k}"


TURNS = "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'"
SPARSE = "SELECT q.id AS query_id, d.id AS point_id, round(sum(q.w * d.w), 6) AS score FROM {q} q JOIN {d} d USING (term) GROUP BY q.id, d.id"
COSINE = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@query("sparse_terms", f"WITH {weights_sql('d', 'SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, term, round(w, 6) AS weight FROM d")
def sparse_terms(t: Tables) -> DataFrame:
    return encode.postings(t.spread("documents", "doc_id"), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("sparse_topk", f"WITH {weights_sql('d', 'SELECT doc_id AS id, text FROM documents')}, {weights_sql('q', TURNS)} {top_sql(10, SPARSE.format(q='q', d='d'))}")
def sparse_topk(t: Tables) -> DataFrame:
    docs = encode.sparse_vector(t.spread("documents", "doc_id").select(F.col("doc_id").alias("point_id"), "text"), "text")
    return ranked(search.sparse_topk(docs, encode.sparse_vector(user_turns(t), "text"), 10))


@query("dense_topk", top_sql(10, f"SELECT q.vec_id AS query_id, d.vec_id AS point_id, {COSINE.format(a='q.embedding', b='d.embedding')} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0"))
def dense_topk(t: Tables) -> DataFrame:
    v = vectors(t)
    return ranked(search.dense_topk(v, vector_questions(t), 10))


@query("dense_topk_filtered", top_sql(5, f"SELECT q.vec_id AS query_id, d.vec_id AS point_id, {COSINE.format(a='q.embedding', b='d.embedding')} AS score FROM embeddings q, embeddings d WHERE d.label = 0 AND q.vec_id % 20 = 0"))
def dense_topk_filtered(t: Tables) -> DataFrame:
    v = vectors(t)
    return ranked(search.dense_topk(v.filter(F.col("source_type") == "rule"), vector_questions(t), 5))


@query("minmax_scores", f"""WITH hits AS ({top_sql(50, f"SELECT q.vec_id AS query_id, d.vec_id AS point_id, {COSINE.format(a='q.embedding', b='d.embedding')} AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0")})
SELECT query_id, point_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm FROM hits WINDOW w AS (PARTITION BY query_id)""")
def minmax_scores(t: Tables) -> DataFrame:
    v = vectors(t)
    hits = search.dense_topk(v, vector_questions(t), 50)
    return search.normalize(hits, ["query_id"]).select("query_id", "point_id", F.round("norm", 6).alias("norm"))


HYBRID_QUESTIONS = "qs AS (SELECT item_id AS id, text, embedding FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"
HYBRID_BASE = f"""pts AS (SELECT doc_id AS id, text, embedding, CASE WHEN label = 0 THEN 'rule' WHEN label < 4 THEN 'ruling' ELSE 'oracle' END AS source_type, source, lang FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
{HYBRID_QUESTIONS}, {weights_sql('d', 'SELECT id, text FROM pts')}, {weights_sql('q', 'SELECT id, text FROM qs')}"""


def hybrid_sql(name: str, top_k: int, where: str = "TRUE", dense: float = 0.5, sparse: float = 0.5, threshold: float = 0.0) -> str:
    """SQL for a hybrid search over ``pts`` and ``qs`` of HYBRID_BASE."""
    norm = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
    dense_sql = f"SELECT qs.id AS query_id, pts.id AS point_id, {COSINE.format(a='qs.embedding', b='pts.embedding')} AS score FROM qs, pts WHERE qs.embedding IS NOT NULL AND pts.embedding IS NOT NULL AND {where}"
    sparse_sql = f"SELECT q.id AS query_id, d.id AS point_id, round(sum(q.w * d.w), 6) AS score FROM q JOIN d USING (term) JOIN pts ON pts.id = d.id WHERE {where} GROUP BY q.id, d.id"
    return f"""{name}_dn AS (SELECT query_id, point_id, {norm} AS norm FROM ({top_sql(50, dense_sql)}) WINDOW w AS (PARTITION BY query_id)),
{name}_sn AS (SELECT query_id, point_id, {norm} AS norm FROM ({top_sql(50, sparse_sql)}) WINDOW w AS (PARTITION BY query_id)),
{name}_f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.point_id, b.point_id) AS point_id,
  round({dense}::DOUBLE * coalesce(a.norm, 0.0::DOUBLE) + {sparse}::DOUBLE * coalesce(b.norm, 0.0::DOUBLE), 6) AS score FROM {name}_dn a FULL JOIN {name}_sn b ON a.query_id = b.query_id AND a.point_id = b.point_id),
{name} AS ({top_sql(top_k, f'SELECT * FROM {name}_f WHERE score >= {threshold}')})"""


@query("hybrid_search", f"WITH {HYBRID_BASE}, {hybrid_sql('h', 10)} SELECT * FROM h")
def hybrid_search(t: Tables) -> DataFrame:
    return ranked(search.hybrid_search(points(t), questions(t)))


@query("hybrid_threshold", f"WITH {HYBRID_BASE}, {hybrid_sql('h', 10, dense=0.7, sparse=0.3, threshold=0.6)} SELECT * FROM h")
def hybrid_threshold(t: Tables) -> DataFrame:
    return ranked(search.hybrid_search(points(t), questions(t), dense_weight=0.7, sparse_weight=0.3, threshold=0.6))


def two_pass(t: Tables) -> DataFrame:
    """Mixed and rules-only hits of every question with what is covered removed, numbered.
    Covered: the source of the question's own document, and its own rule."""
    q = questions(t)
    p = points(t)
    payload = p.select("point_id", F.when(F.col("source_type") == "rule", F.concat(F.lit("r"), F.col("point_id").cast("string"))).alias("rule_id"),
                       F.when(F.col("source_type") != "rule", F.col("source")).alias("oracle_id"), "source_type", "text", "source")
    covered = q.join(t.documents, F.col("query_id") == F.col("doc_id")).select("query_id", F.col("source").alias("oracle_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("rule_id"))

    def hits(k: int, kind: str | None) -> DataFrame:
        return search.hybrid_search(p, q, top_k=k, source_type=kind).join(payload, "point_id")

    mixed = materialize(retrieve.drop_covered(hits(10, None), covered, covered), "mixed-hits")
    seen = mixed.select("query_id", "rule_id").unionByName(covered.select("query_id", "rule_id")).filter(F.col("rule_id").isNotNull()).distinct()
    only = hits(5, "rule").join(seen, ["query_id", "rule_id"], "left_anti")
    values = lambda kind: dict(source=F.col("source_type"), title=F.coalesce("oracle_id", "rule_id"), text=F.col("text"), score=F.col("score"),
                               match_type=F.lit(kind), oracle_id=F.col("oracle_id"), rule_id=F.col("rule_id"), card_name=F.col("oracle_id"))
    order = [F.col("rank"), F.col("point_id").cast("string").alias("p")]
    return retrieve.number_results([retrieve.result_block(only, "query_id", 3, order, **values("rule_vector_hit")), retrieve.result_block(mixed, "query_id", 4, order, **values("vector_hit"))])


TWO_PASS = f"""{HYBRID_BASE}, {hybrid_sql('h', 10)}, {hybrid_sql('r', 5, "source_type = 'rule'")},
cov AS (SELECT qs.id AS query_id, source AS oracle_id, 'r' || doc_id AS rule_id FROM qs JOIN documents ON doc_id = qs.id),
pay AS (SELECT id AS point_id, source_type, text, CASE WHEN source_type = 'rule' THEN 'r' || id END AS rule_id, CASE WHEN source_type <> 'rule' THEN source END AS oracle_id FROM pts),
mixed AS (SELECT h.*, source_type, text, rule_id, oracle_id FROM h JOIN pay USING (point_id) WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.query_id = h.query_id AND (c.oracle_id = pay.oracle_id OR c.rule_id = pay.rule_id))),
only_rules AS (SELECT r.*, source_type, text, rule_id, oracle_id FROM r JOIN pay USING (point_id) WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.query_id = r.query_id AND c.rule_id = pay.rule_id)
  AND NOT EXISTS (SELECT 1 FROM mixed m WHERE m.query_id = r.query_id AND m.rule_id = pay.rule_id)),
results AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY block, rank) AS number, source_type AS source, coalesce(oracle_id, rule_id) AS title, text, score, match_type, rule_id, oracle_id FROM (
  SELECT *, 3 AS block, 'rule_vector_hit' AS match_type FROM only_rules UNION ALL SELECT *, 4, 'vector_hit' FROM mixed)),
labelled AS (SELECT *, CASE source WHEN 'rule' THEN 'Rule ' || rule_id WHEN 'ruling' THEN 'Ruling — ' || oracle_id ELSE 'Card — ' || oracle_id END AS label FROM results)"""


@query("hybrid_two_pass", f"WITH {TWO_PASS} SELECT query_id, number, source, title, score, match_type FROM results")
def hybrid_two_pass(t: Tables) -> DataFrame:
    return two_pass(t).select("query_id", F.col("number").cast("bigint").alias("number"), "source", "title", "score", "match_type")


@query("result_identifiers", f"WITH {TWO_PASS} SELECT query_id, number AS rank, source AS kind, coalesce(CASE WHEN source = 'rule' THEN rule_id END, oracle_id, title) AS key, score FROM results")
def result_identifiers(t: Tables) -> DataFrame:
    return evaluation.result_identifiers(two_pass(t)).withColumn("rank", F.col("rank").cast("bigint"))


@query("context_blocks", f"""WITH {TWO_PASS}, ctx AS (SELECT query_id, string_agg('[' || number || '] ' || label || ': ' || text, chr(10) || chr(10) ORDER BY number) AS context, count(*) AS sources FROM labelled GROUP BY query_id)
SELECT query_id, sources, length(context) AS context_chars, sha256(context) AS context_hash, 100 + length('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || qs.text) AS prompt_chars FROM ctx JOIN qs ON qs.id = query_id""")
def context_blocks(t: Tables) -> DataFrame:
    c = retrieve.build_context(two_pass(t)).join(questions(t).select("query_id", F.col("text").alias("question")), "query_id")
    return c.select("query_id", "sources", F.length("context").cast("bigint").alias("context_chars"), "context_hash",
                    retrieve.prompt_chars(F.col("question"), F.col("context"), 100).cast("bigint").alias("prompt_chars"))


@query("source_labels", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Rule ' || coalesce(CASE WHEN doc_id % 8 = 0 THEN doc_id::VARCHAR END, source) WHEN 1 THEN 'Ruling — ' || source || CASE WHEN doc_id % 8 = 1 THEN ' (2024-01-01)' ELSE '' END
 WHEN 2 THEN 'Card — ' || source ELSE source END AS label FROM documents""")
def source_labels(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    none = F.lit(None).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("rule", "ruling", "oracle", "other"))), (k % 4 + 1).cast("int"))
    return t.documents.select("doc_id", source_label(kind, F.col("source"), F.when(k % 8 == 0, k.cast("string")).otherwise(none), none, F.when(k % 8 == 1, "2024-01-01").otherwise(none)).alias("label"))


@query("enrich_results", """SELECT l_orderkey, l_linenumber, l_partkey, p_name AS card_name, p_type AS type_line, CASE WHEN p_partkey % 2 = 0 THEN 'http://img/small/' || p_partkey || '/normal/x' END AS image_small
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def enrich_results(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    key = F.concat(F.lit("id"), F.col("l_partkey").cast("string"))
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.lit("card").alias("source"), F.lit("").alias("title"), key.alias("oracle_id"), none.alias("rule_id"))
    image = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://img/normal/"), F.col("p_partkey").cast("string"), F.lit("/normal/x")))
    cards = t.part.select(F.concat(F.lit("id"), F.col("p_partkey").cast("string")).alias("oracle_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type_line"),
                          *[none.alias(c) for c in ("mana_cost", "power", "toughness", "loyalty")], image.alias("image_uri"))
    rules = t.region.select(F.col("r_name").alias("rule_id"), none.alias("parent_id"), F.col("r_name").alias("text"))
    return retrieve.enrich(items, cards, rules).select("l_orderkey", "l_linenumber", "l_partkey", F.col("card.name").alias("card_name"), F.col("card.type_line").alias("type_line"), F.col("card.image_small").alias("image_small"))


def retrieval_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, cards, rules and points for a full retrieval: names of the matching
    queries as cards, the keyword section of nations as rules, document vectors as points."""
    from .matching import keyword_rules_table, names

    none = F.lit(None).cast("string")
    asked = t.conversations.filter(F.col("role") == "user").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "text")
    asked = asked.join(t.embeddings, F.col("conv_id") == F.col("vec_id"), "left").join(t.part.select("p_partkey", "p_name", "p_type"), F.col("p_partkey") == F.col("conv_id"), "left")
    q = encode.sparse_vector(asked.select("query_id", F.concat_ws(" ", "text", "p_name", "p_type").alias("text"), F.col("embedding").alias("dense")), "text")
    cards = names(t).select("line_no", "name", F.concat(F.lit("src"), F.pmod("line_no", F.lit(20)).cast("string")).alias("oracle_id"), F.col("name").alias("oracle_text"), none.alias("scryfall_uri"))
    p = points(t)
    rule = F.when(F.col("source_type") == "rule", F.concat(F.lit("702."), (F.col("point_id") % 30).cast("string")))
    payload = F.struct("source_type", "text", rule.alias("rule_id"), F.when(rule.isNull(), F.col("source")).alias("card_name"), F.when(rule.isNull(), F.col("source")).alias("oracle_id"),
                       F.when(F.col("source_type") == "ruling", "2024-01-01").alias("published_at"), none.alias("scryfall_uri"))
    return q, cards, keyword_rules_table(t), p.select("point_id", "source_type", "dense", "sparse", payload.alias("payload"))


_ASKED = "qs AS (SELECT conv_id * 1000 + turn AS id, concat_ws(' ', c.text, p_name, p_type) AS text, embedding FROM conversations c LEFT JOIN embeddings ON conv_id = vec_id LEFT JOIN part ON p_partkey = conv_id WHERE role = 'user')"
_FORM_MATCHES = MATCHES.replace("pieces", "form_pieces").replace("placed", "form_placed").replace("matches AS", "form_matches AS").replace("JOIN dict d", "JOIN (SELECT form AS key FROM forms) d")
# Any number of lengths: a span is in when no better one that crosses it is.
_GREEDY = """ranked AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY "end" - start DESC, start, key) AS r FROM form_matches),
crossing AS (SELECT a.text_id, a.r, coalesce(list(b.r) FILTER (b.r IS NOT NULL), []) AS earlier FROM ranked a LEFT JOIN ranked b ON a.text_id = b.text_id AND b.r < a.r AND a.start < b."end" AND b.start < a."end" GROUP BY a.text_id, a.r),
step(lvl, text_id, r, earlier, chosen) AS (SELECT 0, text_id, r, earlier, CASE WHEN len(earlier) = 0 THEN TRUE END FROM crossing
  UNION ALL SELECT lvl + 1, s.text_id, s.r, s.earlier, CASE WHEN s.chosen IS NOT NULL THEN s.chosen WHEN s.yes > 0 THEN FALSE WHEN s.no = len(s.earlier) THEN TRUE END
  FROM (SELECT a.lvl, a.text_id, a.r, a.earlier, a.chosen, count(*) FILTER (b.chosen) AS yes, count(*) FILTER (NOT b.chosen) AS no FROM step a LEFT JOIN step b ON a.text_id = b.text_id AND list_contains(a.earlier, b.r)
        GROUP BY ALL) s WHERE lvl < 12),
picked AS (SELECT k.text_id, f.rule_id, min(k.start) AS start FROM ranked k JOIN (SELECT text_id, r FROM step WHERE lvl = 12 AND chosen) USING (text_id, r) JOIN forms f ON f.form = k.key GROUP BY ALL)"""
FULL_RESULTS = f"""{HYBRID_BASE.replace(HYBRID_QUESTIONS, _ASKED)}, {hybrid_sql('h', 10)}, {hybrid_sql('r', 5, "source_type = 'rule'")}, texts AS (SELECT id AS text_id, text FROM qs), {NAMES}, {MATCHES}, {CONTAINED}, {KEYWORDS}, {_FORM_MATCHES}, {_GREEDY},
named AS (SELECT f.text_id, f.key, min(f.start) AS start, any_value(n.name) AS name, any_value('src' || n.line_no % 20) AS oracle_id FROM free f JOIN dict USING (key) JOIN names n ON n.line_no = dict.line_no GROUP BY f.text_id, f.key),
sections AS (SELECT rule_id, rule_id AS head, line_no, text FROM heads UNION ALL SELECT '702.' || (c_nationkey + 1) || 'c' || c_custkey, '702.' || (c_nationkey + 1), 1000 + c_custkey, c_name FROM customer),
kw AS (SELECT k.text_id, k.start, x.rule_id, x.line_no, x.text FROM picked k JOIN sections x ON x.head = k.rule_id),
pay AS (SELECT id AS point_id, source_type, CASE WHEN source_type = 'rule' THEN '702.' || id % 30 END AS rule_id, CASE WHEN source_type <> 'rule' THEN source END AS oracle_id FROM pts),
ruled AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY point_id) AS n FROM (SELECT DISTINCT text_id, oracle_id FROM named) m JOIN pay USING (oracle_id) WHERE source_type = 'ruling'),
mixed AS (SELECT h.*, source_type, rule_id, oracle_id FROM h JOIN pay USING (point_id) WHERE NOT EXISTS (SELECT 1 FROM named m WHERE m.text_id = h.query_id AND m.oracle_id = pay.oracle_id) AND NOT EXISTS (SELECT 1 FROM kw k WHERE k.text_id = h.query_id AND k.rule_id = pay.rule_id)),
only_rules AS (SELECT r.*, rule_id FROM r JOIN pay USING (point_id) WHERE NOT EXISTS (SELECT 1 FROM kw k WHERE k.text_id = r.query_id AND k.rule_id = pay.rule_id) AND NOT EXISTS (SELECT 1 FROM mixed m WHERE m.query_id = r.query_id AND m.rule_id = pay.rule_id)),
blocks AS (SELECT text_id AS query_id, 0 AS block, start::DOUBLE AS a, key AS b, 'card' AS source, name AS title, 1.0::DOUBLE AS score, 'card_name_match' AS match_type, name AS text, 'Card — ' || name AS label FROM named
  UNION ALL SELECT text_id, 1, 0, point_id::VARCHAR, 'ruling', oracle_id, 1.0, 'card_ruling_match', (SELECT text FROM pts WHERE pts.id = point_id), 'Ruling — ' || oracle_id || ' (2024-01-01)' FROM ruled WHERE n <= 20
  UNION ALL SELECT text_id, 2, start, lpad(line_no::VARCHAR, 20, '0'), 'rule', rule_id, 1.0, 'keyword_rule_match', text, 'Rule ' || rule_id FROM kw
  UNION ALL SELECT query_id, 3, rank, point_id::VARCHAR, 'rule', rule_id, score, 'rule_vector_hit', (SELECT text FROM pts WHERE pts.id = point_id), 'Rule ' || rule_id FROM only_rules
  UNION ALL SELECT query_id, 4, rank, point_id::VARCHAR, source_type, coalesce(oracle_id, rule_id, ''), score, 'vector_hit', (SELECT text FROM pts WHERE pts.id = point_id), CASE source_type WHEN 'rule' THEN 'Rule ' || rule_id WHEN 'ruling' THEN 'Ruling — ' || oracle_id || ' (2024-01-01)' ELSE 'Card — ' || oracle_id END FROM mixed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY block, a, b) AS number FROM blocks)"""


@query("retrieve_full", f"WITH RECURSIVE {FULL_RESULTS} SELECT query_id, number, source, title, score, match_type FROM numbered")
def retrieve_full(t: Tables) -> DataFrame:
    q, cards, rules, p = retrieval_inputs(t)
    return retrieve.retrieve(q, cards, rules, p).select("query_id", "number", "source", "title", "score", "match_type")


_OWN_RESULTS = FULL_RESULTS.replace("FROM ruled WHERE n <= 20", "FROM ruled WHERE n <= text_id % 7").replace("FROM h JOIN pay", "FROM (SELECT * FROM h WHERE rank <= 1 + query_id % 10) h JOIN pay").replace("FROM r JOIN pay", "FROM (SELECT * FROM r WHERE rank <= query_id % 6) r JOIN pay")


@query("retrieve_by_settings", f"WITH RECURSIVE {_OWN_RESULTS} SELECT query_id, number, source, title, score, match_type FROM numbered")
def retrieve_by_settings(t: Tables) -> DataFrame:
    """The full retrieval with every question's own limits."""
    q, cards, rules, p = retrieval_inputs(t)
    k = F.col("query_id")
    own = q.select("query_id", F.lit(0.5).alias("hybrid_dense_weight"), F.lit(0.5).alias("hybrid_sparse_weight"), (1 + k % 10).cast("int").alias("hybrid_top_k"), F.lit(50).alias("hybrid_per_branch_limit"),
                   F.lit(0.0).alias("hybrid_score_threshold"), (k % 6).cast("int").alias("rules_top_k"), (k % 7).cast("int").alias("card_ruling_limit"))
    return retrieve.retrieve(q, cards, rules, p, settings=own).select("query_id", "number", "source", "title", "score", "match_type")
