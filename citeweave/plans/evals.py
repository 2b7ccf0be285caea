"""Queries on evaluation cases, scores, aggregates and run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cases as cs
from ..operators import encode, evaluation, rundiff, scoring, search
from ..sources import tables as st
from ..session import fresh_path
from .registry import Tables, query
from .search import HYBRID_BASE, SPARSE, hybrid_sql, points, questions, top_sql, weights_sql


def _list(cond, value):
    return F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))


def cases(t: Tables) -> DataFrame:
    """Benchmark texts as cases with requirements derived from their numbers."""
    k = F.col("item_id")
    src = lambda n: F.concat(F.lit("src"), n.cast("string"))
    tag = F.element_at(F.array(*map(F.lit, cs.CATEGORIES)), (k % 6 + 1).cast("int"))
    return t.benchmark.select(
        F.concat(F.lit("b"), k.cast("string")).alias("id"), F.col("text").alias("question"), F.array(tag, F.lit("extra")).alias("tags"), F.when(k % 4 == 0, "test").otherwise("dev").alias("split"),
        _list(k % 3 != 0, F.concat(F.lit("7"), F.lpad((k % 100).cast("string"), 2, "0"))).alias("rules"), _list(k % 2 == 0, src(k % 25)).alias("rulings"), _list(k % 5 < 2, src((k * 7) % 20)).alias("cards"),
        _list(k % 4 == 1, src((k * 3) % 20)).alias("expected_cards"), _list(k % 4 == 2, src((k * 11) % 20)).alias("forbidden_cards"),
        F.when(k % 8 != 7, "gold").alias("gold_answer"), F.when(k % 3 == 1, "yes").when(k % 3 == 2, "no").alias("verdict"), (k % 8 == 7).alias("should_decline"))


def case_results(t: Tables) -> DataFrame:
    """Sparse hits of every case over all documents, in the shape of results."""
    docs = encode.sparse_vector(t.spread("documents", "doc_id").select(F.col("doc_id").alias("point_id"), "text"), "text")
    asked = encode.sparse_vector(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), "text")
    hits = search.sparse_topk(docs, asked, 20)
    k = F.col("doc_id")
    d = t.documents.select("doc_id", "text", F.when(k % 3 == 0, "rule").when(k % 3 == 1, "ruling").otherwise("oracle").alias("source"), F.col("source").alias("card_name"),
                           F.when(k % 3 == 0, F.concat(F.lit("7"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("."), k.cast("string"))).alias("rule_id"))
    return hits.join(d, F.col("point_id") == k).select(
        F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("case_id"), F.col("rank").alias("number"), "source", "rule_id", "card_name", "text",
        F.when(F.col("rank") % 2 == 0, "card_name_match").otherwise("vector_hit").alias("match_type"), "score")


CASES = """cases AS (SELECT item_id, 'b' || item_id AS id, ['keyword', 'cr-only', 'card-ruling', 'interaction', 'negative', 'messy'][item_id % 6 + 1] AS category, CASE WHEN item_id % 4 = 1 THEN 'src' || (item_id * 3) % 20 END AS expected,
  CASE WHEN item_id % 4 = 2 THEN 'src' || (item_id * 11) % 20 END AS forbidden FROM benchmark),
reqs AS (SELECT id AS case_id, 0 AS o, 'rules' AS kind, '7' || lpad((item_id % 100)::VARCHAR, 2, '0') AS value FROM cases WHERE item_id % 3 <> 0 UNION ALL SELECT id, 1, 'rulings', 'src' || item_id % 25 FROM cases WHERE item_id % 2 = 0
  UNION ALL SELECT id, 2, 'cards', 'src' || (item_id * 7) % 20 FROM cases WHERE item_id % 5 < 2),
needs AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY o) - 1 AS ord, kind, value FROM reqs)"""
RESULTS = f"""{weights_sql('d', 'SELECT doc_id AS id, text FROM documents')}, {weights_sql('q', 'SELECT item_id AS id, text FROM benchmark')}, top20 AS ({top_sql(20, SPARSE.format(q='q', d='d'))}),
results AS (SELECT 'b' || query_id AS case_id, rank AS number, CASE doc_id % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'ruling' ELSE 'oracle' END AS source, CASE WHEN doc_id % 3 = 0 THEN '7' || lpad((doc_id % 100)::VARCHAR, 2, '0') || '.' || doc_id END AS rule_id,
  source AS card_name, text, rank % 2 = 0 AS by_name, score FROM top20 JOIN documents ON doc_id = point_id)"""
RANKS = """ranks AS (SELECT n.*, min(r.number) AS rank FROM needs n LEFT JOIN results r ON r.case_id = n.case_id AND ((kind = 'rules' AND r.source = 'rule' AND starts_with(r.rule_id, value)) OR (kind = 'rulings' AND r.source = 'ruling' AND r.card_name = value)
  OR (kind = 'cards' AND r.source = 'oracle' AND r.card_name = value)) GROUP BY ALL)"""


@query("requirement_ranks", f"WITH {CASES}, {RESULTS}, {RANKS} SELECT case_id, ord, kind, value, rank FROM ranks")
def requirement_ranks(t: Tables) -> DataFrame:
    r = scoring.requirement_ranks(cs.requirements(cases(t)), case_results(t))
    return r.select("case_id", F.col("ord").cast("bigint").alias("ord"), "kind", "value", F.col("rank").cast("bigint").alias("rank"))


@query("retrieval_scores", f"""WITH {CASES}, {RESULTS}, {RANKS}, per AS (SELECT case_id, count(*) AS required, count(rank) AS found, min(rank) AS first_hit FROM ranks GROUP BY case_id),
got AS (SELECT case_id, count(*) AS result_count, sum(length(text))::BIGINT AS context_chars FROM results GROUP BY case_id),
joined AS (SELECT c.*, required, found, first_hit, coalesce(result_count, 0) AS result_count, coalesce(context_chars, 0) AS context_chars,
  CASE WHEN expected IS NOT NULL AND NOT EXISTS (SELECT 1 FROM results r WHERE r.case_id = c.id AND by_name AND r.card_name = c.expected) THEN expected END AS missing,
  CASE WHEN forbidden IS NOT NULL AND EXISTS (SELECT 1 FROM results r WHERE r.case_id = c.id AND by_name AND r.card_name = c.forbidden) THEN forbidden END AS hit FROM cases c LEFT JOIN per p ON p.case_id = c.id LEFT JOIN got g ON g.case_id = c.id)
SELECT id, category, CASE WHEN required > 0 THEN found = required AND missing IS NULL AND hit IS NULL WHEN expected IS NOT NULL OR forbidden IS NOT NULL THEN missing IS NULL AND hit IS NULL END AS passed, CASE WHEN required > 0 THEN found = required END AS sources_pass,
 round(found::DOUBLE / required, 6) AS recall, first_hit AS first_hit_rank, coalesce(missing, '') AS expected_missing, coalesce(hit, '') AS forbidden_hits, result_count, context_chars FROM joined""")
def retrieval_scores(t: Tables) -> DataFrame:
    s = scoring.score_retrieval(cases(t), case_results(t))
    return s.select("id", "category", F.col("pass").alias("passed"), "sources_pass", F.round("recall", 6).alias("recall"), F.col("first_hit_rank").cast("bigint").alias("first_hit_rank"),
                    F.array_join("expected_missing", ",").alias("expected_missing"), F.array_join("forbidden_hits", ",").alias("forbidden_hits"), "result_count", F.col("context_chars").cast("bigint").alias("context_chars"))


@query("citations_meet_requirements", f"""WITH {CASES}, {RESULTS}, {RANKS} SELECT c.id AS case_id, bool_or(CASE WHEN k.case_id IS NOT NULL THEN k.rank IS NOT NULL END) AS cited_satisfies_required, any_value(n.n) AS cited_count FROM cases c LEFT JOIN ranks k ON k.case_id = c.id
 LEFT JOIN (SELECT case_id, count(*) AS n FROM results GROUP BY case_id) n ON n.case_id = c.id GROUP BY c.id""")
def citations_meet_requirements(t: Tables) -> DataFrame:
    r = case_results(t).withColumn("source_type", F.when(F.col("source") == "oracle", "card").otherwise(F.col("source")))
    return scoring.score_citations(cases(t), r).select("case_id", "cited_satisfies_required", "cited_count")


@query("case_selection", "SELECT 'b' || item_id AS id FROM benchmark WHERE item_id % 4 <> 0 AND item_id % 6 IN (0, 2)")
def case_selection(t: Tables) -> DataFrame:
    return cs.select(cases(t), "dev", ["keyword", "card-ruling"]).select("id")


@query("case_validation", """WITH r AS (SELECT DISTINCT '7' || lpad((doc_id % 90)::VARCHAR, 2, '0') AS p FROM documents WHERE doc_id % 3 = 0), names AS (SELECT DISTINCT source AS n FROM documents),
ruled AS (SELECT DISTINCT source AS n FROM documents WHERE doc_id % 20 < 9), c AS (SELECT item_id AS k, '''b' || item_id || '''' AS q FROM benchmark),
u AS (SELECT q, k, 'rulings' AS f, 'src' || k % 25 AS n FROM c WHERE k % 2 = 0 UNION ALL SELECT q, k, 'cards', 'src' || (k * 7) % 20 FROM c WHERE k % 5 < 2
  UNION ALL SELECT q, k, 'expected_cards', 'src' || (k * 3) % 20 FROM c WHERE k % 4 = 1 UNION ALL SELECT q, k, 'forbidden_cards', 'src' || (k * 11) % 20 FROM c WHERE k % 4 = 2)
SELECT 'b' || k AS case_id, 'rules' AS field, 'no_rule' AS code, '7' || lpad((k % 100)::VARCHAR, 2, '0') AS value FROM c WHERE k % 3 <> 0 AND '7' || lpad((k % 100)::VARCHAR, 2, '0') NOT IN (SELECT p FROM r)
UNION ALL SELECT 'b' || k, f, 'no_card', n FROM u WHERE n NOT IN (SELECT n FROM names)
UNION ALL SELECT 'b' || k, f, 'no_ruling', n FROM u WHERE f = 'rulings' AND n IN (SELECT n FROM names) AND n NOT IN (SELECT n FROM ruled)""")
def case_validation(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rules = t.documents.filter(k % 3 == 0).select(F.concat(F.lit("7"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit("."), k.cast("string")).alias("rule_id"))
    cards = t.documents.select(F.col("source").alias("name"), k.cast("string").alias("oracle_id"))
    rulings = t.documents.filter(k % 20 < 9).select(k.cast("string").alias("oracle_id"))
    return cs.data_errors(cases(t), rules, cards, rulings)


@query("case_schema_errors", """WITH b AS (SELECT item_id AS k, CASE WHEN item_id % 10 <> 9 THEN 'c' || item_id - item_id % 10 % 2 END AS id FROM benchmark),
e(digit, field, code, detail) AS (VALUES (0, 'tags', 'absent', NULL), (2, 'tags', 'category', 'odd'), (3, 'split', 'value', 'prod'), (4, 'zzz', 'unknown', NULL), (5, 'verdict', 'value', 'maybe'), (6, 'required_sources.odd', 'unknown', NULL),
  (6, 'required_sources.rules', 'type', NULL), (7, 'should_decline', 'type', NULL), (8, 'expected_cards', 'type', NULL), (9, 'id', 'type', NULL))
SELECT k AS index, id AS case_id, field, code, detail FROM b JOIN e ON k % 10 = digit UNION ALL SELECT k, id, 'id', 'repeated', NULL FROM b WHERE k % 10 % 2 = 1 AND k % 10 <> 9""")
def case_schema_errors(t: Tables) -> DataFrame:
    k = F.col("item_id")
    d = k % 10
    lit = lambda name, value, cond=None: F.when(F.lit(True) if cond is None else cond, F.concat(F.lit(f'"{name}": '), value if not isinstance(value, str) else F.lit(value)))
    fields = F.array_compact(F.array(
        lit("id", F.when(d == 9, k.cast("string")).otherwise(F.concat(F.lit('"c'), (k - d % 2).cast("string"), F.lit('"')))), lit("question", F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9)),
        lit("tags", F.when(d == 2, '["odd"]').otherwise('["keyword", "x"]'), d != 0), lit("split", F.when(d == 3, '"prod"').otherwise('"dev"')), lit("zzz", "1", d == 4),
        lit("verdict", F.when(d == 5, '"maybe"').otherwise("true"), d.isin(1, 5)), lit("required_sources", F.when(d == 6, '{"rules": "702.1", "odd": []}').otherwise('{"rules": ["702.1"], "cards": []}')),
        lit("should_decline", F.when(d == 7, '"no"').otherwise("false")), lit("expected_cards", F.when(d == 8, '["a", 1]').otherwise('["a"]'))))
    raw = t.benchmark.select(k.alias("index"), F.concat(F.lit("{"), F.array_join(fields, ", "), F.lit("}")).alias("entry"))
    return cs.schema_errors(raw)


def records(t: Tables) -> DataFrame:
    """Labelled documents as case records of a full run."""
    k = F.col("doc_id")
    grade = F.when(k % 9 == 0, F.when(k % 2 == 0, "declined_properly").otherwise("answered_anyway")).otherwise(F.element_at(F.array(*map(F.lit, ("correct", "partial", "incorrect", "error"))), (k % 4 + 1).cast("int")))
    full = k % 23 != 0
    return t.labels.join(t.documents, "doc_id").select(
        k.cast("string").alias("id"), F.col("lang").alias("category"), F.when(k % 19 == 0, "boom").alias("error"), F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("pass"), ((F.col("n_chars") % 11) / 10).alias("recall"),
        F.when(k % 7 != 0, k % 7).alias("first_hit_rank"), F.array_repeat(F.lit("f"), (k % 3).cast("int")).alias("forbidden_hits"), F.array_repeat(F.lit("e"), (k % 2).cast("int")).alias("expected_missing"), (k % 20).alias("result_count"),
        F.col("n_chars").alias("context_chars"), F.when(full, k % 9 == 0).alias("should_decline"), F.when(full & (k % 5 != 0), "answer").alias("answer"), F.when(full, grade).alias("grade"), F.when(full & (k % 2 == 0), "yes").alias("verdict_expected"),
        F.when(full & (k % 2 == 0), k % 4 == 0).alias("verdict_correct"), F.when(full, k % 3 == 0).alias("answer_cached"), F.when(full, k % 6 == 0).alias("judge_cached"), F.when(full, k % 4).alias("invalid_citations"),
        F.when(full & (k % 3 != 0), F.col("n_chars") * 2.0).alias("generate_ms"), F.when(full, k % 31 == 0).alias("context_overflow"), F.when(full, F.col("n_chars")).alias("prompt_tokens"))


METRICS = """recs AS (SELECT doc_id AS k, lang AS category, doc_id % 19 = 0 AS err, CASE WHEN toxic = 0 THEN quality = 1 END AS pass, (n_chars % 11)::DOUBLE / 10 AS recall, n_chars, doc_id % 23 <> 0 AS full_rec,
 CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'declined_properly' ELSE 'answered_anyway' END ELSE ['correct', 'partial', 'incorrect', 'error'][doc_id % 4 + 1] END AS grade FROM labels JOIN documents USING (doc_id)),
agg AS (SELECT category, count(*) AS cases, count(*) FILTER (err) AS errors, count(CASE WHEN err THEN FALSE ELSE pass END) AS scored, count(*) FILTER (NOT err AND pass) AS passed, avg(recall) FILTER (NOT err) AS mean_recall,
 avg(CASE WHEN k % 7 <> 0 THEN k % 7 END) FILTER (NOT err) AS mean_first_hit_rank, coalesce(sum(k % 3) FILTER (NOT err), 0)::BIGINT AS forbidden_hits, coalesce(sum(k % 2) FILTER (NOT err), 0)::BIGINT AS expected_missing, avg(k % 20) FILTER (NOT err) AS mean_results,
 avg(n_chars) FILTER (NOT err) AS mean_context_chars, count(*) FILTER (full_rec AND k % 5 <> 0) AS answered, count(*) FILTER (full_rec AND grade = 'error') AS judge_errors, count(*) FILTER (full_rec AND k % 9 <> 0 AND grade <> 'error') AS judged,
 count(*) FILTER (full_rec AND grade = 'correct') AS n_correct, count(*) FILTER (full_rec AND grade = 'incorrect') AS n_incorrect, count(*) FILTER (full_rec AND k % 4 = 0) AS n_right, count(*) FILTER (full_rec AND k % 2 = 0) AS n_verdict,
 count(*) FILTER (full_rec AND k % 9 = 0 AND k % 2 = 0) AS n_declined, count(*) FILTER (full_rec AND k % 9 = 0) AS n_decline, count(*) FILTER (full_rec) AS n_full, count(*) FILTER (full_rec AND k % 3 = 0) AS n_cached, count(*) FILTER (full_rec AND k % 6 = 0) AS n_jcached,
 coalesce(sum(k % 4) FILTER (full_rec), 0)::BIGINT AS invalid_citations, avg(n_chars * 2.0::DOUBLE) FILTER (full_rec AND k % 3 <> 0) AS mean_generate_ms, count(*) FILTER (full_rec AND k % 31 = 0) AS context_overruns, max(n_chars) FILTER (full_rec) AS max_prompt_tokens
 FROM recs GROUP BY GROUPING SETS ((category), ()))"""


@query("eval_by_category", f"""WITH {METRICS} SELECT category, cases, errors, scored, passed, round(passed::DOUBLE / nullif(scored, 0), 6) AS pass_rate, round(mean_recall, 6) AS mean_recall, round(mean_first_hit_rank, 6) AS mean_first_hit_rank, forbidden_hits, expected_missing,
 round(mean_results, 6) AS mean_results, round(mean_context_chars, 6) AS mean_context_chars, answered, judge_errors, judged, round(n_correct::DOUBLE / nullif(judged, 0), 6) AS correct_rate, round(n_incorrect::DOUBLE / nullif(judged, 0), 6) AS incorrect_rate,
 round(n_right::DOUBLE / nullif(n_verdict, 0), 6) AS verdict_accuracy, round(n_declined::DOUBLE / nullif(n_decline, 0), 6) AS decline_accuracy, round(n_cached::DOUBLE / nullif(n_full, 0), 6) AS answer_cache_hit_rate, round(n_jcached::DOUBLE / nullif(n_full, 0), 6) AS judge_cache_hit_rate,
 invalid_citations, round(mean_generate_ms, 6) AS mean_generate_ms, context_overruns, max_prompt_tokens FROM agg""")
def eval_by_category(t: Tables) -> DataFrame:
    a = scoring.aggregate(records(t), "full").drop("partial_rate")
    return a.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in a.dtypes])


def _run(t: Tables, new: bool) -> DataFrame:
    """Two runs over the labelled documents; the second differs by arithmetic."""
    k = F.col("doc_id")
    kept = k % 13 != 0 if new else k % 17 != 0
    rank = lambda n: F.when((k + n) % 5 != 0, (k + n) % 5).cast("int")
    ranks = F.map_from_arrays(F.array(F.lit("rules:702.1"), F.lit("cards:Bolt")), F.array(rank(1 if new else 0), rank(2 if new else 3)))
    grades = F.array(*map(F.lit, ("correct", "partial", "incorrect", "no_answer", "error")))
    return t.labels.filter(kept).select(
        k.cast("string").alias("id"), F.when(k % 11 == (3 if new else 4), "boom").alias("error"), (F.col("quality") == 1).alias("pass") if new else (F.col("toxic") == 0).alias("pass"), ranks.alias("requirement_ranks"),
        _list(k % 6 == (1 if new else 2), F.lit("Fog")).alias("forbidden_hits"), F.array().cast("array<string>").alias("expected_missing"), F.element_at(grades, ((k + (2 if new else 0)) % 5 + 1).cast("int")).alias("grade"), F.lit(False).alias("should_decline"),
        (k % 4 == 0).alias("verdict_correct") if new else (k % 3 == 0).alias("verdict_correct"), F.lit("yes" if new else "no").alias("verdict_parsed"))


def _run_sql(name: str, keep: int, err: int, a: int, b: int, forbidden: int, shift: int, passed: str, verdict: str) -> str:
    rank = lambda n: f"CASE WHEN (doc_id + {n}) % 5 <> 0 THEN (doc_id + {n}) % 5 END"
    return (f"{name} AS (SELECT doc_id AS k, CASE WHEN doc_id % 11 = {err} THEN 'boom' END AS error, {passed} AS pass, {rank(a)} AS ra, {rank(b)} AS rb, doc_id % 6 = {forbidden} AS fog, "
            f"['correct', 'partial', 'incorrect', 'no_answer', 'error'][(doc_id + {shift}) % 5 + 1] AS grade, {verdict} AS vc FROM labels WHERE doc_id % {keep} <> 0)")


_DIFF = f"""{_run_sql('ba', 17, 4, 0, 3, 2, 0, 'toxic = 0', 'doc_id % 3 = 0')}, {_run_sql('ne', 13, 3, 1, 2, 1, 2, 'quality = 1', 'doc_id % 4 = 0')},
j AS (SELECT coalesce(b.k, n.k) AS k, b.k AS bk, n.k AS nk, n.error IS NOT NULL AND b.error IS NULL AS failed, b.error IS NOT NULL AND n.error IS NULL AS cleared, b.ra AS bra, n.ra AS nra, b.rb AS brb, n.rb AS nrb, b.fog AS bf, n.fog AS nf, b.pass AS bp, n.pass AS np,
  b.grade AS bg, n.grade AS ng, CASE b.grade WHEN 'correct' THEN 2 WHEN 'partial' THEN 1 WHEN 'incorrect' THEN 0 WHEN 'no_answer' THEN 0 END AS bo, CASE n.grade WHEN 'correct' THEN 2 WHEN 'partial' THEN 1 WHEN 'incorrect' THEN 0 WHEN 'no_answer' THEN 0 END AS no, b.vc AS bv, n.vc AS nv
  FROM ba b FULL JOIN ne n ON b.k = n.k),
r AS (SELECT *, list_filter([CASE WHEN bra IS NOT NULL AND nra IS NULL THEN 'rank:rules:702.1:' || bra || '>' END, CASE WHEN brb IS NOT NULL AND nrb IS NULL THEN 'rank:cards:Bolt:' || brb || '>' END,
   CASE WHEN nf AND NOT bf THEN 'forbidden:Fog:+' END], lambda x: x IS NOT NULL) AS w0,
  list_filter([CASE WHEN cleared THEN 'error:-' END, CASE WHEN bra IS NULL AND nra IS NOT NULL THEN 'rank:rules:702.1:>' || nra END, CASE WHEN brb IS NULL AND nrb IS NOT NULL THEN 'rank:cards:Bolt:>' || nrb END,
   CASE WHEN bf AND NOT nf THEN 'forbidden:Fog:-' END], lambda x: x IS NOT NULL) AS b0 FROM j WHERE bk IS NOT NULL AND nk IS NOT NULL),
r2 AS (SELECT *, CASE WHEN failed THEN ['error:+'] WHEN bp AND NOT np AND len(w0) = 0 THEN ['pass:1>0'] ELSE w0 END AS w1, CASE WHEN failed THEN [] WHEN NOT bp AND np AND len(b0) = 0 THEN ['pass:0>1'] ELSE b0 END AS b1 FROM r),
r3 AS (SELECT k, array_to_string(w1 || list_filter([CASE WHEN bg <> ng AND no < bo THEN 'grade:' || bg || '>' || ng END, CASE WHEN bv AND NOT nv THEN 'verdict:no>yes' END], lambda x: x IS NOT NULL), ' ') AS w,
  array_to_string(b1 || list_filter([CASE WHEN bg <> ng AND no >= bo THEN 'grade:' || bg || '>' || ng END, CASE WHEN NOT bv AND nv THEN 'verdict:no>yes' END], lambda x: x IS NOT NULL), ' ') AS b FROM r2),
d AS (SELECT k::VARCHAR AS id, CASE WHEN w <> '' THEN 'regression' WHEN b <> '' THEN 'fixed' ELSE 'same' END AS status, CASE WHEN w <> '' THEN w WHEN b <> '' THEN b END AS reasons FROM r3
  UNION ALL SELECT k::VARCHAR, CASE WHEN bk IS NULL THEN 'added' ELSE 'removed' END, NULL FROM j WHERE bk IS NULL OR nk IS NULL)"""


@query("run_diff", f"WITH {_DIFF} SELECT * FROM d")
def run_diff(t: Tables) -> DataFrame:
    return rundiff.diff_cases(_run(t, False), _run(t, True))


@query("run_diff_counts", f"""WITH {_DIFF} SELECT count(*) FILTER (status = 'regression') AS regressions, count(*) FILTER (status = 'fixed') AS fixed, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
 count(*) FILTER (status NOT IN ('added', 'removed')) AS shared, (count(*) FILTER (status = 'regression') > 0)::INT AS exit_code FROM d""")
def run_diff_counts(t: Tables) -> DataFrame:
    return rundiff.diff_counts(rundiff.diff_cases(_run(t, False), _run(t, True)))


@query("run_fields_compared", f"""WITH {_run_sql('ba', 17, 4, 0, 3, 2, 0, 'toxic = 0', 'doc_id % 3 = 0')}, {_run_sql('ne', 13, 3, 1, 2, 1, 2, 'quality = 1', 'doc_id % 4 = 0')}, j AS (SELECT b.k::VARCHAR AS id, n.k AS nk, b.error AS be, n.error AS ne2, b.grade AS bg, n.grade AS ng FROM ba b LEFT JOIN ne n ON b.k = n.k)
SELECT id, 'missing' AS field, 'MUST' AS severity FROM j WHERE nk IS NULL UNION ALL SELECT id, 'error', 'MUST' FROM j WHERE nk IS NOT NULL AND be IS DISTINCT FROM ne2 UNION ALL SELECT id, 'grade', 'look' FROM j WHERE nk IS NOT NULL AND bg <> ng""")
def run_fields_compared(t: Tables) -> DataFrame:
    return rundiff.compare_fields(_run(t, False), _run(t, True), "id", ["error"], ["grade"])


@query("config_diff", """WITH b AS (SELECT 'settings.' || p_partkey AS key, p_size::VARCHAR AS v FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT 'settings.' || p_partkey AS key, (p_size + (p_partkey % 3 = 0)::INT)::VARCHAR AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(b.key, n.key) AS key, b.v AS base_value, n.v AS new_value FROM b FULL JOIN n ON b.key = n.key WHERE b.v IS DISTINCT FROM n.v AND coalesce(b.key, n.key) NOT IN (SELECT 'settings.' || s_suppkey FROM supplier)""")
def config_diff(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    key = F.concat(F.lit("settings."), k.cast("string")).alias("key")
    base = t.part.filter(k % 5 != 0).select(key, size.cast("string").alias("value"))
    new = t.part.filter(k % 7 != 0).select(key, (size + (k % 3 == 0).cast("int")).cast("string").alias("value"))
    return rundiff.config_diff(base, new, t.supplier.select(F.concat(F.lit("settings."), F.col("s_suppkey").cast("string")).alias("key")))


@query("runs_equal_up_to_ties", """WITH a AS (SELECT label AS c, round(embedding[1]::DOUBLE, 1) AS s, vec_id % 7 AS item FROM embeddings), b AS (SELECT label AS c, round(embedding[1]::DOUBLE, 1) AS s, CASE WHEN vec_id % 50 = 0 THEN 99 ELSE vec_id % 7 END AS item FROM embeddings)
SELECT c AS case_id, s AS score, item, sum(n)::BIGINT AS surplus FROM (SELECT *, 1 AS n FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL HAVING sum(n) <> 0""")
def runs_equal_up_to_ties(t: Tables) -> DataFrame:
    def run(item):
        return t.embeddings.select(F.col("label").alias("case_id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 1).alias("score"), item.alias("item"))

    k = F.col("vec_id")
    return rundiff.ties_differ(run(k % 7), run(F.when(k % 50 == 0, 99).otherwise(k % 7)), ["case_id", "score", "item"])


EXPERIMENTS = {"even": (0.5, 0.5), "dense": (0.8, 0.2), "sparse": (0.2, 0.8)}


def experiment_records(hits: DataFrame, p: DataFrame) -> DataFrame:
    """Case records of every experiment: a hit is a rule among the first ten results."""
    rule = F.col("source_type") == "rule"
    d = hits.join(p.select("point_id", "source_type", F.length("text").alias("n")), "point_id")
    return d.groupBy("experiment", "query_id").agg(
        F.bool_or(rule).alias("pass"), F.min(F.when(rule, F.col("rank"))).alias("first_hit_rank"), F.avg(rule.cast("int")).alias("recall"), F.count("*").alias("result_count"), F.sum("n").alias("context_chars")
    ).withColumns({"error": F.lit(None).cast("string"), "forbidden_hits": F.array().cast("array<string>"), "expected_missing": F.array().cast("array<string>")})


_EXP = ", ".join(hybrid_sql(f"x{i}", 10, dense=d, sparse=s) for i, (d, s) in enumerate(EXPERIMENTS.values()))
_UNION = " UNION ALL ".join(f"SELECT '{n}' AS e, query_id, point_id, rank FROM x{i}" for i, n in enumerate(EXPERIMENTS))
_FMT = {"pass_rate": "printf('%.1f%%', round_even(round(100.0::DOUBLE * avg(p::INT), 9), 1))", "mean_recall": "printf('%.3f', round_even(round(avg(r), 9), 3))", "mean_first_hit_rank": "coalesce(printf('%.2f', round_even(round(avg(f), 9), 2)), '-')", "forbidden_hits": "'0'", "expected_missing": "'0'", "errors": "'0'",
        "mean_results": "printf('%.1f', round_even(round(avg(n), 9), 1))", "mean_context_chars": "round_even(avg(c), 0)::BIGINT::VARCHAR"}


@query("experiment_sweep", f"""WITH {HYBRID_BASE}, {_EXP}, hits AS ({_UNION}), rec AS (SELECT e, query_id, bool_or(source_type = 'rule') AS p, min(CASE WHEN source_type = 'rule' THEN rank END) AS f, avg((source_type = 'rule')::INT) AS r, count(*) AS n, sum(length(text)) AS c
 FROM hits JOIN pts ON id = point_id GROUP BY e, query_id), long AS ({' UNION ALL '.join(f"SELECT {i} AS position, '{m}' AS metric, e, {_FMT[m]} AS v FROM rec GROUP BY e" for i, (m, _k, _d) in enumerate(rundiff.RETRIEVAL_METRICS))})
SELECT position, metric, {', '.join(f"max(v) FILTER (e = '{n}') AS {n}" for n in EXPERIMENTS)} FROM long GROUP BY position, metric""")
def experiment_sweep(t: Tables) -> DataFrame:
    p = points(t)
    experiments = {name: {"dense_weight": d, "sparse_weight": w} for name, (d, w) in EXPERIMENTS.items()}
    return evaluation.sweep(p, questions(t), experiments, lambda hits: experiment_records(hits, p))


@query("evaluation_run", f"""WITH {CASES}, {RESULTS}, {RANKS}, per AS (SELECT case_id, count(*) AS required, count(rank) AS found, min(rank) AS first_hit FROM ranks GROUP BY case_id),
j AS (SELECT c.*, required, found, first_hit, CASE WHEN expected IS NOT NULL AND NOT EXISTS (SELECT 1 FROM results r WHERE r.case_id = c.id AND by_name AND r.card_name = c.expected) THEN 1 ELSE 0 END AS missing,
  CASE WHEN forbidden IS NOT NULL AND EXISTS (SELECT 1 FROM results r WHERE r.case_id = c.id AND by_name AND r.card_name = c.forbidden) THEN 1 ELSE 0 END AS hit FROM cases c LEFT JOIN per p ON p.case_id = c.id),
k AS (SELECT *, CASE WHEN required > 0 THEN found = required AND missing + hit = 0 WHEN expected IS NOT NULL OR forbidden IS NOT NULL THEN missing + hit = 0 END AS pass FROM j)
SELECT category, count(*) AS cases, count(pass) AS scored, count(*) FILTER (pass) AS passed, round(avg(found::DOUBLE / required), 6) AS mean_recall, round(avg(first_hit), 6) AS mean_first_hit_rank, sum(hit)::BIGINT AS forbidden_hits, sum(missing)::BIGINT AS expected_missing
FROM k GROUP BY GROUPING SETS ((category), ())""")
def evaluation_run(t: Tables) -> DataFrame:
    _records, totals = evaluation.run(cases(t), case_results(t))
    return totals.select("category", "cases", "scored", "passed", F.round("mean_recall", 6).alias("mean_recall"), F.round("mean_first_hit_rank", 6).alias("mean_first_hit_rank"), "forbidden_hits", "expected_missing")


_REPORT = {
    "pass_rate": "avg(outcome::INT)", "mean_recall": "avg((n % 11) / 10.0::DOUBLE) FILTER (NOT err)", "mean_first_hit_rank": "avg(CASE WHEN k % 7 <> 0 THEN k % 7 END) FILTER (NOT err)", "forbidden_hits": "sum(k % 3) FILTER (NOT err)",
    "expected_missing": "sum(k % 2) FILTER (NOT err)", "errors": "count(*) FILTER (err)", "mean_results": "avg(k % 20) FILTER (NOT err)", "mean_context_chars": "avg(n) FILTER (NOT err)",
    "correct_rate": "avg((grade = 'correct')::INT) FILTER (graded)", "partial_rate": "avg((grade = 'partial')::INT) FILTER (graded)", "incorrect_rate": "avg((grade = 'incorrect')::INT) FILTER (graded)",
    "verdict_accuracy": "avg((k % 4 = 0)::INT) FILTER (whole AND k % 2 = 0)", "decline_accuracy": "avg((grade = 'declined_properly')::INT) FILTER (whole AND k % 9 = 0)", "invalid_citations": "sum(k % 4) FILTER (whole)",
    "judge_errors": "count(*) FILTER (whole AND grade = 'error')", "answer_cache_hit_rate": "avg((k % 3 = 0)::INT) FILTER (whole)", "judge_cache_hit_rate": "avg((k % 6 = 0)::INT) FILTER (whole)",
    "mean_generate_ms": "avg(n * 2.0::DOUBLE) FILTER (whole AND k % 3 <> 0)", "context_overruns": "count(*) FILTER (whole AND k % 31 = 0)", "max_prompt_tokens": "max(n) FILTER (whole)",
}
_SHOWN = {"pct": "printf('%.1f%%', round_even(round(v * 100, 9), 1))", "int": "printf('%d', round_even(v, 0)::BIGINT)", "f1": "printf('%.1f', round_even(v, 1))", "f2": "printf('%.2f', round_even(v, 2))", "f3": "printf('%.3f', round_even(v, 3))"}
_SHOWN_SQL = "CASE WHEN v IS NULL THEN '-' " + " ".join(f"WHEN kind = '{k}' THEN {f}" for k, f in _SHOWN.items()) + " END"
_METRICS = rundiff.RETRIEVAL_METRICS + rundiff.FULL_METRICS


def _report_sql(name: str, passed: str) -> str:
    """One run's metrics in long form: position, metric, kind, direction, v, shown."""
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{m}' AS metric, '{k}' AS kind, {d} AS direction, {_REPORT[m]}::DOUBLE AS v FROM {name}_r" for i, (m, k, d) in enumerate(_METRICS))
    return f"{name}_r AS (SELECT *, CASE WHEN err THEN FALSE ELSE {passed} END AS outcome FROM rec), {name} AS (SELECT position, metric, kind, direction, v, {_SHOWN_SQL} AS shown FROM (SELECT * REPLACE (round(v, 9) AS v) FROM ({rows})))"


@query("run_report", f"""WITH rec AS (SELECT *, whole AND k % 9 <> 0 AND grade <> 'error' AS graded FROM (SELECT doc_id AS k, n_chars AS n, doc_id % 19 = 0 AS err, doc_id % 23 <> 0 AS whole, CASE WHEN toxic = 0 THEN quality = 1 END AS pass,
  CASE WHEN doc_id % 9 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'declined_properly' ELSE 'answered_anyway' END ELSE ['correct', 'partial', 'incorrect', 'error'][doc_id % 4 + 1] END AS grade FROM labels JOIN documents USING (doc_id))),
{_report_sql('a', 'pass')}, {_report_sql('b', 'coalesce(pass, TRUE)')}
SELECT b.position, b.metric, a.shown AS baseline, b.shown AS this_run, CASE WHEN a.v IS NULL OR b.v IS NULL OR b.direction = 0 OR a.shown = b.shown THEN '' WHEN (b.v - a.v) * b.direction > 0 THEN '▲' ELSE '▼' END AS mark FROM a JOIN b USING (position)""")
def run_report(t: Tables) -> DataFrame:
    base = scoring.aggregate(records(t), "full")
    new = scoring.aggregate(records(t).withColumn("pass", F.coalesce(F.col("pass"), F.lit(True))), "full")
    return rundiff.report(base, new, "full")


@query("run_round_trip", """SELECT 'r1' AS run_id, doc_id::VARCHAR AS id, lang AS category FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'r2', doc_id::VARCHAR, lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1""")
def run_round_trip(t: Tables) -> DataFrame:
    """Two runs written and read back."""
    base = fresh_path(t.spark, "runs")
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    for run_id, found in (("r1", records(t)), ("r2", records(t).join(toxic, "id", "left_semi"))):
        meta = t.spark.range(1).select(F.lit("full").alias("mode"), F.lit(None).cast("timestamp").alias("started_at"))
        st.write_run(base, run_id, meta, found, scoring.aggregate(found, "full"))
    return st.read_run(t.spark, base, "case_results").select("run_id", "id", "category")


@query("run_names", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' || o_custkey || CASE WHEN o_orderstatus = 'F' THEN '-dirty' ELSE '' END || '-full' || CASE WHEN o_orderkey % 2 = 0 THEN '-exp' ELSE '' END AS run_name FROM orders""")
def run_names(t: Tables) -> DataFrame:
    name = st.run_name(F.col("o_orderdate"), F.col("o_custkey").cast("string"), F.col("o_orderstatus") == "F", F.lit("full"), F.when(F.col("o_orderkey") % 2 == 0, "exp"))
    return t.orders.select("o_orderkey", name.alias("run_name"))


@query("latest_run", "SELECT o_orderkey AS run_id, o_orderstatus AS mode FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_run(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("mode"), F.col("o_orderdate").alias("started_at"))
    return st.latest_run(runs, "F").select("run_id", "mode")


@query("graded_cases", r"""WITH a AS (SELECT item_id AS k, CASE WHEN item_id % 7 = 0 THEN NULL WHEN item_id % 2 = 0 THEN 'Yes, it does.' ELSE 'No.' END AS answer FROM benchmark)
SELECT 'b' || k AS id, CASE WHEN k % 3 <> 0 THEN CASE WHEN answer IS NULL THEN 'unclear' WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END END AS verdict_parsed, CASE WHEN k % 3 <> 0 THEN coalesce(CASE WHEN k % 3 = 1 THEN answer LIKE 'Yes%' ELSE answer LIKE 'No%' END, FALSE) END AS verdict_correct,
 CASE WHEN answer IS NULL THEN 'no_answer' ELSE 'correct' END AS grade, k % 4 <> 0 AND k % 6 = 1 AS context_drift, k % 5 = 0 AS context_overflow FROM a""")
def graded_cases(t: Tables) -> DataFrame:
    k = F.col("item_id")
    answers = t.benchmark.select(F.concat(F.lit("b"), k.cast("string")).alias("case_id"), F.when(k % 7 == 0, None).when(k % 2 == 0, "Yes, it does.").otherwise("No.").alias("answer"), F.lit("h").alias("context_hash"),
                                 F.when(k % 6 == 1, "g").otherwise("h").alias("retrieval_context_hash"), (k % 4 == 0).alias("answer_cached"), F.lit("correct").alias("grade"), F.when(k % 5 == 0, "context overflow: 9000").alias("generation_error"))
    return scoring.grade_cases(cases(t), answers).select("id", "verdict_parsed", "verdict_correct", "grade", "context_drift", "context_overflow")
