"""Queries on citations, references, segments, evidence, verdicts and event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as fa
from ..functions import results as fr
from ..operators import citations
from ..operators.running import ordinal
from ..sources import scans
from .registry import Tables, query


def cited_answers(t: Tables) -> DataFrame:
    """Assistant turns with markers, malformed markers, a rule number and a price put in."""
    c, n = F.col("conv_id"), F.col("turn")
    return t.spread("conversations", "conv_id").filter(F.col("role") == "assistant").select(
        (c * 1000 + n).alias("query_id"), c.alias("conv_id"),
        F.concat("text", F.lit(" Alpha ["), (n + 1).cast("string"), F.lit("]. Beta ["), (c % 5).cast("string"), F.lit(", 2].\nGamma [1-3] see 702.19b and $100.50 [^2].")).alias("answer"))


def answer_results(t: Tables) -> DataFrame:
    """Three documents per answer as its numbered results."""
    wanted = cited_answers(t).select("query_id", F.explode(F.array(*[F.struct(F.lit(i).alias("number"), (F.col("conv_id") + i * 7).alias("doc_id")) for i in (1, 2, 3)])).alias("w")).select("query_id", "w.*")
    kind = F.element_at(F.array(F.lit("rule"), F.lit("ruling"), F.lit("oracle")), F.col("number"))
    none = F.lit(None).cast("string")
    return wanted.join(t.documents, "doc_id").select(
        "query_id", "number", kind.alias("source"), F.col("lang").alias("title"), "text", F.lit(1.0).alias("score"), F.lit("vector_hit").alias("match_type"),
        F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("oracle_id"), F.when(F.col("number") == 1, F.concat(F.lit("702."), F.col("doc_id").cast("string"))).alias("rule_id"),
        F.when(F.col("number") != 1, F.col("source")).alias("card_name"), F.lit("2024-01-01").alias("published_at"), none.alias("scryfall_uri"))


ANSWERS = """a AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn + 1 AS n1, conv_id % 5 AS n2, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, n1 BETWEEN 1 AND 3 AS ok1, n2 BETWEEN 1 AND 3 AS ok2 FROM a),
parsed AS (SELECT query_id, conv_id, text || ' Alpha' || CASE WHEN ok1 THEN ' [' || n1 || ']' ELSE '' END || '. Beta ' || CASE WHEN ok2 AND n2 <> 2 THEN '[' || n2 || ', 2]' ELSE '[2]' END || '.' || chr(10) || 'Gamma see 702.19b and $100.50.' AS cleaned,
  list_filter([CASE WHEN ok1 THEN n1 END, CASE WHEN ok2 AND n2 IS DISTINCT FROM CASE WHEN ok1 THEN n1 END THEN n2 END, CASE WHEN (n1 <> 2) AND (n2 <> 2) THEN 2 END], lambda x: x IS NOT NULL) AS cited,
  2 + CASE WHEN ok1 THEN 0 ELSE 1 END + CASE WHEN ok2 THEN 0 ELSE 1 END AS invalid_count FROM p)"""


@query("parse_citations", f"""WITH {ANSWERS} SELECT query_id, cleaned, array_to_string(cited, ',') AS cited, len(cited)::BIGINT AS cited_count, invalid_count::BIGINT AS invalid_count, len(cited) = 0 AS uncited_answer FROM parsed""")
def parse_citations(t: Tables) -> DataFrame:
    v = citations.validate(cited_answers(t), answer_results(t))
    return v.select("query_id", "cleaned", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.col("cited_count").cast("bigint").alias("cited_count"),
                    F.col("invalid_count").cast("bigint").alias("invalid_count"), "uncited_answer")


RESULTS = """res AS (SELECT query_id, i AS number, CASE i WHEN 1 THEN 'rule' WHEN 2 THEN 'ruling' ELSE 'oracle' END AS source, doc_id, d.source AS src, d.text FROM a, (SELECT unnest([1, 2, 3]) AS i) JOIN documents d ON d.doc_id = conv_id + i * 7),
cites AS (SELECT query_id, unnest(cited)::BIGINT AS number FROM parsed)"""


@query("citation_sources", f"""WITH {ANSWERS}, {RESULTS} SELECT c.query_id, c.number, CASE r.number WHEN 3 THEN 'card' ELSE r.source END AS source_type,
 CASE r.number WHEN 1 THEN 'Rule 702.' || doc_id WHEN 2 THEN 'Ruling — ' || src || ' (2024-01-01)' ELSE 'Card — ' || src END AS title, CASE WHEN r.number = 1 THEN '/rules/702.' || doc_id END AS url,
 CASE WHEN r.number = 2 THEN '2024-01-01' END AS published_at, CASE WHEN r.number <> 1 THEN 'o' || doc_id END AS oracle_id FROM cites c JOIN res r ON r.query_id = c.query_id AND r.number = c.number""")
def citation_sources(t: Tables) -> DataFrame:
    r = answer_results(t)
    c = citations.cited_sources(citations.validate(cited_answers(t), r), r)
    return c.select("query_id", "number", "source_type", "title", "url", "published_at", "oracle_id")


@query("uncited_results", f"WITH {ANSWERS}, {RESULTS} SELECT r.query_id, r.number::BIGINT AS number, src AS source FROM res r LEFT JOIN cites c ON r.query_id = c.query_id AND r.number = c.number WHERE c.number IS NULL")
def uncited_results(t: Tables) -> DataFrame:
    r = answer_results(t)
    kept = citations.uncited(citations.mark_cited(r, citations.validate(cited_answers(t), r)))
    return kept.select("query_id", "number", F.coalesce("card_name", F.lit(None)).alias("c"), F.substring("rule_id", 5, 20).cast("bigint").alias("d")).join(
        t.documents.select(F.col("doc_id").alias("d"), "source"), "d", "left").select("query_id", "number", F.coalesce("c", "source").alias("source"))


REFS = r"""doc AS (SELECT doc_id, text || ' See 702.1a, 100.' || doc_id % 9 || ' not $100.2 or 100.3.4; again 702.1a (100.7).' AS text FROM documents),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z\d.$€£]+')) AS run, generate_subscripts(regexp_extract_all(text, '[a-z\d.$€£]+'), 1) AS r FROM doc),
found AS (SELECT doc_id, r, unnest(regexp_extract_all(run, '(?:^|[a-z])(\d{3}\.\d+[a-z]?)(?:$|[$€£]|\.$|\.[a-z.$€£])', 1)) AS rule_id FROM runs),
firsts AS (SELECT doc_id, rule_id, min(r) AS r FROM found GROUP BY doc_id, rule_id),
known AS (SELECT '702.1a' AS rule_id UNION ALL SELECT '100.' || n_nationkey FROM nation)"""


def _referring(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select(F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" See 702.1a, 100."), (F.col("doc_id") % 9).cast("string"), F.lit(" not $100.2 or 100.3.4; again 702.1a (100.7).")).alias("cleaned"))


@query("rule_references", f"""WITH {REFS}, pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS position FROM firsts) SELECT doc_id, rule_id, position FROM pos WHERE rule_id IN (SELECT rule_id FROM known)""")
def rule_references(t: Tables) -> DataFrame:
    rules = t.nation.select(F.concat(F.lit("100."), F.col("n_nationkey").cast("string")).alias("rule_id")).unionByName(t.spark.range(1).select(F.lit("702.1a").alias("rule_id")))
    return citations.referenced_rules(_referring(t), rules).select(F.col("query_id").alias("doc_id"), "rule_id", F.col("position").cast("bigint").alias("position"))


@query("rule_reference_edges", """SELECT p_partkey, unnest(['702.' || p_size, (100 + p_size)::VARCHAR]) AS rule_id, unnest([0, 1])::BIGINT AS position FROM part""")
def rule_reference_edges(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("As rule 702."), size, F.lit(" says (see rule "), (F.lit(100) + F.col("p_size")).cast("string"), F.lit("), 100 cards or $120.50 are not rules."))
    return t.part.select("p_partkey", F.posexplode(fa.rule_text_references(text)).alias("position", "rule_id")).withColumn("position", F.col("position").cast("bigint"))


SEGMENTS = """pieces AS (SELECT query_id, text || ' Alpha ' AS t1, ok1, n1, ok2, n2 FROM p),
segs AS (SELECT query_id, CASE WHEN ok1 THEN [{'kind': 'text', 'text': t1, 'numbers': ''}, {'kind': 'cite', 'text': '[' || n1 || ']', 'numbers': n1::VARCHAR}, {'kind': 'text', 'text': '. Beta ', 'numbers': ''}]
   ELSE [{'kind': 'text', 'text': t1 || '[' || n1 || ']. Beta ', 'numbers': ''}] END || [{'kind': 'cite', 'text': '[' || n2 || ', 2]', 'numbers': CASE WHEN ok2 THEN n2 || ',2' ELSE '2' END},
   {'kind': 'text', 'text': '.' || chr(10) || 'Gamma [1-3] see ', 'numbers': ''}, {'kind': 'rule', 'text': '702.19b', 'numbers': ''}, {'kind': 'text', 'text': ' and $100.50 [^2].', 'numbers': ''}] AS s FROM pieces),
rows AS (SELECT query_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS segment FROM segs)"""


def _segments(t: Tables) -> DataFrame:
    known = cited_answers(t).withColumn("citation_numbers", F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)])).withColumn("rule_refs", F.array(F.lit("702.19b")))
    return citations.segments(known)


@query("answer_segments", f"WITH {ANSWERS}, {SEGMENTS} SELECT query_id, segment, s.kind AS kind, s.text AS text, s.numbers AS numbers FROM rows")
def answer_segments(t: Tables) -> DataFrame:
    return _segments(t).select("query_id", "segment", "kind", "text", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


# Line breaks become one blank and a mark, so that no boundary eats the next one.
@query("answer_sentences", rf"""WITH {ANSWERS}, {SEGMENTS}, b AS (SELECT query_id, regexp_replace(s.text, '\n+', ' ' || chr(1), 'g') AS x FROM rows WHERE s.kind = 'text')
SELECT query_id, (sum(len(regexp_extract_all(x, '[.!?]+(?:\s|$)')) + len(regexp_extract_all(x, chr(1)))) - 1)::BIGINT AS last_sentence FROM b GROUP BY query_id""")
def answer_sentences(t: Tables) -> DataFrame:
    return citations.sentences(_segments(t)).groupBy("query_id").agg(F.max("sentence").alias("last_sentence"))


@query("answer_layout")
def answer_layout(t: Tables) -> DataFrame:
    pieces = citations.sentences(_segments(t))
    leads = citations.lead(pieces)
    return citations.paragraphs(pieces, leads).join(leads, "query_id").select("query_id", "lead", "paragraph", "piece", "cut", "kind", "text")


@query("evidence_by_kind", """WITH e AS (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position, doc_id % 3 AS k FROM documents)
SELECT lang, CASE k WHEN 0 THEN 'rule' WHEN 1 THEN 'card' ELSE 'ruling' END AS kind, 'r' || position AS key, CASE WHEN k = 0 THEN '/rules/' || source ELSE 'http://x/' || doc_id END AS url, CASE WHEN k <> 0 THEN source END AS card_name,
 row_number() OVER (PARTITION BY lang, k ORDER BY position) - 1 AS place FROM e""")
def evidence_by_kind(t: Tables) -> DataFrame:
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    placed = ordinal(t.documents.select("lang", "doc_id", "source"), ["lang"], "doc_id", "position")
    r = dict(source=F.when(k == 0, "rule").when(k == 1, "oracle").otherwise("ruling"), title=F.col("source"), rule_id=none, card_name=none, text=none,
             scryfall_uri=F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")), published_at=none)
    e = placed.select("lang", "position", fr.evidence(F.col("position"), r).alias("e")).select("lang", "position", "e.*")
    return ordinal(e, ["lang", "kind"], "position", "place").select("lang", "kind", "key", "url", "card_name", "place")


OPENINGS = """CASE conv_id % 6 WHEN 0 THEN 'Yes, ' WHEN 1 THEN '**No.** ' WHEN 2 THEN 'Answer: yes it ' WHEN 3 THEN 'The answer is no. ' WHEN 4 THEN 'Not yes and not no, ' ELSE '' END"""


@query("verdicts", rf"""WITH v AS (SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace({OPENINGS} || text, '[*_`#>]', '', 'g'), '(?i)^\s*(answer|short answer)\s*:\s*', ''))) AS x FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, left(string_split_regex(x, '[.!?\n]')[1], 200) AS s FROM v),
m AS (SELECT conv_id, turn, regexp_replace(s, '[\x{{00AA}}\x{{00B5}}\x{{00BA}}\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00F6}}\x{{00F8}}-\x{{024F}}]', 'A', 'g') AS s FROM f)
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '^(yes|no)\b') THEN regexp_extract(s, '^(yes|no)\b', 1) WHEN regexp_matches(s, '\byes\b') AND NOT regexp_matches(s, '\bno\b') THEN 'yes'
 WHEN regexp_matches(s, '\bno\b') AND NOT regexp_matches(s, '\byes\b') THEN 'no' ELSE 'unclear' END AS verdict FROM m""")
def verdicts(t: Tables) -> DataFrame:
    k = F.col("conv_id") % 6
    opening = F.when(k == 0, "Yes, ").when(k == 1, "**No.** ").when(k == 2, "Answer: yes it ").when(k == 3, "The answer is no. ").when(k == 4, "Not yes and not no, ").otherwise("")
    return t.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", fa.verdict(F.concat(opening, "text")).alias("verdict"))


@query("judge_grades", """WITH e AS (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, CASE k % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'partial' WHEN 2 THEN 'declined_properly' ELSE 'error' END AS grade, CASE k % 5 WHEN 0 THEN 'r' || k WHEN 1 THEN '' WHEN 2 THEN 'r' || k
 WHEN 3 THEN 'unparseable judge reply: {"grade": "great"}' ELSE 'unparseable judge reply: no json ' || k END AS reason FROM e""")
def judge_grades(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.concat(F.lit('", "reason": " r'), k.cast("string"), F.lit(' "}'))
    reply = F.when(k % 5 == 0, F.concat(F.lit('Sure. {"grade": " Correct'), reason)).when(k % 5 == 1, '{"grade": "x"} then {"grade": "partial"} end').when(
        k % 5 == 2, F.concat(F.lit('{"grade": "declined_properly'), reason)).when(k % 5 == 3, '{"grade": "great"}').otherwise(F.concat(F.lit("no json "), k.cast("string")))
    return t.events.select("event_id", fa.parse_grade(reply, k % 5 == 2).alias("g")).select("event_id", "g.grade", "g.reason")


@query("answer_completion", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS text, CASE WHEN event_id % 5 = 0 THEN 'boom' END AS failure, CASE event_id % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'MAX_TOKENS' END AS finish FROM events)
SELECT event_id, CASE WHEN text <> '' OR failure IS NULL THEN text END AS answer, CASE WHEN text <> '' OR failure IS NULL THEN failure IS NULL AND coalesce(finish = 'STOP', FALSE) END AS answer_complete,
 CASE WHEN failure IS NOT NULL THEN failure WHEN text <> '' AND coalesce(finish, '') <> 'STOP' THEN 'answer cut off (finish reason: ' || coalesce(finish, 'none') || ')' END AS error FROM e""")
def answer_completion(t: Tables) -> DataFrame:
    k = F.col("event_id")
    c = fa.completion(F.when(k % 3 == 0, "").otherwise(F.col("event_type")), F.when(k % 5 == 0, "boom"), F.when(k % 4 == 0, "STOP").when(k % 4 == 1, "MAX_TOKENS"))
    return t.events.select("event_id", c.alias("c")).select("event_id", "c.*")


@query("response_notice", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'paused' WHEN event_type = 'signup' THEN CASE WHEN user_id % 4 <> 0 THEN 'breather' ELSE 'quota_used' END WHEN event_id % 2 = 0 THEN 'no_answer' END AS notice,
 user_id % 4 <= 3 AS running_low, CASE WHEN user_id % 7 <= 3 THEN (user_id % 7) || ' AI answer' || CASE WHEN user_id % 7 = 1 THEN '' ELSE 's' END || ' left today' ELSE (user_id % 7) || ' answers left today' END AS left_label FROM events""")
def response_notice(t: Tables) -> DataFrame:
    answer = F.when(F.col("event_id") % 2 == 1, "text")
    degraded = F.when(F.col("event_type") == "error", "global_budget").when(F.col("event_type") == "signup", "ip_quota")
    return t.events.select("event_id", fa.notice(answer, degraded, F.col("user_id") % 4).alias("notice"), fa.is_running_low(F.col("user_id") % 4).alias("running_low"),
                           fa.answers_left_label(F.col("user_id") % 7).alias("left_label"))


@query("sse_transcript_rows", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, CASE role WHEN 'user' THEN 'results' WHEN 'assistant' THEN 'delta' ELSE 'message' END AS event, to_json({'text': text})::VARCHAR AS data FROM conversations""")
def sse_transcript_rows(t: Tables) -> DataFrame:
    data = F.to_json(F.struct("text"))
    frame = F.when(F.col("role") == "system", F.concat(F.lit("data: "), data, F.lit("\n\n"))).otherwise(
        scans.sse_frame(F.when(F.col("role") == "user", "results").otherwise("delta"), data))
    # A conversation is one recorded stream, so its frames are a short list.
    parts = F.sort_array(F.collect_list(F.struct("turn", frame.alias("f"))))
    raw = t.conversations.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(parts, lambda p: p.f), ""), F.lit("event: delta\ndata: unfinished")).alias("raw"))
    return scans.sse_events(raw).withColumn("frame", F.col("frame").cast("bigint"))


@query("chunk_formats", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'm' || event_type END AS text, CASE WHEN event_id % 2 = 0 THEN user_id WHEN event_id % 3 = 0 THEN user_id END AS input_tokens,
 CASE WHEN event_id % 2 = 0 THEN 'STOP' WHEN event_id % 3 = 0 THEN 'MAX_TOKENS' END AS finish_reason FROM events""")
def chunk_formats(t: Tables) -> DataFrame:
    e, u, k = F.col("event_type"), F.col("user_id"), F.col("event_id")
    part = F.struct(e.alias("text"))
    thought = F.struct(F.lit("hidden").alias("text"), F.lit(True).alias("thought"))
    candidate = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.array(F.struct(e.alias("text"), F.lit(False).alias("thought")), thought).alias("parts")).alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates"),
        F.struct(u.alias("promptTokenCount")).alias("usageMetadata")))
    done = k % 3 == 0
    message = F.to_json(F.struct(F.struct(F.concat(F.lit("m"), e).alias("content")).alias("message"), done.alias("done"), F.when(done, "length").alias("done_reason"), u.alias("prompt_eval_count")))
    c = F.when(k % 2 == 0, fa.candidate_chunk(candidate)).otherwise(fa.message_chunk(message))
    return t.events.select("event_id", c.alias("c")).select("event_id", "c.text", F.col("c.input_tokens").cast("bigint").alias("input_tokens"), "c.finish_reason")
