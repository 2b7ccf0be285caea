"""Queries on names and keywords in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_forms, inflections
from ..operators import matching
from .registry import Tables, query


def texts(t: Tables) -> DataFrame:
    docs = t.spread("documents", "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    turns = t.spread("conversations", "conv_id").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("text_id"), "text")
    return docs.union(turns)


def names(t: Tables) -> DataFrame:
    """Part names and the opening words of the benchmark texts: two words, and one word."""
    far = 10_000_000_000
    opening = lambda n: F.regexp_extract("text", rf"^\p{{L}}+(?: \p{{L}}+){{{n}}}", 0)
    part = t.part.select(F.col("p_partkey").alias("line_no"), F.col("p_name").alias("name"))
    two = t.benchmark.select(F.lit(far) + F.col("item_id") * 2, opening(1).alias("name"))
    one = t.benchmark.select(F.lit(far) + F.col("item_id") * 2 + 1, opening(0).alias("name"))
    return part.union(two).union(one)


TEXTS = """texts AS (SELECT 'd' || doc_id AS text_id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"""
NAMES = r"""names AS (SELECT p_partkey AS line_no, p_name AS name FROM part UNION ALL SELECT 10000000000 + item_id * 2, regexp_extract(text, '^\p{L}+(?: \p{L}+){1}') FROM benchmark
  UNION ALL SELECT 10000000000 + item_id * 2 + 1, regexp_extract(text, '^\p{L}+') FROM benchmark),
dict AS (SELECT lower(name) AS key, max(line_no) AS line_no FROM names WHERE name <> '' GROUP BY 1)"""
# Occurrences by cutting each text at a name: independent of the word join under test.
MATCHES = r"""pieces AS (SELECT t.text_id, d.key, unnest(string_split(lower(t.text), d.key)) AS piece, generate_subscripts(string_split(lower(t.text), d.key), 1) AS i
  FROM texts t JOIN dict d ON contains(lower(t.text), d.key)),
placed AS (SELECT text_id, key, i, piece, lead(piece) OVER w AS following, lead(piece, 2) OVER w IS NULL AS ends_text, sum(length(piece)) OVER w + (i - 1) * length(key) AS start FROM pieces WINDOW w AS (PARTITION BY text_id, key ORDER BY i)),
matches AS (SELECT text_id, key, start::BIGINT AS start, (start + length(key))::BIGINT AS "end" FROM placed WHERE following IS NOT NULL
  AND (CASE WHEN piece <> '' THEN NOT regexp_matches(right(piece, 1), '[\p{L}\p{N}]') WHEN i = 1 THEN TRUE ELSE NOT regexp_matches(right(key, 1), '[\p{L}\p{N}]') END)
  AND (CASE WHEN following <> '' THEN NOT regexp_matches(left(following, 1), '[\p{L}\p{N}]') WHEN ends_text THEN TRUE ELSE NOT regexp_matches(left(key, 1), '[\p{L}\p{N}]') END))"""


def _matches(t: Tables) -> DataFrame:
    return matching.phrase_matches(texts(t), matching.dictionary(names(t)).select("key"))


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))


@query("name_dictionary", f"WITH {NAMES} SELECT key, line_no FROM dict")
def name_dictionary(t: Tables) -> DataFrame:
    return matching.dictionary(names(t)).select("key", "entry.line_no")


@query("phrase_matches", f"WITH {TEXTS}, {NAMES}, {MATCHES} SELECT * FROM matches")
def phrase_matches(t: Tables) -> DataFrame:
    return _typed(_matches(t))


CONTAINED = """free AS (SELECT * FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches o WHERE o.text_id = m.text_id AND o.start <= m.start AND m."end" <= o."end" AND (o.start, o."end") <> (m.start, m."end")))"""


@query("contained_spans_dropped", f"WITH {TEXTS}, {NAMES}, {MATCHES}, {CONTAINED} SELECT * FROM free")
def contained_spans_dropped(t: Tables) -> DataFrame:
    return _typed(matching.drop_contained(_matches(t)))


# Two lengths of names only (one word, or two), so a greedy choice takes every two-word
# span that no earlier chosen one overlaps, then the one-word spans left.
@query("greedy_spans", f"""WITH RECURSIVE {TEXTS}, {NAMES}, {MATCHES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY "end" - start DESC, start) AS r FROM matches),
crossing AS (SELECT a.text_id, a.r, list(b.r) AS earlier FROM ranked a LEFT JOIN ranked b ON a.text_id = b.text_id AND b.r < a.r AND a.start < b."end" AND b.start < a."end" GROUP BY a.text_id, a.r),
step(lvl, text_id, r, earlier, chosen) AS (SELECT 0, text_id, r, list_filter(earlier, lambda x: x IS NOT NULL), CASE WHEN len(list_filter(earlier, lambda x: x IS NOT NULL)) = 0 THEN TRUE END FROM crossing
  UNION ALL SELECT lvl + 1, s.text_id, s.r, s.earlier, CASE WHEN s.chosen IS NOT NULL THEN s.chosen WHEN s.yes > 0 THEN FALSE WHEN s.no = len(s.earlier) THEN TRUE END
  FROM (SELECT a.lvl, a.text_id, a.r, a.earlier, a.chosen, count(*) FILTER (b.chosen) AS yes, count(*) FILTER (NOT b.chosen) AS no FROM step a LEFT JOIN step b ON a.text_id = b.text_id AND list_contains(a.earlier, b.r)
        GROUP BY ALL) s WHERE lvl < 30)
SELECT text_id, key, start, "end" FROM ranked JOIN (SELECT text_id, r FROM step WHERE lvl = 30 AND chosen) USING (text_id, r)""")
def greedy_spans(t: Tables) -> DataFrame:
    return _typed(matching.greedy_spans(_matches(t))).select("text_id", "key", "start", "end")


# RE2 has no Unicode word edge: accented letters become 'A', a word character outside a-z.
ORDINARY = r"""ordinary AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]', 'A', 'g'),
  '\b[a-z][a-z''-]*\b')) AS word FROM documents) GROUP BY word HAVING count(*) >= 3)"""


@query("ordinary_words", f"WITH {ORDINARY} SELECT * FROM ordinary")
def ordinary_words(t: Tables) -> DataFrame:
    return matching.ordinary_words(t.spread("documents", "doc_id"))


@query("ordinary_word_guard", f"""WITH {TEXTS}, {NAMES}, {MATCHES}, {ORDINARY}
SELECT m.* FROM matches m JOIN texts t USING (text_id) WHERE key NOT IN (SELECT lower(word) FROM ordinary) OR (regexp_matches(substr(t.text, start + 1, 1), '\\p{{Lu}}')
  AND regexp_replace(left(t.text, start), '[ \\t\\n"''(“‘]+$', '') <> '' AND NOT regexp_matches(regexp_replace(left(t.text, start), '[ \\t\\n"''(“‘]+$', ''), '[.!?]$'))""")
def ordinary_word_guard(t: Tables) -> DataFrame:
    keys = matching.mark_ordinary(matching.dictionary(names(t)).select("key"), matching.ordinary_words(t.spread("documents", "doc_id")))
    return _typed(matching.phrase_matches(texts(t), keys, with_named=True)).select("text_id", "key", "start", "end")


@query("names_in_texts", f"""WITH {TEXTS}, {NAMES}, {MATCHES}, {CONTAINED} SELECT text_id, key, min(start) AS start, any_value(line_no) AS line_no FROM free JOIN dict USING (key) GROUP BY text_id, key""")
def names_in_texts(t: Tables) -> DataFrame:
    return matching.find_cards(texts(t), names(t)).select("text_id", "key", F.col("start").cast("bigint").alias("start"), "entry.line_no")


def keyword_rules_table(t: Tables) -> DataFrame:
    """Nations and customers as a keyword section: a heading names a part, its subrules are
    the nation's customers."""
    part_of = t.part.select("p_partkey", "p_name", "p_type")
    heads = t.nation.join(part_of, F.col("p_partkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("702."), (F.col("n_nationkey") + 1).cast("string")).alias("rule_id"), F.lit("702").alias("parent_id"),
        F.when(F.col("n_nationkey") % 3 == 0, F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")"))).when(
            F.col("n_nationkey") % 3 == 1, F.concat("p_name", F.lit(" and "), F.lower("p_type"))).otherwise(F.concat("p_name", F.lit("!"))).alias("text"),
        F.col("n_nationkey").cast("bigint").alias("line_no"))
    subs = t.customer.select(F.concat(F.lit("702."), (F.col("c_nationkey") + 1).cast("string"), F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("702."), (F.col("c_nationkey") + 1).cast("string")),
                             F.col("c_name"), F.lit(1000) + F.col("c_custkey"))
    return heads.union(subs)


KEYWORDS = r"""heads AS (SELECT '702.' || (n_nationkey + 1) AS rule_id, n_nationkey AS line_no, CASE n_nationkey % 3 WHEN 0 THEN p_name || ' (' || lower(p_type) || ')' WHEN 1 THEN p_name || ' and ' || lower(p_type) ELSE p_name || '!' END AS text
  FROM nation JOIN part ON p_partkey = n_nationkey WHERE n_nationkey <> 0),
based AS (SELECT rule_id, line_no, unnest(f) AS form, generate_subscripts(f, 1) AS pos FROM (SELECT rule_id, line_no, CASE WHEN regexp_matches(text, '\(') THEN [regexp_extract(text, '^(.*?)\s*\((.+)\)$', 1), regexp_extract(text, '^(.*?)\s*\((.+)\)$', 2)]
  WHEN contains(text, ' and ') THEN list_concat([text], string_split(text, ' and ')) ELSE [trim(regexp_replace(text, '!+$', ''))] END AS f FROM heads)),
bent AS (SELECT rule_id, line_no, pos, unnest(v) AS form, generate_subscripts(v, 1) AS b FROM (SELECT *, list_concat([form || 's', form || 'es', form || 'ed', form || 'ing'],
  CASE WHEN form LIKE '%e' THEN [form || 'd', left(form, length(form) - 1) || 'ing'] ELSE [] END) AS v FROM based)),
forms AS (SELECT form, rule_id, rank > 0 AS inflected FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY rank, line_no, pos, b) AS n FROM
  (SELECT form, rule_id, line_no, pos, 0 AS b, 0 AS rank FROM based UNION ALL SELECT form, rule_id, line_no, pos, b, 1 FROM bent)) WHERE n = 1)"""


@query("keyword_inflections", f"WITH {KEYWORDS} SELECT form, rule_id, inflected FROM forms")
def keyword_inflections(t: Tables) -> DataFrame:
    return matching.keyword_forms(matching.keyword_headings(keyword_rules_table(t)))


@query("keyword_subrules", """SELECT '702.' || (n_nationkey + 1) AS keyword_id, '702.' || (n_nationkey + 1) AS rule_id FROM nation WHERE n_nationkey <> 0
UNION ALL SELECT '702.' || (c_nationkey + 1), '702.' || (c_nationkey + 1) || 'c' || c_custkey FROM customer WHERE c_nationkey <> 0""")
def keyword_subrules(t: Tables) -> DataFrame:
    rules = keyword_rules_table(t)
    found = matching.keyword_headings(rules).select(F.lit("q").alias("text_id"), "rule_id", F.col("line_no").alias("start"))
    return matching.keyword_rules(found, rules).select("keyword_id", "rule_id")


@query("keywords_in_names", f"""WITH {KEYWORDS}, padded AS (SELECT p_partkey, ' ' || lower(p_name) || ' ' || lower(p_type) || ' ' AS x FROM part),
cand AS (SELECT p_partkey, x, form, rule_id, unnest(range(1, length(x) + 1)) AS pos0 FROM padded JOIN forms ON contains(x, ' ' || form || ' ')),
hits AS (SELECT p_partkey, form, rule_id, pos0 FROM cand WHERE substr(x, pos0, length(form) + 2) = ' ' || form || ' '),
best AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(form) DESC, pos0) AS r FROM hits)
SELECT b.p_partkey, b.rule_id, min(b.pos0 - 1) AS start FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.p_partkey = b.p_partkey AND o.r < b.r AND o.pos0 < b.pos0 + length(b.form) AND b.pos0 < o.pos0 + length(o.form)) GROUP BY b.p_partkey, b.rule_id""")
def keywords_in_names(t: Tables) -> DataFrame:
    named = t.part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("text"))
    return matching.find_keywords(named, keyword_rules_table(t), "p_partkey").withColumn("start", F.col("start").cast("bigint"))


@query("child_rows_of_matches", """WITH m AS (SELECT o_custkey AS query_id, o_orderkey AS k FROM orders), r AS (SELECT m.query_id, l_orderkey * 100 + l_linenumber AS point_id, l_quantity
  FROM m JOIN (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity FROM lineitem) ON l_orderkey = k)
SELECT query_id, point_id, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY point_id) AS n FROM r) WHERE n <= 20""")
def child_rows_of_matches(t: Tables) -> DataFrame:
    from ..operators.retrieve import ruling_hits

    matched = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("oracle_id"))
    lines = t.lineitem.groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("point_id"), "l_orderkey").agg(F.max("l_quantity").alias("l_quantity"))
    points = lines.select("point_id", F.lit("ruling").alias("source_type"), F.struct(F.col("l_orderkey").alias("oracle_id"), "l_quantity").alias("payload"))
    return ruling_hits(matched, points, 20).select("query_id", "point_id", "payload.l_quantity")
