"""Queries on hashing, scans, outline documents, trees and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import chunks, outline
from ..operators.running import ordinal
from ..sources import scans
from .registry import Tables, query

UUID_SQL = "sha1(unhex('6f6e0e2a6f0a4c1a9f1a6b0c9f6f6e2a') || encode({name}))"


def uuid_sql(name: str) -> str:
    h = UUID_SQL.format(name=name)
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({h},18,3) || '-' || substr({h},21,12))")


@query("content_hash_docs", "SELECT doc_id, sha256(doc_id::VARCHAR || chr(31) || coalesce(text,'')) AS content_hash FROM documents")
def content_hash_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.content_hash(F.col("doc_id"), F.col("text")).alias("content_hash"))


@query("payload_hash_docs", """SELECT doc_id, sha256('{"lang":' || to_json(lang) || ',"n_chars":' || n_chars || ',"published_at":null,"source_type":'
  || to_json(source) || ',"text":' || to_json(text) || '}') AS payload_hash FROM documents""")
def payload_hash_docs(t: Tables) -> DataFrame:
    fields = {"source_type": F.col("source"), "text": F.col("text"), "lang": F.col("lang"), "n_chars": F.col("n_chars"), "published_at": F.lit(None).cast("string")}
    return t.documents.select("doc_id", hashing.payload_hash(fields).alias("payload_hash"))


@query("point_id_uuid5", f"SELECT doc_id, {uuid_sql("'rule:' || doc_id::VARCHAR")} AS point_id FROM documents")
def point_id_uuid5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", hashing.rule_point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query("strip_query_urls", """SELECT page_id, nullif(split_part(url, '?', 1), '') AS url_bare, regexp_matches(url, '^https?://') AS is_external,
  nullif(regexp_extract(url, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), '') AS url_date FROM pages""")
def strip_query_urls(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.strip_query(F.col("url")).alias("url_bare"), text.is_external_url(F.col("url")).alias("is_external"),
                          text.snapshot_date(F.col("url")).alias("url_date"))


_LINKS = r"""links AS (SELECT page_id, (i - 1)::BIGINT AS link_no, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href,
  trim(regexp_replace(a, '(?s)<[^>]*>', '', 'g')) AS link_text
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS a,
        generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>'), 1) AS i FROM pages))"""


@query("extract_links", f"WITH {_LINKS} SELECT * FROM links")
def extract_links(t: Tables) -> DataFrame:
    return scans.page_links(t.pages.select("page_id", "html")).withColumn("link_no", F.col("link_no").cast("bigint"))


@query("find_download_link", f"WITH {_LINKS} SELECT * FROM links WHERE upper(link_text) = 'THE' AND suffix(href, 'he')".replace("suffix(href, 'he')", "ends_with(href, 'he')"))
def find_download_link(t: Tables) -> DataFrame:
    return scans.find_link(t.pages.select("page_id", "html"), "THE", "he").withColumn("link_no", F.col("link_no").cast("bigint"))


@query("feed_entry", """SELECT 'oracle_cards' AS type, page_id, url, CASE WHEN url LIKE 'https%' THEN 'oracle_cards.jsonl.gz' ELSE 'oracle_cards.json' END AS filename FROM pages""")
def feed_entry(t: Tables) -> DataFrame:
    newer = F.when(F.col("url").startswith("https"), F.col("url"))
    older = F.when(~F.col("url").startswith("https"), F.col("url"))
    entry = F.struct(F.lit("oracle_cards").alias("type"), newer.alias("jsonl_download_uri"), older.alias("download_uri"))
    other = F.struct(F.lit("rulings").alias("type"), F.col("url").alias("jsonl_download_uri"), F.lit(None).cast("string").alias("download_uri"))
    feeds = t.pages.select("page_id", F.to_json(F.struct(F.array(other, entry).alias("data"))).alias("body"))
    return scans.resolve_feed_entry(feeds, "oracle_cards").select("type", "page_id", "url", "filename")


@query("latest_snapshot", """SELECT event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS snapshot_date FROM events
  WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_snapshot(t: Tables) -> DataFrame:
    dated = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("snapshot_date"))
    return scans.latest_snapshot(dated).withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def outline_documents(t: Tables) -> DataFrame:
    """Documents turned into outlines: a contents block, the lines with rule numbers put in
    front of every third one, a glossary with a rule that must not be read."""
    base = (F.lit(100) + F.pmod(F.col("doc_id"), F.lit(800))).cast("string")
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 6 == 0, F.concat(base, F.lit("."), (i + 1).cast("string"), F.lit(" "), x)).when(
        i % 6 == 3, F.concat(base, F.lit("."), (i - 2).cast("string"), F.lit("a "), x)).otherwise(x))
    return t.spread("documents", "doc_id").select("doc_id", F.concat(
        F.lit("1. Intro\n"), base, F.lit(". Contents\nGlossary\n1. Intro\n"), base, F.lit(". General\n\n"), F.array_join(numbered, "\n"),
        F.lit("\n2. More\nGlossary\n999.1 Never read.")).alias("text"))


_OUTLINE = r"""src AS (SELECT doc_id, (100 + doc_id % 800)::VARCHAR AS base, string_split(text, chr(10)) AS ls FROM documents),
full_text AS (SELECT doc_id, '1. Intro' || chr(10) || base || '. Contents' || chr(10) || 'Glossary' || chr(10) || '1. Intro' || chr(10) || base || '. General' || chr(10) || chr(10) ||
  array_to_string([CASE WHEN (i-1) % 6 = 0 THEN base || '.' || i || ' ' || ls[i] WHEN (i-1) % 6 = 3 THEN base || '.' || (i-3) || 'a ' || ls[i] ELSE ls[i] END FOR i IN range(1, len(ls)+1)], chr(10))
  || chr(10) || '2. More' || chr(10) || 'Glossary' || chr(10) || '999.1 Never read.' AS text FROM src),
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS x FROM full_text),
flagged AS (SELECT *, regexp_matches(x, '^\d{1,2}\.\s+\S') AS sec, regexp_extract(x, '^(\d{1,2})\.', 1) AS num FROM lines),
opened AS (SELECT doc_id, min(n) AS o, arg_min(num, n) AS num FROM flagged WHERE sec GROUP BY doc_id),
closed AS (SELECT f.doc_id, any_value(o.o) AS o, min(f.n) AS c FROM flagged f JOIN opened o ON f.doc_id = o.doc_id AND f.sec AND f.num = o.num AND f.n > o.o GROUP BY f.doc_id),
body AS (SELECT f.*, (f.n < c.o OR f.n > c.c) AS in_body FROM flagged f JOIN closed c USING (doc_id)),
gloss AS (SELECT doc_id, min(n) AS g FROM body WHERE in_body AND x = 'Glossary' GROUP BY doc_id),
kept AS (SELECT b.doc_id, b.n, b.x, regexp_matches(b.x, '^(\d{3}(?:\.\d+[a-z]?)?)\.?\s+(\S.*)$') AS head FROM body b JOIN gloss g USING (doc_id) WHERE in_body AND NOT sec AND x <> '' AND n < g),
grouped AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM kept),
folded AS (SELECT doc_id, min(n)::BIGINT AS line_no, regexp_extract(arg_min(x, n), '^(\d{3}(?:\.\d+[a-z]?)?)\.?\s+(\S.*)$', 1) AS rule_id,
  string_agg(CASE WHEN head THEN regexp_extract(x, '^(\d{3}(?:\.\d+[a-z]?)?)\.?\s+(\S.*)$', 2) ELSE x END, ' ' ORDER BY n) AS text FROM grouped WHERE grp > 0 GROUP BY doc_id, grp)
SELECT doc_id, line_no, rule_id, text, CASE WHEN rule_id NOT LIKE '%.%' THEN NULL WHEN regexp_matches(rule_id, '[a-z]$') THEN substr(rule_id, 1, length(rule_id)-1)
  ELSE split_part(rule_id, '.', 1) END AS parent_id, sha256(rule_id || chr(31) || text) AS content_hash FROM folded"""


@query("outline_chunks", "WITH " + _OUTLINE)
def outline_chunks(t: Tables) -> DataFrame:
    return outline.parse_outline(outline_documents(t)).withColumn("line_no", F.col("line_no").cast("bigint"))


def tree(t: Tables) -> DataFrame:
    """Region > nation > customer as a rule tree in file order."""
    region = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("rule_id"), F.lit(None).cast("string").alias("parent_id"),
                             F.col("r_name").alias("text"), F.col("r_regionkey").cast("bigint").alias("line_no"))
    nation = t.nation.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.concat("n_name", F.lit(".")),
                             (F.col("n_nationkey") + 1000).cast("bigint"))
    customer = t.customer.select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.concat("c_name", F.lit(":")),
                                 (F.col("c_custkey") + 100000).cast("bigint"))
    return region.union(nation).union(customer)


TREE = """tree AS (SELECT 'R' || r_regionkey AS rule_id, NULL::VARCHAR AS parent_id, r_name AS text, r_regionkey::BIGINT AS line_no FROM region
 UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name || '.', (n_nationkey + 1000)::BIGINT FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name || ':', (c_custkey + 100000)::BIGINT FROM customer)"""


@query("ancestor_breadcrumbs", f"""WITH RECURSIVE {TREE},
up AS (SELECT rule_id, parent_id AS nxt, '' AS crumb, 0::BIGINT AS depth, CASE WHEN length(text) <= 60 AND NOT regexp_matches(rtrim(text), '[.:)]$') THEN text END AS heading FROM tree
  UNION ALL SELECT u.rule_id, p.parent_id, CASE WHEN p.parent_id IS NULL THEN 'Section ' ELSE '' END || p.rule_id || ': ' || p.text || CASE WHEN u.crumb = '' THEN '' ELSE ' > ' || u.crumb END, u.depth + 1,
  coalesce(u.heading, CASE WHEN length(p.text) <= 60 AND NOT regexp_matches(rtrim(p.text), '[.:)]$') THEN p.text END) FROM up u JOIN tree p ON u.nxt = p.rule_id)
SELECT rule_id, depth, CASE WHEN crumb = '' THEN '' ELSE crumb || chr(10) END AS breadcrumb, heading FROM up WHERE nxt IS NULL""")
def ancestor_breadcrumbs(t: Tables) -> DataFrame:
    a = outline.with_ancestors(tree(t))
    return a.select("rule_id", F.size("ancestors").cast("bigint").alias("depth"), outline.breadcrumb(F.col("ancestors")).alias("breadcrumb"),
                    outline.heading(F.col("text"), F.col("ancestors")).alias("heading"))


@query("children_in_order", f"""WITH {TREE} SELECT c.parent_id, c.rule_id, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.line_no) - 1 AS position
  FROM tree c JOIN tree p ON c.parent_id = p.rule_id""")
def children_in_order(t: Tables) -> DataFrame:
    return outline.children(tree(t)).select("parent_id", "rule_id", "position")


_TITLES = " ".join(f"WHEN {n} THEN '{title}'" for n, title in outline.SECTION_TITLES.items())


@query("toc_sections", f"""WITH r AS (SELECT (100 + p_partkey % 900)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '.' || p_partkey ELSE '' END AS rule_id, p_name AS text, p_partkey AS line_no FROM part)
SELECT left(rule_id, 1)::INT AS section, CASE left(rule_id, 1)::INT {_TITLES} END AS section_title, rule_id, text,
 row_number() OVER (PARTITION BY left(rule_id, 1) ORDER BY line_no) - 1 AS position FROM r WHERE regexp_matches(rule_id, '^\\d{{3}}$')""")
def toc_sections(t: Tables) -> DataFrame:
    number = (F.lit(100) + F.col("p_partkey") % 900).cast("string")
    rules = t.part.select(F.concat(number, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), F.col("p_partkey").cast("string"))).otherwise("")).alias("rule_id"),
                          F.col("p_name").alias("text"), F.col("p_partkey").alias("line_no"))
    return outline.table_of_contents(rules).select("section", "section_title", "rule_id", "text", "position")


@query("siblings_prev_next", f"""WITH {TREE} SELECT rule_id, lag(rule_id) OVER w AS prev, lead(rule_id) OVER w AS next FROM tree WINDOW w AS (PARTITION BY parent_id ORDER BY line_no)""")
def siblings_prev_next(t: Tables) -> DataFrame:
    return outline.neighbours(tree(t), ["parent_id"], "line_no", "rule_id").select("rule_id", "prev", "next")


@query("window_around", """WITH p AS (SELECT p_brand AS g, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS total FROM part),
w AS (SELECT g, p_partkey AS window_id, CASE WHEN total <= 14 THEN 0 ELSE least(greatest(0, pos - 7), total - 14) END AS s FROM p)
SELECT w.window_id, p.p_partkey, p.pos AS position FROM w JOIN p ON p.g = w.g AND p.pos >= w.s AND p.pos < w.s + 14""")
def window_around(t: Tables) -> DataFrame:
    totals = t.part.groupBy("p_brand").agg(F.count("*").alias("total"))
    placed = ordinal(t.part.select(F.col("p_brand"), "p_partkey"), ["p_brand"], "p_partkey", "position")
    centres = placed.join(totals, "p_brand").withColumn("window_id", F.col("p_partkey"))
    return outline.window_around(placed, centres, 14, "p_brand").select("window_id", "p_partkey", "position")


def raw_cards(t: Tables) -> DataFrame:
    """Part rows in the shape of raw card records, two-faced ones included."""
    k = F.col("p_partkey")
    face = lambda text_col, power: F.struct(
        text_col.alias("oracle_text"), power.alias("power"), F.lit(None).cast("string").alias("toughness"), F.lit(None).cast("string").alias("loyalty"),
        F.struct(F.concat(F.lit("http://img/normal/"), k.cast("string")).alias("normal")).alias("image_uris"))
    faces = F.array(face(F.col("p_type"), F.col("p_size").cast("string")), face(F.lit(None).cast("string"), F.lit("0")))
    none = F.lit(None).cast("string")
    return t.part.select(
        F.when(k % 13 == 0, "").when(k % 13 == 1, none).otherwise(F.concat(F.lit("id"), k.cast("string"))).alias("oracle_id"), F.col("p_name").alias("name"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat("p_brand", F.lit(" "), "p_type")).otherwise(none).alias("oracle_text"), F.col("p_type").alias("type_line"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit("{R}")).alias("mana_cost"), F.concat(F.lit("http://cards/"), k.cast("string"), F.lit("?utm=api")).alias("scryfall_uri"),
        F.when(k % 5 == 0, "9").alias("power"), none.alias("toughness"), none.alias("loyalty"), F.lit(None).cast("struct<normal:string>").alias("image_uris"),
        F.when(k % 2 == 0, faces).alias("card_faces"), k.alias("line_no"))


CARDS = """cards AS (SELECT p_partkey AS line_no, 'id' || p_partkey AS oracle_id, p_name AS name,
 CASE WHEN p_partkey % 3 = 1 THEN p_brand || ' ' || p_type WHEN p_partkey % 2 = 0 THEN p_type || chr(10) || '//' || chr(10) ELSE '' END AS oracle_text, p_type AS type_line,
 CASE WHEN p_partkey % 4 = 1 THEN '{R}' END AS mana_cost, 'http://cards/' || p_partkey AS scryfall_uri, CASE WHEN p_partkey % 5 = 0 THEN '9' WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS power,
 CASE WHEN p_partkey % 2 = 0 THEN 'http://img/normal/' || p_partkey END AS image_uri FROM part WHERE p_partkey % 13 NOT IN (0, 1))"""
CARD_HASH = "sha256(oracle_id || chr(31) || name || chr(31) || oracle_text || chr(31) || type_line || chr(31) || coalesce(mana_cost, ''))"


@query("card_records", f"WITH {CARDS} SELECT oracle_id, name, oracle_text, mana_cost, scryfall_uri, power, image_uri, {CARD_HASH} AS content_hash FROM cards")
def card_records(t: Tables) -> DataFrame:
    return chunks.parse_cards(raw_cards(t)).select("oracle_id", "name", "oracle_text", "mana_cost", "scryfall_uri", "power", "image_uri", "content_hash")


@query("parent_chunks", f"""WITH {CARDS} SELECT {uuid_sql("'oracle:' || oracle_id")} AS point_id, name || chr(10) || type_line || chr(10) || coalesce(mana_cost, '') || chr(10) || oracle_text AS text_to_embed,
 {CARD_HASH} AS content_hash, 'oracle' AS source_type, name AS card_name, sha256('{{"card_name":' || to_json(name) || ',"content_hash":"' || {CARD_HASH} || '","oracle_id":' || to_json(oracle_id) ||
 ',"scryfall_uri":' || to_json(scryfall_uri) || ',"source_type":"oracle","text":' || to_json(oracle_text) || '}}') AS payload_hash FROM cards""")
def parent_chunks(t: Tables) -> DataFrame:
    c = chunks.card_chunks(chunks.parse_cards(raw_cards(t)))
    return c.select("point_id", "text_to_embed", "content_hash", "source_type", F.col("payload.card_name").alias("card_name"), "payload_hash")


def order_rulings(t: Tables) -> DataFrame:
    """Orders as rulings: the key misses some customers, the comment is the order's state."""
    key = F.concat(F.lit("c"), (F.col("o_custkey") + 5 * (F.col("o_orderkey") % 11)).cast("string"))
    raw = t.orders.select(key.alias("oracle_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"),
                          F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("comment"), F.col("o_orderkey").alias("line_no"))
    return chunks.parse_rulings(raw)


def customer_cards(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("oracle_id"), F.col("c_name").alias("name"),
                             F.repeat(F.concat("c_mktsegment", F.lit(" ")), 30).alias("oracle_text"), F.lit(None).cast("string").alias("scryfall_uri"))


RULINGS = """rulings AS (SELECT 'c' || (o_custkey + 5 * (o_orderkey % 11)) AS oracle_id, strftime(o_orderdate, '%Y-%m-%d') AS published_at, o_orderpriority || ' ' || o_orderstatus AS comment, o_orderkey AS line_no FROM orders),
custcards AS (SELECT 'c' || c_custkey AS oracle_id, c_name AS name, repeat(c_mktsegment || ' ', 30) AS oracle_text FROM customer)"""


@query("child_chunks_with_parent", f"""WITH {RULINGS}, placed AS (SELECT *, row_number() OVER (PARTITION BY oracle_id ORDER BY line_no) - 1 AS ordinal FROM rulings)
SELECT {uuid_sql("'ruling:' || p.oracle_id || ':' || p.ordinal")} AS point_id, c.name || ' — ' || substr(c.oracle_text, 1, 200) || chr(10) || 'Ruling: ' || p.comment AS text_to_embed,
 sha256(p.oracle_id || chr(31) || p.published_at || chr(31) || p.comment) AS content_hash, c.name AS card_name, p.published_at FROM placed p JOIN custcards c USING (oracle_id)""")
def child_chunks_with_parent(t: Tables) -> DataFrame:
    c = chunks.ruling_chunks(order_rulings(t), customer_cards(t))
    return c.select("point_id", "text_to_embed", "content_hash", F.col("payload.card_name").alias("card_name"), F.col("payload.published_at").alias("published_at"))


@query("unmatched_children", f"WITH {RULINGS} SELECT count(*) AS skipped_no_card FROM rulings WHERE oracle_id NOT IN (SELECT oracle_id FROM custcards)")
def unmatched_children(t: Tables) -> DataFrame:
    return chunks.skipped_rulings(order_rulings(t), customer_cards(t))


@query("rule_chunks", f"""WITH RECURSIVE {TREE},
up AS (SELECT rule_id, text, parent_id AS nxt, '' AS crumb, rule_id AS top_id, text AS top_text FROM tree
  UNION ALL SELECT u.rule_id, u.text, p.parent_id, CASE WHEN p.parent_id IS NULL THEN 'Section ' ELSE '' END || p.rule_id || ': ' || p.text || CASE WHEN u.crumb = '' THEN '' ELSE ' > ' || u.crumb END, p.rule_id, p.text
  FROM up u JOIN tree p ON u.nxt = p.rule_id)
SELECT {uuid_sql("'rule:' || rule_id")} AS point_id, CASE WHEN crumb = '' THEN '' ELSE crumb || chr(10) END || text AS text_to_embed, top_id AS section_id, top_text AS section_title FROM up WHERE nxt IS NULL""")
def rule_chunks(t: Tables) -> DataFrame:
    nodes = tree(t).withColumn("content_hash", hashing.content_hash(F.col("rule_id"), F.col("text")))
    return chunks.rule_chunks(nodes).select("point_id", "text_to_embed", F.col("payload.section_id").alias("section_id"), F.col("payload.section_title").alias("section_title"))


@query("rule_id_forms", """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (100 + p_partkey % 900)::VARCHAR WHEN 1 THEN (100 + p_partkey % 900) || '.' || p_size WHEN 2 THEN (100 + p_partkey % 900) || '.' || p_size || 'b'
 ELSE ' ' || (100 + p_partkey % 900) || '.' || p_size || 'B. ' END AS raw FROM part), n AS (SELECT p_partkey, lower(regexp_replace(trim(raw), '\\.+$', '')) AS rule_id FROM r)
SELECT p_partkey, rule_id, CASE WHEN rule_id LIKE '%b' THEN substr(rule_id, 1, length(rule_id) - 1) ELSE rule_id END AS entry_id, regexp_matches(rule_id, '^\\d{3}$') AS top_level, left(rule_id, 1)::INT AS section FROM n""")
def rule_id_forms(t: Tables) -> DataFrame:
    base, size, k = (F.lit(100) + F.col("p_partkey") % 900).cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(k == 0, base).when(k == 1, F.concat(base, F.lit("."), size)).when(k == 2, F.concat(base, F.lit("."), size, F.lit("b"))).otherwise(
        F.concat(F.lit(" "), base, F.lit("."), size, F.lit("B. ")))
    r = F.col("rule_id")
    return t.part.select("p_partkey", text.normalize_rule_id(raw).alias("rule_id")).select(
        "p_partkey", "rule_id", text.entry_id(r).alias("entry_id"), text.is_top_level(r).alias("top_level"), text.section_of(r).alias("section"))
