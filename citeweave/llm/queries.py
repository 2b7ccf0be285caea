"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import materialize
from . import bpe, decontaminate, licenses, near, packing, pii, quality, recompress, repair, suffixes, topk, toxicity, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_bpe")
def op1(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@register("op4_decontaminate", OP4_SQL)
def op4(spark, sf_dir):
    return decontaminate.contamination(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@register("op7_quality")
def op7(spark, sf_dir):
    found = materialize(quality.vectors(table(spark, sf_dir, "documents")), "quality")
    return quality.score(found, quality.fit(found, table(spark, sf_dir, "labels")))


OP10_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.k <> c.k)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@register("op10_topk", OP10_SQL)
def op10(spark, sf_dir):
    points = materialize(topk.prepare(table(spark, sf_dir, "embeddings")), "topk-points")
    return topk.search(points, points.where("id % 50 = 0"), 5)


@register("op2_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register("op6_pii")
def op6(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return pii.report(documents, pii.train(documents))


@register("op8_licenses", licenses.oracle())
def op8(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@register("op5_near_duplicates", OP5_SQL)
def op5(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5(b[i : i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
again AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER w > 200, TRUE) AS opens FROM s SEMI JOIN again USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g) GROUP BY doc_id, n),
kept AS (SELECT doc_id, coalesce(lag(z) OVER w, 1) AS a, a AS z, z AS next, lead(a) OVER w IS NULL AS final FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
parts AS (SELECT doc_id, a, z FROM kept UNION ALL SELECT doc_id, next, NULL FROM kept WHERE final),
cut AS (SELECT doc_id, string_agg(hex(CASE WHEN p.z IS NULL THEN b[p.a :] WHEN p.z > p.a THEN b[p.a : p.z - 1] ELSE ''::BLOB END), '' ORDER BY p.a) AS rest FROM parts p JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN rest IS NULL THEN b ELSE unhex(rest) END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


@register("op3_suffix_dedup", OP3_SQL)
def op3(spark, sf_dir):
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT h, min(doc_id) AS origin FROM s GROUP BY h),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS p FROM s JOIN firsts USING (h) WHERE doc_id > origin GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
 sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""


@register("op9_substring_dedup", OP9_SQL)
def op9(spark, sf_dir):
    return recompress.dedup_words(table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    """Damage by CRC in bit operations; repairs by a running list of the four states' lightest repairs, each a string of cost and audit."""

    def add(x: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {x} = '~' THEN '~' ELSE lpad(({x}[1:8]::BIGINT + {cost})::VARCHAR, 8, '0') || {x}[9:] || '{edit}' END"

    e, s, u, a = (f"acc[{i}]" for i in (1, 2, 3, 4))
    closed = {"u": f"least({u}, {add(e, '2', 'I')}, {add(s, '2', 'I')}, {add(a, '2', 'I')})"}
    opened = f"list_transform([[{e}, {s}, {closed['u']}, {a}]], lambda q: [q[1], q[2], q[3], least(q[4], {add('q[3]', '2', 'I')})])[1]"
    e, s, u, a = (f"q[{i}]" for i in (1, 2, 3, 4))
    kind, more = "row[1]", "(CASE WHEN row[2] = 'truncated' THEN 1 ELSE 0 END)"
    before = f"least({e}, {s}, {a})"

    def to(state: str, source: str, initial: str) -> str:
        written = f"{add(source, more, 'K')}" if initial == "s" else f"least({add(source, '2 + ' + more, 'R')}, CASE WHEN {kind} = '{initial}' THEN {add(source, more, 'K')} ELSE '~' END)"
        good = "row[2] NOT IN ('blank', 'duplicate')" + (f" AND {kind} = 's'" if initial == "s" else "")
        return f"least({add(state, '3', 'D')}, CASE WHEN {good} THEN {written} ELSE '~' END)"

    step = f"list_transform([{opened}], lambda q: [{add(e, '3', 'D')}, {to(s, e, 's')}, {to(u, before, 'u')}, {to(a, u, 'a')}])[1]"
    final = f"least(st[1], st[4], {add('st[3]', '2', 'I')}, {add('st[2]', '4', 'II')})"
    return rf"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (SELECT * EXCLUDE (t, k), xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS h FROM keyed, bits),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
            FROM hashed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
judged AS (SELECT conv_id, turn, role, text, i, role[1:1] AS kind, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
           role[1:1] || lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM placed),
whole AS (SELECT conv_id, (coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0))::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list_reduce(list_prepend(['00000000', '~', '~', '~'], list([kind, fault] ORDER BY i)), lambda acc, row: {step}) AS st FROM judged GROUP BY conv_id),
best AS (SELECT * EXCLUDE (st), {final} AS w FROM whole),
edits AS (SELECT conv_id, w, e, edit, count(*) FILTER (edit <> 'I') OVER o AS i, count(*) FILTER (edit <> 'D') OVER o AS written, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) AS total
          FROM (SELECT conv_id, w, unnest(range(1, len(w) - 7)) AS e, w[7 + e + 1] AS edit FROM best) WINDOW o AS (PARTITION BY conv_id ORDER BY e)),
lines AS (SELECT x.conv_id, e, CASE WHEN edit = 'K' THEN role WHEN (total - written) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
          FROM edits x LEFT JOIN judged y ON x.conv_id IS NOT DISTINCT FROM y.conv_id AND x.i = y.i WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY e) AS t FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(w[1:8]::BIGINT, 0) AS cost, coalesce(w[9:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts x ON c.conv_id IS NOT DISTINCT FROM x.conv_id
"""


@register("op11_whitening")
def op11(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_toxicity")
def op12(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = _op13_sql()


@register("op13_conversation_repair", OP13_SQL)
def op13(spark, sf_dir):
    return repair.report(table(spark, sf_dir, "conversations"))
