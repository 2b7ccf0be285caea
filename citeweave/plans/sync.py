"""Queries on incremental sync: two derived snapshots of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sync
from ..sources import points as store
from .registry import Tables, query

# Stored: all documents but every 7th, as of an earlier state. New: all but every 11th.
_SPARSE = "struct<indices:array<bigint>,values:array<double>>"


def stored_points(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.documents.filter(k % 7 != 0).select(
        k.cast("string").alias("point_id"), F.concat(F.lit("s"), F.pmod(k, F.lit(3)).cast("string")).alias("source_type"),
        F.sha2("text", 256).alias("content_hash"), F.when(k % 13 == 1, F.lit(None).cast("string")).otherwise(F.sha2(F.concat("lang", "source"), 256)).alias("payload_hash"),
        F.col("lang").alias("payload"), F.array(F.col("n_chars").cast("float")).alias("dense"), F.lit(None).cast(_SPARSE).alias("sparse"))


def new_chunks(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    text = F.when(k % 5 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text"))
    lang = F.when(k % 4 == 0, F.concat("lang", F.lit("2"))).otherwise(F.col("lang"))
    return t.documents.filter(k % 11 != 0).select(
        k.cast("string").alias("point_id"), F.concat(F.lit("s"), F.pmod(k, F.lit(3)).cast("string")).alias("source_type"), text.alias("text_to_embed"),
        F.sha2(text, 256).alias("content_hash"), F.sha2(F.concat(lang, "source"), 256).alias("payload_hash"), lang.alias("payload"))


SNAPSHOTS = """stored AS (SELECT doc_id::VARCHAR AS point_id, 's' || doc_id % 3 AS source_type, sha256(text) AS content_hash, CASE WHEN doc_id % 13 = 1 THEN NULL ELSE sha256(lang || source) END AS payload_hash,
  lang AS payload, n_chars::DOUBLE AS dense FROM documents WHERE doc_id % 7 <> 0),
fresh AS (SELECT doc_id::VARCHAR AS point_id, 's' || doc_id % 3 AS source_type, CASE WHEN doc_id % 5 = 0 THEN text || ' v2' ELSE text END AS text_to_embed,
  sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' v2' ELSE text END) AS content_hash, sha256(CASE WHEN doc_id % 4 = 0 THEN lang || '2' ELSE lang END || source) AS payload_hash,
  CASE WHEN doc_id % 4 = 0 THEN lang || '2' ELSE lang END AS payload FROM documents WHERE doc_id % 11 <> 0),
classified AS (SELECT f.*, CASE WHEN s.point_id IS NULL OR s.content_hash <> f.content_hash THEN 'embed' WHEN s.payload_hash IS DISTINCT FROM f.payload_hash THEN 'payload' ELSE 'skip' END AS action
  FROM fresh f LEFT JOIN stored s USING (point_id)),
stale AS (SELECT point_id, source_type FROM stored WHERE source_type IN (SELECT source_type FROM fresh) AND point_id NOT IN (SELECT point_id FROM fresh))"""


@query("sync_classify", f"WITH {SNAPSHOTS} SELECT point_id, source_type, action FROM classified")
def sync_classify(t: Tables) -> DataFrame:
    return sync.classify(new_chunks(t), stored_points(t)).select("point_id", "source_type", "action")


@query("prune_stale", f"WITH {SNAPSHOTS} SELECT * FROM stale")
def prune_stale(t: Tables) -> DataFrame:
    return sync.stale_points(new_chunks(t), stored_points(t)).select("point_id", "source_type")


@query("sync_summary", f"""WITH {SNAPSHOTS}, rows AS (SELECT source_type, action FROM classified UNION ALL SELECT source_type, 'pruned' FROM stale)
SELECT coalesce(source_type, 'TOTAL') AS source_type, count(*) FILTER (action <> 'pruned') AS total_seen, count(*) FILTER (action = 'embed') AS embedded,
 count(*) FILTER (action = 'skip') AS skipped_unchanged, count(*) FILTER (action = 'payload') AS payload_updated, count(*) FILTER (action = 'pruned') AS pruned FROM rows GROUP BY ROLLUP (source_type)""")
def sync_summary(t: Tables) -> DataFrame:
    chunks, stored = new_chunks(t), stored_points(t)
    return sync.summary(sync.classify(chunks, stored), sync.stale_points(chunks, stored))


def _encode(changed: DataFrame) -> DataFrame:
    # Stand-in vector: the length of the text that was embedded.
    return changed.withColumn("dense", F.when(F.col("text_to_embed").isNotNull(), F.array(F.length("text_to_embed").cast("float")))).withColumn("sparse", F.lit(None).cast(_SPARSE))


@query("sync_apply", f"""WITH {SNAPSHOTS} SELECT c.point_id, c.source_type, c.content_hash, c.payload_hash, c.payload, CASE WHEN c.action = 'embed' THEN length(c.text_to_embed)::DOUBLE ELSE s.dense END AS vector
FROM classified c LEFT JOIN stored s USING (point_id)""")
def sync_apply(t: Tables) -> DataFrame:
    return sync.apply(new_chunks(t), stored_points(t), _encode).select(
        "point_id", "source_type", "content_hash", "payload_hash", "payload", F.get("dense", F.lit(0)).cast("double").alias("vector"))


@query("upsert_delete_points", f"""WITH {SNAPSHOTS}, changed AS (SELECT point_id, source_type, content_hash, payload_hash, payload, length(text_to_embed)::DOUBLE AS vector FROM classified WHERE action = 'embed'),
kept AS (SELECT point_id, source_type, content_hash, payload_hash, payload, dense AS vector FROM stored WHERE point_id NOT IN (SELECT point_id FROM changed) UNION ALL SELECT * FROM changed),
patched AS (SELECT k.point_id, k.source_type, k.content_hash, CASE WHEN c.point_id IS NULL THEN k.payload_hash ELSE c.payload_hash END AS payload_hash, CASE WHEN c.point_id IS NULL THEN k.payload ELSE c.payload END AS payload, k.vector
  FROM kept k LEFT JOIN (SELECT * FROM classified WHERE action = 'payload') c USING (point_id))
SELECT * FROM patched WHERE point_id NOT IN (SELECT point_id FROM stale)""")
def upsert_delete_points(t: Tables) -> DataFrame:
    chunks, stored = new_chunks(t), stored_points(t)
    todo = sync.classify(chunks, stored)
    embed = todo.filter(F.col("action") == "embed")
    changed = _encode(embed).select(stored.columns)
    out = store.overwrite_payloads(store.upsert(stored, changed), todo.filter(F.col("action") == "payload"))
    out = store.delete(out, sync.stale_points(chunks, stored))
    return out.select("point_id", "source_type", "content_hash", "payload_hash", "payload", F.get("dense", F.lit(0)).cast("double").alias("vector"))


@query("point_count", "SELECT count(*) AS points_count FROM documents WHERE doc_id % 7 <> 0")
def point_count(t: Tables) -> DataFrame:
    return store.count(stored_points(t))


@query("stored_hashes", f"WITH {SNAPSHOTS} SELECT f.point_id, s.content_hash, s.payload_hash FROM fresh f LEFT JOIN stored s USING (point_id)")
def stored_hashes(t: Tables) -> DataFrame:
    return new_chunks(t).select("point_id").join(store.stored_hashes(stored_points(t)), "point_id", "left").select("point_id", "content_hash", "payload_hash")
