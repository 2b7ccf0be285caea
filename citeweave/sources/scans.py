"""Scans of raw records, whole documents, dated snapshots, feed catalogues and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import snapshot_date

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# The characters that count as blank at the ends of a line.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newline JSON (plain or gzip; blank lines are skipped) or, for a bare ``.json``
    file, one JSON array."""
    reader = spark.read.schema(schema)
    if path.rstrip("/").endswith(".json"):
        reader = reader.option("multiLine", True)
    return reader.json(path)


def pick_format(spark: SparkSession, directory: str, name: str) -> str:
    """The current compressed format of a source when it is there, else the older ones."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(directory)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for suffix in (".jsonl.gz", ".jsonl", ".json"):
        candidate = jvm.org.apache.hadoop.fs.Path(folder, name + suffix)
        if fs.exists(candidate):
            return candidate.toString()
    raise FileNotFoundError(f"no {name} in any known format under {directory}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each: ``doc_id`` (the file path) and ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table with fewer splits than the cluster has cores over all cores, by a unique
    key. Tables with enough splits stay as they are, so nothing large is ever shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def document_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with its position; no shuffle."""
    return documents.select(doc_id, F.posexplode(F.split(text, LINE_BREAK, -1)).alias("line_no", "line"))


def read_numbered_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newline JSON with ``line_no`` = position in file order, for ordinals that must not
    change between runs. A gzip file is one split anyway; plain files are read whole."""
    documents = read_documents(spark, path)
    return (
        document_lines(documents).filter(F.trim("line") != "")
        .select("doc_id", "line_no", F.from_json("line", schema).alias("r")).select("doc_id", "line_no", "r.*")
    )


def latest_snapshot(df: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot. The maximum is a scalar subquery, so a partition
    column prunes files at run time; an empty table raises."""
    newest = df.groupBy().agg(F.max(column).alias("m"))
    newest = newest.select(F.when(F.col("m").isNull(), F.raise_error(F.lit("no snapshot found")).cast(df.schema[column].dataType)).otherwise(F.col("m")))
    return df.filter(F.col(column) == newest.scalar())


def with_snapshot_date(df: DataFrame) -> DataFrame:
    """Add the date found in each row's file name."""
    return df.withColumn("snapshot_date", snapshot_date(F.col("_metadata.file_name")))


def resolve_feed_entry(catalogue: DataFrame, data_type: str, body: str = "body") -> DataFrame:
    """Location of one feed in a JSON catalogue: the newer URL field, else the older
    one; an entry with neither raises. Other columns of the catalogue are kept."""
    entry = "struct<type:string,jsonl_download_uri:string,download_uri:string>"
    kept = [c for c in catalogue.columns if c != body]
    entries = catalogue.select(*kept, F.explode(F.from_json(body, f"struct<data:array<{entry}>>").data).alias("e")).filter(F.col("e.type") == data_type)
    newer, older = F.col("e.jsonl_download_uri"), F.col("e.download_uri")
    return entries.select(
        *kept, F.col("e.type").alias("type"),
        F.coalesce(newer, older, F.raise_error(F.lit(f"no location for {data_type}")).cast("string")).alias("url"),
        F.when(newer.isNotNull(), f"{data_type}.jsonl.gz").otherwise(f"{data_type}.json").alias("filename"),
    )


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every anchor of every page: position, address and text without tags."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    return pages.select("*", F.posexplode(anchors).alias("link_no", "_a")).select(
        *[c for c in pages.columns if c != html], "link_no",
        F.regexp_extract("_a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
        F.regexp_replace(F.regexp_replace("_a", r"(?s)<[^>]*>", ""), r"(?U)^\s+|\s+$", "").alias("link_text"),
    )


def find_link(pages: DataFrame, text: str = "TXT", suffix: str = ".txt") -> DataFrame:
    """Links whose text equals ``text`` (any case) and whose address ends in ``suffix``."""
    return page_links(pages).filter((F.upper("link_text") == text.upper()) & F.col("href").endswith(suffix))


def sse_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Frames of captured event streams: one row per frame with a data line. An
    unfinished last frame is not an event yet."""
    blocks = F.split(raw, "\n\n", -1)
    finished = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    lines = F.split("_block", "\n", -1)
    data = F.filter(lines, lambda x: x.startswith("data:"))
    names = F.filter(lines, lambda x: x.startswith("event:"))
    name = F.trim(F.substring(F.element_at(names, -1), 7, 1 << 30))
    return (
        df.select(*[c for c in df.columns if c != raw], F.posexplode(finished).alias("frame", "_block"))
        .filter(F.size(data) > 0)
        .select(
            *[c for c in df.columns if c != raw], "frame",
            F.when(F.size(names) > 0, name).otherwise("message").alias("event"),
            F.array_join(F.transform(data, lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), "^ ", "")), "\n").alias("data"),
        )
    )


def sse_frame(event: Column, data: Column) -> Column:
    """One event as a frame; ``data`` is one-line JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))
