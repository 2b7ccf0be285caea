"""Append-only tables: ledger events, history, answer cache, run records, published snapshots."""

from __future__ import annotations

from urllib.parse import quote
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F



def write_counted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> int:
    """Write a table and return its row count, measured by the write itself."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return seen.get["rows"]


def append_ledger(rows: DataFrame, path: str) -> int:
    """Append ledger rows, one folder per UTC day."""
    return write_counted(rows.withColumn("day", F.to_date("created_at")), path, mode="append", partition_by=("day",))


def latest_by_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last state of every key: the row with the greatest ``order`` columns. One
    aggregation with map-side combine, so a hot key costs no more than a cold one."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(df.columns)


def settled_ledger(reservations: DataFrame, settlements: DataFrame) -> DataFrame:
    """Ledger rows after settlement: a settled answer takes its real outcome and cost, a
    reservation that never settled stays pending at its worst-case cost."""
    final = latest_by_key(settlements, ["id"], "settled_at").select(
        "id", F.col("outcome").alias("_outcome"), F.col("cost_usd").alias("_cost"),
        *[F.col(c).alias(f"_{c}") for c in ("input_tokens", "output_tokens", "thinking_tokens")])
    filled = {"outcome": F.coalesce("_outcome", F.lit("pending")), "cost_usd": F.coalesce("_cost", "cost_usd")}
    filled |= {c: F.coalesce(f"_{c}", F.lit(0)) for c in ("input_tokens", "output_tokens", "thinking_tokens")}
    kept = [c for c in reservations.columns if c not in filled]
    return reservations.join(final, "id", "left").select(*kept, *[v.alias(k) for k, v in filled.items()])


def history_page(history: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first. Only limit + offset rows per task reach the final sort."""
    return history.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def history_entry(history: DataFrame, history_id: int) -> DataFrame:
    return history.filter(F.col("id") == history_id)


def savable_history(requests: DataFrame, eval_mode: Column, source: str = "source") -> DataFrame:
    """Evaluation requests are not user questions and are left out."""
    return requests.filter(~(eval_mode & F.coalesce(F.col(source) == "eval", F.lit(False))))


def cache_entries(cache_log: DataFrame) -> DataFrame:
    """Current entry per key of an append-only cache log."""
    return latest_by_key(cache_log, ["key"], "created_at")


def hit_counts(cache: DataFrame, lookups: DataFrame) -> DataFrame:
    """Entries with the number of lookups since they were written."""
    hits = lookups.join(cache.select("key", "created_at"), "key").filter(F.col("looked_up_at") >= F.col("created_at"))
    return cache.join(hits.groupBy("key").agg(F.count("*").alias("hit_count")), "key", "left").fillna(0, ["hit_count"])


def data_version(versions: DataFrame | None, snapshots: DataFrame) -> DataFrame:
    """The last published version, else one made of the newest snapshot of each kind
    (``none`` for a kind without any)."""
    kinds = snapshots.agg(*[
        F.coalesce(F.max(F.when(F.col("kind") == k, F.col("name"))), F.lit("none")).alias(k) for k in ("cards", "rules")])
    derived = kinds.select(F.concat_ws("|", "cards", "rules").alias("derived"))
    if versions is None:
        return derived.select(F.col("derived").alias("data_version"))
    latest = versions.agg(F.max_by("version", "published_at").alias("version"))
    return latest.select(F.coalesce(F.col("version"), derived.scalar()).alias("data_version"))


def publish(df: DataFrame, base: str, version: str, now: datetime | None = None) -> DataFrame:
    """Write a new version of a table, check that it reads back with the same number of
    rows, and only then append it to the version table."""
    spark = df.sparkSession
    target = f"{base}/version={quote(version, safe=str())}"
    written = write_counted(df, target)
    read = spark.read.schema(df.schema).parquet(target).count()
    if read != written:
        raise RuntimeError(f"published {read} rows, expected {written}")
    stamp = (now or datetime.now(timezone.utc)).isoformat(timespec="seconds")
    row = spark.range(1).select(F.lit(version).alias("version"), F.lit(stamp).alias("published_at"), F.lit(written).alias("rows"))
    row.write.mode("append").parquet(f"{base}/_versions")
    return spark.read.parquet(f"{base}/_versions")


def write_run(base: str, run_id: str, metadata: DataFrame, records: DataFrame, aggregates: DataFrame) -> None:
    """One evaluation run as three tables under ``base``, each in a folder of the run. The metadata go last: a run
    without them is not there."""
    for name, part in (("case_results", records), ("aggregates", aggregates), ("runs", metadata)):
        part.write.mode("overwrite").parquet(f"{base}/{name}/run_id={quote(run_id, safe=str())}")


def read_run(spark: SparkSession, base: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of all runs or, with ``run_id``, of that one (``runs``, ``case_results``, ``aggregates``)."""
    rows = spark.read.parquet(f"{base}/{name}")
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def latest_run(runs: DataFrame, mode: str | None = None) -> DataFrame:
    """The newest run, optionally of one mode."""
    pool = runs if mode is None else runs.filter(F.col("mode") == mode)
    return pool.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def baseline_key(mode: Column, generator: Column) -> Column:
    """What a baseline is kept under: full runs by their generator, other runs by mode alone."""
    return F.concat_ws("/", mode, F.when(mode == "full", generator))


def run_name(started: Column, sha: Column, dirty: Column, mode: Column, experiment: Column) -> Column:
    return F.concat_ws("-", F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), sha, F.when(dirty, "dirty"), mode, F.nullif(experiment, F.lit("")))


def promote(runs: DataFrame, run_id: str) -> DataFrame:
    """The pointer row that makes a run the baseline of its mode and generator."""
    return runs.filter(F.col("run_id") == run_id).select("mode", "generator", "run_id", F.current_timestamp().alias("promoted_at"))


def current_baseline(pointers: DataFrame) -> DataFrame:
    return latest_by_key(pointers, ["mode", "generator"], "promoted_at")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
