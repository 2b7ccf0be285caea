"""Usage ledger analytics: spend, quotas, gate audit, the usage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.usage import ANSWER_OUTCOMES, Quota, chart_max
from .running import running_before


def is_answer() -> Column:
    """Rows that use up a quota: answers of visitors, not of administrators."""
    return ~F.col("is_admin") & F.col("outcome").isin(*ANSWER_OUTCOMES)


def spend_since(ledger: DataFrame, since: Column) -> DataFrame:
    return ledger.filter(F.col("created_at") >= since).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend_usd"))


def answers_since(ledger: DataFrame, since: Column) -> DataFrame:
    """Answers per bucket from a moment on."""
    return ledger.filter((F.col("created_at") >= since) & is_answer()).groupBy("ip_bucket").agg(F.count("*").alias("answers"))


def _slot_width(minutes: int) -> int:
    return max(3600, minutes * 60)


def _slot(minutes: int) -> Column:
    return F.floor(F.unix_micros("created_at") / 1_000_000 / _slot_width(minutes))


def _window_counts(ledger: DataFrame, minutes: int) -> DataFrame:
    """Answers of the same bucket in the last ``minutes``, the row itself left out.

    Time is cut into slots at least as long as the window; rows near the end of a slot are
    copied into the next one as context. A frame then never leaves its (bucket, slot), so a
    bucket with a third of all rows is spread over all its slots."""
    width = _slot_width(minutes)
    seconds = F.unix_micros("created_at") / 1_000_000
    slot = _slot(minutes)
    near_end = seconds >= (slot + 1) * width - minutes * 60
    copies = F.when(near_end & is_answer(), F.array(slot, slot + 1)).otherwise(F.array(slot))
    rows = ledger.withColumn("_own", slot).withColumn("_slot", F.explode(copies)).withColumn("_answer", is_answer().cast("int"))
    frame = Window.partitionBy("ip_bucket", "_slot").orderBy(F.unix_micros("created_at")).rangeBetween(-minutes * 60_000_000, 0)
    counted = rows.withColumn("window_used", F.coalesce(F.sum("_answer").over(frame), F.lit(0)) - F.col("_answer"))
    return counted.filter(F.col("_own") == F.col("_slot")).drop("_own", "_answer")


def gate_audit(ledger: DataFrame, q: Quota) -> DataFrame:
    """Per recorded request: what the gate would have said just before it.

    Global budget first, then the daily quota, then the sliding window. Earlier rows are
    those before it in (created_at, id); the window counts equal times as earlier."""
    # Chunk totals come from the bare ledger; the rows pass once through all windows. The
    # first two windows share the partitioning by (bucket, slot).
    bare = ledger.withColumn("_day", F.to_date("created_at")).withColumn("_slot", _slot(q.window_minutes))
    d = _window_counts(ledger, q.window_minutes).withColumn("_day", F.to_date("created_at"))
    d = running_before(d, ["ip_bucket", "_day"], ["created_at", "id"], F.col("_slot"), {"used_today": is_answer().cast("int")}, bare)
    # The global sum has one key per day: chunks of a minute keep its tasks small.
    d = running_before(d, ["_day"], ["created_at", "id"], F.floor(F.unix_micros("created_at") / 60_000_000), {"spent_today": F.col("cost_usd")}, bare)
    left = F.greatest(F.lit(0), F.lit(q.daily_answers) - F.col("used_today"))
    spent = F.round("spent_today", 9) >= q.daily_budget_usd
    day_used = F.col("used_today") >= q.daily_answers
    window_used = F.col("window_used") >= q.window_answers
    return d.withColumn("degraded", F.when(spent, "global_budget").when(day_used | window_used, "ip_quota")).withColumn(
        "answers_remaining", F.when(~spent & day_used, 0).otherwise(left)).drop("_day", "_slot")


def usage_days(ledger: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Spend and outcome counts per UTC day, oldest first, days without rows included:
    date, outcome, requests, spend_usd (one row with a null outcome for an empty day)."""
    first = F.date_sub(today, days - 1)
    spine = ledger.sparkSession.range(1).select(F.explode(F.sequence(first, today)).alias("date"))
    rows = ledger.filter((F.col("created_at") >= first) & (F.to_date("created_at") <= today))
    per = rows.groupBy(F.to_date("created_at").alias("date"), "outcome").agg(F.count("*").alias("requests"), F.sum("cost_usd").alias("spend_usd"))
    return spine.join(per, "date", "left").fillna(0, ["requests"]).fillna(0.0, ["spend_usd"])


def usage_report(ledger: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """One row per day with spend and an outcome -> count map (at most six outcomes)."""
    d = usage_days(ledger, today, days)
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("outcome").isNotNull(), F.struct("outcome", "requests")))))
    return d.groupBy("date").agg(F.sum("spend_usd").alias("spend_usd"), counts.alias("outcomes"))


def cache_hit_rate(ledger: DataFrame, today: Column) -> DataFrame:
    """Today's cached share of the requests that asked for an answer; degraded rows do not
    count, null without any."""
    rows = ledger.filter((F.col("created_at") >= today) & (F.col("created_at") < F.date_add(today, 1)))
    return rows.agg(F.try_divide(
        F.count_if(F.col("outcome") == "cached"), F.count_if(F.col("outcome").isin("cached", *ANSWER_OUTCOMES))).alias("cache_hit_rate"))


def bucket_usage(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ip_bucket").agg(
        F.count("*").alias("requests"), F.count_if(F.col("outcome").isin(*ANSWER_OUTCOMES)).alias("answers"), F.sum("cost_usd").alias("spend_usd"))


def top_buckets(ledger: DataFrame, today: Column, top: int = 10) -> DataFrame:
    """Today's busiest buckets."""
    rows = ledger.filter((F.col("created_at") >= today) & (F.col("created_at") < F.date_add(today, 1)))
    return bucket_usage(rows).orderBy(F.desc("requests"), "ip_bucket").limit(top)


def spend_chart(per_day: DataFrame, budget: float, height: int, value: str = "spend_usd") -> DataFrame:
    """Bars of a spend chart; ``per_day`` has one row per day."""
    top = per_day.agg(chart_max(F.max(value), budget).alias("m"))
    bars = per_day.withColumn("scale_max", top.scalar())
    return bars.withColumn("tick_mid", F.col("scale_max") / 2).withColumn("bar", F.floor(F.col(value) / F.col("scale_max") * height + 0.5).cast("bigint"))
