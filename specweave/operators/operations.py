"""Ledger, quotas and coverage: aggregates over what a run did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARGIN = 0.9
THIN = 0.25


def ledger_summary(ledger: DataFrame, *by: str) -> DataFrame:
    """Calls, errors, cache hits, tokens by the given columns."""
    return ledger.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached_calls"), F.count_if("failed").alias("errors"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_call"))


def quota_headroom(ledger: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests left by provider and UTC day under a margin of the limit; null where unlimited."""
    used = ledger.where("not cached").groupBy("provider", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    ceiling = F.floor(F.col("daily_limit") * MARGIN)
    return used.join(limits, "provider", "left").select("provider", "day", "requests", F.when(ceiling.isNotNull(), F.greatest(ceiling - F.col("requests"), F.lit(0))).cast("bigint").alias("headroom"), (F.col("requests") >= ceiling).alias("exhausted"))


def blocked_until(ledger: DataFrame) -> DataFrame:
    """``(provider, until)``: until when a provider is out after refusals: the latest of what it asked for
    (``retry_after`` seconds), else the end of the UTC day."""
    midnight = F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")
    asked = F.timestamp_seconds(F.unix_seconds("ts") + F.col("retry_after"))
    return ledger.where("refused").groupBy("provider").agg(F.max(F.coalesce(asked, midnight)).alias("until"))


def lost_batches(runs: DataFrame) -> DataFrame:
    """``(paper_id, kind, coverage, batches_lost)`` by paper and kind of fact, of runs with what was read, of
    how much, and how many batches went well."""
    share = F.round(F.sum("read_chars") / F.nullif(F.sum("all_chars"), F.lit(0)), 3)
    return runs.groupBy("paper_id", "kind").agg(share.alias("coverage"), (F.sum("batches") - F.sum("batches_ok")).alias("batches_lost"))


def first_eligible(requests: DataFrame, legs: DataFrame, exhausted: DataFrame) -> DataFrame:
    """For each request the first provider of its route that is not exhausted on its day."""
    free = requests.join(legs, "route").join(exhausted.where("exhausted").select("provider", "day"), ["provider", "day"], "left_anti")
    return free.groupBy("request_id").agg(F.min_by("provider", "leg").alias("provider"))


def coverage(read: DataFrame, *by: str) -> DataFrame:
    """Share of the text that was read, and whether it is thin."""
    share = F.round(F.sum("read_chars") / F.nullif(F.sum("all_chars"), F.lit(0)), 3)
    return read.groupBy(*by).agg(F.sum("read_chars").alias("read_chars"), F.sum("all_chars").alias("all_chars"), share.alias("coverage")).withColumn("thin", F.coalesce("coverage", F.lit(0.0)) < THIN)


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """Distinct requests that the cache cannot answer."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
