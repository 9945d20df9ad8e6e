"""Savings and performance reports (R*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACKED = ("prompt", "compress")


def savings_report(df: DataFrame, by: list[str], how: str = "groupBy") -> DataFrame:
    """(by, docs, original_chars, compressed_chars, saved_chars, tokens_saved, ratio); how: groupBy, rollup or cube."""
    out = getattr(df, how)(*by).agg(F.count("*").alias("docs"), F.coalesce(F.sum("original_chars"), F.lit(0)).alias("original_chars"), F.coalesce(F.sum("compressed_chars"), F.lit(0)).alias("compressed_chars"))
    saved = F.col("original_chars") - F.col("compressed_chars")
    return out.withColumn("saved_chars", saved).withColumn("tokens_saved", F.floor(saved / 4)).withColumn("ratio", F.round(saved / F.greatest(F.col("original_chars"), F.lit(1)), 4))


def _rate(n: Column, seconds: Column) -> Column:
    return F.round(F.when(seconds > 0, n / seconds).otherwise(0.0), 4)


def throughput(df: DataFrame) -> DataFrame:
    """R2: adds total_rate, prompt_rate, generation_rate and first_token_s to (prompt_tokens, completion_tokens, total_s,
    prompt_s, generation_s); no time, no rate."""
    c = F.col
    out = df.withColumn("total_rate", _rate(c("prompt_tokens") + c("completion_tokens"), c("total_s"))).withColumn("prompt_rate", _rate(c("prompt_tokens"), c("prompt_s")))
    return out.withColumn("generation_rate", _rate(c("completion_tokens"), c("generation_s"))).withColumn("first_token_s", c("prompt_s"))


def net_savings(df: DataFrame) -> DataFrame:
    """Adds net_tokens, net_percent of the original's tokens (0 at least) and negative to (original_chars,
    compressed_chars, overhead_tokens)."""
    net = F.floor((F.col("original_chars") - F.col("compressed_chars")) / 4) - F.col("overhead_tokens")
    percent = F.round(100 * F.greatest(F.lit(0), net) / F.greatest(F.floor(F.col("original_chars") / 4), F.lit(1)), 2)
    return df.withColumn("net_tokens", net).withColumn("net_percent", percent).withColumn("negative", net < 0)


def timing_shares(df: DataFrame, phases: list[str], keys: list[str]) -> DataFrame:
    """(keys, phase, seconds, share): phases' columns as rows, each as a share of their sum."""
    long = df.select(*keys, *phases).unpivot(keys, phases, "phase", "seconds")
    total = F.sum(F.coalesce("seconds", F.lit(0.0))).over(Window.partitionBy(*keys))
    return long.withColumn("share", F.round(F.when(total > 0, F.coalesce("seconds", F.lit(0.0)) / total).otherwise(0.0), 4))


def op_timing(log: DataFrame, last: int = 10) -> DataFrame:
    """(phase, n, avg_s, min_s, max_s, recent_avg_s): the last is over the newest rows of a phase. Newest rows come by
    a ranked cut per phase and day before the final one, so a phase with most rows is spread."""
    order = [F.col("ts").desc(), F.col("correlation_id"), F.col("duration")]
    day = F.row_number().over(Window.partitionBy("phase", F.to_date("ts")).orderBy(*order))
    some = log.withColumn("r", day).where(F.col("r") <= last)
    recent = some.withColumn("r", F.row_number().over(Window.partitionBy("phase").orderBy(*order))).where(F.col("r") <= last).groupBy("phase").agg(F.round(F.avg("duration"), 4).alias("recent_avg_s"))
    every = log.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 4).alias("avg_s"), F.min("duration").alias("min_s"), F.max("duration").alias("max_s"))
    return every.join(recent.hint("shuffle_merge"), "phase", "left")


def op_frequency(log: DataFrame, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """(phase, n, span_s, per_s) of phases whose name holds a tracked word, seen twice at least."""
    hit = F.lit(False)
    for word in tracked:
        hit = hit | F.contains(F.lower("phase"), F.lit(word))
    out = log.where(hit).groupBy("phase").agg(F.count("*").alias("n"), (F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))).alias("us")).where("n >= 2")
    span = F.greatest(F.col("us") / 1e6, F.lit(1.0))
    return out.select("phase", "n", F.round(span, 4).alias("span_s"), F.round(F.col("n") / span, 6).alias("per_s"))
