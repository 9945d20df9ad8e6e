"""Streaming operators (T*): the same expressions on streams and tables; state only where a result needs it."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexipress.functions import text as X
from lexipress.operators import transform as C

CHUNK = "struct<id:string,object:string,created:long,model:string,choices:array<struct<index:int,delta:struct<role:string,content:string>>>,usage:struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>>"


def parse_sse(lines: DataFrame) -> DataFrame:
    """Adds kind (empty, done, data, bad, field, other) and chunk to lines (value); broken JSON is bad and stays."""
    v = X.strip(X.text_of(F.col("value")))
    data = X.strip(F.regexp_replace(v, "^data:", ""))
    chunk = F.from_json(data, CHUNK)
    kind = F.when(v == "", "empty").when(~F.startswith(v, F.lit("data:")), F.when(v.rlike("^(event|id|retry):"), "field").otherwise("other")).when(data == "[DONE]", "done").when(F.get_json_object(data, "$").isNull(), "bad").otherwise("data")
    return lines.withColumn("kind", kind).withColumn("chunk", F.when(F.col("kind") == "data", chunk))


def expand_stream(chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds content: the chunk's text, expanded where it holds a symbol. The dictionary is a static table, routed as in
    C2."""
    content = F.coalesce(F.get(F.col("chunk.choices"), F.lit(0))["delta"]["content"], F.lit(""))
    return chunks.withColumn("content", C.expanded(C.rule_list(dictionary), content))


def repair_chunks(chunks: DataFrame, model: str = "unknown", created: int = 0) -> DataFrame:
    """Chunks with an id, object, time and model, and a text (never null)."""
    c = F.col("chunk")
    fixed = F.struct(
        F.coalesce(c["id"], F.lit("chatcmpl-0")).alias("id"), F.coalesce(c["object"], F.lit("chat.completion.chunk")).alias("object"), F.coalesce(c["created"], F.lit(created).cast("long")).alias("created"), F.coalesce(c["model"], F.lit(model)).alias("model"),
        F.transform(c["choices"], lambda x: x.withField("delta", F.struct(F.coalesce(x["delta"]["role"], F.lit("assistant")).alias("role"), F.coalesce(x["delta"]["content"], F.lit("")).alias("content")))).alias("choices"), c["usage"].alias("usage"),
    )
    return chunks.withColumn("chunk", F.when(F.col("kind") == "data", fixed))


def response_metrics(chunks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """T4: per request (request, ts, seq, kind, chunk, content): first_token_ts, last usage counters and the text in order;
    on a stream with a watermark of ``delay``, and a response that says nothing for as long is over."""
    rows = chunks.withWatermark("ts", delay) if chunks.isStreaming else chunks
    keys = [F.session_window("ts", delay), "request"] if chunks.isStreaming else ["request"]
    said = F.col("content") != ""
    out = rows.groupBy(*keys).agg(
        F.min(F.when(said, F.col("ts"))).alias("first_token_ts"), F.max_by("chunk.usage", F.when(F.col("chunk.usage").isNotNull(), F.col("seq"))).alias("usage"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said, F.struct("seq", "content")))), lambda x: x["content"]), "").alias("text"), F.bool_or(F.col("kind") == "done").alias("done"),
    )
    return out.select("request", "first_token_ts", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.col("usage.completion_tokens").alias("completion_tokens"), F.col("usage.total_tokens").alias("total_tokens"), "text", "done")


STATE = "turns long, original long, compressed long, efficiencies array<double>"
CONVERSATION = "conv_id long, turn long, turns long, original_chars long, compressed_chars long, cumulative_ratio double, trend string"


def _rounded(x: float) -> float:
    """Four places, halves up, as Spark rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def conversation_stream(turns: DataFrame, idle_ms: int = 3_600_000, n: int = 3, step: float = 0.01) -> DataFrame:
    """A row per arriving turn (conv_id, turn, original_chars, compressed_chars): the conversation's running tally
    and trend; equal to W6 and W7 where turns arrive in order. State is a few numbers a conversation and goes after
    ``idle_ms`` without a turn."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, original, compressed, last = state.get if state.exists else (0, 0, 0, [])
        last = list(last)
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for r in rows.itertuples():
            count, original, compressed = count + 1, original + int(r.original_chars), compressed + int(r.compressed_chars)
            last = [*last, _rounded(1 - r.compressed_chars / max(1, r.original_chars))][-n:]
            change = last[-1] - last[0]
            trend = "insufficient_data" if len(last) < n else "improving" if change > step else "declining" if change < -step else "stable"
            out.append((key[0], int(r.turn), count, original, compressed, _rounded((original - compressed) / max(1, original)), trend))
        state.update((count, original, compressed, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "turns", "original_chars", "compressed_chars", "cumulative_ratio", "trend"])

    return turns.groupBy("conv_id").applyInPandasWithState(run, CONVERSATION, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


RULE = "conv_id long, text string, symbol string, first_turn long, value long"


def rule_stream(candidates: DataFrame, k: int = 262, min_len: int = 5, idle_ms: int = 3_600_000) -> DataFrame:
    """A row per rule that a conversation gains, from arriving candidates (conv_id, turn, text, symbol, value): equal to
    W3 where turns arrive in order. State is the texts that have a symbol, at most k a conversation, and goes after
    ``idle_ms`` without a candidate."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches))
        rows = rows[rows["text"].str.len().fillna(0) >= min_len].sort_values(["turn", "value", "symbol"], ascending=[True, False, True])
        rows = rows.drop_duplicates("text").sort_values(["turn", "value", "text"], ascending=[True, False, True])
        new = rows[~rows["text"].isin(known)].head(max(0, k - len(known)))
        state.update(([*known, *new["text"]],))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": key[0], "text": new["text"], "symbol": new["symbol"], "first_turn": new["turn"], "value": new["value"]})

    return candidates.groupBy("conv_id").applyInPandasWithState(run, RULE, "texts array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def log_rates(log: DataFrame, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, phase, category, n, seconds) by window; a stream drops rows later than the delay."""
    rows = log.withWatermark("ts", delay) if log.isStreaming else log
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = rows.groupBy(win.alias("w"), "phase", X.log_category(F.col("message")).alias("category")).agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"))
    return out.select(F.col("w.start").alias("start"), "phase", "category", "n", "seconds")
