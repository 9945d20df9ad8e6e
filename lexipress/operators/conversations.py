"""Conversation analytics (W*): windows over (conv_id, turn, role, text), no state outside Spark."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexipress.functions import text as X
from lexipress.operators import mining as M

ROLES = ("user", "assistant", "system")


def _so_far() -> Window:
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)


def request_context(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, messages, total_chars, last_user_chars) of the request that each turn ends."""
    chars = F.when(F.col("role").isin(*ROLES), F.length(X.text_of(F.col("text")))).otherwise(0)
    last = F.last(F.when(F.col("role") == "user", F.length(X.text_of(F.col("text")))), ignorenulls=True)
    w = _so_far()
    return messages.select("conv_id", "turn", F.count("*").over(w).alias("messages"), F.sum(chars).over(w).alias("total_chars"), F.coalesce(last.over(w), F.lit(0)).alias("last_user_chars"))


def short_turn(context: DataFrame, threshold: int = 250, most: int = 20_000) -> DataFrame:
    """Adds short_turn: a follow-up whose last user text is below the threshold, in a conversation that isn't long."""
    c = F.col
    return context.withColumn("short_turn", (c("messages") > 1) & (c("last_user_chars") > 0) & (c("last_user_chars") < threshold) & (c("total_chars") < most))


def additive_rules(candidates: DataFrame, k: int = 262, min_len: int = 5) -> DataFrame:
    """(conv_id, text, symbol, first_turn, value): rules of candidates (conv_id, turn, text, symbol, value). A text keeps
    the symbol of its first turn; at most k texts a conversation, by first turn, value and text. Valid at t: first_turn <= t."""
    first = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn", F.col("value").desc(), "symbol"))
    rows = candidates.where(F.length("text") >= min_len).withColumn("r", first).where("r = 1")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", F.col("value").desc(), "text"))
    return rows.withColumn("r", rank).where(F.col("r") <= k).select("conv_id", "text", "symbol", F.col("turn").alias("first_turn"), "value")


def needs_analysis(turns: DataFrame, min_chars: int = 250, threshold: int = 20, room: int = 262) -> DataFrame:
    """Adds rules_before and may_add to turns (conv_id, turn, compressed_chars, new_chars, new_rules): whether a turn may
    add rules. Its text is over twice ``min_chars`` after the rules so far, and it's the first turn, or there are under
    ``room`` rules; texts of over 500 thresholds go on up to 350 rules, turns with over 750 of new text up to 500. Rules that
    come with turns which aren't analysed don't count."""
    c = F.col
    large = c("compressed_chars") > 2 * min_chars
    limit = F.greatest(F.lit(room), F.when(c("compressed_chars") > 500 * threshold, 350).otherwise(0), F.when(c("new_chars") > 750 * threshold, 500).otherwise(0))
    rows = turns.select("conv_id", "turn", large.alias("large"), limit.cast("long").alias("limit"), F.coalesce(c("new_rules"), F.lit(0)).cast("long").alias("new_rules"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, rules, first = object(), 0, True
        for batch in batches:
            before, may = [], []
            for key, big, most, new in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if key != conversation:
                    conversation, rules, first = key, 0, True
                go = bool(big) and (first or rules < most)
                before.append(rules)
                may.append(go)
                rules, first = rules + (new if go else 0), False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.int64()), pa.array(may, pa.bool_())], names=["conv_id", "turn", "rules_before", "may_add"])

    # Whether a turn counts depends on the ones before it: a partition holds whole conversations in order of turns and
    # streams through with one running count, so memory doesn't grow with a conversation.
    marks = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(scan, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, rules_before long, may_add boolean")
    return turns.join(marks.hint("shuffle_merge"), ["conv_id", "turn"])


def reassign_conflicts(rules: DataFrame, pool: DataFrame) -> DataFrame:
    """Rules where no symbol has two texts in a conversation: the earliest keeps it, later ones take the conversation's
    free symbols in pool order; without one left, symbol is null."""
    turn = F.row_number().over(Window.partitionBy("conv_id", "symbol").orderBy("first_turn", "text"))
    marked = rules.withColumn("k", turn)
    kept = marked.where("k = 1").drop("k")
    late = marked.where("k > 1").drop("k", "symbol").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "text")))
    used = kept.groupBy("conv_id").agg(F.collect_set("symbol").alias("used"))  # at most the pool
    every = F.broadcast(pool.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("pool")))
    free = used.join(every).select("conv_id", F.posexplode(F.array_except("pool", "used")).alias("pos", "symbol")).select("conv_id", (F.col("pos") + 1).alias("place"), "symbol")
    again = late.join(free.hint("shuffle_merge"), ["conv_id", "place"], "left").select(*rules.columns)
    return kept.select(*rules.columns).unionByName(again)


def turn_metrics(turns: DataFrame, mode: str = "stateless", all_turns: DataFrame | None = None) -> DataFrame:
    """Per turn, from (conv_id, turn, original_chars, compressed_chars, dict_chars, new_dict_chars): compression_ratio,
    tokens_saved, overhead_tokens (of all rules when stateless, of new ones when stateful), overhead_ratio, net_efficiency.
    W14: turns of ``all_turns`` (conv_id, turn, original_chars) that weren't compressed count with ratio 0."""
    if all_turns is not None:
        keys = all_turns.select("conv_id", "turn", F.col("original_chars").alias("o"))
        turns = keys.join(turns.hint("shuffle_merge"), ["conv_id", "turn"], "left")
        o = F.coalesce("original_chars", "o")
        turns = turns.select("conv_id", "turn", o.alias("original_chars"), F.coalesce("compressed_chars", o).alias("compressed_chars"), F.coalesce("dict_chars", F.lit(0)).alias("dict_chars"), F.coalesce("new_dict_chars", F.lit(0)).alias("new_dict_chars"))
    c = F.col
    paid = c("dict_chars") if mode == "stateless" else c("new_dict_chars")
    out = turns.withColumn("compression_ratio", F.round(1 - c("compressed_chars") / F.greatest(c("original_chars"), F.lit(1)), 4))
    out = out.withColumn("compression_ratio", F.when(c("original_chars") > 0, c("compression_ratio")).otherwise(0.0))
    out = out.withColumn("tokens_saved", F.floor((c("original_chars") - c("compressed_chars")) / 4).cast("long"))
    out = out.withColumn("overhead_tokens", F.floor(paid / F.lit(3.5) * F.lit(1.15)).cast("long"))
    out = out.withColumn("overhead_ratio", F.round(c("overhead_tokens") / F.greatest(F.floor(c("original_chars") / 4), F.lit(1)), 4))
    return out.withColumn("net_efficiency", F.round(c("compression_ratio") - c("overhead_ratio"), 4))


def running_tally(metrics: DataFrame) -> DataFrame:
    """Adds cumulative original, compressed and saved characters, messages, ratio and net ratio (overhead is 4 characters
    a token)."""
    w = _so_far()
    c = F.col
    out = metrics.withColumn("cumulative_original", F.sum("original_chars").over(w)).withColumn("cumulative_compressed", F.sum("compressed_chars").over(w))
    out = out.withColumn("cumulative_messages", F.count("*").over(w)).withColumn("cumulative_overhead", 4 * F.sum("overhead_tokens").over(w))
    out = out.withColumn("cumulative_saved", c("cumulative_original") - c("cumulative_compressed"))
    ratio = lambda x: F.round(x / F.greatest(c("cumulative_original"), F.lit(1)), 4)
    return out.withColumn("cumulative_ratio", ratio(c("cumulative_saved"))).withColumn("cumulative_net", ratio(c("cumulative_saved") - c("cumulative_overhead")))


def efficiency_trend(metrics: DataFrame, n: int = 3, step: float = 0.01) -> DataFrame:
    """Adds trend over the last n turns: improving, declining, stable, insufficient_data."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    last = w.rowsBetween(1 - n, 0)
    change = F.col("net_efficiency") - F.first("net_efficiency").over(last)
    return metrics.withColumn("trend", F.when(F.count("*").over(last) < n, "insufficient_data").when(change > step, "improving").when(change < -step, "declining").otherwise("stable"))


def should_continue(metrics: DataFrame, min_eff: float = 0.01, most_rules: int = 262) -> DataFrame:
    """Adds should_continue: rules in order, over (net_efficiency, trend, symbols_used): the first two turns go on; a
    full dictionary stops; two turns below the minimum stop; a decline below twice the minimum stops; after turn 20
    anything below 0.02 stops; else it goes on."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    place, before = F.row_number().over(w), F.lag("net_efficiency").over(w)
    e = F.col("net_efficiency")
    go = F.when(place <= 2, True).when(F.col("symbols_used") >= most_rules, False).when((e < min_eff) & (before < min_eff), False).when((F.col("trend") == "declining") & (e < 2 * min_eff), False).when((place > 20) & (e < 0.02), False).otherwise(True)
    return metrics.withColumn("should_continue", go)


def symbol_usage(rules: DataFrame, uses: DataFrame, k: int = 5) -> DataFrame:
    """(conv_id, available, added, used, avg_per_turn, efficiency, top): symbols of a conversation's rules (conv_id,
    symbol, first_turn), how many of them came after its first turn with rules, how many were used, uses a turn, share used, and the k most used, joined by spaces. uses: (conv_id, turn, symbol, n)."""
    some = uses.groupBy("conv_id", "symbol").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("n").desc(), "symbol"))
    top = some.withColumn("r", rank).groupBy("conv_id").agg(F.count("*").alias("used"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= k, F.struct("r", "symbol")))), lambda x: x["symbol"]), " ").alias("top"))
    turns = uses.groupBy("conv_id", "turn").agg(F.countDistinct("symbol").alias("s")).groupBy("conv_id").agg(F.round(F.avg("s"), 4).alias("avg_per_turn"))
    born = rules.groupBy("conv_id", "symbol").agg(F.min("first_turn").alias("born"))
    have = born.groupBy("conv_id").agg(F.count("*").alias("available"), F.min("born").alias("start"), F.array_agg("born").alias("borns"))  # at most the pool
    have = have.select("conv_id", "available", F.size(F.filter("borns", lambda b: b > F.col("start"))).alias("added"))
    out = have.join(top.hint("shuffle_merge"), "conv_id", "left").join(turns.hint("shuffle_merge"), "conv_id", "left")
    used = F.coalesce("used", F.lit(0))
    return out.select("conv_id", "available", "added", used.alias("used"), F.coalesce("avg_per_turn", F.lit(0.0)).alias("avg_per_turn"), F.round(used / F.greatest("available", F.lit(1)), 4).alias("efficiency"), F.coalesce("top", F.lit("")).alias("top"))


def top_tokens(messages: DataFrame, k: int = 5) -> DataFrame:
    """(conv_id, token, n, rank): a conversation's most used tokens."""
    counts = messages.select("conv_id", F.explode(M.tokens(F.col("text"))).alias("token")).groupBy("conv_id", "token").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("n").desc(), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def global_stats(metrics: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row (conversations, turns, avg_turns, original_chars, compressed_chars; with rules (conv_id, symbol) also
    symbols: different ones in use)."""
    per = metrics.groupBy("conv_id").agg(F.count("*").alias("t"), F.sum("original_chars").alias("o"), F.sum("compressed_chars").alias("c"))
    out = per.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("t"), F.lit(0)).alias("turns"), F.round(F.avg("t"), 4).alias("avg_turns"), F.sum("o").alias("original_chars"), F.sum("c").alias("compressed_chars"))
    return out if rules is None else out.join(F.broadcast(rules.agg(F.countDistinct("symbol").alias("symbols"))))  # one row each


def retain_recent(df: DataFrame, n: int = 1000, slack: int = 100, ts: str = "ts", key: str = "conv_id") -> DataFrame:
    """All rows if there are at most n conversations, else those of the newest n - slack."""
    last = df.groupBy(key).agg(F.max(ts).alias("last"))
    keep = last.orderBy(F.col("last").desc(), key).limit(n - slack) if last.count() > n else last
    return df.join(keep.select(key).hint("shuffle_merge"), key, "left_semi")


def conversation_summary(metrics: DataFrame, usage: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Per conversation, from W5 to W8: turns, totals, mean ratio, net tokens, last trend and decision, short turns;
    with seconds a turn in the metrics also their mean (avg_seconds), with W9's rows (usage) its columns, and with W10's
    (tokens) top_tokens, most used first."""
    last = lambda c: F.max_by(c, "turn")
    timed = [F.round(F.avg("seconds"), 6).alias("avg_seconds")] if "seconds" in metrics.columns else []
    out = metrics.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.sum("original_chars").alias("original_chars"), F.sum("compressed_chars").alias("compressed_chars"), (F.round(F.sum(F.round(F.col("compression_ratio") * 10_000).cast("long")) / F.count("*")) / 10_000).alias("avg_ratio"),
        (F.sum("tokens_saved") - F.sum("overhead_tokens")).alias("net_tokens"), last("trend").alias("trend"), last("should_continue").alias("should_continue"), F.count_if("short_turn").alias("short_turns"), *timed,
    )
    if usage is not None:
        out = out.join(usage.hint("shuffle_merge"), "conv_id", "left")
    if tokens is not None:
        top = tokens.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("top_tokens"))  # k a conversation
        out = out.join(top.hint("shuffle_merge"), "conv_id", "left")
    return out


def is_continuation(messages: DataFrame, session: Column | None = None) -> DataFrame:
    """(conv_id, is_continuation): several user messages, an answer, or a session id."""
    named = F.max(session.isNotNull()) if session is not None else F.lit(False)
    return messages.groupBy("conv_id").agg(((F.count_if(F.col("role") == "user") > 1) | (F.count_if(F.col("role") == "assistant") > 0) | named).alias("is_continuation"))


def gate_min_chars(messages: DataFrame, least: int = 250) -> DataFrame:
    """messages of conversations with so many characters from users, assistants and the system."""
    total = messages.where(F.col("role").isin(*ROLES)).groupBy("conv_id").agg(F.sum(F.length(X.text_of(F.col("text")))).alias("total")).where(F.col("total") >= least)
    return messages.join(total.select("conv_id").hint("shuffle_merge"), "conv_id", "left_semi")


def validate_sequence(messages: DataFrame) -> DataFrame:
    """(conv_id, roles_ok, starts_with_user): apart from the system, only users and assistants; a user first."""
    said = messages.where(F.col("role") != "system")
    return said.groupBy("conv_id").agg(F.bool_and(F.col("role").isin("user", "assistant")).alias("roles_ok"), (F.min_by("role", "turn") == "user").alias("starts_with_user"))


def exclude_clients(requests: DataFrame, names: list[str], agent: str = "user_agent") -> DataFrame:
    """requests whose agent holds none of the names."""
    return requests.where(~X.contains_any(F.lower(X.text_of(F.col(agent))), [n.lower() for n in names]))


def filter_log(log: DataFrame, enabled: DataFrame) -> DataFrame:
    """without DEBUG rows whose category isn't in ``enabled`` (category)."""
    rows = log.withColumn("category", X.log_category(F.col("message")))
    debug = rows.where("level = 'DEBUG'").join(enabled.select("category").distinct().hint("shuffle_merge"), "category", "left_semi")
    return rows.where("level <> 'DEBUG'").unionByName(debug.select(*rows.columns))


# Signs of structured content, word characters of any script.
STRUCTURE = (r"\bdef\s+[\p{L}\p{N}_]+", r"\bclass\s+[\p{L}\p{N}_]+", r"\bimport\s+[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+\([^)]*\)", r"\{[^}]*\}", r"<[^>]+>")


def repetition(text: Column, min_n: int) -> Column:
    """struct(total, different, repeated): words between white space, how many different ones, and how many of these come
    at least ``min_n`` times. One pass over the sorted words of a row; no shuffle."""
    start = F.struct(F.lit(None).cast("string").alias("word"), *[F.lit(0).alias(c) for c in ("run", "total", "different", "repeated")])

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["word"] == x, F.lit(False))
        run = F.when(same, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("word"), run.alias("run"), (acc["total"] + 1).alias("total"), (acc["different"] + (~same).cast("int")).alias("different"), (acc["repeated"] + (run == min_n).cast("int")).alias("repeated"))

    return F.aggregate(F.array_sort(F.filter(F.split(text, r"\s+"), lambda x: x != "")), start, step)


def gate_reason(text: Column, min_chars: int = 100, threshold: float = 0.15, min_n: int = 2, hits: int = 20) -> Column:
    """tool_call, markdown, too_short, repetitive (of over 50 words, the share of different ones that come min_n times
    is above the threshold), structured (over so many signs), default."""
    signs = reduce(lambda a, b: a + b, [F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in STRUCTURE])
    often = F.exists(F.array(repetition(text, min_n)), lambda w: (w["total"] > 50) & (w["repeated"] > threshold * w["different"]))  # the fold runs once
    return F.when(X.has_tool_call(text), "tool_call").when(X.has_markdown(text), "markdown").when(F.length(text) < min_chars, "too_short").when(often, "repetitive").when(signs > hits, "structured").otherwise("default")


def analysis_gate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, reason): why each text is analysed or not; options as in ``gate_reason``."""
    return df.select(id_col, gate_reason(X.text_of(F.col(text_col)), **options).alias("reason"))
