"""Prompt assembly (M*) as aggregations over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexipress.functions import text as X

#: A caller's catalog of at most so many rows is broadcast.
CATALOG_ROWS = 10_000
# Formats of a system prompt.
FORMATS = {"chatml": "<|im_start|>system\n{}<|im_end|>", "claude": "{}", "gemini": "{}", "gemma": "<start_of_turn>system\n{}<end_of_turn>", "qwen": "<|im_start|>system\n{}<|im_end|>", "deepseek": "{}", "claude_legacy": "Human: {}", "chatgpt": "{}"}
# Guidance in order: what calls for it (nothing: always; code: a text in a programming language; else any of
# the words), and the lines.
GUIDANCE = (
    ((), ("Be concise and direct in your responses", "Respond as briefly and precisely as possible", "Provide only essential information unless specifically asked for details", "Limit explanations unless explicitly requested")),
    (("code",), ("Use minimal but descriptive function and variable names", "Minimize comments unless they clarify complex logic", "Prefer concise code patterns over verbose alternatives", "Avoid unnecessary intermediate variables")),
    (("explain", "describe", "how to", "what is", "tutorial", "guide"), ("Structure your response with clear headings", "Lead with the key takeaway or conclusion", "Use numbered steps for processes")),
    (("debug", "error", "fix", "broken", "not working", "issue"), ("Identify the specific problem first", "Provide the corrected code immediately after diagnosis", "Explain the fix in one concise sentence")),
)
# Sets that a caller may add.
CUSTOM_GUIDANCE = {
    "ultra_brief": ("Respond in the fewest words possible", "Use sentence fragments if they convey the meaning", "Omit pleasantries and filler words", "Provide direct answers without context unless essential"),
    "code_only": ("Provide only executable code without explanations", "Include minimal inline comments only for complex logic", "Omit example usage unless specifically requested"),
}


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMATS.items()), "format string, template string")


def system_prompts(messages: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """M1: (conv_id, source, pos, content): from a system parameter, a system instruction (conv_id, system,
    system_instruction), and system messages, in this order."""
    said = messages.where("role = 'system'").select("conv_id", F.lit("messages_array").alias("source"), (F.lit(2_000_000) + F.col("turn")).cast("long").alias("pos"), X.text_of(F.col("text")).alias("content"))
    if params is None:
        return said
    one = params.where("system is not null").select("conv_id", F.lit("system_parameter").alias("source"), F.lit(0).cast("long").alias("pos"), F.col("system").alias("content"))
    two = params.where("system_instruction is not null").select("conv_id", F.lit("system_instruction").alias("source"), F.lit(1_000_000).cast("long").alias("pos"), F.col("system_instruction").alias("content"))
    return one.unionByName(two).unionByName(said)


def merge_prompts(prompts: DataFrame, decoders: DataFrame) -> DataFrame:
    """M2: (conv_id, merged): the decoder (conv_id, decoder) first, then cleaned prompts that it doesn't hold, each once,
    with a blank line between."""
    rows = prompts.withColumn("clean", X.clean_prompt(F.col("content"))).where("clean <> ''")
    ordered = rows.groupBy("conv_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clean"))), lambda x: x["clean"])).alias("ps"))
    both = decoders.join(ordered.hint("shuffle_merge"), "conv_id", "full")
    decoder, ps = X.text_of(F.col("decoder")), F.coalesce("ps", F.array().cast("array<string>"))
    kept = F.filter(ps, lambda p: ~F.contains(decoder, p))
    return both.select("conv_id", F.array_join(F.filter(F.concat(F.array(decoder), kept), lambda x: x != ""), "\n\n").alias("merged"))


def apply_prompt(messages: DataFrame, merged: DataFrame) -> DataFrame:
    """M3: conversations with a merged prompt have it at turn -1 in place of their system rows; others stay."""
    some = merged.where("merged <> ''")
    rest = messages.join(some.select("conv_id", F.lit(True).alias("has")).hint("shuffle_merge"), "conv_id", "left").where("has is null or role <> 'system'").drop("has")
    first = some.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("merged").alias("text"))
    return rest.select("conv_id", "turn", "role", "text").unionByName(first)


def format_prompt(prompts: DataFrame, kinds: DataFrame, col: str = "merged") -> DataFrame:
    """M4: adds formatted: the text in its format's template (column format); unknown formats as it is."""
    small = kinds.limit(CATALOG_ROWS + 1).count() <= CATALOG_ROWS
    out = prompts.join(F.broadcast(kinds) if small else kinds.hint("shuffle_merge"), "format", "left")
    return out.withColumn("formatted", F.coalesce(F.replace(F.col("template"), F.lit("{}"), F.col(col)), F.col(col))).drop("template")


def guidance(messages: DataFrame, rules: tuple = GUIDANCE, custom: tuple[str, ...] = (), k: int = 6) -> DataFrame:
    """M5: (conv_id, guidance): the lines that a conversation's user messages call for, then those of the sets named in
    ``custom``; the first k, different ones in order. Messages become a flag for each rule, so no conversation's texts
    are gathered."""
    text = X.text_of(F.col("text"))
    calls = [X.detect_language(text).isNotNull() if words == ("code",) else X.contains_any(F.lower(text), words) if words else F.lit(True) for words, _ in rules]
    flags = messages.where("role = 'user'").groupBy("conv_id").agg(*[F.max(c).alias(f"f{i}") for i, c in enumerate(calls)])
    none = F.array().cast("array<string>")
    lines = [F.when(F.col(f"f{i}"), F.array(*[F.lit(x) for x in some])).otherwise(none) for i, (_, some) in enumerate(rules)]
    lines += [F.array(*[F.lit(x) for x in CUSTOM_GUIDANCE[name]]) for name in custom]
    return flags.select("conv_id", F.array_join(F.array_distinct(F.slice(F.concat(*lines), 1, k)), "\n").alias("guidance"))
