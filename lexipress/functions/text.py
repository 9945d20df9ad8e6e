"""Projections and predicates on text columns (P*, F* of the survey): Column in, Column out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexipress import catalogs

WORD = r"[\p{L}\p{N}_]+"


def text_of(col: Column) -> Column:
    """Null is the empty string."""
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def words(col: Column) -> Column:
    return F.regexp_extract_all(text_of(col), F.lit(WORD), F.lit(0))


def contains_any(col: Column, some: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(s)) for s in some], F.lit(False))


def count_of(col: Column, some: tuple[str, ...] | list[str]) -> Column:
    """How many of the strings occur."""
    return reduce(lambda a, b: a + b, [F.contains(col, F.lit(s)).cast("int") for s in some], F.lit(0))


def flatten_content(parts: Column, keys: tuple[str, ...] = ("text", "data")) -> Column:
    """One text from message parts (type, text, name, data, url); other types give the first of their ``keys`` that isn't
    empty (text, content, data where parts have them all); empty parts go, lines join the others."""
    one = lambda p: (
        F.when(p["type"] == "text", text_of(p["text"]))
        .when(p["type"] == "attachment", F.concat(F.lit("[Attachment: "), text_of(p["name"]), F.lit("]\n"), text_of(p["data"])))
        .when(p["type"].isin("image_url", "image"), F.lit("[Image attachment]"))
        .otherwise(F.coalesce(*[F.nullif(p[k], F.lit("")) for k in keys], F.lit("")))
    )
    return F.array_join(F.filter(F.transform(parts, one), lambda x: x != ""), "\n")


def normalize_role(role: Column) -> Column:
    """Known roles stay, aliases are mapped, others are users."""
    alias = F.create_map(*[F.lit(x) for kv in catalogs.ROLE_ALIASES.items() for x in kv])
    return F.when(role.isin(*catalogs.ROLES), role).otherwise(F.coalesce(alias[role], F.lit("user")))


# Spacing rules, in order.
NORMALIZE_RULES = (
    (r"([\p{L}\p{N}_]+)\s*=\s*", "$1 = "), (r",\s+", ", "), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\.([\p{L}\p{N}_]+)\s*\(", ".$1("),
    (r"\)\s*:", "):"), ('"\\s*([^"]*)\\s*"', '"$1"'), ("'\\s*([^']*)\\s*'", "'$1'"),
)


def normalize_text(col: Column) -> Column:
    """Eight spacing rules, in order."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), NORMALIZE_RULES, text_of(col))


def normalize_model(col: Column) -> Column:
    """Last part of a path, lower case, dashes, without a tuning suffix."""
    last = F.element_at(F.split(text_of(col), "/"), -1)
    return F.regexp_replace(F.translate(F.lower(last), "_ ", "--"), "-(instruct|chat|preview)$", "")


def model_family(df: DataFrame, col: str = "model", custom: dict[str, list[str]] | None = None) -> DataFrame:
    """P5: adds ``family``: of the patterns that the lower-case name contains, the first in order; else unknown."""
    some = catalogs.family_patterns(df.sparkSession, custom).collect()  # a catalog
    name = F.lower(text_of(F.col(col)))
    found = [F.when(F.contains(name, F.lit(r.pattern)), F.lit(r.family)) for r in sorted(some, key=lambda r: r.priority)]
    return df.withColumn("family", F.coalesce(*found, F.lit("unknown")))


def token_estimate(col: Column, method: str = "chars") -> Column:
    """Chars: at least 1, characters div 4; words: words; prompt: characters / 3.5 * 1.15."""
    text = text_of(col)
    if method == "chars":
        return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))
    if method == "words":
        return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return F.floor(F.length(text) / F.lit(3.5) * F.lit(1.15)).cast("int")


def char_entropy(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, entropy): Shannon entropy of the characters, in bits; texts without a character give 0."""
    chars = df.select(*keys, F.explode_outer(F.filter(F.split(text_of(F.col(col)), ""), lambda x: x != "")).alias("ch"))
    counts = chars.groupBy(*keys, "ch").agg(F.count("ch").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")).otherwise(0.0)).alias("s"))
    return total.select(*keys, F.when(F.col("total") > 0, F.log2("total") - F.col("s") / F.col("total")).otherwise(F.lit(0.0)).alias("entropy"))


def detect_language(text: Column, filename: Column | None = None) -> Column:
    """By file ending, else by telling words in order, else by a shell's first line."""
    chain = F.when(F.lit(False), F.lit(""))
    if filename is not None:
        for name, endings, *_ in catalogs.LANGUAGES:
            chain = chain.when(reduce(lambda a, b: a | b, [F.endswith(F.lower(filename), F.lit(e)) for e in endings]), F.lit(name))
    for name, _, some, *_ in catalogs.LANGUAGES:
        if some:
            chain = chain.when(contains_any(text, some), F.lit(name))
    head = F.left(text, F.lit(100))
    return chain.when(F.startswith(text, F.lit("#!")) & contains_any(head, ("/bin/bash", "/bin/sh", "/usr/bin/env")), F.lit("shell"))


def log_category(message: Column) -> Column:
    """The first tag in order that the upper-case message contains."""
    up = F.upper(text_of(message))
    chain = F.when(F.lit(False), F.lit(""))
    for tags, category in catalogs.LOG_TAGS:
        chain = chain.when(contains_any(up, tags), F.lit(category))
    return chain.otherwise(F.lit(catalogs.DEFAULT_CATEGORY))


def clean_params(params: Column) -> Column:
    """Without timeout settings and without keys that are one non-ASCII character."""
    return F.map_filter(params, lambda k, _: ~F.lower(k).isin(*catalogs.TIMEOUT_PARAMS) & ~k.rlike(r"^[^\x00-\x7F]$"))


def target_format(model: Column) -> Column:
    """The prompt format of a provider/model name."""
    provider = F.lower(F.element_at(F.split(text_of(model), "/"), 1))
    formats = F.create_map(*[F.lit(x) for kv in catalogs.PROVIDER_FORMATS.items() for x in kv])
    return F.when(F.startswith(model, F.lit("deepseek/deepseek-r1")), F.lit("deepseek")).otherwise(F.coalesce(formats[provider], F.lit("chatml")))


def prompt_format(content: Column, source: Column) -> Column:
    """P10: by markers in the text, else by where the prompt came from."""
    content = text_of(content)
    return (
        F.when(F.contains(content, F.lit("<start_of_turn>")) & F.contains(content, F.lit("<end_of_turn>")), "gemma")
        .when(F.startswith(content, F.lit("Human:")) & F.contains(content, F.lit("Assistant:")), "claude_legacy")
        .when(F.get_json_object(content, "$.parts").isNotNull(), "gemini")
        .when(F.contains(content, F.lit("role:")) & contains_any(content, ("system", "user")), "chatgpt")
        .when(source == "system_parameter", "claude").when(source == "system_instruction", "gemini").otherwise("chatgpt")
    )


def clean_prompt(content: Column) -> Column:
    """P10: without turn markers and speakers' names."""
    plain = F.regexp_replace(text_of(content), r"<start_of_turn>(system|user|model)?\n?|<end_of_turn>|<\|im_start\|>(system|user|assistant)?\n?|<\|im_end\|>", "")
    return strip(F.regexp_replace(plain, r"^(Human|Assistant|System):\s*", ""))


def project_message(message: Column) -> Column:
    """A message (a map of its fields) with role, content and name only."""
    return F.map_filter(message, lambda k, _: k.isin(*catalogs.MESSAGE_FIELDS))


def client_engine(headers: Column, params: Column, first_role: Column | None = None, configured: str = "auto") -> Column:
    """Which client sent a request, by rules in order: a web client shows two of three signs (a browser, a local origin
    or referer, a request with messages whose first is from the system or that has a web client's parameters); then names
    and headers of others; else standard. headers: lower-case names; params: fields of the request as strings;
    ``first_role``: of its first message, null without messages. ``configured``: one of CLIENTS overrides all rules."""
    if configured.lower() in catalogs.CLIENTS:
        return F.lit(configured.lower())
    agent, first = F.lower(text_of(headers["user-agent"])), F.lit(None).cast("string") if first_role is None else first_role
    has = lambda where, some: F.arrays_overlap(F.coalesce(F.map_keys(where), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in some]))
    local = contains_any(text_of(headers["origin"]), catalogs.LOCAL_ORIGINS) | contains_any(text_of(headers["referer"]), catalogs.LOCAL_ORIGINS)
    shaped = first.isNotNull() & ((first == "system") | has(params, catalogs.WEB_PARAMS))
    signs = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") for x in (contains_any(agent, catalogs.BROWSERS), local, shaped)])
    model = F.lower(text_of(params["model"]))
    return (
        F.when(signs >= 2, "webui").when(contains_any(agent, ("sillytavern", "silly")), "sillytavern").when(has(headers, catalogs.ANTHROPIC_HEADERS), "anthropic")
        .when(F.contains(model, F.lit("claude")) & ~F.contains(model, F.lit("/")), "anthropic").when(F.contains(agent, F.lit("anthropic")) & F.contains(agent, F.lit("sdk")), "anthropic")
        .when(contains_any(agent, catalogs.CLINE_AGENTS), "cline").when(has(headers, catalogs.CLINE_HEADERS), "cline").otherwise("standard")
    )


# --- predicates ---


def has_reasoning(text: Column) -> Column:
    """F4"""
    return reduce(lambda a, b: a | b, [text_of(text).rlike(f"(?s)<{t}>.*?</{t}>") for t in catalogs.REASONING_TAGS])


# Marks whose loss would change how a text reads. Dots cross lines only in fenced code, HTML and critic marks.
MARKDOWN = (
    r"(?s)```.*?```", r"`[^`\n]+`",
    r"\*\*\*[^*\n]+\*\*\*", r"\*\*[^*\n]+\*\*", r"__[^_\n]+__", r"~~[^~\n]+~~", r"(?s)==.+?==", r"(?s)\^\^.+?\^\^", r"\[[^\]]+\]\([^)]+\)", r"!\[[^\]]*\]\([^)]+\)",
    r"(?m)^#{1,6}\s+.*$", r"(?m)^\s*[-*+]\s+.*$", r"(?m)^\s*[0-9]+\.\s+.*$", r"(?m)^\s*\[[ x]\]\s+.*$", r"(?m)^>\s+.*$",
    r"(?s)<b>.*?</b>", r"(?s)<i>.*?</i>", r"(?s)<em>.*?</em>", r"(?s)<strong>.*?</strong>", r"<br\s*/?>", r"(?s)<pre>.*?</pre>",
    r"[A-Za-z0-9]+~[^~\s]+~", r"[A-Za-z0-9]+\^[^\^\s]+\^", r"(?s)\+\+.+?\+\+",
    r"(?s)\{--.*?--\}", r"(?s)\{\+\+.*?\+\+\}", r"(?s)\{==.*?==\}", r"(?s)\{>>.*?<<\}",
    r"(?m)^\s*!!!\s+[\p{L}\p{N}_]+.*$", r"(?m)^\s*:::[\p{L}\p{N}_]+.*$", r"(?m)^\s*>\s*\[![\p{L}\p{N}_]+\].*$",
    r"(?m)^\s*\|.*\|.*$", r"(?m)^\s*\|[-:\s]+\|.*$", r"(?m)^---+\s*$", r"(?m)^\*\*\*+\s*$", r"(?m)^___+\s*$",
)
# What counts in texts with reasoning tags, and in code.
CRITICAL_MARKDOWN = (r"(?m)^\s*\|.*\|.*\|.*$", r"(?m)^---+\s*$", r"(?m)^\*\*\*+\s*$", r"(?m)^___+\s*$", r"\[.*?\]\(https?://.*?\)")
STRICT_MARKDOWN = (MARKDOWN[0], r"(?m)^\s*>\s+[A-Za-z].*$", *CRITICAL_MARKDOWN)
# Lines that look like code, and like markdown.
CODE_LINE = r"^\s*(?:import |from |def |class |if |for |while |with |try:)|^(?:    |\t)\s*\S|[:{};]\s*$|=|\(\)|\[\]|\{\}|\S -> \S|\S in \S|\S and \S|\S or \S"
MARKDOWN_LINE = r"^\s*#(?:$|[^!]|![^/])|^\s*[-*+] +\S|^\s*> +\S|\*\*.*\*\*|^\s*```|\[.*\]\(|\]\(.*\["


def has_markdown(text: Column) -> Column:
    """texts with reasoning tags: only critical marks count. Else the first 50 lines vote: over twice as many lines of
    code as of markdown make it code, in which only strict marks count."""
    text = text_of(text)
    some = lambda patterns: reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])
    lines = F.slice(F.split(text, "\n"), 1, 50)
    code, marks = F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))), F.size(F.filter(lines, lambda x: x.rlike(MARKDOWN_LINE)))
    return F.when(has_reasoning(text), some(CRITICAL_MARKDOWN)).when(code > 2 * marks, some(STRICT_MARKDOWN)).otherwise(some(MARKDOWN))


# Tags of a tool that is being run.
TOOL_TAGS = (r"(?is)<tool_use[^>]*>\s*<name>[^<]+</name>\s*<parameters>", r"(?is)<function_calls[^>]*>\s*<invoke[^>]*>")
FLAT_OBJECT = r"\{[^{}]*\}"
#: What the brace scanner steps over: an escaped character, a mark, or a run of anything else.
_SCANNED = r"""(?s)\\.|["{}]|[^\\"{}]+|\\"""
#: A quoted string, which may hold raw line ends, or what is between strings.
_STRINGS = r"""(?s)"(?:[^"\\]|\\.)*"|[^"]+|\""""


def balanced_objects(text: Column) -> Column:
    """Array of the outermost {...} of a text, over any number of lines and levels.

    A fold over braces and quotes: braces inside a quoted string, and escaped characters in it, don't count; outside of
    objects quotes are ordinary text. An object that never closes gives nothing."""
    state = F.struct(F.lit(1).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("start"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        opens, closes = (x == "{") & ~acc["quoted"], (x == "}") & ~acc["quoted"] & (acc["depth"] > 0)
        ends = closes & (acc["depth"] == 1)
        after = acc["at"] + F.length(x)
        return F.struct(
            after.alias("at"), F.when(opens, acc["depth"] + 1).when(closes, acc["depth"] - 1).otherwise(acc["depth"]).alias("depth"),
            F.when((x == '"') & (acc["depth"] > 0), ~acc["quoted"]).otherwise(acc["quoted"]).alias("quoted"),
            F.when(opens & (acc["depth"] == 0), acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(ends, F.array_append(acc["out"], F.struct(acc["start"].alias("start"), (after - acc["start"]).alias("size")))).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(F.regexp_extract_all(text, F.lit(_SCANNED), F.lit(0)), state, step)["out"]
    return F.transform(found, lambda o: F.substring(text, o["start"], o["size"]))


def repaired_json(x: Column) -> Column:
    """JSON whose strings hold raw line ends and tabs, with these escaped; what is between strings stays."""
    inside = lambda p: F.replace(F.replace(F.replace(p, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_STRINGS), F.lit(0)), lambda p: F.when(F.startswith(p, F.lit('"')), inside(p)).otherwise(p)), "")


def json_fields(x: Column) -> Column:
    """A JSON object as a map from its fields to their values, nested ones as JSON; raw line ends and tabs in strings are
    repaired where it doesn't parse as it is."""
    return F.coalesce(F.from_json(x, "map<string,string>"), F.from_json(repaired_json(x), "map<string,string>"))


def tool_objects(text: Column) -> Column:
    """Array of the JSON objects of a text that a tool call may be: the outermost ones, and flat ones with a tool key that
    are inside others. Texts without a quoted tool key aren't scanned."""
    quoted = contains_any(text, [f'"{k}"' for k in catalogs.TOOL_KEYS])
    flat = F.filter(F.regexp_extract_all(text, F.lit(FLAT_OBJECT), F.lit(0)), lambda x: contains_any(x, [f'"{k}"' for k in catalogs.TOOL_KEYS]))
    return F.when(quoted & F.contains(text, F.lit("}")), F.array_distinct(F.concat(balanced_objects(text), flat))).otherwise(F.array().cast("array<string>"))


def is_tool_call(fields: Column) -> Column:
    """Whether an object's fields make it a tool call: a tool key, and a path or structure key or two fields."""
    keys = F.map_keys(fields)
    lit = lambda some: F.array(*[F.lit(x) for x in some])
    return F.coalesce(F.arrays_overlap(keys, lit(catalogs.TOOL_KEYS)) & (F.arrays_overlap(keys, lit(catalogs.PATH_KEYS + catalogs.STRUCTURE_KEYS)) | (F.size(keys) >= 2)), F.lit(False))


def has_tool_call(text: Column) -> Column:
    """a tag of a tool being run, or a JSON object, nested or over several lines, that is a tool call."""
    text = text_of(text)
    return text.rlike(TOOL_TAGS[0]) | text.rlike(TOOL_TAGS[1]) | F.exists(tool_objects(text), lambda x: is_tool_call(json_fields(x)))


def looks_like_code(text: Column, variant: str = "head") -> Column:
    """head: at least 3 of 8 signs in the first 1000 characters; full: 3 of 20 signs in all of the text."""
    text = text_of(text)
    return (count_of(F.left(text, F.lit(1000)), catalogs.CODE_INDICATORS) if variant == "head" else count_of(text, catalogs.ALL_CODE_INDICATORS)) >= 3


def alnum_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]", ""))


def meaningful(col: Column, min_len: int = 3) -> Column:
    """a letter, and half of ``min_len`` characters besides white space at the ends."""
    return col.rlike(r"\p{L}") & (F.length(strip(col)) >= min_len // 2)


def meaningful_share(col: Column, min_len: int = 5, most: int = 100) -> Column:
    """F7, the other form: ``min_len`` to ``most`` characters, of which 30 % letters and digits."""
    return F.length(col).between(min_len, most) & (alnum_count(col) * 10 >= F.length(col) * 3)


def quality(col: Column) -> Column:
    """F8: whether a pattern is worth a symbol."""
    bare = strip(col)
    kinds = F.size(F.array_distinct(F.filter(F.split(F.lower(col), ""), lambda x: x != "")))
    structure = (
        (F.contains(col, F.lit("_")) & F.replace(col, F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$")) | (F.contains(col, F.lit(".")) & ~F.startswith(col, F.lit(" ")))
        | F.contains(col, F.lit("(")) | (bare.rlike(r"^[\p{L}\p{N}]+$") & (F.length(bare) >= 4)) | contains_any(F.lower(col), catalogs.CODE_TERMS)
    )
    return (F.length(col) >= 4) & (alnum_count(col) * 10 >= F.length(col) * 4) & (F.length(bare) >= 3) & ~((F.length(col) > 6) & (kinds < 3)) & (structure | ((F.length(col) >= 8) & (col == bare)))


def effective_threshold(text: Column, threshold: float) -> Column:
    """half the threshold where the text looks compressed already."""
    text = text_of(text)
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    parts = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    mean = F.length(F.array_join(parts, "")) / F.greatest(F.size(parts), F.lit(1))
    return F.when((odd > 0.01 * F.length(text)) | (mean < 4), F.lit(threshold / 2)).otherwise(F.lit(threshold))


def conversation_key(messages: DataFrame) -> DataFrame:
    """(conv_id, key): md5 over the number of messages and the start of the first three."""
    w = Window.partitionBy("conv_id")
    first = messages.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("turn"))).where("r <= 3")
    part = F.concat("role", F.lit(":"), F.left(text_of(F.col("text")), F.lit(50)))
    rows = first.groupBy("conv_id", "n").agg(F.array_sort(F.collect_list(F.struct("r", part.alias("p")))).alias("ps"))
    joined = F.array_join(F.concat(F.array(F.col("n").cast("string")), F.transform("ps", lambda x: x["p"])), "|")
    return rows.select("conv_id", F.concat(F.lit("conv_"), F.left(F.md5(joined), F.lit(12))).alias("key"))


def session_key(session: Column, first_user: Column) -> Column:
    """The key of a named session and its first user text."""
    clean = F.left(F.regexp_replace(text_of(session), "[^A-Za-z0-9_-]", ""), F.lit(32))
    return F.concat(F.lit("sess_"), clean, F.lit("_"), F.left(F.md5(F.concat(clean, F.lit(":"), F.left(text_of(first_user), F.lit(100)))), F.lit(12)))


def auto_session(messages: DataFrame) -> DataFrame:
    """(conv_id, session): a name for conversations of several messages, md5 over the start of the first two."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    part = F.concat("role", F.lit(":"), F.left(text_of(F.col("text")), F.lit(30)))
    first = messages.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2).select("conv_id", "r", part.alias("p"))
    both = first.groupBy("conv_id").agg(F.max(F.when(F.col("r") == 1, F.col("p"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("b"))
    return both.where("b is not null").select("conv_id", F.concat(F.lit("auto_"), F.left(F.md5(F.concat("a", "b")), F.lit(12))).alias("session"))


def content_hash(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, content_hash, is_new): hash of the user and assistant turns so far; whether it changed.

    A partition holds whole conversations in order of turns and streams through with one running hash, so that a long
    conversation is neither gathered nor hashed anew at each turn."""
    spoken = F.when(F.col("role").isin("user", "assistant"), F.concat("role", F.lit(":"), text_of(F.col("text")), F.lit("\n"))).otherwise(F.lit(""))
    rows = messages.select("conv_id", "turn", spoken.alias("spoken")).repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, so_far, before = object(), None, None
        for batch in batches:
            hashes, new = [], []
            for key, said in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != conversation:
                    conversation, so_far, before = key, hashlib.sha256(), None
                so_far.update(said.encode())
                now = so_far.hexdigest()[:16]
                hashes.append(now)
                new.append(now != before)
                before = now
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string()), pa.array(new, pa.bool_())], names=["conv_id", "turn", "content_hash", "is_new"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"conv_id {types['conv_id']}, turn {types['turn']}, content_hash string, is_new boolean")
