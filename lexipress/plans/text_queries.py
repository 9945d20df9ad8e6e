"""Queries of the projections, predicates and mining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexipress import catalogs
from lexipress.functions import text as X
from lexipress.operators import conversations as W
from lexipress.operators import mining as M
from lexipress.plans import derived as V
from lexipress.plans.derived import CODE_SQL, TOOL_SQL

TOKENS_SQL = r"""list_concat(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[\p{L}_].{2,}$')),
  list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+'), lambda x: not regexp_matches(x, '^[\p{L}_][\p{L}\p{N}_]{2,}\.')))"""
COUNTED = "select {by} pattern, sum(k)::bigint as n, count(*) as df from (select {by} pattern, doc_id, count(*) as k from rows group by all) r group by all"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _any(col: str, some) -> str:
    return "(" + " or ".join(f"contains({col}, '{s.replace(chr(39), chr(39) * 2)}')" for s in some) + ")"


def _count(col: str, some) -> str:
    return "(" + " + ".join(f"contains({col}, '{s}')::int" for s in some) + ")"


QUALITY_SQL = rf"""(length(pattern) >= 4 and length(regexp_replace(pattern, '[^\p{{L}}\p{{N}}]', '', 'g')) * 10 >= length(pattern) * 4
  and length({STRIP.format("pattern")}) >= 3 and not (length(pattern) > 6 and len(list_distinct(string_split(lower(pattern), ''))) < 3)
  and ((contains(pattern, '_') and regexp_matches(replace(pattern, '_', ''), '^[\p{{L}}\p{{N}}]+$')) or (contains(pattern, '.') and not starts_with(pattern, ' ')) or contains(pattern, '(')
    or (regexp_matches({STRIP.format("pattern")}, '^[\p{{L}}\p{{N}}]+$') and length({STRIP.format("pattern")}) >= 4) or {_any("lower(pattern)", catalogs.CODE_TERMS)}
    or (length(pattern) >= 8 and pattern = {STRIP.format("pattern")})))"""
EST = "greatest(1, length({0}) // 4)"


def _logs(spark, d):
    names = ("[FIX] retry", "[CLINE] hello", "[KV CACHE] miss", "Token calculation", "server up", "timeout hit", "a test ran", "symbol pick", "plain", "[PROXY] x", "compression on")
    pick = F.array(*[F.lit(x) for x in names])
    return V.table(spark, d, "events").select("event_id", F.concat(F.element_at(pick, (F.col("event_id") % len(names) + 1).cast("int")), F.lit(" "), F.coalesce("props", F.lit(""))).alias("message"))


def _log_sql() -> str:
    names = ("[FIX] retry", "[CLINE] hello", "[KV CACHE] miss", "Token calculation", "server up", "timeout hit", "a test ran", "symbol pick", "plain", "[PROXY] x", "compression on")
    pick = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    chain = " ".join(f"when {_any('upper(message)', tags)} then '{c}'" for tags, c in catalogs.LOG_TAGS)
    return f"""with logs as (select event_id, {pick}[event_id % {len(names)} + 1] || ' ' || coalesce(props, '') as message from events)
select case {chain} else '{catalogs.DEFAULT_CATEGORY}' end as category, count(*) as n from logs group by 1"""


MODELS = ("openai/gpt-4-turbo", "Claude_3 opus-chat", "meta/Llama-3-8b-instruct", "qwen/qwen2.5-7b", "mistral/mixtral-8x7b", "deepseek/deepseek-r1-x", "google/gemini-pro", "tii/falcon 40b", "unknown/own", "qwen3-max")


def _models(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("c_custkey") % len(MODELS) + 1).cast("int")).alias("model"))


MODELS_SQL = "models as (select c_custkey, [" + ", ".join(f"'{m}'" for m in MODELS) + f"][c_custkey % {len(MODELS)} + 1] as model from customer)"


def _family_sql() -> str:
    rows = list(catalogs.SPECIAL_FAMILIES) + [(p, f) for f, some in catalogs.FAMILIES.items() for p in some]
    return "coalesce(" + ", ".join(f"case when contains(lower(model), '{p}') then '{f}' end" for p, f in rows) + ", 'unknown')"


def _gate(spark, d):
    return W.analysis_gate(V.documents(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


def _code_rows_sql(patterns=catalogs.CODE_PATTERNS, least: int = 2) -> str:
    parts = " union all ".join(f"select doc_id, '{k}' as kind, unnest(list_filter(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'), lambda m: length(m) between {lo} and {hi})) as pattern from code_docs" for k, p, lo, hi in patterns)
    return f"with {CODE_SQL}, rows as ({parts}) select kind, pattern, sum(k)::bigint as n, count(*) as df from (select kind, pattern, doc_id, count(*) as k from rows group by all) r group by all having sum(k) >= {least}"


def _templates_cte() -> str:
    parts = []
    for kind, p, form in M.TEMPLATES:
        head, tail = form.split("{}", 1)
        tail = tail.replace("{{}}", "{}")
        parts.append(f"select doc_id, '{kind}' as kind, unnest(list_transform(regexp_extract_all(text, '{p}', 1), lambda s: '{head}' || s || '{tail}')) as template, unnest(regexp_extract_all(text, '{p}', 0)) as instance from code_docs")
    return f"""{CODE_SQL}, rows as ({" union all ".join(parts)}), g0 as (select kind, template, count(*) as n, sum(length(instance))::bigint as total_len from rows group by all),
g as (select *, greatest(0, total_len - length(template) * n) - (length(template) + 9) as savings from g0 where n >= 3 and length(template) >= 8 and greatest(0, total_len - length(template) * n) - (length(template) + 9) > 0)"""


def _language_sql() -> str:
    chain = " ".join(f"when {' or '.join(f'ends_with(lower(filename), {chr(39)}{e}{chr(39)})' for e in ends)} then '{name}'" for name, ends, *_ in catalogs.LANGUAGES)
    chain += " " + " ".join(f"when {_any('text', some)} then '{name}'" for name, _, some, *_ in catalogs.LANGUAGES if some)
    return f"""with {CODE_SQL}, a as (select text, null::varchar as filename from documents union all select text, case when doc_id % 3 = 0 then filename end from code_docs union all select html, null from pages)
select case {chain} when starts_with(text, '#!') and {_any("left(text, 100)", ("/bin/bash", "/bin/sh", "/usr/bin/env"))} then 'shell' else 'none' end as language, count(*) as n from a group by 1"""


# Names and tags as the rules give them, not as the code under test has them.
_TOOL, _REST = "tool function action command operation method".split(), "path file filename filepath directory location operationIsLocatedInWorkspace content arguments params parameters options config".split()


def _tool_sql(col: str = "text") -> str:
    """Tags of a tool being run, or a flat object that is a call."""
    keys = lambda some: "[" + ", ".join(f"'{k}'" for k in some) + "]"
    tags = f"regexp_matches({col}, '(?is)<tool_use[^>]*>\\s*<name>[^<]+</name>\\s*<parameters>') or regexp_matches({col}, '(?is)<function_calls[^>]*>\\s*<invoke[^>]*>')"
    names = f"list_transform(regexp_extract_all({col}, '\\{{[^{{}}]*\\}}'), lambda x: case when json_valid(x) then json_keys(x) else [] end)"
    quoted = " or ".join(f"contains({col}, '\"{k}\"')" for k in _TOOL)
    return f"({tags} or (({quoted}) and len(list_filter({names}, lambda k: list_has_any(k, {keys(_TOOL)}) and (len(k) >= 2 or list_has_any(k, {keys(_REST)})))) > 0))"


def _markdown_sql(col: str = "text") -> str:
    some = lambda patterns: "(" + " or ".join(f"regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"
    lines = f"string_split({col}, chr(10))[1:50]"
    votes = lambda p: f"len(list_filter({lines}, lambda x: regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}')))"
    code, marks = votes(X.CODE_LINE), votes(X.MARKDOWN_LINE)
    reasoning = "(" + " or ".join(f"regexp_matches({col}, '(?s)<{t}>.*?</{t}>')" for t in catalogs.REASONING_TAGS) + ")"
    return f"(case when {reasoning} then {some(X.CRITICAL_MARKDOWN)} when {code} > 2 * {marks} then {some(X.STRICT_MARKDOWN)} else {some(X.MARKDOWN)} end)"


def _gate_reason_sql() -> str:
    signs = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in (r"\bdef\s+[\p{L}\p{N}_]+", r"\bclass\s+[\p{L}\p{N}_]+", r"\bimport\s+[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+\([^)]*\)", r"\{[^}]*\}", "<[^>]+>"))
    return f"case when {_tool_sql()} then 'tool_call' when {_markdown_sql()} then 'markdown' when length(text) < 100 then 'too_short' when total > 50 and share > 0.15 then 'repetitive' when {signs} > 20 then 'structured' else 'default' end"


GATE_CTES = r"""w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as w from gated), c as (select doc_id, w, count(*) as n from w group by all),
s as (select doc_id, sum(n) as total, (count(*) filter (n >= 2)) / count(*) as share from c group by 1)"""


def _gate_sql() -> str:
    return f"with gated as (select doc_id, text from documents), {GATE_CTES}, r as (select doc_id, {_gate_reason_sql()} as reason from gated left join s using (doc_id)) select reason, count(*) as n from r group by 1"


# Clients: a user agent and headers by rule, in the order of the rules.
AGENTS = ("Mozilla/5.0 Firefox", "SillyTavern/1.2.3", "so/js 4.83.0", "Anthropic-SDK/1", "generic-client/1.0", "Cline/2", "curl/8")


def _clients(spark, d):
    key = F.col("c_custkey")
    agent = F.element_at(F.array(*[F.lit(x) for x in AGENTS]), (key % len(AGENTS) + 1).cast("int"))
    headers = F.map_filter(F.map_from_arrays(F.array(*[F.lit(x) for x in ("user-agent", "origin", "referer", "x-api-key", "x-task-id")]), F.array(
        agent, F.when(key % 4 == 0, "http://localhost:80").when(key % 4 == 1, "https://example.org"), F.when(key % 9 == 0, "http://192.168.0.7/"), F.when(key % 11 == 3, "k"), F.when(key % 13 == 5, "t"))), lambda _, v: v.isNotNull())
    params = F.map_filter(F.map_from_arrays(F.array(F.lit("model"), F.lit("samplers")), F.array(F.when(key % 5 == 0, "Claude-3-opus").when(key % 5 == 1, "anthropic/claude-3").otherwise("m"), F.when(key % 3 == 0, "x"))), lambda _, v: v.isNotNull())
    first = F.when(key % 6 == 0, "system").when(key % 6 < 4, "user")
    return V.table(spark, d, "customer").select("c_custkey", X.client_engine(headers, params, first).alias("engine"))


CLIENTS_SQL = """with c as (select c_custkey as k, ['mozilla', 'silly', 'sojs', 'sdk', 'generic', 'cline', 'curl'][c_custkey % 7 + 1] as a from customer)
select k as c_custkey, case
  when (a = 'mozilla')::int + (k % 4 = 0 or k % 9 = 0)::int + (k % 6 < 4 and (k % 6 = 0 or k % 3 = 0))::int >= 2 then 'webui'
  when a = 'silly' then 'sillytavern' when k % 11 = 3 then 'anthropic' when k % 5 = 0 then 'anthropic' when a = 'sdk' then 'anthropic'
  when a in ('sojs', 'cline') then 'cline' when k % 13 = 5 then 'cline' else 'standard' end as engine from c"""
# Settings of a request, and the twelve timeouts as SQL knows them.
SETTINGS = ("timeout", "Request_Timeout", "response_timeout", "connection_timeout", "read_timeout", "WRITE_TIMEOUT", "stream_timeout", "api_timeout", "client_timeout", "server_timeout", "connect_timeout", "total_timeout", "pool_timeout", "timeouts", "α", "β2", "a")
_TIMEOUTS = "timeout request_timeout response_timeout connection_timeout read_timeout write_timeout stream_timeout api_timeout client_timeout server_timeout connect_timeout total_timeout".split()


def _params(spark, d):
    some = F.slice(F.array(*[F.lit(x) for x in SETTINGS]), (F.col("event_id") % 12 + 1).cast("int"), F.lit(6))
    params = F.map_from_arrays(F.concat(some, F.array(F.concat(F.lit("k_"), "event_type"))), F.array_repeat(F.lit("1"), 7))
    message = F.create_map(F.lit("role"), F.col("event_type"), F.lit("content"), F.lit("x"), F.lit("cache_control"), F.lit("y"), F.concat(F.lit("nam"), F.when(F.col("event_id") % 2 == 0, "e").otherwise("ed")), F.lit("z"))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return V.table(spark, d, "events").select("event_id", keys(X.clean_params(params)).alias("keys"), keys(X.project_message(message)).alias("fields"))


PARAMS_SQL = f"""with p as (select *, {list(SETTINGS)!r}[event_id % 12 + 1:event_id % 12 + 6] || ['k_' || event_type] as names from events)
select event_id, array_to_string(list_sort(list_filter(names, lambda x: lower(x) not in ({", ".join(f"'{x}'" for x in _TIMEOUTS)}) and x <> 'α')), ',') as keys, case when event_id % 2 = 0 then 'content,name,role' else 'content,role' end as fields from p"""


def tool_texts(spark, d):
    """Texts with a call of some form, by document: over lines with nested objects, flat inside others, alone in its object,
    broken, a tag, with a raw line end in a string, and none."""
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    esc = F.translate(F.left(F.col("text"), F.lit(400)), '{}\t\r\\"', "()  /'")
    i = F.col("doc_id")
    return V.documents(spark, d).select("doc_id", F.when(i % 7 == 0, say('so:\n{\n  "tool": "write",\n  "arguments": {"path": "f', i.cast("string"), '", "opts": {"n": [1, {"m": 2}]}},\n  "content": "a } and { b ', esc, '"\n}\ndone {x}'))
        .when(i % 7 == 1, say('{"outer": [{"action": "go", "path": "p"}]} ', esc)).when(i % 7 == 2, say('{"tool": 1} ', esc)).when(i % 7 == 3, say('{"function": "f", "arguments": {"a": {}} ', esc))
        .when(i % 7 == 4, say("<function_calls>\n<invoke name=x>", esc)).when(i % 7 == 5, say('{"command": "run\nnow", "deep": {"path": "x"}} ', esc)).otherwise(say('the "tool" word ', esc)).alias("text"))


QUERIES = {
    "p1_flatten_content": lambda s, d: V.messages(s, d).select(
        "conv_id", "turn",
        X.flatten_content(F.array(
            F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("data")),
            F.struct(F.when(F.col("turn") % 2 == 1, "attachment").when(F.col("turn") % 3 == 0, "image").otherwise("other").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("notes").alias("name"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("data")),
        )).alias("content"),
    ),
    "p2_roles": lambda s, d: V.messages(s, d).select(X.normalize_role(F.when(F.col("turn") % 5 == 0, "human").when(F.col("turn") % 7 == 0, "ai").when(F.col("turn") % 11 == 0, "robot").otherwise(F.col("role"))).alias("r")).groupBy("r").agg(F.count("*").alias("n")),
    "p3_normalize_text": lambda s, d: V.code_docs(s, d).select("doc_id", X.normalize_text(F.col("text")).alias("t")),
    "p4_p5_p12_models": lambda s, d: X.model_family(_models(s, d)).select("c_custkey", X.normalize_model(F.col("model")).alias("name"), "family", X.target_format(F.col("model")).alias("format")),
    "p6_token_estimate": lambda s, d: V.documents(s, d).select("doc_id", X.token_estimate(F.col("text")).alias("by_chars"), X.token_estimate(F.col("text"), "words").alias("by_words"), X.token_estimate(F.col("text"), "prompt").alias("by_prompt")),
    "p7_conversation_key": lambda s, d: X.conversation_key(V.messages(s, d)),
    "p8_content_hash": lambda s, d: X.content_hash(V.messages(s, d)),
    "p9_clean_params": _params,
    "p10_prompt_format": lambda s, d: V.messages(s, d).select("conv_id", "turn", X.prompt_format(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Human: "), "text", F.lit(" Assistant:"))).otherwise(F.col("text")), F.when(F.col("role") == "user", "system_parameter").otherwise("messages_array")).alias("format")),
    "p10_clean_prompt": lambda s, d: V.messages(s, d).select("conv_id", "turn", X.clean_prompt(F.concat(F.lit("<start_of_turn>system\n"), "text", F.lit("<end_of_turn>"))).alias("clean")),
    "p11_client_engine": _clients,
    "p13_log_category": lambda s, d: _logs(s, d).select(X.log_category(F.col("message")).alias("category")).groupBy("category").agg(F.count("*").alias("n")),
    "p14_detect_language": lambda s, d: V.documents(s, d).select("doc_id", F.col("text"), F.lit(None).cast("string").alias("filename")).unionByName(V.code_docs(s, d).select((-F.col("doc_id")).alias("doc_id"), "text", F.when(F.col("doc_id") % 3 == 0, F.col("filename")).alias("filename"))).unionByName(V.table(s, d, "pages").select((F.col("page_id") + 10_000_000_000).alias("doc_id"), F.col("html").alias("text"), F.lit(None).cast("string").alias("filename"))).select(F.coalesce(X.detect_language(F.col("text"), F.col("filename")), F.lit("none")).alias("language")).groupBy("language").agg(F.count("*").alias("n")),
    "p15_char_entropy": lambda s, d: X.char_entropy(V.documents(s, d), "text", ["doc_id"]).select("doc_id", F.round("entropy", 6).alias("entropy")),
    "f1_min_chars": lambda s, d: W.gate_min_chars(V.messages(s, d), 2000).select("conv_id", "turn"),
    "f2_tool_call": lambda s, d: V.tool_docs(s, d).unionByName(V.documents(s, d).select((-1 - F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<tool_use id=1>\n<name>x</name><parameters>"), "text", F.lit("</tool_use>"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"tool": 1} '), "text")).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('{"name": 1, "path": 2} '), "text")).otherwise(F.col("text")).alias("text"))).select("doc_id", X.has_tool_call(F.col("text")).alias("hit")),
    "f2_nested_calls": lambda s, d: tool_texts(s, d).select("doc_id", X.has_tool_call(F.col("text")).alias("hit")),
    "f3_markdown": lambda s, d: V.documents(s, d).select("doc_id", X.has_markdown(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# Title\n\n- a **b** item\n"), "text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\nH~2~O and <b>x</b>"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("def f(x):\n    return x\n"), "text")).otherwise(F.col("text"))).alias("hit")).groupBy("hit").agg(F.count("*").alias("n")),
    "f4_reasoning": lambda s, d: V.documents(s, d).select("doc_id", X.has_reasoning(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("<think>"), "text", F.lit("</thought>"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("<analysis>\n"), "text", F.lit("</analysis>"))).otherwise(F.col("text"))).alias("hit")),
    "f5_looks_like_code": lambda s, d: V.code_docs(s, d).unionByName(V.documents(s, d).select((-1 - F.col("doc_id")).alias("doc_id"), "text", F.lit("").alias("filename"))).select("doc_id", X.looks_like_code(F.col("text")).alias("head"), X.looks_like_code(F.col("text"), "full").alias("full")),
    "f6_analysis_gate": _gate,
    "f7_f8_quality": lambda s, d: M.mine_word_ngrams(V.documents(s, d), 2, 2, min_n=5).select("pattern", X.meaningful(F.col("pattern")).alias("meaningful"), X.meaningful_share(F.col("pattern"), 5, 12).alias("by_share"), X.quality(F.col("pattern")).alias("quality")),
    "f9_continuation": lambda s, d: W.is_continuation(V.messages(s, d)),
    "f10_exclude_clients": lambda s, d: W.exclude_clients(V.table(s, d, "customer").withColumn("user_agent", F.concat(F.lit("Agent-"), (F.col("c_custkey") % 7).cast("string"))), ["agent-3", "AGENT-5"]).select("c_custkey"),
    "f11_validate_sequence": lambda s, d: W.validate_sequence(V.messages(s, d)),
    "f12_filter_log": lambda s, d: W.filter_log(_logs(s, d).withColumn("level", F.when(F.col("event_id") % 3 == 0, "INFO").otherwise("DEBUG")), s.createDataFrame([("system_fixes",), ("kv_cache_optimization",)], "category string")).groupBy("level", "category").agg(F.count("*").alias("n")),
    "f13_effective_threshold": lambda s, d: V.documents(s, d).select("doc_id", X.effective_threshold(F.col("text"), 0.02).alias("threshold")),
    "a1_tokens": lambda s, d: M.mine_tokens(V.documents(s, d)),
    "a1_tokens_by_source": lambda s, d: M.mine_tokens(V.documents(s, d), ["source"], min_n=3),
    "a2_char_ngrams": lambda s, d: M.mine_char_ngrams(V.documents(s, d), (8, 16), min_n=20),
    "a2_lengths": lambda s, d: M.mine_char_ngrams(V.messages(s, d), range(6, 31), id_col="turn", max_ngram=30).groupBy(F.length("pattern").alias("length")).agg(F.count("*").alias("patterns"), F.sum("n").alias("n"), F.sum("df").alias("df")),
    "a3_lines": lambda s, d: M.mine_lines(V.documents(s, d)),
    "a3_line_pairs": lambda s, d: M.line_pairs(V.documents(s, d)),
    "a4_word_ngrams": lambda s, d: M.mine_word_ngrams(V.documents(s, d)).select("pattern", "n", "df", F.round("confidence", 4).alias("confidence")),
    "a5_a6_code": lambda s, d: M.mine_code(V.code_docs(s, d)),
    "a19_simple_code": lambda s, d: M.mine_code(V.code_docs(s, d), simple=True, min_n=3),
    "a7_templates": lambda s, d: M.mine_templates(V.code_docs(s, d)),
    "a8_expand_templates": lambda s, d: M.expand_templates(V.code_docs(s, d), M.mine_templates(V.code_docs(s, d))),
    "a9_rank": lambda s, d: M.rank_patterns(M.mine_tokens(V.documents(s, d)), k=200).select("pattern", "n", "value", "rank"),
    "a10_merge_whitespace": lambda s, d: M.merge_whitespace(V.documents(s, d).select(F.explode(F.split("text", "\n")).alias("pattern")).where("pattern <> ''").withColumn("pattern", F.when(F.length("pattern") % 2 == 0, F.concat(F.lit(" "), "pattern")).otherwise(F.col("pattern"))).groupBy("pattern").agg(F.count("*").alias("n"), F.count("*").alias("df"))),
    "a11_containment": lambda s, d: M.resolve_containment(M.rank_patterns(M.mine_word_ngrams(V.documents(s, d), 2, 4), k=400)),
    "a12_merge_similar": lambda s, d: M.merge_similar(M.rank_patterns(M.mine_tokens(V.documents(s, d)), k=300)),
    "a13_contexts": lambda s, d: M.contexts(V.documents(s, d), M.rank_patterns(M.mine_lines(V.documents(s, d), min_len=10), k=5)),
    "a14_entropy_filter": lambda s, d: M.filter_entropy(M.rank_patterns(M.mine_tokens(V.documents(s, d), ["source"]), ["source"], k=300), M.scope_entropy(V.documents(s, d), ["source"]), 0.6, ["source"]).select("source", "pattern", "n", F.round("entropy", 6).alias("entropy")),
    "a15_structural_score": lambda s, d: M.mine_code(V.code_docs(s, d)).select("kind", "pattern", M.structural_score(F.col("pattern")).alias("score")),
    "a16_clusters": lambda s, d: M.cluster_patterns(M.rank_patterns(M.mine_tokens(V.documents(s, d)), k=500)),
    "a17_candidates": lambda s, d: M.rank_candidates(M.mine_word_ngrams(V.documents(s, d), 2, 2, min_n=8).withColumn("entropy", F.length("pattern") / 4.0)).select("pattern", "n", "quality"),
    "a18_chunks": lambda s, d: M.chunk_text(V.documents(s, d), 500, 50),
    "a20_all_patterns": lambda s, d: M.mine_patterns(V.code_docs(s, d)),
    "a20_consolidated": lambda s, d: M.consolidate(M.rank_patterns(M.mine_patterns(V.code_docs(s, d), ngrams=()), k=524)),
}

DOCS = "documents"
SQL = {
    "p1_flatten_content": "select conv_id, turn, array_to_string(list_filter([text, case when turn % 2 = 1 then '[Attachment: notes]' || chr(10) || role when turn % 3 = 0 then '[Image attachment]' else '' end], lambda x: x <> ''), chr(10)) as content from conversations",
    "p2_roles": "with m as (select case when turn % 5 = 0 then 'human' when turn % 7 = 0 then 'ai' when turn % 11 = 0 then 'robot' else role end as r from conversations) select case when r in ('system', 'user', 'assistant', 'function') then r when r = 'ai' then 'assistant' else 'user' end as r, count(*) as n from m group by 1",
    "p3_normalize_text": f"with {CODE_SQL} select doc_id, " + __import__("functools").reduce(lambda c, r: f"regexp_replace({c}, '{r[0].replace(chr(39), chr(39) * 2)}', '{r[1].replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', 'g')", X.NORMALIZE_RULES, "text") + " as t from code_docs",
    "p4_p5_p12_models": f"with {MODELS_SQL} select c_custkey, regexp_replace(translate(lower(string_split(model, '/')[-1]), '_ ', '--'), '-(instruct|chat|preview)$', '') as name, {_family_sql()} as family, case when starts_with(model, 'deepseek/deepseek-r1') then 'deepseek' else case lower(string_split(model, '/')[1]) " + " ".join(f"when '{p}' then '{f}'" for p, f in catalogs.PROVIDER_FORMATS.items()) + " else 'chatml' end end as format from models",
    "p6_token_estimate": r"select doc_id, greatest(1, length(text) // 4)::int as by_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::int as by_words, floor(length(text) / 3.5 * 1.15)::int as by_prompt from documents",
    "p7_conversation_key": "with m as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) as r from conversations) select conv_id, 'conv_' || left(md5(n || '|' || string_agg(role || ':' || left(text, 50), '|' order by r)), 12) as key from m where r <= 3 group by conv_id, n",
    "p8_content_hash": "with h as (select conv_id, turn, left(sha256(string_agg(case when role in ('user', 'assistant') then role || ':' || text || chr(10) else '' end, '') over (partition by conv_id order by turn)), 16) as content_hash from conversations) select *, coalesce(content_hash <> lag(content_hash) over (partition by conv_id order by turn), true) as is_new from h",
    "p9_clean_params": PARAMS_SQL,
    "p10_prompt_format": "with m as (select *, case when turn % 3 = 0 then 'Human: ' || text || ' Assistant:' else text end as c from conversations) select conv_id, turn, case when contains(c, '<start_of_turn>') and contains(c, '<end_of_turn>') then 'gemma' when starts_with(c, 'Human:') and contains(c, 'Assistant:') then 'claude_legacy' when contains(c, 'role:') and (contains(c, 'system') or contains(c, 'user')) then 'chatgpt' when role = 'user' then 'claude' else 'chatgpt' end as format from m",
    "p10_clean_prompt": r"select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '^(Human|Assistant|System):\s*', ''), '^\s+', ''), '\s+$', '') as clean from conversations",
    "p11_client_engine": CLIENTS_SQL,
    "p13_log_category": _log_sql(),
    "p15_char_entropy": "with c as (select doc_id, unnest(string_split(text, '')) as ch from documents where text <> ''), n as (select doc_id, ch, count(*) as n from c group by all), t as (select doc_id, sum(n) as total, sum(n * log2(n)) as s from n group by 1) select d.doc_id, round(coalesce(log2(total) - s / total, 0), 6) as entropy from documents d left join t using (doc_id)",
    "f1_min_chars": "select conv_id, turn from conversations where conv_id in (select conv_id from conversations where role in ('user', 'assistant', 'system') group by 1 having sum(length(text)) >= 2000)",
    "f2_tool_call": f"with {TOOL_SQL}, a as (select doc_id, text from tool_docs union all select -1 - doc_id, case doc_id % 4 when 0 then '<tool_use id=1>' || chr(10) || '<name>x</name><parameters>' || text || '</tool_use>' when 1 then '{{\"tool\": 1}} ' || text when 2 then '{{\"name\": 1, \"path\": 2}} ' || text else text end from documents) select doc_id, {_tool_sql()} as hit from a",
    "f2_nested_calls": "select doc_id, doc_id % 7 in (0, 1, 4, 5) as hit from documents",
    "f3_markdown": f"with m as (select case when doc_id % 4 = 0 then '# Title' || chr(10) || chr(10) || '- a **b** item' || chr(10) || text when doc_id % 4 = 1 then text || chr(10) || 'H~2~O and <b>x</b>' when doc_id % 4 = 2 then 'def f(x):' || chr(10) || '    return x' || chr(10) || text else text end as text from documents) select {_markdown_sql()} as hit, count(*) as n from m group by 1",
    "f4_reasoning": "with m as (select doc_id, case doc_id % 5 when 0 then '<think>' || text || '</think>' when 1 then '<think>' || text || '</thought>' when 2 then '<analysis>' || chr(10) || text || '</analysis>' else text end as text from documents) select doc_id, " + " or ".join(f"regexp_matches(text, '(?s)<{t}>.*?</{t}>')" for t in catalogs.REASONING_TAGS) + " as hit from m",
    "f5_looks_like_code": f"with {CODE_SQL}, a as (select doc_id, text from code_docs union all select -1 - doc_id, text from documents) select doc_id, {_count('left(text, 1000)', catalogs.CODE_INDICATORS)} >= 3 as head, {_count('text', catalogs.ALL_CODE_INDICATORS)} >= 3 as full from a",
    "f9_continuation": "select conv_id, (count(*) filter (role = 'user') > 1 or count(*) filter (role = 'assistant') > 0) as is_continuation from conversations group by 1",
    "f10_exclude_clients": "select c_custkey from customer where c_custkey % 7 not in (3, 5)",
    "f11_validate_sequence": "select conv_id, bool_and(role in ('user', 'assistant')) as roles_ok, min_by(role, turn) = 'user' as starts_with_user from conversations where role <> 'system' group by 1",
    "f13_effective_threshold": r"select doc_id, case when length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) > 0.01 * length(text) or length(regexp_replace(text, '\s+', '', 'g')) / greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 1) < 4 then 0.01 else 0.02 end as threshold from documents",
    "a1_tokens": f"with rows as (select doc_id, unnest({TOKENS_SQL}) as pattern from documents) " + COUNTED.format(by=""),
    "a1_tokens_by_source": f"with rows as (select source, doc_id, unnest({TOKENS_SQL}) as pattern from documents) " + COUNTED.format(by="source,") + " having sum(k) >= 3",
    "a2_char_ngrams": r"with rows as (select doc_id, unnest(list_transform(generate_series(1, length(text) - 7), lambda i: substring(text, i, 8))) as pattern from documents union all select doc_id, unnest(list_transform(generate_series(1, length(text) - 15), lambda i: substring(text, i, 16))) from documents) select * from (" + COUNTED.format(by="") + r" having sum(k) >= 20) where regexp_matches(pattern, '\p{L}') and length(regexp_replace(pattern, '^\s+|\s+$', '', 'g')) >= 1",
    "a2_lengths": r"with rows as (select conv_id, turn, unnest(list_transform(generate_series(1, length(text) - L + 1), lambda i: substring(text, i, L))) as pattern from conversations, (select unnest(range(6, 30)) as L) l where length(text) >= L), c as (select pattern, count(*) as n, count(distinct (conv_id, turn)) as df from rows group by 1 having count(*) >= 2) select length(pattern)::int as length, count(*) as patterns, sum(n)::bigint as n, sum(df)::bigint as df from c where regexp_matches(pattern, '\p{L}') and length(regexp_replace(pattern, '^\s+|\s+$', '', 'g')) >= 1 group by 1",
    "a14_entropy_filter": f"with rows as (select source, doc_id, unnest({TOKENS_SQL}) as pattern from documents), c as ({COUNTED.format(by='source,')}), r as (select source, pattern, n from c where n >= 3 and {QUALITY_SQL} qualify row_number() over (partition by source order by n * length(pattern) desc, pattern) <= 300), h as (select source, text[:1000] as head from documents where text <> '' qualify row_number() over (partition by source order by doc_id, text) = 1), x as (select source, null as pattern, unnest(string_split(head, '')) as ch from h union all select source, pattern, unnest(string_split(pattern, '')) from r), n as (select source, pattern, ch, count(*) as n from x group by all), e as (select source, pattern, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from n group by all) select r.source, r.pattern, r.n, round(e.entropy, 6) as entropy from r join e on r.source is not distinct from e.source and r.pattern = e.pattern left join e b on b.pattern is null and b.source is not distinct from r.source where e.entropy >= 0.6 * coalesce(b.entropy, 0)",
    "a3_lines": f"with lines as (select doc_id, {STRIP.format('unnest(string_split(text, chr(10)))')} as pattern from documents), rows as (select * from lines where length(pattern) >= 3) " + COUNTED.format(by="") + " having sum(k) >= 2",
    "a3_line_pairs": f"with l as (select doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos, {STRIP.format('unnest(string_split(text, chr(10)))')} as pattern from documents), w as (select pattern, count(*) over (partition by doc_id, pattern order by pos range between 1 following and 50 following) as later from l where length(pattern) >= 3) select pattern, sum(later)::bigint as pairs from w group by 1 having sum(later) > 0",
    "a4_word_ngrams": r"with b as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') as w from documents), r as (" + " union all ".join(f"select doc_id, unnest(list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i+{k - 1}], ' '))) as pattern from b" for k in (2, 3, 4, 5)) + "), rows as (select * from r where length(pattern) >= 5) select *, round(least(1.0, n / 10), 4) as confidence from (" + COUNTED.format(by="") + " having sum(k) >= 3)",
    "a5_a6_code": _code_rows_sql(),
    "a19_simple_code": _code_rows_sql(catalogs.SIMPLE_CODE_PATTERNS, 3),
    "f7_f8_quality": r"with b as (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') as w from documents), r as (select unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i+1], ' '))) as pattern from b), g as (select pattern from r where length(pattern) >= 5 group by 1 having count(*) >= 5) select pattern, regexp_matches(pattern, '\p{L}') as meaningful, length(pattern) between 5 and 12 and length(regexp_replace(pattern, '[^\p{L}\p{N}]', '', 'g')) * 10 >= length(pattern) * 3 as by_share, " + QUALITY_SQL + " as quality from g",
    "a7_templates": f"with {_templates_cte()} select * from g",
    "a8_expand_templates": f"with {_templates_cte()}, c as (select kind, template, instance as pattern, count(*) as n from rows group by all), t as (select c.* from c join g using (kind, template) where c.n >= greatest(2, g.n // 4) qualify row_number() over (partition by kind, template order by c.n desc, pattern) <= 3) select kind, template, template as pattern, n from g union all select * from t",
    "a10_merge_whitespace": f"with l as (select unnest(string_split(text, chr(10))) as x from documents), p as (select case when length(x) % 2 = 0 then ' ' || x else x end as pattern, count(*) as n from l where x <> '' group by 1), b as (select *, {STRIP.format('pattern')} as bare, sum(n) over (partition by {STRIP.format('pattern')}) as total, max(n) over (partition by {STRIP.format('pattern')}) as df from p qualify row_number() over (partition by {STRIP.format('pattern')} order by n desc, length(pattern) desc, pattern desc) = 1) select pattern, total::bigint as n, df from b",
    "a15_structural_score": f"with c as ({_code_rows_sql()}) select kind, pattern, greatest(0, least(10, case when regexp_matches(pattern, '\\b(def|class|import|return|if|for|while|function)\\b') then 4 else 0 end + case when regexp_matches(pattern, '[:;{{}}\\[\\]]|\\n') then 3 else 0 end + case when regexp_matches(pattern, '[A-Za-z0-9_]\\(') then 3 else 0 end - case when regexp_matches(pattern, '[0-9]{{3,}}|@|https?:') then 3 else 0 end)) / 10.0::double as score from c",
    "f12_filter_log": f"with c as (select event_id, category, case when event_id % 3 = 0 then 'INFO' else 'DEBUG' end as level from ({_log_sql().replace('select case', 'select event_id, case').replace(', count(*) as n from logs group by 1', ' from logs')}) x) select level, category, count(*) as n from c where level = 'INFO' or category in ('system_fixes', 'kv_cache_optimization') group by all",
    "p14_detect_language": _language_sql(),
    "f6_analysis_gate": _gate_sql(),
    "a9_rank": f"with rows as (select doc_id, unnest({TOKENS_SQL}) as pattern from documents), c as ({COUNTED.format(by='')}) select pattern, n, n * length(pattern) as value, row_number() over (order by n * length(pattern) desc, pattern)::int as rank from c where n >= 3 and {QUALITY_SQL} qualify rank <= 200",
    "a18_chunks": "select doc_id, start::int as start, substring(text, start, 500) as chunk from (select doc_id, text, unnest(generate_series(1, greatest(1, length(text)), 450)) as start from documents) x",
}
