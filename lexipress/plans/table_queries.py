"""Queries of the dictionary, transform, conversation, prompt, report, source and streaming operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexipress import catalogs, sources
from lexipress import streaming as T
from lexipress.functions import text as X
from lexipress.operators import conversations as W
from lexipress.operators import dictionary as D
from lexipress.operators import mining as M
from lexipress.operators import prompts as P
from lexipress.operators import reports as R
from lexipress.operators import transform as C
from lexipress.plans import derived as V
from lexipress.plans.derived import CODE_SQL, COSTS_SQL, TURNS_SQL
from lexipress.plans.text_queries import COUNTED, QUALITY_SQL, TOKENS_SQL, _log_sql, _logs, tool_texts
from lexipress.storage import fresh_path, settle
from lexipress.streaming import conversations as live


def _dictionary(s, d, k: int = 262, counts: DataFrame | None = None):
    """The slice's dictionary: ranked tokens (``counts``, where they are mined already) take free private-use and pool symbols."""
    docs = V.documents(s, d)
    ranked = M.rank_patterns(M.mine_tokens(docs) if counts is None else counts, k=2 * k)
    pool = D.free_symbols(catalogs.symbol_pool(s, private_use=True), docs, k=k)
    return settle(D.assign_symbols(ranked, D.rank_symbols(pool, k=k), k=k), "dictionary")


def _pool_sql() -> str:
    values = ", ".join(f"('{x}', {i + 1}, '{k}', { {'unicode': 1, 'ascii': 2, 'private': 3}[k]})" for i, (x, k) in enumerate(catalogs.symbols(False)))
    return f"(select * from (values {values}) t(symbol, rank, kind, cost) union all select chr((57344 + i)::int), {len(catalogs.symbols(False))} + 1 + i, 'private', 3 from range(0, 6400) r(i))"


def _dictionary_sql(k: int = 262, docs: str = "documents") -> str:
    value = "greatest(0, (length(pattern) - length({0})) * n - (length(pattern) + length({0}) + 3)) / 4.0"
    return f"""rows as (select doc_id, unnest({TOKENS_SQL}) as pattern from {docs} x), counted as ({COUNTED.format(by='')}),
ranked as (select pattern, n from counted where n >= 3 and {QUALITY_SQL} qualify row_number() over (order by n * length(pattern) desc, pattern) <= {2 * k}),
pool as (select p.* from {_pool_sql()} p where not exists (select 1 from {docs} x where contains(text, p.symbol))),
symbols as (select symbol, row_number() over (order by cost + (kind = 'ascii')::int, length(symbol), rank) as srank from pool qualify srank <= {k}),
best as (select pattern, n, row_number() over (order by {value.format("'α'")} desc, length(pattern) desc, pattern) as srank from ranked where {value.format("'α'")} > 0),
dictionary as (select row_number() over (order by length(pattern) desc, pattern)::int as seq, symbol, pattern, n, round({value.format('symbol')}, 4) as value from best join symbols using (srank) where {value.format('symbol')} > 0)"""


SUBSTITUTED_SQL = """rules as (select list(struct_pack(s := symbol, p := pattern) order by seq) as r from dictionary),
sub as (select doc_id, source, lang, text, list_reduce(list_prepend(struct_pack(s := '', p := text), (select r from rules)), lambda acc, x: struct_pack(s := '', p := replace(acc.p, x.p, x.s))).p as compressed_text from documents)"""
SAVED = "count(*) as docs, sum(length(text))::bigint as original_chars, sum(length(compressed_text))::bigint as compressed_chars"
SAVED_REST = "*, original_chars - compressed_chars as saved_chars, (original_chars - compressed_chars) // 4 as tokens_saved, round((original_chars - compressed_chars) / greatest(original_chars, 1), 4) as ratio"


def slice_savings(s, d):
    """The flagship: dictionary of the corpus, substitution, savings by source and language."""
    return R.savings_report(C.substitute(V.documents(s, d), _dictionary(s, d)), ["source", "lang"])


def _rejected(s, d):
    """Tokens are mined once, for the dictionary and for what it leaves out."""
    counts = settle(M.mine_tokens(V.documents(s, d)), "counts")
    return D.rejected(M.rank_patterns(counts, k=600), _dictionary(s, d, counts=counts)).select("pattern", "n", "value")


def _metrics(s, d, **kw):
    return W.turn_metrics(V.turns(s, d), **kw)


def _candidates(s, d):
    return M.mine_tokens(V.messages(s, d).withColumnRenamed("turn", "doc_id"), ["conv_id"], min_n=1)


def _rules(s, d):
    """(conv_id, turn, text, symbol, value): long tokens want a symbol by their first letter."""
    rows = V.messages(s, d).select("conv_id", "turn", F.explode(M.tokens(F.col("text"))).alias("text")).groupBy("conv_id", "turn", "text").agg(F.count("*").alias("n"))
    return rows.where(F.length("text") >= 10).select("conv_id", "turn", "text", F.upper(F.left("text", F.lit(2))).alias("symbol"), (F.col("n") * F.length("text")).alias("value"))


RULE_ROWS_SQL = f"select conv_id, turn, text, upper(left(text, 2)) as symbol, n * length(text) as value from (select conv_id, turn, text, count(*) as n from (select conv_id, turn, unnest({TOKENS_SQL}) as text from conversations) u group by all) g where length(text) >= 10"
RULES_SQL = f"""cand as ({RULE_ROWS_SQL}),
firsts as (select * from cand qualify row_number() over (partition by conv_id, text order by turn, value desc, symbol) = 1),
rules as (select conv_id, text, symbol, turn as first_turn, value from firsts qualify row_number() over (partition by conv_id order by turn, value desc, text) <= 40)"""


def _conflicts(s, d):
    pool = s.createDataFrame([(i, f"S{i}") for i in range(1, 21)], "rank int, symbol string")
    return W.reassign_conflicts(W.additive_rules(_rules(s, d), 40), pool)


def _sse(s, d, m=None):
    """(request, seq, ts, value): a response per conversation, a line per turn, some empty, done or broken. ``m``: messages with
    a column ``said`` that is sent in place of the text."""
    m = V.messages(s, d).withColumn("said", F.col("text")) if m is None else m
    body = F.to_json(F.struct(F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), F.array(F.struct(F.lit(0).alias("index"), F.struct(F.col("said").alias("content")).alias("delta"))).alias("choices"), F.when(F.col("turn") % 2 == 1, F.struct(F.col("turn").alias("prompt_tokens"), F.length("text").cast("long").alias("completion_tokens"), (F.col("turn") + F.length("text")).cast("long").alias("total_tokens"))).alias("usage")))
    value = F.when(F.col("turn") == 5, "data: {broken").when(F.col("turn") == 6, "").when(F.col("turn") == 7, "event: x").when(F.col("turn") == 3, "data: [DONE]").otherwise(F.concat(F.lit("data: "), body))
    return m.select(F.col("conv_id").alias("request"), F.col("turn").alias("seq"), F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"), value.alias("value"))


def _message_dictionary(s, d, k: int = 262):
    m = V.messages(s, d)
    pool = D.free_symbols(catalogs.symbol_pool(s, private_use=True), m, k=k)
    return settle(D.assign_symbols(M.rank_patterns(M.mine_tokens(m), k=2 * k), D.rank_symbols(pool, k=k), k=k), "dictionary")


def _chunks(s, d):
    """Turns are sent with symbols for their words, and expanded chunk by chunk."""
    rules = _message_dictionary(s, d)
    m = C.substitute(V.messages(s, d), rules).withColumn("said", F.col("compressed_text"))
    return T.expand_stream(T.repair_chunks(T.parse_sse(_sse(s, d, m))), rules)


SENT_SQL = "with " + _dictionary_sql(262, "(select conv_id, turn as doc_id, text from conversations)") + """, rules as (select list(struct_pack(s := symbol, p := pattern) order by seq) as r from dictionary),
sent as (select *, list_reduce(list_prepend(struct_pack(s := '', p := text), (select r from rules)), lambda acc, x: struct_pack(s := '', p := replace(acc.p, x.p, x.s))).p as said from conversations)"""


def _flat(df):
    sent = F.length(F.coalesce(F.get(F.col("chunk.choices"), F.lit(0))["delta"]["content"], F.lit("")))
    return df.select("request", "seq", "kind", "content", sent.alias("sent_chars"))


def _dict_round(s, d):
    """Encoded by source and parsed again."""
    docs = V.documents(s, d)
    ranked = M.rank_patterns(M.mine_tokens(docs, ["source"]), ["source"], k=10)
    made = D.assign_symbols(ranked, D.rank_symbols(catalogs.symbol_pool(s), k=10), ["source"], 10)
    return D.decode_dictionary(D.encode_dictionary(made, ["source"]), keys=["source"])


ODD = ("a;b‖c⟦d", "list⟦int⟧", "x#DICT_END;y", "tail\\", "one\ntwo\\n", "plain text")


def _odd_dictionary(s, d, plain: bool = False):
    """(scope, seq, symbol, pattern): a dictionary per customer, an entry per order, patterns with separators and escapes."""
    key = F.col("o_orderkey")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    odd = F.element_at(F.array(*[F.lit(x) for x in ODD]), (key % len(ODD) + 1).cast("int"))
    return V.table(s, d, "orders").select(F.col("o_custkey").alias("scope"), seq.alias("seq"), F.decode(F.unhex(F.lpad(F.hex((F.lit(945) + seq).cast("long")), 4, "0")), "UTF-16BE").alias("symbol"), F.concat(odd, F.lit(" "), key.cast("string")).alias("pattern"))


ODD_SQL = "odd as (select o_custkey as scope, row_number() over (partition by o_custkey order by o_orderkey)::int as seq, o_orderkey, ['a;b‖c⟦d', 'list⟦int⟧', 'x#DICT_END;y', 'tail' || chr(92), 'one' || chr(10) || 'two' || chr(92) || 'n', 'plain text'][o_orderkey % 6 + 1] || ' ' || o_orderkey as pattern from orders), entries as (select scope, seq, chr(945 + seq) as symbol, pattern from odd)"
ESCAPED_SQL = "replace(replace(replace(replace(replace(pattern, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '‖', chr(92) || '‖'), '⟦', chr(92) || '⟦'), '#DICT_END', chr(92) || '#DICT_END')"


def _stored(s, d):
    path = fresh_path(s, "stored")
    sources.write_dictionary(_dictionary(s, d), path, prompt_chars=F.lit(1000).cast("long"))
    return sources.read_dictionary(s, path).select("seq", "symbol", "pattern", "pattern_len", "prompt_chars", "savings", F.round("ratio", 6).alias("ratio"))


def _requests(s, d):
    """Conversations written as JSON lines of requests, with fields that the schema doesn't name, and read again."""
    path = fresh_path(s, "requests")
    m = V.messages(s, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    some = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a"), F.col("conv_id").cast("string")))
    m.select(F.col("conv_id").cast("string").alias("id"), F.lit("m").alias("model"), "messages", (F.col("conv_id") / 4).alias("temperature"), some.alias("stop"), F.struct(F.struct(F.col("conv_id").alias("k")).alias("inner")).alias("meta")).write.json(path)
    field = lambda name, path, kind: F.try_variant_get(F.col("open")[name], path, kind)
    return sources.read_requests(s, path).select("id", "model", "idx", "role", F.length("content").alias("chars"), field("temperature", "$", "double").alias("temperature"), field("stop", "$[1]", "string").alias("stop"), field("meta", "$.inner.k", "long").alias("k"), F.array_join(F.array_sort(F.map_keys("open")), ",").alias("names"))


def _counts(s, d):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    docs = V.documents(s, d)
    store, _ = D.update_token_counts(docs.where("doc_id % 2 = 0"), s.createDataFrame([], "key string, tokens long, at timestamp"), now)
    _, report = D.update_token_counts(docs, settle(store, "store"), now)
    return report


def _token_store(s, d):
    """A store on disk, run over half of the texts, then over all, then over all again a day and a half later."""
    path = fresh_path(s, "token-store")
    docs, at = V.documents(s, d), lambda x: F.lit(x).cast("timestamp")
    runs = [D.update_token_store(some, path, at(now)) for some, now in ((docs.where("doc_id % 2 = 0"), "2026-01-02 00:00:00"), (docs, "2026-01-02 06:00:00"), (docs, "2026-01-02 07:00:00"), (docs, "2026-01-03 18:00:00"))]
    reports = [r.select(F.lit(i + 1).alias("run"), "hits", "misses") for i, r in enumerate(runs)]
    kept = D.read_token_store(s, path, at("2026-01-03 18:00:00")).agg(F.count("*").alias("stored"), F.sum("tokens").alias("tokens"))
    return reduce(DataFrame.unionByName, reports).join(F.broadcast(kept))  # one row


def _calls(s, d):
    return C.extract_tool_calls(V.tool_docs(s, d))


def _requests_table(s, d):
    return V.turns(s, d).groupBy("conv_id").agg(F.sum("original_chars").alias("original_chars"), F.sum("compressed_chars").alias("compressed_chars"), F.floor(F.sum("dict_chars") / 40).alias("overhead_tokens"), F.count("*").alias("prompt_tokens"), (2 * F.count("*")).alias("completion_tokens"), (F.count("*") % 4).cast("double").alias("total_s"), F.lit(0.5).alias("prompt_s"), (F.count("*") % 3).cast("double").alias("generation_s"))


REQ_SQL = f"with {TURNS_SQL}, q as (select conv_id, sum(original_chars)::bigint as original_chars, sum(compressed_chars)::bigint as compressed_chars, (sum(dict_chars) // 40)::bigint as overhead_tokens, count(*) as prompt_tokens, 2 * count(*) as completion_tokens, (count(*) % 4)::double as total_s, 0.5::double as prompt_s, (count(*) % 3)::double as generation_s from turns group by 1)"
METRICS_SQL = """m0 as (select *, case when original_chars > 0 then round(1 - compressed_chars / greatest(original_chars, 1), 4) else 0 end as compression_ratio, (original_chars - compressed_chars) // 4 as tokens_saved, floor({paid} / 3.5 * 1.15)::bigint as overhead_tokens from turns),
m1 as (select *, round(overhead_tokens / greatest(original_chars // 4, 1), 4) as overhead_ratio from m0), m as (select *, round(compression_ratio - overhead_ratio, 4) as net_efficiency from m1)"""
METRICS = f"{TURNS_SQL}, " + METRICS_SQL.format(paid="dict_chars")
STATEFUL = f"{TURNS_SQL}, " + METRICS_SQL.format(paid="new_dict_chars")
TREND_SQL = "case when count(*) over w < 3 then 'insufficient_data' when net_efficiency - first_value(net_efficiency) over w > 0.01 then 'improving' when net_efficiency - first_value(net_efficiency) over w < -0.01 then 'declining' else 'stable' end as trend"
WIN3 = "window w as (partition by conv_id order by turn rows between 2 preceding and current row)"


def _summary(s, d):
    m = W.should_continue(W.efficiency_trend(_metrics(s, d)).withColumn("symbols_used", F.lit(10)))
    short = W.short_turn(W.request_context(V.messages(s, d))).select("conv_id", "turn", "short_turn")
    usage = W.symbol_usage(W.additive_rules(_rules(s, d), 40), _rules(s, d).groupBy("conv_id", "turn", "symbol").agg(F.count("*").alias("n")))
    out = W.conversation_summary(m.join(short.hint("shuffle_merge"), ["conv_id", "turn"]), usage, W.top_tokens(V.messages(s, d)))
    return out.withColumn("top_tokens", F.array_join("top_tokens", " "))


def _analysed(s, d):
    """Turns that may add rules; a turn's new rules are those that come first in it, the limits small enough to be met."""
    new = W.additive_rules(_rules(s, d), 1 << 30).groupBy("conv_id", F.col("first_turn").alias("turn")).agg(F.count("*").alias("new_rules"))
    turns = V.turns(s, d).select("conv_id", "turn", "compressed_chars", F.col("original_chars").alias("new_chars")).join(new.hint("shuffle_merge"), ["conv_id", "turn"], "left")
    return W.needs_analysis(turns, 50, 1, 12).select("conv_id", "turn", "rules_before", "may_add")


def _session_keys(s, d):
    m = V.messages(s, d)
    first = m.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_user"))
    return X.auto_session(m).join(first.hint("shuffle_merge"), "conv_id").select("conv_id", "session", X.session_key(F.col("session"), F.col("first_user")).alias("key"))


def _expired(s, d):
    path = fresh_path(s, "expiring")
    V.table(s, d, "events").select("event_type", "ts").write.partitionBy("event_type").parquet(path)
    return sources.expire_stored(s, path, "ts", F.lit("2024-01-03 00:00:00").cast("timestamp"), 24, ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


def _prompts(s, d):
    m = V.messages(s, d).withColumn("role", F.when(F.col("turn") == 0, "system").otherwise(F.col("role")))
    decoders = m.select("conv_id").distinct().where("conv_id % 2 = 0").withColumn("decoder", F.lit("Decode symbols."))
    return m, P.merge_prompts(P.system_prompts(m), decoders)


PROMPT_SQL = r"""m as (select conv_id, turn, case when turn = 0 then 'system' else role end as role, text from conversations),
said as (select conv_id, regexp_replace(regexp_replace(text, '^(Human|Assistant|System):\s*', ''), '^\s+|\s+$', '', 'g') as clean from m where role = 'system'),
ids as (select distinct conv_id, case when conv_id % 2 = 0 then 'Decode symbols.' else '' end as decoder from conversations),
p as (select conv_id, decoder, string_agg(clean, chr(10) || chr(10)) as ps from ids left join said using (conv_id) group by all),
merged as (select conv_id, case when decoder = '' then ps when coalesce(ps, '') = '' then decoder else decoder || chr(10) || chr(10) || ps end as merged from p where decoder <> '' or coalesce(ps, '') <> '')"""

def _streamed(s, rows, run):
    """The rows written to a folder, read as a stream, put through ``run`` and what comes out read back."""
    source, out = fresh_path(s, "stream-in"), fresh_path(s, "stream-out")
    rows.coalesce(1).write.parquet(source)
    query = run(s.readStream.schema(rows.schema).parquet(source)).writeStream.format("parquet").option("checkpointLocation", fresh_path(s, "stream-cp")).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return s.read.parquet(out)


def _stateful(s, rows, run):
    s.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else time-outs of state keep the query going
    try:
        return _streamed(s, rows, run)
    finally:
        s.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def _conversation_stream(s, d):
    """T5: the running tally and trend from state; SQL has them from windows."""
    return _stateful(s, V.turns(s, d).select("conv_id", "turn", "original_chars", "compressed_chars"), T.conversation_stream)


def _live_turns(s, d, gap: int):
    """Turns as they would arrive: (TURN columns, part); a minute apart, ``gap`` seconds more after each third."""
    rules = _rules(s, d).groupBy("conv_id", "turn").agg(F.collect_list(F.struct("text", "symbol", "value")).alias("rules"))  # one turn's
    m = _metrics(s, d, mode="stateful").select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn", "original_chars", "compressed_chars")], "net_efficiency")
    ts = F.timestamp_seconds(1_700_000_000 + 60 * F.col("turn") + gap * F.floor(F.col("turn") / 3))
    part = (F.pmod("conv_id", F.lit(3)) + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2))).cast("int")
    return m.join(rules.hint("shuffle_merge"), ["conv_id", "turn"], "left").withColumn("ts", ts).withColumn("part", part)


def _conversation_state(s, d, gap: int = 0):
    """Turns shuffled over four files, a batch each, and a last row that lets the watermark pass them all."""
    source, out = fresh_path(s, "turns-in"), fresh_path(s, "turns-out")
    rows = settle(_live_turns(s, d, gap), "turns")
    last = rows.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "ts", F.lit(0).cast("long").alias("original_chars"), F.lit(0).cast("long").alias("compressed_chars"), F.lit(0.0).alias("net_efficiency"))
    for part in range(4):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    last.join(rows.drop("part").limit(0).select("rules"), F.lit(True), "left").coalesce(1).write.mode("append").parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    s.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = s.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = live.conversation_state(stream, "10 days", k=40).writeStream.format("parquet").option("checkpointLocation", fresh_path(s, "stream-cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        s.conf.set(name, before)
    rule_names = F.array_join(F.array_sort(F.transform("rules", lambda x: F.concat(x["text"], F.lit("="), x["symbol"]))), " ")
    return s.read.schema(live.OUTPUT).parquet(out).where("conv_id >= 0").select("conv_id", "turn", "turns", "original_chars", "compressed_chars", "cumulative_ratio", "trend", "symbols_used", "should_continue", rule_names.alias("rules"))


def _state_sql(session: str) -> str:
    """W6, W7, W3 and W8 by window, within sessions of a conversation."""
    return f"""with {STATEFUL}, cand as (select *, {session} as session from ({RULE_ROWS_SQL}) c),
firsts as (select * from cand qualify row_number() over (partition by conv_id, session, text order by turn, value desc, symbol) = 1),
kept as (select * from firsts qualify row_number() over (partition by conv_id, session order by turn, value desc, text) <= 40),
added as (select conv_id, turn, count(*) as n, string_agg(text || '=' || symbol, ' ' order by text || '=' || symbol) as rules from kept group by all),
r as (select m.*, {session} as session, coalesce(n, 0) as n, coalesce(rules, '') as rules from m left join added using (conv_id, turn)),
t as (select *, case when count(*) over w < 3 then 'insufficient_data' when net_efficiency - first_value(net_efficiency) over w > 0.01 then 'improving' when net_efficiency - first_value(net_efficiency) over w < -0.01 then 'declining' else 'stable' end as trend,
  count(*) over a as turns, sum(original_chars) over a as o, sum(compressed_chars) over a as c, sum(n) over a as symbols_used, lag(net_efficiency) over v as prior
  from r window v as (partition by conv_id, session order by turn), a as (partition by conv_id, session order by turn rows unbounded preceding), w as (partition by conv_id, session order by turn rows between 2 preceding and current row))
select conv_id, turn, turns, o::bigint as original_chars, c::bigint as compressed_chars, round((o - c) / greatest(o, 1), 4) as cumulative_ratio, trend, symbols_used::bigint as symbols_used,
  case when turns <= 2 then true when symbols_used >= 40 then false when net_efficiency < 0.01 and prior < 0.01 then false when trend = 'declining' and net_efficiency < 0.02 then false when turns > 20 and net_efficiency < 0.02 then false else true end as should_continue, rules from t"""


def _read_sse(s, d):
    """S3: the lines of each response as a text file, read as a stream."""
    folder, out = fresh_path(s, "sse-in"), fresh_path(s, "sse-out")
    _sse(s, d).select("value").write.text(folder)
    query = T.parse_sse(sources.read_sse(s, folder)).select("kind", F.length("value").alias("chars")).writeStream.format("parquet").option("checkpointLocation", fresh_path(s, "stream-cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return s.read.parquet(out).groupBy("kind").agg(F.count("*").alias("n"))


def _tagged(s, d):
    """Messages with the first tag of the log catalog that they hold, by a join with the catalog."""
    tags = F.broadcast(catalogs.log_tags(s))
    rows = _logs(s, d).join(tags, F.expr("contains(upper(message), tag)"), "left").groupBy("event_id").agg(F.min_by("category", "priority").alias("category"))
    return rows.groupBy(F.coalesce("category", F.lit(catalogs.DEFAULT_CATEGORY)).alias("category")).agg(F.count("*").alias("n"))


def _upper_fields(s, d):
    """A caller's compressor that drops vowels."""
    done = C.substitute_fields(_calls(s, d), _dictionary(s, d), 300, lambda text, rules: F.regexp_replace(text, "[aeiou]", ""))
    return done.select("doc_id", F.md5(F.col("compressed")["content"]).alias("content_md5"))


def _long_words(df):
    """A caller's strategy: words of 12 letters and more."""
    rows = df.select("doc_id", F.explode(F.filter(X.words(F.col("text")), lambda w: F.length(w) >= 12)).alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df"))


QUERIES = {
    "s3_sse_stream": _read_sse,
    "t5_conversation_stream": _conversation_stream,
    "t5_conversation_state": _conversation_state,
    "t6_idle_state": lambda s, d: _conversation_state(s, d, 7200),
    "t5_rule_stream": lambda s, d: _stateful(s, _rules(s, d), lambda rows: T.rule_stream(rows, 40)),
    "w3_analyse": _analysed,
    "p7_session_key": _session_keys,
    "s6_rewrite": _expired,
    "u1_tokenizer": lambda s, d: D.token_efficiency(V.documents(s, d).select("doc_id", "text", F.regexp_replace("text", "[aeiou]", "").alias("compressed_text")), tokenizer=lambda c: F.length(F.regexp_replace(c, r"\s", ""))).select("doc_id", "original_tokens", "compressed_tokens", "saved", "valid"),
    "u2_compressor": _upper_fields,
    "u3_strategy": lambda s, d: M.mine_patterns(V.documents(s, d), strategies=[_long_words], only=True),
    "slice_savings": slice_savings,
    "s1_messages": lambda s, d: sources.read_messages(s, f"{d}/conversations.parquet").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    "s2_requests": _requests,
    "s4_symbol_pool": lambda s, d: catalogs.symbol_pool(s).join(V.documents(s, d).select(F.explode(F.array_distinct(F.split("text", ""))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("docs")).hint("shuffle_merge"), "symbol", "left").select("symbol", "rank", "kind", "cost", F.coalesce("docs", F.lit(0)).alias("docs")),
    "s5_stored_dictionary": _stored,
    "s6_expire": lambda s, d: sources.expire(V.table(s, d, "events"), "ts", F.lit("2024-01-03 00:00:00").cast("timestamp"), 24).agg(F.count("*").alias("n")),
    "s7_op_log": lambda s, d: V.op_log(s, d).groupBy("phase", "level").agg(F.count("*").alias("n")),
    "s8_catalogs": lambda s, d: V.code_docs(s, d).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_like("text", F.lit(p)).alias("hit")) for k, p, *_ in catalogs.CODE_PATTERNS]))).groupBy("kind").agg(F.count_if("hit").alias("n")),
    "s8_log_tags": lambda s, d: _tagged(s, d),
    "s8_comment_rules": lambda s, d: V.code_docs(s, d).select("filename").unionByName(V.table(s, d, "pages").select("url").withColumnRenamed("url", "filename")).join(F.broadcast(catalogs.comment_rules(s).select("language", "line", F.explode("endings").alias("ending"))), F.expr("endswith(lower(filename), ending)")).groupBy("language", "line", "ending").agg(F.count("*").alias("n")),
    "d2_by_scope": lambda s, d: D.free_symbols(catalogs.symbol_pool(s), V.documents(s, d).withColumn("text", F.concat("text", F.element_at(F.array(F.lit("α"), F.lit("|A"), F.lit("€")), F.length("source") % 3 + 1))), scope=["source"]).select("source", "symbol", "rank"),
    "d1_rank_symbols": lambda s, d: D.rank_symbols(V.symbol_costs(s, d).groupBy("symbol").agg(F.lit("unicode").alias("kind"), F.min(F.substring("symbol", 2, 9).cast("int")).alias("rank"), F.lit(9).alias("cost")), V.symbol_costs(s, d), "f1", 100),
    "d2_free_symbols": lambda s, d: D.free_symbols(catalogs.symbol_pool(s), V.documents(s, d)).select("symbol", "rank"),
    "d3_value": lambda s, d: M.rank_patterns(M.mine_tokens(V.documents(s, d)), k=300).select("pattern", F.round(D.assignment_value(F.col("pattern"), F.col("n"), F.lit("α")), 4).alias("by_tokens"), F.round(D.assignment_value(F.col("pattern"), F.col("n"), F.lit("α"), "chars"), 4).alias("by_chars")),
    "d4_dictionary": lambda s, d: _dictionary(s, d),
    "d5_by_priority": lambda s, d: D.assign_by_priority(M.rank_patterns(M.mine_tokens(V.documents(s, d)), k=300).withColumn("priority", F.length("pattern")), D.rank_symbols(catalogs.symbol_pool(s)), k=200),
    "d6_metrics": lambda s, d: D.dictionary_metrics(_dictionary(s, d), V.documents(s, d).agg(F.sum(F.length("text")).alias("original_chars"))),
    "d7_rejected": _rejected,
    "d8_accept": lambda s, d: D.accept(C.substitute(V.documents(s, d), _dictionary(s, d)), 0.05).select("doc_id", "accepted", F.md5("final_text").alias("final_md5")),
    "d9_token_efficiency": lambda s, d: D.token_efficiency(C.substitute(V.documents(s, d), _dictionary(s, d))).select("doc_id", "original_tokens", "compressed_tokens", "saved", "ratio", "valid"),
    "d10_symbol_stats": lambda s, d: D.symbol_stats(V.symbol_costs(s, d)),
    "d11_compare_families": lambda s, d: D.compare_families(V.symbol_costs(s, d), "f0", "f1"),
    "d12_context_efficiency": lambda s, d: D.context_efficiency(V.symbol_costs(s, d).select("symbol").distinct(), [("the ", " of"), ("x=", ";")], lambda c: X.token_estimate(c, "words")),
    "d13_d14_dictionary_text": _dict_round,
    "d13_encoded": lambda s, d: D.encode_dictionary(_odd_dictionary(s, d), ["scope"]),
    "d14_odd_round_trip": lambda s, d: D.decode_dictionary(D.encode_dictionary(_odd_dictionary(s, d), ["scope"]), keys=["scope"]),
    "d15_prompt": lambda s, d: D.dictionary_prompt(_dictionary(s, d)),
    "d16_overhead": lambda s, d: D.prompt_overhead(_dictionary(s, d)),
    "d17_token_counts": _counts,
    "d17_token_store": _token_store,
    "c1_substitute": lambda s, d: C.substitute(V.documents(s, d), _dictionary(s, d)).select("doc_id", F.md5("compressed_text").alias("md5"), "original_chars", "compressed_chars"),
    "c2_expand": lambda s, d: (lambda made: C.expand(C.substitute(V.documents(s, d), made), made))(_dictionary(s, d)).select("doc_id", F.md5("expanded_text").alias("md5")),
    "c3_roundtrip": lambda s, d: C.roundtrip_report(V.documents(s, d), _dictionary(s, d), ["source"]),
    "c4_strip_comments": lambda s, d: V.code_docs(s, d).select("doc_id", F.md5(C.strip_comments(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "python").otherwise("javascript"))).alias("md5")),
    "c4_strip_html_comments": lambda s, d: V.table(s, d, "pages").select("page_id", F.md5(C.strip_comments(F.col("html"), F.lit("html"))).alias("md5")),
    "c5_comment_savings": lambda s, d: C.comment_savings(V.code_docs(s, d).withColumn("language", X.detect_language(F.col("text"), F.col("filename"))), ["language"]),
    "c6_tool_calls": lambda s, d: _calls(s, d).select("doc_id", "name", F.col("fields")["path"].alias("path"), F.md5(F.col("fields")["content"]).alias("content_md5")),
    "c6_nested_calls": lambda s, d: C.extract_tool_calls(tool_texts(s, d)).select("doc_id", "call", "name", F.try_variant_get("value", "$.arguments.path", "string").alias("path"), F.try_variant_get("value", "$.arguments.opts.n[1].m", "int").alias("m"), F.try_variant_get("value", "$.deep.path", "string").alias("deep"), F.size(F.map_keys("fields")).alias("fields")),
    "c7_fields": lambda s, d: (lambda made: C.expand_fields(C.substitute_fields(_calls(s, d), made), made))(_dictionary(s, d)).select("doc_id", F.md5(F.col("fields")["content"]).alias("content_md5")),
    "c8_multipass": lambda s, d: C.compress_multipass(V.documents(s, d).select("doc_id", "text"), 3)[0].select("doc_id", F.length("text").alias("chars")),
    "c9_adaptive": lambda s, d: C.compress_multipass(V.documents(s, d).select("doc_id", "text"), 10, adaptive=True)[0].select("doc_id", F.length("text").alias("chars")),
    "c8_history": lambda s, d: C.compress_multipass(V.messages(s, d).select("conv_id", "turn", "text"))[1],
    "c10_renest": lambda s, d: C.renest_content(V.messages(s, d).select("conv_id", "turn", F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("parts")), V.messages(s, d).select("conv_id", "turn", F.lit(0).alias("idx"), F.concat(F.lit("x"), "text").alias("text")), ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.col("parts")[0]["text"]).alias("md5")),
    "c11_compress": lambda s, d: C.compress(V.documents(s, d)).select("doc_id", "gate", "accepted", F.length("final_text").alias("chars")),
    "c12_estimate_ratio": lambda s, d: (lambda made: C.estimate_ratio(C.substitute(V.documents(s, d), made), made))(_dictionary(s, d)).select("doc_id", "ratio"),
    "w1_w2_context": lambda s, d: W.short_turn(W.request_context(V.messages(s, d))),
    "w3_additive_rules": lambda s, d: W.additive_rules(_rules(s, d), 40),
    "w4_conflicts": _conflicts,
    "w5_stateless": lambda s, d: _metrics(s, d).drop("role"),
    "w5_stateful": lambda s, d: _metrics(s, d, mode="stateful").drop("role"),
    "w14_skipped_turns": lambda s, d: W.turn_metrics(V.turns(s, d).where("role <> 'user'"), all_turns=V.turns(s, d)).groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.round(F.col("compression_ratio") * 10_000).cast("long")).alias("ratio_sum_e4")),
    "w6_running_tally": lambda s, d: W.running_tally(_metrics(s, d)).select("conv_id", "turn", "cumulative_messages", "cumulative_original", "cumulative_compressed", "cumulative_saved", "cumulative_overhead", "cumulative_ratio", "cumulative_net"),
    "w7_trend": lambda s, d: W.efficiency_trend(_metrics(s, d)).select("conv_id", "turn", "trend"),
    "w8_continue": lambda s, d: W.should_continue(W.efficiency_trend(_metrics(s, d)).withColumn("symbols_used", 250 + F.col("turn").cast("int"))).select("conv_id", "turn", "should_continue"),
    "w9_symbol_usage": lambda s, d: W.symbol_usage(W.additive_rules(_rules(s, d), 40), _rules(s, d).groupBy("conv_id", "turn", "symbol").agg(F.count("*").alias("n"))),
    "w10_top_tokens": lambda s, d: W.top_tokens(V.messages(s, d)),
    "w11_global": lambda s, d: W.global_stats(V.turns(s, d), W.additive_rules(_rules(s, d), 40)),
    "w12_retain_recent": lambda s, d: W.retain_recent(V.table(s, d, "events"), 50, 10, key="user_id").groupBy("user_id").agg(F.count("*").alias("n")),
    "w13_summary": _summary,
    "m1_system_prompts": lambda s, d: P.system_prompts(_prompts(s, d)[0]),
    "m2_merge_prompts": lambda s, d: _prompts(s, d)[1],
    "m3_apply_prompt": lambda s, d: P.apply_prompt(*_prompts(s, d)),
    "m4_format_prompt": lambda s, d: P.format_prompt(_prompts(s, d)[1].withColumn("format", F.when(F.col("conv_id") % 3 == 0, "chatml").when(F.col("conv_id") % 3 == 1, "gemma").otherwise("own")), P.formats(s)),
    "m5_guidance": lambda s, d: P.guidance(V.messages(s, d).withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Explain the ERROR: "), "text")).otherwise(F.col("text"))), custom=("code_only",)),
    "r1_savings_cube": lambda s, d: R.savings_report(V.turns(s, d).withColumn("half", F.col("conv_id") % 2), ["role", "half"], "cube"),
    "r2_throughput": lambda s, d: R.throughput(_requests_table(s, d)).select("conv_id", "total_rate", "prompt_rate", "generation_rate", "first_token_s"),
    "r3_net_savings": lambda s, d: R.net_savings(_requests_table(s, d)).select("conv_id", "net_tokens", "net_percent", "negative"),
    "r4_timing_shares": lambda s, d: R.timing_shares(_requests_table(s, d), ["prompt_s", "generation_s"], ["conv_id"]),
    "r5_op_timing": lambda s, d: R.op_timing(V.op_log(s, d).withColumn("duration", F.floor(F.col("duration") * 100) / 100)),
    "r6_op_frequency": lambda s, d: R.op_frequency(V.op_log(s, d), ("c", "p")),
    "t1_parse_sse": lambda s, d: T.parse_sse(_sse(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    "t2_t3_chunks": lambda s, d: _flat(_chunks(s, d)),
    "t4_response_metrics": lambda s, d: T.response_metrics(_chunks(s, d)),
    "t7_log_rates": lambda s, d: T.log_rates(V.op_log(s, d), "1 hour").withColumn("seconds", F.round("seconds", 3)),
}

PATH_ = "'f' || doc_id || '.txt'"
CLEAN = "translate(text, '{}' || chr(9) || chr(13), '()  ')"
DICT = "with " + _dictionary_sql()
SUB = DICT + ", " + SUBSTITUTED_SQL
EST = "greatest(1, length({0}) // 4)"

VALUE_SQL = f"least({EST.format('pattern')} - {EST.format('symbol')}, length(pattern) // 3)"
ENTRY_SQL = EST.format("(chr(10) || pattern || '=' || symbol)")
TOKEN_VALUE_SQL = f"case when {VALUE_SQL} <= 0 then -1 when n >= 5 and {VALUE_SQL} * n - {ENTRY_SQL} > -2 then greatest({VALUE_SQL} * n - {ENTRY_SQL}, 0.1) else {VALUE_SQL} * n - {ENTRY_SQL} end"
SYMBOLS_SQL = f"select symbol, row_number() over (order by cost + (kind = 'ascii')::int, length(symbol), rank)::int as srank from {_pool_sql()} p where kind <> 'private' qualify srank <= "
PROMPT_TEXT = """prompt as (select case when count(*) >= 3 then '#DICT ' || case when bool_or(regexp_matches(pattern, '[;:]')) then string_agg(symbol || '⟦' || pattern || '‖', '' order by seq) else string_agg(symbol || ':' || pattern || ';', '' order by seq) end || '#DICT_END'
  else 'Symbols stand for text:' || chr(10) || string_agg(symbol || ' = ' || pattern, chr(10) order by seq) end as prompt from dictionary)"""
PY, JS = "regexp_replace(text, '(?m) *#.*$', '', 'g')", "regexp_replace(text, '(?m)^//.*$', '', 'g')"
WORDS_SQL = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"


def _guidance_sql() -> str:
    quote = lambda some: "[" + ", ".join(f"'{x}'" for x in some) + "]"
    code = " or ".join([*(f"({' or '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in some)})" for _, _, some, *_ in catalogs.LANGUAGES if some), "(starts_with(text, '#!') and regexp_matches(left(text, 100), '/bin/bash|/bin/sh|/usr/bin/env'))"])
    calls = [code if words == ("code",) else " or ".join(f"contains(lower(text), '{w}')" for w in words) or "true" for words, _ in P.GUIDANCE]
    lines = [f"case when f{i} then {quote(some)} else []::varchar[] end" for i, (_, some) in enumerate(P.GUIDANCE)] + [quote(P.CUSTOM_GUIDANCE["code_only"])]
    every = lines[0]
    for x in lines[1:]:
        every = f"list_concat({every}, {x})"
    return f"with u as (select conv_id, case when conv_id % 2 = 0 then 'Explain the ERROR: ' || text else text end as text from conversations where role = 'user'), f as (select conv_id, {', '.join(f'bool_or({c}) as f{i}' for i, c in enumerate(calls))} from u group by 1) select conv_id, array_to_string(({every})[1:6], chr(10)) as guidance from f"


SSE_KIND = "case turn when 5 then 'bad' when 6 then 'empty' when 7 then 'field' when 3 then 'done' else 'data' end"

SQL = {
    "s3_sse_stream": f"select {SSE_KIND} as kind, count(*) as n from conversations group by 1",
    "t5_conversation_stream": f"with {TURNS_SQL}, r as (select *, round(1 - compressed_chars / greatest(1, original_chars), 4) as e from turns) select conv_id, turn, count(*) over a as turns, (sum(original_chars) over a)::bigint as original_chars, (sum(compressed_chars) over a)::bigint as compressed_chars, round((sum(original_chars) over a - sum(compressed_chars) over a) / greatest(sum(original_chars) over a, 1), 4) as cumulative_ratio, case when count(*) over w < 3 then 'insufficient_data' when e - first_value(e) over w > 0.01 then 'improving' when e - first_value(e) over w < -0.01 then 'declining' else 'stable' end as trend from r window a as (partition by conv_id order by turn rows unbounded preceding), w as (partition by conv_id order by turn rows between 2 preceding and current row)",
    "u1_tokenizer": r"with t as (select doc_id, length(regexp_replace(text, '\s', '', 'g'))::int as original_tokens, length(regexp_replace(regexp_replace(text, '[aeiou]', '', 'g'), '\s', '', 'g'))::int as compressed_tokens from documents) select *, original_tokens - compressed_tokens as saved, original_tokens > compressed_tokens as valid from t",
    "u2_compressor": f"with c as (select doc_id, {CLEAN} as c, regexp_replace({CLEAN}, '[aeiou]', '', 'g') as v from documents) select doc_id, md5(case when length(c) >= 300 and length(v) * 10 <= length(c) * 9 then v else c end) as content_md5 from c",
    "u3_strategy": r"with w as (select doc_id, unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x) >= 12)) as pattern from documents) select pattern, count(*) as n, count(distinct doc_id) as df from w group by 1 having count(*) >= 3",
    "s4_symbol_pool": f"with d as (select unnest(list_distinct(string_split(text, ''))) as symbol from documents), n as (select symbol, count(*) as docs from d group by 1) select p.symbol, p.rank, p.kind, p.cost, coalesce(docs, 0) as docs from {_pool_sql()} p left join n using (symbol) where kind <> 'private'",
    "d5_by_priority": f"with rows as (select doc_id, unnest({TOKENS_SQL}) as pattern from documents), c as ({COUNTED.format(by='')}), r as (select pattern, n from c where n >= 3 and {QUALITY_SQL} qualify row_number() over (order by n * length(pattern) desc, pattern) <= 300), q as (select *, row_number() over (order by length(pattern) * n desc, pattern)::int as srank from r qualify srank <= 200), s as ({SYMBOLS_SQL} 262) select srank, symbol, pattern, n from q join s using (srank) where length(symbol) = 1",
    "d6_metrics": f"{DICT}, o as (select sum(length(text))::bigint as original_chars from documents), v as (select *, least(greatest({TOKEN_VALUE_SQL}, 0), (original_chars // 4) * 0.1::double)::double as each from dictionary, o), g as (select count(*) as entries, sum((length(pattern) - length(symbol)) * n)::bigint as chars_saved, greatest(0, least(floor(sum(each)), floor((original_chars // 4) * 0.8), original_chars // 4 - 1))::bigint as tokens_saved, original_chars from v group by original_chars) select *, round(least(0.95, tokens_saved / greatest(original_chars // 4, 1)), 4)::double as ratio from g",
    "d12_context_efficiency": f"with {COSTS_SQL}, x as (select distinct symbol from costs), y as (select symbol, unnest([{WORDS_SQL.format("('the ' || symbol || ' of')")} - {WORDS_SQL.format("'the  of'")}, {WORDS_SQL.format("('x=' || symbol || ';')")} - {WORDS_SQL.format("'x=;'")}]) as added from x) select symbol, round(avg(1.0 / greatest(1, added + 1)), 4)::double as efficiency from y group by 1",
    "d13_d14_dictionary_text": f"with rows as (select source, doc_id, unnest({TOKENS_SQL}) as pattern from documents), c as ({COUNTED.format(by='source,')}), r as (select source, pattern, n from c where n >= 3 and {QUALITY_SQL} qualify row_number() over (partition by source order by n * length(pattern) desc, pattern) <= 10), s as ({SYMBOLS_SQL} 10), b as (select *, row_number() over (partition by source order by greatest(0, (length(pattern) - 1) * n - (length(pattern) + 4)) desc, length(pattern) desc, pattern)::int as srank from r where (length(pattern) - 1) * n > length(pattern) + 4) select source, row_number() over (partition by source order by length(pattern) desc, pattern)::int as seq, symbol, pattern from b join s using (srank) where (length(pattern) - length(symbol)) * n > length(pattern) + length(symbol) + 3",
    "d13_encoded": f"with {ODD_SQL}, e as (select scope, seq, symbol, {ESCAPED_SQL} as p, pattern from entries), o as (select scope, bool_or(contains(pattern, ';') or contains(pattern, ':') or contains(pattern, '#DICT_END')) as odd from entries group by 1) select scope, '#DICT ' || case when odd then string_agg(symbol || '⟦' || p || '‖', '' order by seq) else string_agg(symbol || ':' || p || ';', '' order by seq) end || '#DICT_END' as dict_text from e join o using (scope) group by scope, odd",
    "d14_odd_round_trip": f"with {ODD_SQL} select * from entries",
    "d15_prompt": f"with {_dictionary_sql()}, {PROMPT_TEXT} select prompt from prompt",
    "d16_overhead": f"with {_dictionary_sql()}, {PROMPT_TEXT} select floor(length(prompt) / 3.5 * 1.15)::int as overhead_tokens from prompt",
    "c4_strip_comments": f"with {CODE_SQL} select doc_id, md5(case when doc_id % 2 = 0 then {PY} else {JS} end) as md5 from code_docs",
    "c5_comment_savings": f"with {CODE_SQL}, t as (select case when ends_with(filename, '.py') then 'python' else 'javascript' end as language, text, case when ends_with(filename, '.py') then {PY} else {JS} end as stripped from code_docs), g as (select language, count(*) as docs, sum(length(text))::bigint as original_chars, sum(length(stripped))::bigint as stripped_chars, sum({EST.format('text')} - {EST.format('stripped')})::bigint as saved_tokens from t group by 1) select *, original_chars - stripped_chars as saved_chars, round(100 * (original_chars - stripped_chars) / greatest(original_chars, 1), 2) as percent from g",
    "w9_symbol_usage": f"with {RULES_SQL}, uses as (select conv_id, turn, symbol, count(*) as n from cand group by all), totals as (select conv_id, symbol, sum(n) as n from uses group by all), top as (select conv_id, count(*) as used, string_agg(symbol, ' ' order by r) filter (r <= 5) as top from (select *, row_number() over (partition by conv_id order by n desc, symbol) as r from totals) x group by 1), per as (select conv_id, round(avg(s), 4) as avg_per_turn from (select conv_id, turn, count(distinct symbol) as s from uses group by all) x group by 1), born as (select conv_id, symbol, min(first_turn) as born from rules group by all), have as (select conv_id, count(*) as available, (count(*) filter (born > start))::int as added from (select *, min(born) over (partition by conv_id) as start from born) x group by 1) select conv_id, available, added, coalesce(used, 0) as used, coalesce(avg_per_turn, 0) as avg_per_turn, round(coalesce(used, 0) / greatest(available, 1), 4) as efficiency, coalesce(top, '') as top from have left join top using (conv_id) left join per using (conv_id)",
    "w13_summary": f"with {METRICS}, t as (select *, {TREND_SQL} from m {WIN3}), p as (select *, row_number() over v as place, lag(net_efficiency) over v as prior from t window v as (partition by conv_id order by turn)), d as (select *, case when place <= 2 then true when net_efficiency < 0.01 and prior < 0.01 then false when trend = 'declining' and net_efficiency < 0.02 then false when place > 20 and net_efficiency < 0.02 then false else true end as go from p), c as (select conv_id, turn, count(*) over w > 1 and coalesce(last_value(case when role = 'user' then length(text) end ignore nulls) over w, 0) between 1 and 249 and sum(case when role in ('user', 'assistant', 'system') then length(text) else 0 end) over w < 20000 as short from conversations window w as (partition by conv_id order by turn rows unbounded preceding)) select conv_id, count(*) as turns, sum(original_chars)::bigint as original_chars, sum(compressed_chars)::bigint as compressed_chars, round(sum(round(compression_ratio * 10000)::bigint) / count(*)) / 10000 as avg_ratio, (sum(tokens_saved) - sum(overhead_tokens))::bigint as net_tokens, arg_max(trend, turn) as trend, arg_max(go, turn) as should_continue, count(*) filter (short) as short_turns from d join c using (conv_id, turn) group by 1",
    "m5_guidance": _guidance_sql(),
    "t4_response_metrics": f"with k as (select conv_id as request, turn, make_timestamp((turn + 1700000000) * 1000000) as ts, {SSE_KIND} as kind, case when turn in (3, 5, 6, 7) then '' else text end as content, turn not in (3, 5, 6, 7) and turn % 2 = 1 as counted, length(text) as n from conversations) select request, min(ts) filter (content <> '') as first_token_ts, arg_max(turn, turn) filter (counted) as prompt_tokens, arg_max(n, turn) filter (counted) as completion_tokens, arg_max(turn + n, turn) filter (counted) as total_tokens, coalesce(string_agg(content, '' order by turn), '') as text, bool_or(kind = 'done') as done from k group by 1",
    "slice_savings": f"{SUB}, g as (select source, lang, {SAVED} from sub group by all) select {SAVED_REST} from g",
    "s1_messages": "select role, count(*) as n, sum(length(text))::bigint as chars from conversations group by 1",
    "s2_requests": "select conv_id::varchar as id, 'm' as model, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, role, length(text)::int as chars, conv_id / 4 as temperature, case when conv_id % 2 = 0 then conv_id::varchar end as stop, conv_id::bigint as k, case when conv_id % 2 = 0 then 'meta,stop,temperature' else 'meta,temperature' end as names from conversations",
    "s5_stored_dictionary": "with " + _dictionary_sql() + " select seq, symbol, pattern, length(pattern)::int as pattern_len, 1000::bigint as prompt_chars, ((length(pattern) - length(symbol)) * n)::bigint as savings, round((length(pattern) - length(symbol)) * n / 1000, 6) as ratio from dictionary",
    "s6_expire": "select count(*) as n from events where ts >= timestamp '2024-01-02 00:00:00'",
    "s7_op_log": "select event_type as phase, 'INFO' as level, count(*) as n from events group by 1",
    "s8_catalogs": f"with {CODE_SQL}, k as (" + " union all ".join(f"select '{k}' as kind, count(*) filter (regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) as n from code_docs group by 1" for k, p, *_ in catalogs.CODE_PATTERNS) + ") select kind, sum(n)::bigint as n from k group by 1",
    "s8_log_tags": _log_sql(),
    "s8_comment_rules": f"with {CODE_SQL}, f as (select filename from code_docs union all select url from pages), r as (select * from (values " + ", ".join(f"('{n}', {'null' if line is None else repr(line)}, '{e}')" for n, ends, _, _, line in catalogs.LANGUAGES for e in ends) + ") t(language, line, ending)) select language, line, ending, count(*) as n from f join r on ends_with(lower(filename), ending) group by all",
    "d2_by_scope": f"with t as (select source, text || ['α', '|A', '€'][length(source) % 3 + 1] as text from documents), k as (select distinct source from documents) select k.source, symbol, rank from k, {_pool_sql()} p where kind <> 'private' and not exists (select 1 from t where t.source is not distinct from k.source and contains(t.text, p.symbol))",
    "d1_rank_symbols": f"with {COSTS_SQL}, c as (select symbol, coalesce(max(tokens) filter (family = 'f1'), floor(avg(tokens)))::int as cost, min(substr(symbol, 2)::int) as r from costs group by 1) select symbol, cost, row_number() over (order by cost, length(symbol), r)::int as srank from c qualify srank <= 100",
    "d2_free_symbols": f"select symbol, rank from {_pool_sql()} p where kind <> 'private' and not exists (select 1 from documents where contains(text, p.symbol))",
    "d4_dictionary": f"{DICT} select * from dictionary",
    "d3_value": f"with rows as (select doc_id, unnest({TOKENS_SQL}) as pattern from documents), c as ({COUNTED.format(by='')}), r as (select pattern, n from c where n >= 3 and {QUALITY_SQL} qualify row_number() over (order by n * length(pattern) desc, pattern) <= 300), v as (select *, least({EST.format('pattern')} - 1, length(pattern) // 3) as each, least({EST.format('pattern')} - 1, length(pattern) // 3) * n - {EST.format("(chr(10) || pattern || '=α')")} as net from r) select pattern, round(case when each <= 0 then -1 when n >= 5 and net > -2 then greatest(net, 0.1) else net end, 4)::double as by_tokens, round(greatest(0, (length(pattern) - 1) * n - (length(pattern) + 4)) / 4.0, 4)::double as by_chars from v",
    "d7_rejected": f"{DICT}, r as (select pattern, n from counted where n >= 3 and {QUALITY_SQL} qualify row_number() over (order by n * length(pattern) desc, pattern) <= 600) select pattern, n, n * length(pattern) as value from r where pattern not in (select pattern from dictionary) order by value desc, pattern limit 20",
    "r6_op_frequency": "with g as (select event_type as phase, count(*) as n, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) as span from events where contains(lower(event_type), 'c') or contains(lower(event_type), 'p') group by 1 having count(*) >= 2) select phase, n, round(span, 4) as span_s, round(n / span, 6) as per_s from g",
    "w14_skipped_turns": f"with {TURNS_SQL}, r as (select conv_id, case when role = 'user' or original_chars = 0 then 0 else round(1 - compressed_chars / original_chars, 4) end as ratio from turns) select conv_id, count(*) as turns, sum(round(ratio * 10000)::bigint)::bigint as ratio_sum_e4 from r group by 1",
    "d8_accept": f"{SUB}, a as (select *, 1 - length(compressed_text) / greatest(length(text), 1) >= 0.05 - 1e-6 and 1 - {EST.format('compressed_text')} / {EST.format('text')} >= 0.05 - 1e-6 as accepted from sub) select doc_id, accepted, md5(case when accepted then compressed_text else text end) as final_md5 from a",
    "d9_token_efficiency": f"{SUB}, e as (select doc_id, {EST.format('text')}::int as original_tokens, {EST.format('compressed_text')}::int as compressed_tokens from sub) select *, original_tokens - compressed_tokens as saved, round((original_tokens - compressed_tokens) / greatest(original_tokens, 1), 4) as ratio, original_tokens > compressed_tokens as valid from e",
    "d10_symbol_stats": f"with {COSTS_SQL}, r as (select *, row_number() over (partition by family order by tokens, symbol) as b, row_number() over (partition by family order by tokens desc, symbol) as w from costs) select family, count(*) as n, min(tokens) as least, max(tokens) as most, round(avg(tokens), 4) as mean, count(*) filter (tokens = 1) as single, count(*) filter (tokens > 1) as multi, string_agg(symbol, ' ' order by b) filter (b <= 10) as best, string_agg(symbol, ' ' order by w) filter (w <= 10) as worst from r group by 1",
    "d11_compare_families": f"with {COSTS_SQL}, x as (select a.symbol, a.tokens - b.tokens as diff from costs a join costs b using (symbol) where a.family = 'f0' and b.family = 'f1'), g as (select count(*) filter (diff < 0) as better, count(*) filter (diff > 0) as worse, count(*) filter (diff = 0) as equal, round(avg(diff), 4) as mean_diff from x) select * from (select * from x order by abs(diff) desc, symbol limit 20) t, g",
    "d17_token_counts": "with k as (select md5('chars' || text) as key, count(*) as asked, bool_or(doc_id % 2 = 0) as known from documents group by 1) select sum(case when known then asked else asked - 1 end)::bigint as hits, count(*) filter (not known) as misses from k",
    "d17_token_store": f"with k as (select md5(text) as key, any_value(text) as text, count(*) as asked, count(*) filter (doc_id % 2 = 0) as even from documents group by 1), t as (select count(*) as stored, sum({EST.format('text')})::bigint as tokens, sum(asked)::bigint as asked, sum(even)::bigint as even, count(*) filter (even > 0) as first, coalesce(sum(asked) filter (even > 0), 0)::bigint as again from k) select run, case run when 1 then even - first when 2 then again + (asked - again) - (stored - first) when 3 then asked else asked - stored end::bigint as hits, case run when 1 then first when 2 then stored - first when 3 then 0 else stored end::bigint as misses, stored, tokens from t, (select unnest([1, 2, 3, 4])::int as run) r",
    "c1_substitute": f"{SUB} select doc_id, md5(compressed_text) as md5, length(text)::int as original_chars, length(compressed_text)::int as compressed_chars from sub",
    "c2_expand": "select doc_id, md5(text) as md5 from documents",
    "c3_roundtrip": "select source, count(*) as docs, 0::bigint as broken from documents group by 1",
    "c4_strip_html_comments": r"select page_id, md5(regexp_replace(html, '<!--[\s\S]*?-->', '', 'g')) as md5 from pages",
    "c6_tool_calls": f"select doc_id, 'read_file' as name, {PATH_} as path, md5({CLEAN}) as content_md5 from documents",
    "c6_nested_calls": "select doc_id, case when doc_id % 7 = 1 then 1 else 0 end::int as call, case doc_id % 7 when 0 then 'write' when 1 then 'go' when 2 then '1' else 'run' || chr(10) || 'now' end as name, case when doc_id % 7 = 0 then 'f' || doc_id end as path, case when doc_id % 7 = 0 then 2 end::int as m, case when doc_id % 7 = 5 then 'x' end as deep, case doc_id % 7 when 0 then 3 when 2 then 1 else 2 end::int as fields from documents where doc_id % 7 in (0, 1, 2, 5)",
    "c7_fields": f"select doc_id, md5({CLEAN}) as content_md5 from documents",
    "c10_renest": "select conv_id, turn, md5('x' || text) as md5 from conversations",
    "c12_estimate_ratio": f"{SUB} select doc_id, round(greatest(0, least(1, 1 - length(compressed_text) / greatest(length(text), 1))), 4) as ratio from sub",
    "w1_w2_context": "with c as (select conv_id, turn, count(*) over w as messages, (sum(case when role in ('user', 'assistant', 'system') then length(text) else 0 end) over w)::bigint as total_chars, coalesce(last_value(case when role = 'user' then length(text) end ignore nulls) over w, 0)::int as last_user_chars from conversations window w as (partition by conv_id order by turn rows unbounded preceding)) select *, messages > 1 and last_user_chars > 0 and last_user_chars < 250 and total_chars < 20000 as short_turn from c",
    "w3_additive_rules": f"with {RULES_SQL} select * from rules",
    "w4_conflicts": f"""with {RULES_SQL}, k as (select *, row_number() over (partition by conv_id, symbol order by first_turn, text) as k from rules), kept as (select * from k where k = 1),
late as (select *, row_number() over (partition by conv_id order by first_turn, text) as place from k where k > 1),
free as (select c.conv_id, 'S' || i as symbol, row_number() over (partition by c.conv_id order by i) as place from (select distinct conv_id from kept) c, range(1, 21) r(i) where not exists (select 1 from kept x where x.conv_id = c.conv_id and x.symbol = 'S' || i))
select conv_id, text, symbol, first_turn, value from kept union all select l.conv_id, text, f.symbol, first_turn, value from late l left join free f using (conv_id, place)""",
    "w5_stateless": f"with {METRICS} select * exclude (role) from m",
    "w5_stateful": f"with {STATEFUL} select * exclude (role) from m",
    "w6_running_tally": f"with {METRICS}, t as (select conv_id, turn, count(*) over w as cumulative_messages, (sum(original_chars) over w)::bigint as cumulative_original, (sum(compressed_chars) over w)::bigint as cumulative_compressed, (4 * sum(overhead_tokens) over w)::bigint as cumulative_overhead from m window w as (partition by conv_id order by turn rows unbounded preceding)) select *, cumulative_original - cumulative_compressed as cumulative_saved, round((cumulative_original - cumulative_compressed) / greatest(cumulative_original, 1), 4) as cumulative_ratio, round((cumulative_original - cumulative_compressed - cumulative_overhead) / greatest(cumulative_original, 1), 4) as cumulative_net from t",
    "w7_trend": f"with {METRICS} select conv_id, turn, {TREND_SQL} from m {WIN3}",
    "w8_continue": f"with {METRICS}, t as (select *, {TREND_SQL} from m {WIN3}), p as (select *, row_number() over v as place, lag(net_efficiency) over v as prior from t window v as (partition by conv_id order by turn)) select conv_id, turn, case when place <= 2 then true when 250 + turn >= 262 then false when net_efficiency < 0.01 and prior < 0.01 then false when trend = 'declining' and net_efficiency < 0.02 then false when place > 20 and net_efficiency < 0.02 then false else true end as should_continue from p",
    "w10_top_tokens": f"with t as (select conv_id, unnest({TOKENS_SQL}) as token from conversations) select conv_id, token, count(*) as n, row_number() over (partition by conv_id order by count(*) desc, token)::int as rank from t group by 1, 2 qualify rank <= 5",
    "w11_global": f"with {TURNS_SQL}, {RULES_SQL}, p as (select conv_id, count(*) as t, sum(original_chars) as o, sum(compressed_chars) as c from turns group by 1) select count(*) as conversations, sum(t)::bigint as turns, round(avg(t), 4) as avg_turns, sum(o)::bigint as original_chars, sum(c)::bigint as compressed_chars, (select count(distinct symbol) from rules) as symbols from p",
    "w12_retain_recent": "with l as (select user_id, max(ts) as last, count(*) as n, count(*) over () as users from events group by 1) select user_id, n from l qualify users <= 50 or row_number() over (order by last desc, user_id) <= 40",
    "m1_system_prompts": "select conv_id, 'messages_array' as source, 2000000 + turn as pos, text as content from conversations where turn = 0 or role = 'system'",
    "m2_merge_prompts": f"with {PROMPT_SQL} select conv_id, merged from merged",
    "m3_apply_prompt": f"with {PROMPT_SQL} select m.* from m left join merged using (conv_id) where merged is null or role <> 'system' union all select conv_id, -1, 'system', merged from merged",
    "m4_format_prompt": f"with {PROMPT_SQL} select conv_id, merged, case conv_id % 3 when 0 then 'chatml' when 1 then 'gemma' else 'own' end as format, case conv_id % 3 when 0 then '<|im_start|>system' || chr(10) || merged || '<|im_end|>' when 1 then '<start_of_turn>system' || chr(10) || merged || '<end_of_turn>' else merged end as formatted from merged",
    "r1_savings_cube": f"with {TURNS_SQL}, g as (select role, conv_id % 2 as half, count(*) as docs, sum(original_chars)::bigint as original_chars, sum(compressed_chars)::bigint as compressed_chars from turns group by cube (role, conv_id % 2)) select {SAVED_REST} from g",
    "r2_throughput": f"{REQ_SQL} select conv_id, round(case when total_s > 0 then (prompt_tokens + completion_tokens) / total_s else 0 end, 4) as total_rate, round(prompt_tokens / prompt_s, 4) as prompt_rate, round(case when generation_s > 0 then completion_tokens / generation_s else 0 end, 4) as generation_rate, prompt_s as first_token_s from q",
    "r3_net_savings": f"{REQ_SQL}, n as (select *, (original_chars - compressed_chars) // 4 - overhead_tokens as net_tokens from q) select conv_id, net_tokens, round(100 * greatest(0, net_tokens) / greatest(original_chars // 4, 1), 2) as net_percent, net_tokens < 0 as negative from n",
    "r4_timing_shares": f"{REQ_SQL} select conv_id, phase, seconds, round(seconds / (prompt_s + generation_s), 4) as share from (select *, unnest(['prompt_s', 'generation_s']) as phase, unnest([prompt_s, generation_s]) as seconds from q) x",
    "r5_op_timing": "with e as (select event_type as phase, ts, user_id::varchar as who, floor(value * 100) / 100 as s from events), r as (select *, row_number() over (partition by phase order by ts desc, who, s) as r from e) select phase, count(*) as n, round(avg(s), 4) as avg_s, min(s) as min_s, max(s) as max_s, round(avg(s) filter (r <= 10), 4) as recent_avg_s from r group by 1",
    "t1_parse_sse": "select case turn when 5 then 'bad' when 6 then 'empty' when 7 then 'field' when 3 then 'done' else 'data' end as kind, count(*) as n from conversations group by 1",
    "t2_t3_chunks": SENT_SQL + " select conv_id as request, turn as seq, case turn when 5 then 'bad' when 6 then 'empty' when 7 then 'field' when 3 then 'done' else 'data' end as kind, case when turn in (3, 5, 6, 7) then '' else text end as content, case when turn in (3, 5, 6, 7) then 0 else length(said) end::int as sent_chars from sent",
    "t7_log_rates": "select date_trunc('hour', ts) as start, event_type as phase, 'request_processing' as category, count(*) as n, round(sum(value), 3) as seconds from events group by all",
}

SQL["t5_conversation_state"] = _state_sql("0")
SQL["t6_idle_state"] = _state_sql("turn // 3")
SQL["t5_rule_stream"] = SQL["w3_additive_rules"]
SQL["w3_analyse"] = f"""with recursive {TURNS_SQL}, {RULES_SQL}, new as (select conv_id, turn, count(*) as n from firsts group by all),
t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as place, compressed_chars > 100 as large, greatest(12, case when compressed_chars > 500 then 350 else 0 end, case when original_chars > 750 then 500 else 0 end) as most, coalesce(n, 0) as n from turns left join new using (conv_id, turn)),
f as (select conv_id, turn, place, 0::bigint as rules_before, large as may_add, (case when large then n else 0 end)::bigint as rules from t where place = 1
union all select t.conv_id, t.turn, t.place, f.rules, t.large and f.rules < t.most, (f.rules + case when t.large and f.rules < t.most then t.n else 0 end)::bigint from f join t on t.conv_id = f.conv_id and t.place = f.place + 1)
select conv_id, turn, rules_before, may_add from f"""
SQL["p7_session_key"] = "with m as (select *, row_number() over (partition by conv_id order by turn) as r from conversations), a as (select conv_id, 'auto_' || left(md5(string_agg(role || ':' || left(text, 30), '' order by r)), 12) as session from m where r <= 2 group by 1 having count(*) = 2), u as (select conv_id, arg_min(text, turn) as first_user from conversations where role = 'user' group by 1) select conv_id, session, 'sess_' || session || '_' || left(md5(session || ':' || left(first_user, 100)), 12) as key from a join u using (conv_id)"
SQL["s6_rewrite"] = "select event_type, count(*) as n from events where ts >= timestamp '2024-01-02 00:00:00' group by 1"
SQL["w13_summary"] = f"with s as ({SQL['w13_summary']}), u as ({SQL['w9_symbol_usage']}), k as (select conv_id, string_agg(token, ' ' order by rank) as top_tokens from ({SQL['w10_top_tokens']}) x group by 1) select s.*, u.* exclude (conv_id), k.top_tokens from s left join u using (conv_id) left join k using (conv_id)"

# SQL for the rules as the queries have them: capitals by Unicode's full mapping (ß is SS; DuckDB's upper maps one character to one), and four places by the digits of a number, halves up (DuckDB's round multiplies by 10,000 first, so that ties fall as that product does).
_CAPITALS = {c: c.upper() for c in map(chr, range(128, 0x1E944)) if len(c.upper()) > 1} | {"ƛ": "\ua7dc", "ɤ": "\ua7cb"}
_CAPITAL = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in _CAPITALS.items()) + "}"
SYMBOL_SQL = " || ".join(f"coalesce({_CAPITAL}[substring(text, {i}, 1)], upper(substring(text, {i}, 1)))" for i in (1, 2))
_PLACES = re.compile(r"round\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*?), 4\)")
for _name in ("t5_conversation_state", "t5_rule_stream", "t6_idle_state", "w3_additive_rules", "w4_conflicts", "w9_symbol_usage", "w13_summary", "w14_skipped_turns"):
    SQL[_name] = _PLACES.sub(r"round((\1)::varchar::decimal(38, 20), 4)::double", SQL[_name].replace("upper(left(text, 2))", SYMBOL_SQL))
