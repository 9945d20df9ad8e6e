"""Operators with state on disk, in streams or between passes, and rules with fixtures of their own, against plain Python."""

import json
import os
import random
import re
from collections import Counter
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexipress import catalogs, sources
from lexipress.functions import text as X
from lexipress.operators import conversations as W
from lexipress.operators import dictionary as D
from lexipress.operators import mining as M
from lexipress.operators import transform as C
from lexipress.storage import fresh_path


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- substitution by routed rules


def folded(rules, text):
    used = []
    for symbol, pattern in rules:
        if len(pattern) >= 3 and len(pattern) > len(symbol) and pattern in text:
            text = text.replace(pattern, symbol)
            used.append(symbol)
    return text, used


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["α", "β", "~A~", "|B", "a", ""]), st.text("abcα~A|B ", max_size=7)), max_size=12), st.text("abcα~A|B ", max_size=60))
def test_routing_is_the_fold(rules, text):
    assert C.RuleIndex(rules).substitute(text) == folded(rules, text)
    back = text
    for symbol, pattern in reversed(rules):
        back = back.replace(symbol, pattern) if symbol else back
    assert C.RuleIndex(rules).expand(text) == back


def test_routed_and_folded_columns_agree(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é🙂\n") for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["", None]
    made = spark.createDataFrame([(i + 1, s, p) for i, (s, p) in enumerate([("α", "abca"), ("β", "bc é"), ("γ", "🙂ab"), ("δ", "aaa")])], "seq int, symbol string, pattern string")
    df = frame(spark, texts).withColumn("scope", F.lit("x"))
    routed = C.expand(C.substitute(df, made), made).select("doc_id", "compressed_text", "used", "expanded_text")
    by_scope = made.withColumn("scope", F.lit("x"))
    other = C.expand(C.substitute(df, by_scope, ["scope"]), by_scope, ["scope"]).select("doc_id", "compressed_text", "used", "expanded_text")
    assert sorted(routed.collect()) == sorted(other.collect())
    with pytest.raises(ValueError):
        C.rule_list(spark.range(C.MOST_RULES + 1).select(F.col("id").alias("seq"), F.lit("s").alias("symbol"), F.lit("p").alias("pattern")))


# --- dictionaries


def test_any_dictionary_comes_back(spark):
    rng = random.Random(7)
    odd = [";", ":", "‖", "⟦", "\\", "\n", "#DICT_END", "#DICT ", "a", "bc", "n"]
    rows = []
    for scope in range(150):
        pieces = odd if scope % 3 else ["‖", "⟦", "\\", "\n", "a", "n"]  # every third without what makes the other form
        for seq in range(rng.randint(1, 6)):
            rows.append((scope, seq + 1, rng.choice(["α", "|A", "⟦x", "~:~", "\\"]) + str(seq), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))))
    df = spark.createDataFrame(rows, "scope long, seq int, symbol string, pattern string")
    text = D.encode_dictionary(df, ["scope"]).withColumn("dict_text", F.concat(F.lit("before #DICT_END "), "dict_text", F.lit(" after;#DICT_END")))
    assert sorted(map(tuple, D.decode_dictionary(text, keys=["scope"]).collect())) == sorted(rows)


@pytest.mark.parametrize("pairs", [[("α", "import numpy as np"), ("β", "def __init__(self,")], [("α", "function(param1; param2)"), ("β", "obj: {key: value}"), ("γ", "normal_text")], [("α", "a;b‖c⟦d"), ("β", "plain text")], [("α", "list⟦int⟧"), ("β", "plain")]])
def test_dictionary_text_fixtures(spark, pairs):
    df = spark.createDataFrame([(i + 1, s, p) for i, (s, p) in enumerate(pairs)], "seq int, symbol string, pattern string")
    text = D.encode_dictionary(df)
    first = text.first().dict_text
    assert first.startswith("#DICT α") and first.endswith((";#DICT_END", "‖#DICT_END")) and first[-10] == ("‖" if any(c in p for _, p in pairs for c in ";:") else ";")
    assert [(r.symbol, r.pattern) for r in D.decode_dictionary(text).orderBy("seq").collect()] == pairs


def test_symbols_of_other_scopes_stay_free(spark):
    rows = [(1, "α here", "x"), (2, "|A and β", "y"), (3, None, "z"), (4, "γ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pool = spark.createDataFrame([("α", 1, "unicode", 1), ("β", 2, "unicode", 1), ("|A", 3, "ascii", 2), ("γ", 4, "unicode", 1)], "symbol string, rank int, kind string, cost int")
    found = {}
    for r in D.free_symbols(pool, df, scope=["source"]).collect():
        found.setdefault(r.source, set()).add(r.symbol)
    assert found["x"] == {"β", "|A", "γ"} and found["y"] == {"α", "γ"} and found["z"] == {"α", "β", "|A", "γ"}
    assert {r.symbol for r in D.free_symbols(pool, df).collect()} == set()
    assert [r.symbol for r in D.free_symbols(pool, df, scope=["source"], k=1).where("source = 'x'").collect()] == ["β"]
    used = spark.createDataFrame([("x", "β")], "source string, symbol string")
    assert {r.symbol for r in D.free_symbols(pool, df, used=used, scope=["source"]).where("source = 'x'").collect()} == {"|A", "γ"}


def test_token_store(spark):
    path, at = fresh_path(spark, "store"), lambda x: F.lit(x).cast("timestamp")
    texts = ["one two three", "one two three", "four", None, "", "x" * 400]
    run = lambda some, now: tuple(D.update_token_store(frame(spark, some), path, at(now)).first())
    assert run(texts[:3], "2026-03-01 10:00:00") == (1, 2)
    assert run(texts, "2026-03-01 11:00:00") == (4, 2)  # null and empty are one text
    assert run(texts, "2026-03-01 12:00:00") == (6, 0)  # a second run counts none
    stored = {r.key: r.tokens for r in D.read_token_store(spark, path, at("2026-03-01 12:00:00")).collect()}
    assert len(stored) == 4 and sorted(stored.values()) == [1, 1, 3, 100]
    assert run(texts[:3], "2026-03-02 10:30:00") == (1, 2)  # the first ones are over a day old by now
    assert D.read_token_store(spark, path, at("2026-03-02 10:30:00")).count() == 4
    assert run([], "2026-03-09 00:00:00") == (0, 0) and D.read_token_store(spark, path, at("2026-03-09 00:00:00")).count() == 0


def test_expiry_touches_only_what_is_old(spark):
    path = fresh_path(spark, "expiring")
    rows = [("a", "2026-01-01"), ("a", "2026-01-05"), ("b", "2026-01-05"), ("b", "2026-01-06"), ("c d", "2026-01-01"), (None, "2026-01-01"), (None, "2026-01-05"), ("e", None)]
    spark.createDataFrame(rows, "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts")).repartition(1).write.partitionBy("k").parquet(path)
    folder = path.removeprefix("file://")
    files = lambda: {d: sorted(f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")) for d in os.listdir(folder) if d.startswith("k=")}
    before = files()
    left = sources.expire_stored(spark, path, "ts", F.lit("2026-01-05 12:00:00").cast("timestamp"), 24, ["k"])
    assert sorted((str(r.k), str(r.ts.date())) for r in left.collect()) == [("None", "2026-01-05"), ("a", "2026-01-05"), ("b", "2026-01-05"), ("b", "2026-01-06")]
    after = files()
    assert after["k=b"] == before["k=b"] and after["k=a"] != before["k=a"] and not {"k=c d", "k=e"} & after.keys()


# --- requests and tool calls


def test_open_fields(spark, tmp_path):
    lines = [{"id": "1", "model": "m", "messages": [{"role": "user", "content": "x"}], "temperature": 0.5, "stop": ["a"], "deep": {"k": {"n": 3}}, "extras": {"e": "1"}}, {"id": "2", "messages": []}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    rows = {r.id: r for r in sources.read_requests(spark, str(tmp_path)).select("id", "extras", "role", F.to_json("open").alias("open"), F.try_variant_get(F.col("open")["deep"], "$.k.n", "int").alias("n")).collect()}
    assert json.loads(rows["1"].open) == {k: lines[0][k] for k in ("temperature", "stop", "deep")} and rows["1"].n == 3 and rows["1"].extras == {"e": "1"}
    assert rows["2"].open == "{}" and None in rows and rows[None].role is None


def objects(text):
    """Outermost balanced objects, character by character."""
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 2
            continue
        if c == '"' and depth:
            quoted = not quoted
        elif c == "{" and not quoted:
            start, depth = (i if not depth else start), depth + 1
        elif c == "}" and not quoted and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
        i += 1
    return out


def test_brace_scanner(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(['{', "}", '"', "\\", "a", "\n", '{"k": ', "é🙂"]) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", '{"a": "}"} {"b": {"c": "\\"{"}} }{', "\\"]
    got = {r.doc_id: r.o for r in frame(spark, texts).select("doc_id", X.balanced_objects(F.col("text")).alias("o")).collect()}
    assert got == {i: objects(t) for i, t in enumerate(texts)}


def test_nested_tool_call(spark):
    call = 'now\n{\n  "tool": "write_file",\n  "arguments": {"path": "a.txt", "opts": {"mode": [1, 2]}},\n  "content": "line } one\nline { two"\n}\nthen {"name": "x"} and {"tool": 1}'
    row = C.extract_tool_calls(frame(spark, [call])).select("name", "fields", F.variant_get("value", "$.arguments.path", "string").alias("path"), F.variant_get("value", "$.arguments.opts.mode[1]", "int").alias("mode")).collect()
    assert [r.name for r in row] == ["write_file", "1"] and row[0].path == "a.txt" and row[0]["mode"] == 2
    assert row[0].fields["content"] == "line } one\nline { two" and json.loads(row[0].fields["arguments"])["opts"] == {"mode": [1, 2]}
    hits = {r.doc_id: r.h for r in frame(spark, [call, '{"tool": 1}', 'the "tool" {broken', '{"a": {"tool": "x", "path": "y"}}', None]).select("doc_id", X.has_tool_call(F.col("text")).alias("h")).collect()}
    assert hits == {0: True, 1: False, 2: False, 3: True, 4: False}


# --- clients, code, gates

CLIENTS = [
    ({"user-agent": "generic-client/1.0"}, {}, "user", "standard"),
    ({"user-agent": "SillyTavern/1.2.3"}, {}, "user", "sillytavern"),
    ({"user-agent": "cline/1.0.0"}, {}, "user", "cline"),
    ({"user-agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36", "x-llama-webui": "true"}, {"timings_per_token": "true"}, "user", "webui"),
    ({"user-agent": "Mozilla/5.0", "x-llama-webui": "true"}, {}, "user", "standard"),
    ({"user-agent": "Mozilla/5.0"}, {"samplers": "x"}, None, "standard"),
    ({"user-agent": "x", "referer": "http://192.168.1.4/"}, {}, "system", "webui"),
    ({"x-api-key": "k", "user-agent": "so/js 4.83.0"}, {}, "user", "anthropic"),
    ({"user-agent": "so/js 4.83.0"}, {"model": "anthropic/claude-3"}, "user", "cline"),
    ({}, {"model": "Claude-3"}, None, "anthropic"),
    ({"x-task-id": "1"}, {}, None, "cline"),
    (None, None, None, "standard"),
]


def test_clients(spark):
    df = spark.createDataFrame([(i, h, p, f) for i, (h, p, f, _) in enumerate(CLIENTS)], "i int, h map<string,string>, p map<string,string>, f string")
    got = {r.i: r.e for r in df.select("i", X.client_engine(F.col("h"), F.col("p"), F.col("f")).alias("e")).collect()}
    assert got == {i: c[3] for i, c in enumerate(CLIENTS)}
    assert df.select(X.client_engine(F.col("h"), F.col("p"), configured="cline").alias("e")).distinct().collect()[0].e == "cline"


def test_nested_receivers_and_plain_parts(spark):
    text = "self.logger.info(x)\nself.config.get(a)\nself.logger.info(x)\nself.config.get(a)\nasync def run(self, a):\nasync def run(self, a):\n"
    got = {(r.kind, r.pattern): r.n for r in M.mine_code(frame(spark, [text])).collect()}
    for receiver in ("self.logger", "logger.info", "self.config", "config.get"):
        assert got["attribute", receiver] == 2, receiver
    assert got["method_call", "logger.info(x)"] == 2 and got["logging", "logger.info(x)"] == 2
    assert got["function", "def run(self, a):"] == 4 and got["function", "async def run(self, a):"] == 2
    for _, pattern, lo, hi in catalogs.CODE_PATTERNS:  # what must be in every match is in every match
        plain = re.compile(pattern.replace(r"[\p{L}\p{N}_]", r"\w").replace(r"\p{L}\p{N}_", r"\w"))
        assert all(M.literal_of(pattern) in m.group() for m in plain.finditer(text))


def plain_gate(text, min_n=2):
    words = Counter((text or "").split())
    signs = sum(len(re.findall(p, text)) for p in (r"\bdef\s+\w+", r"\bclass\s+\w+", r"\bimport\s+\w+", r"\w+\([^)]*\)", r"\{[^}]*\}", r"<[^>]+>"))
    if '"tool"' in text and '"path"' in text:
        return "tool_call"
    if text.startswith("# "):
        return "markdown"
    if len(text) < 100:
        return "too_short"
    if sum(words.values()) > 50 and sum(n >= min_n for n in words.values()) / len(words) > 0.15:
        return "repetitive"
    return "structured" if signs > 20 else "default"


def test_end_to_end_against_plain_python(spark):
    """C11: the gate's six reasons, and what becomes of each text, from the dictionary of the texts that are open."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))
    base = "the configuration of the distributed processing pipeline was written again "
    texts = ['{"tool": "x", "path": "y", "content": "' + base * 3 + '"}', "# Title\n\n" + base * 3, base[:60], base * 12, " ".join(f"fun{i}(a{i})" for i in range(25)), say(45), say(40) + " configuration of the distributed processing", ""] * 3
    df = frame(spark, texts)
    out = {r.doc_id: r for r in C.compress(df).collect()}
    reasons = {i: plain_gate(t) for i, t in enumerate(texts)}
    assert {i: r.gate for i, r in out.items()} == reasons and set(reasons.values()) == {"tool_call", "markdown", "too_short", "repetitive", "structured", "default"}
    held = df.where(F.col("doc_id").isin([i for i, g in reasons.items() if g in C.OPEN]))
    rules = C.rule_list(C.build_dictionary(held))
    assert rules
    for i, t in enumerate(texts):
        small = folded(rules, t)[0] if reasons[i] in C.OPEN else t
        tokens = lambda x: max(1, len(x) // 4)
        ok = 1 - len(small) / max(len(t), 1) >= 0.01 - 1e-6 and 1 - tokens(small) / tokens(t) >= 0.01 - 1e-6
        assert (out[i].compressed_text, out[i].accepted, out[i].final_text) == (small, ok, small if ok else t)
    assert any(r.accepted for r in out.values()) and not all(r.accepted for r in out.values())


# --- mining


def test_one_pass_is_all_strategies(spark):
    """A20's single pass against its strategies one by one, each of which has SQL of its own."""
    rng = random.Random(2)
    line = lambda: rng.choice(["import os_path", "def run_all(self, x):", "    value = config.get('key', 1)", "    logger.info('a longer message number %d')" % rng.randrange(3), "x = table[index_of_row]", "plain words here", "class Big(Base):"])
    df = spark.createDataFrame([(i, "\n".join(line() for _ in range(rng.randint(1, 30))), "ab"[i % 2]) for i in range(40)] + [(99, None, "a")], "doc_id long, text string, source string")
    for scope in ([], ["source"]):
        code = df.where(X.looks_like_code(F.col("text")))
        templates = M.expand_templates(code, M.mine_templates(code, scope), scope=scope).withColumn("df", F.lit(None).cast("long"))
        parts = [M.mine_tokens(df, scope), M.mine_lines(df, scope), M.mine_code(code, scope), templates, M.mine_char_ngrams(df, (8, 16), scope)]
        want = M.sum_patterns(reduce(DataFrame.unionByName, [p.select(*scope, "pattern", "n", "df") for p in parts]), scope)
        got = M.mine_patterns(df, scope, ngrams=(8, 16))
        assert sorted(map(tuple, got.select(*scope, "pattern", "n", "df").collect())) == sorted(map(tuple, want.select(*scope, "pattern", "n", "df").collect()))


def test_passes_by_changes_are_full_recounts(spark):
    rng = random.Random(6)
    words = ["configuration", "pipeline", "distributed", "processing", "alpha", "beta", "gamma", "of", "the"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(25)] + ["short text", "", None]
    df = frame(spark, texts)
    a, history = C.compress_multipass(df, 4, adaptive=True, ngrams=(8,))
    b, again = C.compress_multipass(df, 4, adaptive=True, ngrams=(8,), recount=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    rows = sorted(map(tuple, history.collect()))
    assert rows == sorted(map(tuple, again.collect())) and len(rows) > 1 and history.columns == ["pass", "min_n", "min_len", "entries", "changed", "before", "after"]
    kept = {r.doc_id: r.text for r in a.collect()}
    assert kept[25] == "short text" and kept[26] == kept[27] == ""
    _, none = C.compress_multipass(frame(spark, ["too short"] * 5), 3)
    assert none.count() == 0  # nothing is long enough


def test_entropy_of_a_scope(spark):
    df = spark.createDataFrame([(1, "", "x"), (2, "aaaaabbbbb", "x"), (3, "abcdefgh", "x"), (4, "zzzz", "y"), (5, None, "w")], "doc_id long, text string, source string")
    assert {r.source: round(r.entropy, 6) for r in M.scope_entropy(df, ["source"]).collect()} == {"x": 1.0, "y": 0.0}
    patterns = spark.createDataFrame([("x", "aab", 3), ("x", "aaaa", 3), ("y", "aaaa", 3), ("w", "aaaa", 3)], "source string, pattern string, n int")
    assert {(r.source, r.pattern) for r in M.filter_entropy(patterns, M.scope_entropy(df, ["source"]), 0.5, ["source"]).collect()} == {("x", "aab"), ("y", "aaaa"), ("w", "aaaa")}


def test_repetition_counts(spark):
    texts = ["a b a\tc  a b", "", " x ", "a"]
    got = {r.doc_id: tuple(r.w) for r in frame(spark, texts).select("doc_id", W.repetition(F.col("text"), 2).alias("w")).select("doc_id", F.struct("w.total", "w.different", "w.repeated").alias("w")).collect()}
    assert got == {0: (6, 3, 2), 1: (0, 0, 0), 2: (1, 1, 0), 3: (1, 1, 0)}


def test_passes_count_ngrams_by_names(spark, monkeypatch):
    def text(*_):
        raise AssertionError("n-grams leave tasks as text")

    monkeypatch.setattr(M, "gram_changes", text)
    df = frame(spark, [f"{i} the same long run of words in every text, and then {'some ' * (i % 5)}more of it " * 3 for i in range(30)])
    out, history = C.compress_multipass(df, 1, ngrams=(8, 16), min_chars=20)
    row = history.first()
    assert row.entries and row.after < row.before and out.count() == 30
