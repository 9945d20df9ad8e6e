"""Literal fixtures and invariants of the library."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexipress import catalogs, sources
from lexipress import streaming as T
from lexipress.functions import text as X
from lexipress.operators import conversations as W
from lexipress.operators import dictionary as D
from lexipress.operators import mining as M
from lexipress.operators import ngrams as N
from lexipress.operators import prompts as P
from lexipress.operators import transform as C
from lexipress.operators.graph import connected_components
from lexipress.storage import fresh_path


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("model", "family"), [("GPT-4-turbo", "gpt-4"), ("gpt-3.5-turbo", "gpt-3.5"), ("text-davinci-003", "gpt-3"), ("Claude-3", "claude"), ("meta/llama-2-7b", "llama"), ("llama3-8b", "llama3"), ("Mixtral-8x7b", "mistral"), ("qwen2.5", "qwen2"), ("Qwen3-32B", "qwen3"), ("gemini-pro", "gemini"), ("own", "unknown")])
def test_families(spark, model, family):
    df = spark.createDataFrame([(model,)], "model string")
    assert X.model_family(df).first().family == family
    assert X.model_family(df, custom={"mine": ["own"]}).first().family == ("mine" if model == "own" else family)


@pytest.mark.parametrize(("message", "category"), [("[fix] x", "system_fixes"), ("[KV CACHE] hit", "kv_cache_optimization"), ("Set model context to x", "model_context"), ("calling api", "server_communication"), ("demo run", "test_utilities"), ("hello", "request_processing"), ("token calculation", "token_calculations")])
def test_log_categories(spark, message, category):
    assert one(spark, X.log_category(F.lit(message))) == category


@pytest.mark.parametrize(
    ("language", "text", "out"),
    [
        ("python", "x = 1  # note\ns = '# no' # yes\n# whole\n", "x = 1\ns = '# no'\n\n"),
        ("python", 'a = "it\\"s # in"\n"""doc\nstring"""\ny', 'a = "it\\"s # in"\n\ny'),
        ("javascript", "let a = 'http://x'; // c\n/* b\nb */z", "let a = 'http://x';\nz"),
        ("html", "<p>a<!-- c\nd --></p>", "<p>a</p>"),
        ("sql", "select 1 -- c", "select 1 -- c"),
        ("none", "# stays", "# stays"),
    ],
)
def test_strip_comments(spark, language, text, out):
    assert one(spark, C.strip_comments(F.lit(text), F.lit(language))) == out


def test_sql_comments(spark):
    assert one(spark, C.strip_comments(F.lit("select 1 -- c"), F.lit("sql"), sql_comments=True)) == "select 1"


def test_tool_calls_and_gates(spark):
    call = 'see {"tool": "read_file", "path": "a.txt", "content": "x\ny"} end'
    assert one(spark, X.has_tool_call(F.lit(call))) and not one(spark, X.has_tool_call(F.lit('{"name": "x"}')))
    assert one(spark, X.has_tool_call(F.lit("<tool_use id='1'>\n <name>run</name>\n<Parameters>")))
    assert one(spark, X.has_tool_call(F.lit("<function_calls>\n<invoke name='x'>"))) and not one(spark, X.has_tool_call(F.lit("<tool_call>\nrun\n</tool_call>")))
    df = spark.createDataFrame([(1, call)], "doc_id long, text string")
    row = C.extract_tool_calls(df).first()
    assert row.name == "read_file" and row["fields"]["content"] == "x\ny"
    assert one(spark, X.has_markdown(F.lit("# T\n\n- item"))) and not one(spark, X.has_markdown(F.lit("plain text")))
    assert not one(spark, X.has_markdown(F.lit("<think>* not a list *</think>")))


def test_dictionary_text_round_trip(spark):
    rows = [("a", 1, "α", "plain words"), ("a", 2, "β", "with\nline and \\n"), ("b", 1, "γ", "semi; and: colon"), ("b", 2, "δ", "tail\\")]
    df = spark.createDataFrame(rows, "scope string, seq int, symbol string, pattern string")
    back = D.decode_dictionary(D.encode_dictionary(df, ["scope"]), keys=["scope"]).collect()
    assert sorted(map(tuple, back)) == rows


def test_round_trip_and_symbols(spark):
    texts = [("the quick brown foxes jumped over configuration files " * 3 + str(i), i) for i in range(8)] + [("", 20), (None, 21), ("α and Ω stay", 22)]
    df = spark.createDataFrame([(i, t, "s") for t, i in texts], "doc_id long, text string, source string")
    for scope in ([], ["doc_id"]):
        made = C.build_dictionary(df, scope)
        rows = made.collect()
        own = {i: t or "" for t, i in texts}
        assert rows and not [r for r in rows if any(r.symbol in t for i, t in own.items() if not scope or i == r.doc_id)]
        assert bool({"α", "Ω"} & {r.symbol for r in rows}) == bool(scope)  # other scopes' texts hold them, not these
        assert len({(*[r[c] for c in scope], r.symbol) for r in rows}) == len(rows)
        out = C.substitute(df, made, scope)
        assert out.agg(F.sum("compressed_chars") < F.sum("original_chars")).first()[0]
        assert [r.broken for r in C.roundtrip_report(df, made, ["source"], scope).collect()] == [0]


def test_multipass_shrinks(spark):
    df = spark.createDataFrame([(i, "alpha beta gamma delta epsilon " * 5) for i in range(30)], "doc_id long, text string")
    for adaptive in (False, True):
        out, history = C.compress_multipass(df, 3, adaptive, ngrams=())
        history = history.orderBy("pass").collect()
        assert out.count() == 30 and all(h["after"] <= h["before"] for h in history) and history[0]["after"] < history[0]["before"]


def test_containment_and_similar(spark):
    df = spark.createDataFrame([("alpha beta", 10), ("alpha beta gamma", 8), ("beta gamma", 50), ("alpha betas", 3), ("zzzz", 1)], "pattern string, n long")
    got = {r.pattern: r.n for r in M.resolve_containment(df).collect()}
    assert got == {"alpha beta gamma": 18, "beta gamma": 50, "alpha betas": 3, "zzzz": 1}
    same = {r.pattern: r.n for r in M.merge_similar(df).collect()}
    assert sum(same.values()) == 72 and len(same) < 5


def test_containment_against_all_pairs(spark):
    rng = random.Random(5)
    rows = {"".join(rng.choice("ab") for _ in range(rng.randint(2, 18))): rng.randint(1, 9) for _ in range(120)}
    got = {r.pattern: r.n for r in M.resolve_containment(spark.createDataFrame(list(rows.items()), "pattern string, n long")).collect()}
    home = {}
    for p in rows:
        outer = [q for q in rows if len(p) >= 4 and p != q and p in q and rows[p] <= 2 * rows[q]]
        if outer:
            home[p] = min(outer, key=lambda q: (-len(q), q))
    want = {p: n + sum(rows[q] for q in home if home[q] == p) for p, n in rows.items() if p not in home}
    assert got == want and home


def test_similar_against_all_pairs(spark):
    rng = random.Random(6)
    rows = {"".join(rng.choice("abcdefghij"[: rng.randint(2, 10)]) for _ in range(rng.randint(1, 16))): rng.randint(1, 9) for _ in range(150)}
    got = {r.pattern: r.n for r in M.merge_similar(spark.createDataFrame(list(rows.items()), "pattern string, n long")).collect()}
    place = sorted(rows, key=lambda p: (-rows[p] * len(p), p))

    def near(p, q):
        a, b, most = set(p), set(q), max(len(p), len(q))
        return abs(len(p) - len(q)) <= 0.3 * most and len(a & b) / len(a | b) > (0.8 if most < 10 else 0.7)

    before = {p: [q for q in place[:i] if near(p, q)] for i, p in enumerate(place)}
    home = {p: next((q for q in qs if not before[q]), p) for p, qs in before.items()}
    want = {}
    for p, q in home.items():
        want[q] = want.get(q, 0) + rows[p]
    assert got == want and len(want) < len(rows)


def test_similar_patterns_against_all_pairs(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "run", "text", "of"]
    some = sorted({"_".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "s", "9"]) for _ in range(150)})
    grams = [Counter(p[i : i + k] for k in (2, 3, 4) for i in range(len(p) - k + 1)) for p in some]
    df = Counter(g for c in grams for g in c)
    vectors = []
    for c in grams:
        v = {g: n * (math.log((len(some) + 1) / (df[g] + 1)) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({g: x / size for g, x in v.items()})
    cosine = lambda a, b: sum(x * b[g] for g, x in a.items() if g in b)
    got = {(r.src, r.dst) for r in M.similar_patterns(spark.createDataFrame(list(enumerate(some)), "id long, pattern string")).collect()}
    want = {(i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if cosine(vectors[i], vectors[j]) >= 0.5}
    assert got == want and want
    assert M.cluster_patterns(spark.createDataFrame([], "pattern string, n long")).count() == 0


@pytest.mark.parametrize("bits", [1 << 27, 32_768])
def test_contexts_against_plain_search(spark, monkeypatch, bits):
    monkeypatch.setattr(N, "MOST_BITS", bits)
    rng = random.Random(2)
    texts = ["".join(rng.choice("aab.\\E 🙂é") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None]
    patterns = ["aa", "a.", "\\E", "ab", "zz", "🙂", "a🙂é", "aab.", "aaaaa", "b. aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, M.contexts(df, spark.createDataFrame([(p,) for p in [*patterns, "", "aa"]], "pattern string"), 3, 4).collect()))
    want = []
    for p in patterns:
        places = [(i, k) for i, t in enumerate(texts) for k in range(len(t or "")) if t.startswith(p, k)]
        want += [(p, i, k + 1, texts[i][max(0, k - 3) : k + len(p) + 3]) for i, k in places[:4]]
    assert got == sorted(want)
    none = M.contexts(df, spark.createDataFrame([], "pattern string"))
    assert none.count() == 0 and none.columns == ["pattern", "doc_id", "pos", "context"]


def test_contexts_of_thousands(spark):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    whole = "\n".join(texts)
    patterns = sorted({whole[i : i + rng.randint(3, 14)] for i in (rng.randrange(len(whole) - 20) for _ in range(5200))} | {"".join(rng.choice("abcdef") for _ in range(9)) for _ in range(800)})
    assert len(patterns) > 5000
    got = M.contexts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), 5, 3)
    want = set()
    for p in patterns:
        places = ((i, k) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(p, k)) if p in whole else ()
        want |= {(p, i, k + 1, texts[i][max(0, k - 5) : k + len(p) + 5]) for (i, k), _ in zip(places, range(3))}
    assert set(map(tuple, got.collect())) == want


def plain_ngrams(texts, lengths, min_n, max_ngram=None):
    n, docs = Counter(), {}
    for i, t in enumerate(texts):
        most = min(max_ngram, max(50, len(t or "") // 20)) - 1 if max_ngram else 10**9
        for length in (x for x in lengths if x <= most):
            for k in range(len(t or "") - length + 1):
                n[t[k : k + length]] += 1
                docs.setdefault(t[k : k + length], set()).add(i)
    return {p: (c, len(docs[p])) for p, c in n.items() if c >= min_n and any(x.isalpha() for x in p) and p.strip()}


@pytest.mark.parametrize(("lengths", "max_ngram"), [(range(1, 41), None), ((8, 16, 32), None), ((5,), None), (range(3, 70), 60), ((7, 8, 9, 15, 31), 100)])
def test_ngrams_of_any_length(spark, lengths, max_ngram):
    """Against brute force: every length of a range, overlaps, copies, characters beyond 16 bits, and long texts' own limit."""
    rng = random.Random(4)
    base = "".join(rng.choice("abc é🙂\n") for _ in range(90))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 50))) for _ in range(12)] + [base + "x", "y" + base, base[5:60], "aaaaaaaaaaaa", "", None, "ab" * 600]
    df = spark.createDataFrame([(i % 5, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.pattern: (r.n, r.df) for r in M.mine_char_ngrams(df, lengths, ["source"], max_ngram=max_ngram, min_len=2).collect()}
    assert got == plain_ngrams(texts, sorted(lengths), 2, max_ngram) and got


def test_ngrams_by_scope(spark):
    df = spark.createDataFrame([(1, "abcdefgh abcdefgh", "x"), (2, "abcdefgh", "y"), (3, "abcdefgh", "y"), (4, "abcdefgh", None), (5, "zzz", "z")], "doc_id long, text string, source string")
    got = {(r.source, r.pattern): (r.n, r.df) for r in M.mine_char_ngrams(df, (8,), ["source"]).collect()}
    assert got == {("x", "abcdefgh"): (2, 1), ("y", "abcdefgh"): (2, 2)}


@pytest.mark.parametrize(("lo", "hi", "min_n"), [(2, 5, 3), (1, 1, 2), (3, 9, 2), (2, 4, 1), (5, 7, 2)])
def test_word_runs_of_any_length(spark, lo, hi, min_n):
    """Against brute force: by scope, with copies, overlaps, marks between words, short rows and rows without a word."""
    rng = random.Random(6)
    words = ["a", "bb", "Été", "x_y", "数据", "🙂", "word"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    rows = [(i, text(rng.choice((0, 1, 4, 30))), "xy"[i % 2]) for i in range(40)] + [(90, None, "x"), (91, "...", "x"), (92, "bb " * 40, None), (93, "bb " * 40, "y"), (93, text(3_000), "y")]
    n, docs = Counter(), {}
    for i, (_, t, s) in enumerate(rows):
        w = re.findall(r"\w+", t or "")
        for k in range(lo, hi + 1):
            for j in range(len(w) - k + 1):
                key = (s, " ".join(w[j : j + k]))
                n[key] += 1
                docs.setdefault(key, set()).add(i)
    want = {k: (c, len(docs[k]), min(1.0, c / 10)) for k, c in n.items() if c >= min_n and len(k[1]) >= 5}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mine_word_ngrams(df, lo, hi, ["source"], min_n=min_n).collect()
    assert {(r.source, r.pattern): (r.n, r.df, r.confidence) for r in got} == want and len(got) == len(want)
    assert M.mine_word_ngrams(df.limit(0), lo, hi).count() == 0


def test_ranks_without_a_bound(spark):
    """Ranks over all patterns come from ranges and agree with a plain sort."""
    rows = [(f"pattern {i:04d}", 3 + i * 7919 % 13) for i in range(500)]
    got = [(r["rank"], r.pattern) for r in M.rank_patterns(spark.createDataFrame(rows, "pattern string, n long")).collect()]
    assert sorted(got) == [(k + 1, p) for k, (p, n) in enumerate(sorted(rows, key=lambda r: (-r[1] * len(r[0]), r[0])))]


def test_candidates_inside_longer_ones_go(spark):
    df = spark.createDataFrame([("alpha beta", 9, 0.9, 2.0), ("alpha beta gamma", 3, 0.3, 2.0), ("delta", 4, 0.4, 1.0)], "pattern string, n long, confidence double, entropy double")
    assert {r.pattern for r in M.rank_candidates(df).collect()} == {"alpha beta gamma", "delta"}


def test_guidance(spark):
    rows = [(1, 0, "user", "Explain this, please"), (1, 1, "assistant", "debug"), (2, 0, "user", "def f(x): # broken"), (3, 0, "user", "hello")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.guidance.split("\n") for r in P.guidance(df, k=9).collect()}
    line = [x for _, some in P.GUIDANCE for x in some]
    assert got == {1: line[:4] + line[8:11], 2: line[:8] + line[11:12], 3: line[:4]}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 199), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 150: 150, 199: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_conflicts(spark):
    rules = spark.createDataFrame([(1, "aaaaa", "S1", 0, 5), (1, "bbbbb", "S1", 1, 5), (1, "ccccc", "S2", 1, 5), (1, "ddddd", "S2", 2, 5)], "conv_id long, text string, symbol string, first_turn long, value long")
    pool = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "rank int, symbol string")
    assert {r.text: r.symbol for r in W.reassign_conflicts(rules, pool).collect()} == {"aaaaa": "S1", "bbbbb": "S3", "ccccc": "S2", "ddddd": None}


def test_stored_dictionaries(spark):
    path = fresh_path(spark, "dict")
    df = spark.createDataFrame([("x", 1, "α", "long pattern"), ("x", 2, "turned round", "β")], "scope string, seq int, symbol string, pattern string")
    sources.write_dictionary(df, path, ["scope"])
    assert {(r.symbol, r.pattern) for r in sources.read_dictionary(spark, path).collect()} == {("α", "long pattern"), ("β", "turned round")}


def test_streams_equal_tables(spark):
    turns = spark.createDataFrame([(c, t, 100 + t, 60 + (t * c) % 30) for c in range(5) for t in range(6)], "conv_id long, turn long, original_chars long, compressed_chars long")
    folder = fresh_path(spark, "turns")
    turns.coalesce(1).write.parquet(folder)
    stream = T.conversation_stream(spark.readStream.schema(turns.schema).parquet(folder))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else time-outs of state keep the query going
    query = stream.writeStream.format("memory").queryName("tally").outputMode("append").option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    query.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {(r.conv_id, r.turn): (r.cumulative_ratio, r.trend) for r in spark.table("tally").collect()}
    m = turns.withColumn("overhead_tokens", F.lit(0)).withColumn("net_efficiency", F.round(1 - F.col("compressed_chars") / F.col("original_chars"), 4))
    want = {(r.conv_id, r.turn): (r.cumulative_ratio, r.trend) for r in W.efficiency_trend(W.running_tally(m)).collect()}
    assert got == want


def _run(spark, folder, cp, name, op):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = f"{cp}-out"
    query = op(spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
    query.awaitTermination(90)
    query.stop()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.schema(T.CONVERSATION if name == "tally" else T.RULE).parquet(out).collect()


@pytest.mark.parametrize(("idle", "turns"), [(1, 1), (3_600_000, 4)])
def test_idle_conversations_start_afresh(spark, idle, turns):
    """State of a conversation that said nothing for long is gone when others speak."""
    folder, cp = fresh_path(spark, "idle"), fresh_path(spark, "cp")
    last = []
    for rows in ([(1, t) for t in range(3)], [(2, 0)], [(1, 3)]):
        spark.createDataFrame([(c, t, 10, 5) for c, t in rows], "conv_id long, turn long, original_chars long, compressed_chars long").coalesce(1).write.mode("append").parquet(folder)
        last = _run(spark, folder, cp, "tally", lambda s: T.conversation_stream(s, idle))
    assert [(r.conv_id, r.turn, r.turns) for r in last if r.turn == 3] == [(1, 3, turns)]


def test_rules_in_state(spark):
    """Rules over several batches equal those of the table."""
    rng = random.Random(3)
    rows = sorted({(c, t, rng.choice(["alpha", "betas", "gamma", "delta", "omegas", "no"]), rng.choice("XYZ"), rng.randint(1, 3)) for c in range(4) for t in range(6) for _ in range(3)}, key=lambda r: r[1])
    schema = "conv_id long, turn long, text string, symbol string, value long"
    folder, cp, got = fresh_path(spark, "rules"), fresh_path(spark, "cp"), None
    for part in (range(0, 1), range(1, 4), range(4, 6)):
        spark.createDataFrame([r for r in rows if r[1] in part], schema).coalesce(1).write.mode("append").parquet(folder)
        got = _run(spark, folder, cp, "rules", lambda s: T.rule_stream(s, 4))
    assert sorted(map(tuple, got)) == sorted(map(tuple, W.additive_rules(spark.createDataFrame(rows, schema), 4).collect()))


def test_when_to_analyse(spark):
    rows = [(1, 0, 600, 600, 262), (1, 1, 600, 600, 9), (1, 2, 10_001, 10_001, 88), (1, 3, 10_001, 15_001, 150), (1, 4, 501, 15_001, 1), (1, 5, 10_001, 10_001, 1), (1, 6, 500, 20_000, 1), (2, 0, 500, 500, 5), (2, 1, 501, 501, None)]
    got = {(r.conv_id, r.turn): (r.rules_before, r.may_add) for r in W.needs_analysis(spark.createDataFrame(rows, "conv_id long, turn long, compressed_chars long, new_chars long, new_rules long")).collect()}
    assert got == {(1, 0): (0, True), (1, 1): (262, False), (1, 2): (262, True), (1, 3): (350, True), (1, 4): (500, False), (1, 5): (500, False), (1, 6): (500, False), (2, 0): (0, False), (2, 1): (0, True)}


def test_summary_with_time(spark):
    df = spark.createDataFrame([(1, t, 100, 50, 0.5, 12, 2, "stable", True, False, float(t)) for t in range(3)], "conv_id long, turn long, original_chars long, compressed_chars long, compression_ratio double, tokens_saved long, overhead_tokens long, trend string, should_continue boolean, short_turn boolean, seconds double")
    row = W.conversation_summary(df, tokens=spark.createDataFrame([(1, "a", 3, 1), (1, "b", 2, 2)], "conv_id long, token string, n long, rank int")).first()
    assert row.avg_seconds == 1.0 and row.net_tokens == 30 and row.top_tokens == ["a", "b"]


def test_sse_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text('data: {"id":"1","choices":[{"delta":{"content":"α b"}}]}\n\ndata: [DONE]\nevent: x\ndata: {bad\n')
    rules = spark.createDataFrame([(1, "α", "alpha")], "seq int, symbol string, pattern string")
    out = T.expand_stream(T.repair_chunks(T.parse_sse(sources.read_sse(spark, str(tmp_path)))), rules)
    query = out.writeStream.format("memory").queryName("sse").option("checkpointLocation", fresh_path(spark, "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    query.stop()
    rows = spark.table("sse").collect()
    assert sorted(r.kind for r in rows) == ["bad", "data", "done", "empty", "field"] and {r.content for r in rows} == {"alpha b", ""}
    assert next(r for r in rows if r.kind == "data").chunk.model == "unknown"


def test_symbols():
    some = catalogs.symbols()
    assert len(some) == 312 and len({s for s, _ in some}) == 312 and some[0] == ("α", "unicode") and some[-1] == ("?H?", "ascii")


def test_windows_are_counted_in_tasks_and_pruned_by_near_lengths(spark, monkeypatch):
    from lexipress.operators import ngrams

    seen, plain = [], ngrams._windows

    def noted(texts, read, sizes, half, *rest):
        out = plain(texts, read, sizes, half, *rest)
        seen.append((sizes, half, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(ngrams, "_windows", noted)
    texts = ["abcabcabcabd", "abcabcabcabd", "xbcabcabcy", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {(r.pattern, r.n, r.df) for r in ngrams.mine_char_ngrams(docs, range(6, 13)).collect()}
    want = {}
    for i, t in enumerate(texts):
        for size in range(6, 13):
            for at in range(len(t or "") - size + 1):
                want.setdefault(t[at : at + size], []).append(i)
    assert got == {(p, len(v), len(set(v))) for p, v in want.items() if len(v) >= 2}
    for sizes, half, plan in seen:
        assert half is None or sizes[-1] <= half + max(1, half // 4) or len(sizes) == 1
        lines = plan.splitlines()
        assert not any("HashAggregate" in x for x in lines[next(i for i, x in enumerate(lines) if "Exchange" in x) :])  # none before the shuffle, where it would spill


def test_patterns_with_a_beginning_in_common_do_not_meet_in_pairs(spark):
    texts = [f"common {i * i:07d} end" for i in range(3000)] + ["common 0000004", "comm", "x" * 40, "y" + "x" * 41]
    rows = spark.createDataFrame([(t, 1) for t in texts], "pattern string, n long")
    assert M._met(rows).count() < 5 * len(texts)
    got = {(r.inner, r.outer) for r in M._inside(rows).select("inner", "outer").distinct().collect()}
    assert got == {(a, b) for a in texts[-4:] for b in texts if a in b and a != b}
