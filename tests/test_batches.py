"""Steps inside tasks against the expressions that define them."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexipress import catalogs
from lexipress.functions import pieces as B
from lexipress.functions import text as X
from lexipress.operators import conversations as W
from lexipress.operators import dictionary as D
from lexipress.operators import mining as M
from lexipress.operators import ngrams as N
from lexipress.operators import transform as C

TEXTS = ["", None, "a.b.c.d self.x foo.bar ab.cd 1st.x _ab.c", "naïve Ⅷ² x²y3.z４５ 漢字.かな.名前 𝒜𝒷𝒸.𐐀𐐁 éléments", "newࡰletters 𞓐ab.cd ᲊabc ᲊ.abc x\U000323afy", "α |A one two α.β€", "a" * 50 + ".b"]


def test_tokens_are_those_of_the_expression(spark):
    rows = [(i, "s" if i % 2 else None, t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    for scope in ([], ["source"]):
        want = M._counted(df, scope, M.tokens(F.col("text")))
        assert sorted(map(str, M.mine_tokens(df, scope).collect())) == sorted(map(str, want.select(*scope, "pattern", "n", "df").collect()))


def test_words_of_every_character(spark):
    """Python's words are the JVM's, character by character, with newer Unicode in Python."""
    newer = B.newer_letters(spark)
    words = B.Words(newer)
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    jvm = {r.id for r in spark.range(0x110000).where("id < 55296 or id > 57343").where(char.rlike(rf"^{X.WORD}$")).select("id").collect()}
    assert {x for x in range(0x110000) if not 0xD800 <= x < 0xE000 and words.of(chr(x))[0]} == jvm


def test_used_symbols_are_those_that_texts_hold(spark):
    df = spark.createDataFrame([(str(i % 2), t) for i, t in enumerate(TEXTS)], "source string, text string")
    pool = catalogs.symbol_pool(spark)
    symbols = [r.symbol for r in pool.collect()]
    free = {(r.source, r.symbol) for r in D.free_symbols(pool, df, scope=["source"]).collect()}
    assert free == {(s, x) for s in "01" for x in symbols if not any(x in (t or "") for i, t in enumerate(TEXTS) if str(i % 2) == s)}
    assert {r.symbol for r in D.free_symbols(pool, df).collect()} == {x for x in symbols if not any(x in (t or "") for t in TEXTS)}


def test_only_pieces_of_a_batch_are_read_at_once():
    texts = pa.array(["x" * 10, None, "y" * 30, "z" * 5, "z" * 5])
    got = list(B.pieces(texts, 15))
    assert [p.to_pylist() for p in got] == [["x" * 10, None], ["y" * 30], ["z" * 5, "z" * 5]]
    lists = pa.array([["x" * 10], None, [], ["y" * 10, None, "y" * 20], ["z" * 5]])
    got = list(B.pieces(lists.slice(1), 15))
    assert [p.to_pylist() for p in got] == [[None, [], ["y" * 10, None, "y" * 20]], [["z" * 5]]]


def test_fields_are_routed(spark):
    """One dictionary for all is routed in C7 too: no fold over all rules in the plan."""
    rules = [(1, "α", "long words here"), (2, "β", "words"), (3, "γ", "αx")]
    d = spark.createDataFrame(rules, "seq int, symbol string, pattern string")
    fields = [{"content": "long words here and words " * 30, "path": "words words words"}, {"text": "short words"}, {"code": None, "k": "words " * 90}, {"data": "nothing " * 60}, None]
    calls = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "doc_id int, fields map<string,string>")
    done = C.substitute_fields(calls, d)
    assert "aggregate(" not in done._jdf.queryExecution().optimizedPlan().toString().replace("Aggregate", "")
    work = lambda t: C.RuleIndex([(s, p) for _, s, p in rules]).substitute(t)[0]
    want = [f and {k: work(v) if v and k != "k" and len(v) >= 300 and len(work(v)) * 10 <= len(v) * 9 else v for k, v in f.items()} for f in fields]
    assert [r.compressed for r in done.orderBy("doc_id").collect()] == want
    assert [r.fields for r in C.expand_fields(done, d).orderBy("doc_id").collect()] == fields
    upper = C.substitute_fields(calls, d, 300, lambda t, r: F.replace(t, F.lit("words"), F.lit("w")))
    assert upper.where("doc_id = 0").first().compressed["content"] == fields[0]["content"].replace("words", "w")


def test_gate_folds_a_text_once(spark):
    df = spark.range(1).select(F.lit("x").alias("text"))
    plan = df.select(W.gate_reason(F.col("text")).alias("reason"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(array_sort(") == 1, plan


def test_word_runs_write_no_hashes(spark, monkeypatch):
    """What A4 writes of texts is their words; hashes are made in each pass, and documents without a place stay out."""
    from lexipress.operators import ngrams as N

    kept = {}
    monkeypatch.setattr(N, "settle", lambda df, name: kept.setdefault(name, df) if name == "texts" else df)
    rows = [(i, f"one two three w{i} x{i}") for i in range(40)]
    got = N.mine_word_ngrams(spark.createDataFrame(rows, "doc_id long, text string"), 2, 3)
    assert kept["texts"].columns == ["body", "most", "doc", "seed"]
    assert {(r.pattern, r.n, r.df) for r in got.collect()} == {("one two", 40, 40), ("two three", 40, 40), ("one two three", 40, 40)}


def test_windows_of_short_rows_are_named_together(spark, monkeypatch):
    """Naming takes steps by units, not by rows, and no window crosses from one row into the next."""

    class Task:
        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

        def __getattr__(self, _):
            return lambda *a, **kw: self

    steps = []
    mixed = N._mixed
    monkeypatch.setattr(N, "_mixed", lambda *a: steps.append(1) or mixed(*a))
    texts = [["abcabcabc", "", "bcabc", "cabcabcabcabc", "ab"][i % 5] for i in range(1000)]
    most = [6 if i % 3 else 4 for i in range(1000)]
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(1000), pa.int64()), pa.array(most, pa.int32()), pa.array([i % 2 - 1 for i in range(1000)], pa.int64())], names=["units", "doc", "most", "seed"])
    want = Counter()
    for i, (t, m) in enumerate(zip(texts, most, strict=True)):
        want.update((i % 2, t[p : p + n]) for n in (4, 6) if n <= m for p in range(len(t) - n + 1))
    for together in (1, 50, N.TOGETHER):
        monkeypatch.setattr(N, "TOGETHER", together)
        steps.clear()
        for bits, half in ((None, None), (np.full(4096, 255, np.uint8), 4)):
            task = Task()
            N._windows(task, N._characters, [4, 6], half, bits, 1, 1)
            (out,) = task.run(iter([rows]))
            assert len(set(zip(*(out.column(i).to_pylist() for i in (0, 1, 2)), strict=True))) == out.num_rows
            got = Counter({(r["doc"] % 2, texts[r["doc"]][r["pos"] : r["pos"] + r["size"]]): r["k"] for r in out.to_pylist()})
            assert got == want
    assert len(steps) < 100
