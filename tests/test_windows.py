"""What windows of texts go on to be counted: all that a result needs, few others."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexipress.operators import mining as M
from lexipress.operators import ngrams
from lexipress.operators import transform as C


def _texts(n: int = 60) -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 12))) for _ in range(120)]
    code = ["import os_path", "    value = config.get('key', 1)", "    logger.info('a longer message number 7')", "def run_all(self, x):", "class Big(Base):", "return value"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]
    out += ["\n".join(rng.choice(code) + (f"({i})" if rng.random() < 0.2 else "") for _ in range(20)) for i in range(n // 4)]
    return [*out, *out[:5], "", None, "é🙂" * 30, "short"]


@pytest.mark.parametrize("k", [10, 100_000])
def test_a_dictionary_needs_few_ngrams(spark, k):
    """The k best patterns with their counts are those of the whole list, which is longer."""
    df = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string")
    best = lambda rows: [tuple(r) for r in M.rank_patterns(rows, k=k).select("pattern", "n", "rank").orderBy("rank").collect()]
    some, every = M.best_patterns(df, k).cache(), M.mine_patterns(df).cache()
    assert best(some) == best(every)
    assert some.count() < 0.5 * every.count() if k < 100 else some.count() == every.count()


def test_a_pattern_may_be_worth_it_by_other_counts(spark):
    """Worth 60 only with what it is worth elsewhere: its n-grams are counted too."""
    df = spark.createDataFrame([(1, "wwwwwwww pq " * 9), (2, "abcdefgh and more"), (3, "an abcdefgh"), (4, "xyzxyzxy, xyzxyzxy")], "doc_id long, text string")
    known = spark.createDataFrame([("abcdefgh",), ("not there",)], "pattern string")
    got = {r.pattern: (r.n, r.df) for r in M.mine_char_ngrams(df, (8, 16), worth=60, known=known).collect()}
    assert got["abcdefgh"] == (2, 2) and got["wwwwwwww"] == (9, 1) and "xyzxyzxy" not in got
    with pytest.raises(ValueError):
        M.mine_char_ngrams(df, (8,), ["doc_id"], worth=60)


def test_sketches_of_large_corpora_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "MOST_CELLS", 1 << 16)
    monkeypatch.setattr(ngrams, "LISTED", 50)  # sums of a task are added up
    test_a_dictionary_needs_few_ngrams(spark, 10)


def test_lines_in_tasks_are_those_of_the_jvm(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(" \t\r\n\x0b\x0c\x85  \xa0　ab") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 5, "aaa \x85", "bbb   ", "  ", None]
    df = spark.createDataFrame([(i, t, "xy"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for scope in ([], ["source"]):
        want = {tuple(r) for r in M.mine_lines(df, scope, min_n=1).select(*scope, "pattern", "n", "df").collect()}
        got = M.raw_counts(df, scope).where("strategy = 'line'").select(*scope, "pattern", "n", "df").collect()
        assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_dictionaries_do_not_count_every_ngram(spark, monkeypatch):
    """C11: no list of all n-grams is made for a dictionary; few windows are counted."""
    seen, plain = [], ngrams._patterns

    def noted(*rest):
        out = plain(*rest)
        seen.append(out.count())
        return out

    def every(*_):
        raise AssertionError("all n-grams are counted")

    monkeypatch.setattr(ngrams, "_patterns", noted)
    monkeypatch.setattr(ngrams, "_windows", every)
    df = spark.createDataFrame([(i, (t or "") + " and again") for i, t in enumerate(_texts(400))], "doc_id long, text string")
    rows = C.build_dictionary(df, k=20).collect()
    total = df.agg(F.sum(F.length("text"))).first()[0]
    assert len(rows) and len(seen) == 1 and seen[0] < total / 50


@pytest.mark.parametrize(("lengths", "min_n"), [((8, 16), 3), (range(6, 20), 2), ((8,), 300)])
def test_windows_that_come_too_rarely_are_not_passed_on(spark, monkeypatch, lengths, min_n):
    """A2, of many windows: names alone are listed first; counts are those of plain search, in batches of any size."""
    seen, plain = [], ngrams._windows

    def noted(*rest):
        seen.append(rest[7] is not None)
        return plain(*rest)

    monkeypatch.setattr(ngrams, "_windows", noted)
    for name, value in (("LISTED", 500), ("BATCH", 300), ("LIST_ROWS", 1000), ("TOGETHER", 100)):
        monkeypatch.setattr(ngrams, name, value)
    texts = [*_texts(), *(["ab" * 90] * 6)]
    want: dict = {}
    for i, t in enumerate(texts):
        for size in lengths:
            for at in range(len(t or "") - size + 1):
                want.setdefault(t[at : at + size], []).append(i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r.pattern, r.n, r.df) for r in M.mine_char_ngrams(df, lengths, min_n=min_n).collect()}
    assert got == {(p, len(v), len(set(v))) for p, v in want.items() if len(v) >= min_n and any(x.isalpha() for x in p) and p.strip()} and got
    assert all(seen) and seen


def test_a_task_passes_a_window_on_once(spark, monkeypatch):
    """Windows that come in many of a task's batches become one row; ``repartition`` gets the rows that tasks pass on."""
    monkeypatch.setattr(ngrams, "BATCH", 1000)
    passed, plain = [], type(spark.range(0)).repartition

    def noted(df, *rest):
        passed.append(df.count())
        return plain(df, *rest)

    df = spark.createDataFrame([("the same words again and again", i, 99, 0) for i in range(3000)], "units string, doc long, most int, seed long").coalesce(1)
    monkeypatch.setattr(type(df), "repartition", noted)
    rows = ngrams._windows(df, ngrams._characters, [8], None, None, 2, 4).collect()
    assert passed == [23] and len(rows) == 23 and all(r.df == 3000 for r in rows) and sum(r.n for r in rows) == 23 * 3000
