import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from lexipress.llm import decontaminate as D
from lexipress.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_groups(docs, width=5, similarity=0.8):
    sets = {i: set(simhash.shingles(t, width)) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= (similarity - 1e-9) * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_groups_against_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, n = {}, 0
    for _ in range(60):
        base = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.choice((1, 1, 2, 5))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                if w:
                    w[rng.randrange(len(w))] = word()
            docs[n] = " ".join(w).upper() if n % 3 else " ".join(w)
            n += 1
    docs |= {n: "", n + 1: None, n + 2: "one"}
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()] + [(0, docs[0], 2)], "doc_id long, text string, n int")
    got = {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}
    assert got == plain_groups(docs)
    assert simhash.similar_components(df.limit(0)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs.withColumn("extra", F.lit(1)), SF)
        assert out.columns == columns
        out = C.settle(out, name)
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after and after <= before
        if name == "simhash_near_dedup":
            groups = plain_groups({r.doc_id: r.text for r in docs.collect()})
            assert after == set(groups.values())
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            index = D.ItemIndex(items, 0.8, 5)
            assert after == {r.doc_id for r in docs.collect() if not index.matches(r.text)}
        docs, before = out, after
    last = C.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == before


def test_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "The quick brown fox jumps over the lazy dog and runs to the river every day of the week.\n" * 2
    rows = [(None, text, "en", None, 1), (1, text, "en", "a", 1), (2, text, None, "b", 1), (2, text, None, "b", 1), (3, None, "en", "c", None)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(str(r.doc_id) for r in C.near_duplicate_stage(spark, df, SF).collect()) == ["1", "3", "None"]
    for _, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_odd_rows(spark):
    """Nulls, repeated rows, a very long text and columns with names that stages use inside."""
    text = "The quick brown fox jumps over the lazy dog and runs to the river every day of the week.\n"
    rng = random.Random(4)
    long = "".join(f"the {rng.choice(['river', 'forest', 'market', 'winter'])} of {rng.randrange(10**6)} was old and the people of the town went there.\n" for _ in range(20_000))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, text * 3, "en", "a", 1), (1, text * 3, "en", "a", 1), (2, long, "en", "a", 1), (3, "", "en", None, 0), (None, None, None, None, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for name in ("__row", "h", "id", "item", "component_id", "rep", "fingerprint", "__key", "spans"):
        df = df.withColumn(name, F.lit("x"))
    kept = {}
    for name, stage in C.STAGES:
        out = stage(spark, df, SF)
        if name != C.STAGES[-1][0]:
            assert out.columns == list(C.COLUMNS)
        kept[name] = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    assert kept["simhash_near_dedup"] == ["1", "2", "3", "None"]
    every = ["1", "1", "2", "3", "4", "None"]
    assert kept["benchmark_decontamination"] == every and kept["byte_bpe"] == every
    assert set(kept["quality_classifier"]) | set(kept["language_id"]) <= {"1", "2"} and kept["quality_classifier"].count("1") in (0, 2)


def test_ids_with_several_texts(spark):
    """Different texts under one id are different documents: none is lost without a near copy, none stays beside one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(40):
        for side in (0, 1):
            base = [word() for _ in range(rng.randint(20, 60))]
            near = [*base]
            near[rng.randrange(2)] = word()
            rows += [(i, " ".join(base)), (1000 + 2 * i + side, " ".join(near))]
    rows += rows[:9] + [(5, None), (6, ""), (7, "one"), (8, "one")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, rng.choice(["en", None]), "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    every = sorted(set((i, t or "") for i, t in rows))
    groups = plain_groups({k: t for k, (_, t) in enumerate(every)})
    assert len(set(groups.values())) < len(every) > len({i for i, _ in every})
    out = [(r.doc_id, r.text or "") for r in C.near_duplicate_stage(spark, df, SF).collect()]
    assert len(out) == len(set(out)) and set(out) <= set(every)
    kept = [groups[every.index(x)] for x in out]
    assert sorted(kept) == sorted(set(groups.values()))  # one of each group, and no group without one
    ids = {g: min(every[k][0] for k in groups if groups[k] == g) for g in groups.values()}
    assert all(i == ids[groups[every.index((i, t))]] for i, t in out)
    named = {(r.doc_id, r.component_id) for r in simhash.similar_components(df).collect()}
    assert named == {(every[k][0], ids[g]) for k, g in groups.items()}
