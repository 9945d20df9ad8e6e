import random

import pytest

from lexipress.llm import decontaminate as D


def plain(docs, items, t=0.8):
    out = []
    for d, text in docs:
        w = D.words_of(text)
        for i, item in set(items):
            s = D.shingles_of(D.words_of(item))
            if s:
                n = len(next(iter(s)))
                hit = len(s & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
                if hit / len(s) >= t - 1e-12:
                    out.append((d, i, hit, len(s)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x_y"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice((5, 6, 9, 14, 20, 36, 59)))) for i in range(60)]
    items += [(100, "only three words"), (101, ""), (102, None), (103, "one"), items[0], (104, "--- !!!")]
    docs = []
    for i in range(150):
        w = text(rng.randint(0, 300)).split()
        if i % 3 == 0:
            leak = (items[rng.randrange(60)][1]).upper().replace(" ", ", ").split()
            for _ in range(rng.randint(0, 3)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "Here ONLY three (words) are"), (903, text(60_000)), (904, items[5][1]), (904, items[5][1]), (None, items[6][1])]
    return docs, items


@pytest.mark.parametrize("task_items", [10_000, 3])
def test_rows(spark, cases, monkeypatch, task_items):
    docs, items = cases
    monkeypatch.setattr(D, "TASK_ITEMS", task_items)
    left = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r)[:4] for r in D.contaminated(left, right).collect()]
    assert sorted(got, key=str) == plain(docs, items)
    assert D.contaminated(left.limit(0), right).count() == 0 and D.contaminated(left, right.limit(0)).count() == 0


@pytest.mark.parametrize("task_items", [10_000, 3])
def test_clean_rows_keep_all_columns(spark, cases, monkeypatch, task_items):
    docs, items = cases
    monkeypatch.setattr(D, "TASK_ITEMS", task_items)
    left = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id long, text string, __row int, key int, whole int, id int")
    right = spark.createDataFrame(items, "item_id long, text string")
    dirty = {r[0] for r in plain(docs, items)}
    got = D.select_clean(left, right)
    assert got.columns == left.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, t, 1, 2, 3, 4) for i, t in docs if i not in dirty), key=str)
    assert D.select_clean(left.limit(0), right).count() == 0 and D.select_clean(left, right.limit(0)).count() == len(docs)


def test_sketch_makes_a_miss_impossible():
    for n in range(1, 200):
        assert D.sketch_size([n], 0.8) + D.needed(n, 0.8) > n
