import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lexipress.llm import simhash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, distance=2):
    root = {i: i for i in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(pairs)
    for i in ids:
        for j in ids:
            if i < j and bin(pairs[i] ^ pairs[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\x0b", "One", "A b", "É Über x y z", "a\x1cb c\x85d e f g", "ab " * 70_000])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text, 3) == plain_fingerprint(text)


def test_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts = base + base[:20] + [t.upper() for t in base[:10]] + [t + " tail" for t in base] + [None, "", "   ", "x"]
    rows = list(enumerate(texts))
    rows.append(rows[0])
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    comp = plain_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i]:016x}", comp[i]) for i, _ in rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    lone = simhash.near_duplicates(df.where("doc_id = 3").select(F.lit(None).cast("long").alias("doc_id"), "text")).first()
    assert lone.fingerprint == f"{prints[3]:016x}" and lone.component_id is None


def test_hot_buckets(spark, monkeypatch):
    """Chains and dense clouds of fingerprints, with buckets far over the limit, link as all pairs would."""
    rng = random.Random(2)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(120):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))))
            prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7, 2**64 - 1}
    pairs = dict(enumerate(sorted(prints)))
    expect = plain_components(pairs)
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in pairs.items()], "rep long, fp long")
    for limit in (4, 10_000):
        monkeypatch.setattr(simhash, "BUCKET_PAIRS", limit)
        found = {r.node: r.component for r in simhash.connected_components(simhash.links(rows)).collect()}
        assert {i: found.get(i, i) for i in pairs} == expect
    monkeypatch.setattr(simhash, "plan", lambda *a: [simhash.Part(tuple(range(30)), 1), simhash.Part(tuple(range(30, 64)), 0)])
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 4)
    found = {r.node: r.component for r in simhash.connected_components(simhash.links(rows)).collect()}
    assert {i: found.get(i, i) for i in pairs} == expect


def test_thresholds_cover_the_distance(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(500)], "rep long, fp long")
    n, both = simhash.bit_statistics(rows)
    assert n == 500
    for m in (2, 3, 4):
        groups = simhash.correlated_groups(n, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, parts = simhash.allot(groups, [100.0] * m, n, both, 2)
        assert sum(p.threshold for p in parts) == 2 - m + 1 and min(p.threshold for p in parts) >= -1


def test_crowded_bands_lose_no_pair(spark, monkeypatch):
    """Pairs of near copies among texts that share most of their words, in buckets far over the limit."""
    common = [f"t{i}" for i in range(180)]
    texts = [" ".join([*common, *(f"p{i // 2}w{k}" for k in range(10)), *(f"d{i}w{k}" for k in range(20))]) for i in range(160)]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    alike = {(j, i) for i in range(160) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike == {(i, i + 1) for i in range(0, 160, 2)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 4)
    found = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert found == {i: i // 2 * 2 for i in range(160)}
