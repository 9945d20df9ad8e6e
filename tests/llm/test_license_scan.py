import os

import duckdb
import pytest

from lexipress.llm import licences
from lexipress.llm import license_scan as S


def test_texts_and_notices(spark):
    mit = next(t for i, k, t in licences.known() if i == "MIT" and t.startswith("MIT License"))
    styled = "  /* " + mit.replace(". ", ".\n * ").replace("License", "LICENCE") + " */"
    styled = styled.replace("LICENCE", "LICENCE\nCopyright (c) 2020 Somebody\nAll rights reserved.\n")
    rows = [
        (1, styled), (2, mit[:-20]), (3, "Prose.\n// Released under the MIT Licence!\nMore.\n  licensed under cc by-nc 4.0"), (4, None), (5, ""),
        (6, "Released under the MIT License"), (7, "copyright 2020\n\n"), (8, "the MIT License is nice"), (9, "SPDX-License-Identifier: Apache-2.0\n" * 30_000),
        (3, "Prose.\n// Released under the MIT Licence!\nMore.\n  licensed under cc by-nc 4.0"), (None, "Released under the MIT License"), (3, "other"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license_id string, digest int")
    got = sorted([tuple(r) for r in S.scan(df).collect()], key=str)
    expect = [
        (1, "MIT", "MIT", 1), (2, None, "MIT", 1), (3, None, "CC-BY-NC-4.0,MIT", 2), (3, None, "CC-BY-NC-4.0,MIT", 2), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0),
        (6, "MIT", "MIT", 1), (7, None, "", 0), (8, None, "", 0), (9, None, "Apache-2.0", 30_000), (None, "MIT", "MIT", 1),
    ]
    assert got == sorted(expect, key=str)
    assert S.scan(df.limit(0)).count() == 0


def test_other_known_texts(spark, monkeypatch):
    known = spark.createDataFrame([("A", "My  words, here."), ("B", "my words here"), (None, "x"), ("C", None), ("D", "!!")], "license_id string, text string")
    df = spark.createDataFrame([(1, "MY WORDS: HERE"), (2, "!!")], "doc_id long, text string")
    for rows in (10, 0):
        monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
        assert sorted(map(tuple, S.scan(df, known).collect())) == [(1, "A", "A", 1), (2, None, "", 0)]


def test_oracle(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}'")
    assert sorted(con.sql(S.oracle()).fetchall(), key=str) == sorted(map(tuple, S.scan(spark.read.parquet(d)).collect()), key=str)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = S.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no published texts on this machine")
def test_published_texts(spark):
    """Whole published texts, other case, line ends and copyright lines aside; not a text with a word more."""
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    texts = {i: open(f"{FOLDER}/{f}", encoding="utf-8", errors="replace").read() for i, f in names.items() if os.path.exists(f"{FOLDER}/{f}")}
    rows = [(i, t) for i, t in texts.items()] + [(i, "Copyright (c) 2020 Someone\n" + t.upper().replace(", ", " - ").replace("license", "licence")) for i, t in texts.items()]
    rows += [(None, t + " more") for t in texts.values()]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in S.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [i for i, _ in rows]


def test_filter_loses_nothing(spark):
    """Known texts whose first word or length equivalent spellings change."""
    known = [("a", "Sub license granted"), ("b", "copyright owner " * 40), ("c", "Per cent rules"), ("d", "licence"), ("e", "non infringement, whilst organised")]
    df = spark.createDataFrame([(k, t.replace("license", "licence").upper()) for k, (_, t) in enumerate(known)], "doc_id long, text string")
    got = {r.doc_id: r.text_license for r in S.scan(df, spark.createDataFrame(known, "license_id string, text string")).collect()}
    assert got == {k: i for k, (i, _) in enumerate(known)}
