"""Queries whose SQL has to state capitals and rounding as Spark has them, on texts where the engines' own differ."""

import duckdb
import pytest
from test_oracle import same

from lexipress.plans import registry

TIE = " ".join(["abcdefghijklm"] * 7 + ["abc"] * 15 + ["ab"])  # 160 characters, 83 without what its long words lose: 1 - 83 / 160 is just below 0.48125
TURNS = [(0, 0, "user", "ßeinbeöein ßschheitschsch ssabcdefgh"), (0, 1, "assistant", "ŉabcdefghij ǰxabcdefghi ßeinbeöein"), (1, 0, "user", "stabcdefgh ßübcdefghi unabcdefgh deabcdefgh enabcdefgh"), (1, 1, "assistant", TIE), (2, 0, "assistant", TIE)]


@pytest.mark.parametrize("name", ["t5_conversation_state", "t5_rule_stream", "t6_idle_state", "w3_additive_rules", "w4_conflicts", "w9_symbol_usage", "w13_summary", "w14_skipped_turns"])
def test_sql_states_the_same_rule(spark, tmp_path, name):
    assert len(TIE) == 160
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    out = registry.queries()[name](spark, str(tmp_path))
    columns = sorted(out.columns)
    got = sorted(tuple(r) for r in out.select(*columns).collect())
    want = sorted(con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]}) x").fetchall())
    assert len(got) == len(want) and all(same(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True)), (got, want)


def test_capitals_of_every_character(spark, tmp_path):
    """A symbol's capitals in SQL are the query's for every character that a word can hold."""
    from pyspark.sql import functions as F

    from lexipress.plans.table_queries import SYMBOL_SQL

    rows = [(i, chr(i)) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    chars = spark.createDataFrame(rows, "i int, c string").where(F.col("c").rlike(r"^[\p{L}\p{N}_]$"))
    chars.selectExpr("i", "c || 'ß' as text").withColumn("symbol", F.upper("text")).write.parquet(f"{tmp_path}/c.parquet")
    bad = duckdb.sql(f"select i, text, symbol, {SYMBOL_SQL} as said from '{tmp_path}/c.parquet/*.parquet' where symbol is distinct from said").fetchall()
    assert chars.count() > 100_000 and not bad, bad[:20]


def test_four_places_at_every_tie(spark, tmp_path):
    """the SQL's four places are the query's wherever a quotient's fifth place is a 5 and nothing follows."""
    from pyspark.sql import functions as F

    from lexipress.plans.table_queries import _PLACES

    forms = {"share": "c / o", "ratio": "1 - c / greatest(o, 1)", "left_": "(o - c) / greatest(o, 1)"}
    rows = spark.range(1, 3126).select((F.col("id") * 32).alias("o"))  # only these give such quotients
    rows = rows.select("o", F.explode(F.sequence(F.lit(1), F.lit(19_999), F.lit(2))).alias("k")).where("k * o % 20000 = 0").select("o", F.expr("k * o div 20000").alias("c"))
    rows.select("o", "c", *[F.round(F.expr(x), 4).alias(n) for n, x in forms.items()]).write.parquet(f"{tmp_path}/t.parquet")
    said = {n: _PLACES.sub(r"round((\1)::varchar::decimal(38, 20), 4)::double", f"round({x}, 4)") for n, x in forms.items()}
    ((count, *bad),) = duckdb.sql(f"select count(*), {', '.join(f'count(*) filter ({n} is distinct from {x})' for n, x in said.items())} from '{tmp_path}/t.parquet/*.parquet'").fetchall()
    assert count > 100_000 and not any(bad), (count, bad)
