"""Corpora that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexipress.functions import text as X


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores and name in ("documents", "pages", "conversations") else df


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


_WORD = "lower(replace(substr(o_orderpriority, 3), ' ', '_'))"
LINES = (
    "concat('import orders_', lower(o_orderstatus))", f"concat('def load_', {_WORD}, '(self, key):')", "concat('    logger.info(\"processing order ', cast(o_orderkey as string), ' in batch\")')",
    f"concat('    value = config.get(\"', {_WORD}, '\", ', cast(o_custkey as string), ')  # fallback')", "concat('    total = self.compute(', cast(o_orderkey as string), ', \"', o_orderstatus, '\")')",
    "concat('    data[', cast(o_custkey as string), '] = result[', cast(o_orderkey as string), ']')", "concat('// const price = ', cast(cast(floor(o_totalprice) as bigint) as string))", "concat('class Order', o_orderstatus, '(Base):')",
)
LINE = "case o_orderkey % 8 " + " ".join(f"when {i} then {x}" for i, x in enumerate(LINES)) + " end"


def code_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, filename, text): a source file per customer, from its orders."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.expr(LINE).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    name = F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".js"))
    return rows.groupBy("doc_id").agg(lines.alias("text")).withColumn("filename", name)


CODE_SQL = f"""code_docs as (select o_custkey as doc_id, 'c' || o_custkey || case when o_custkey % 2 = 0 then '.py' else '.js' end as filename,
  string_agg({LINE.replace("as string", "as varchar")}, chr(10) order by o_orderkey) as text from orders group by o_custkey)"""


def tool_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): each document as the content of a tool call."""
    esc = F.replace(F.replace(F.replace(X.text_of(F.col("text")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    esc = F.translate(esc, "{}\t\r", "()  ")
    return documents(spark, d).select("doc_id", F.concat(F.lit('{"tool": "read_file", "path": "f'), F.col("doc_id").cast("string"), F.lit('.txt", "content": "'), esc, F.lit('"}')).alias("text"))


TOOL_SQL = """tool_docs as (select doc_id, '{"tool": "read_file", "path": "f' || doc_id || '.txt", "content": "' ||
  translate(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), '{}' || chr(9) || chr(13), '()  ') || '"}' as text from documents)"""


def op_log(spark: SparkSession, d: str) -> DataFrame:
    from lexipress.sources import read_op_log

    return read_op_log(spark, f"{d}/events.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, role, original_chars, compressed_chars, dict_chars, new_dict_chars): what a turn would take if each
    word of 8 letters and more became 2 characters, with an entry for each new word."""
    long = F.filter(X.words(F.col("text")), lambda w: F.length(w) >= 8)
    saved = F.aggregate(F.transform(long, lambda w: F.length(w) - 2), F.lit(0), lambda a, b: a + b)
    new = F.aggregate(F.transform(F.array_distinct(long), lambda w: F.length(w) + 5), F.lit(0), lambda a, b: a + b)
    n = F.length("text")
    return messages(spark, d).select("conv_id", "turn", "role", n.alias("original_chars"), (n - saved).alias("compressed_chars"), (2 * new).alias("dict_chars"), new.alias("new_dict_chars"))


_LONG = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w) >= 8)"
TURNS_SQL = f"""turns as (select conv_id, turn, role, length(text) as original_chars,
  length(text) - coalesce(list_sum(list_transform({_LONG}, lambda w: length(w) - 2)), 0) as compressed_chars,
  2 * coalesce(list_sum(list_transform(list_distinct({_LONG}), lambda w: length(w) + 5)), 0) as dict_chars,
  coalesce(list_sum(list_transform(list_distinct({_LONG}), lambda w: length(w) + 5)), 0) as new_dict_chars from conversations)"""


def symbol_costs(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, family, tokens): part names' first letters and sizes stand in for symbols and costs."""
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 400).cast("string")).alias("symbol"), F.concat(F.lit("f"), (F.col("p_size") % 4).cast("string")).alias("family"), (1 + F.col("p_partkey") % 3).alias("tokens"))
    return rows.groupBy("symbol", "family").agg(F.max("tokens").cast("int").alias("tokens"))


COSTS_SQL = "costs as (select 'p' || (p_partkey % 400) as symbol, 'f' || (p_size % 4) as family, max(1 + p_partkey % 3)::int as tokens from part group by all)"
