"""Readers and writers (S*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexipress.storage import settle

MESSAGE = "conv_id long, turn long, role string, text string"
REQUEST = "id string, ts timestamp, model string, headers map<string,string>, params map<string,string>, messages array<struct<role:string,content:string>>, extras map<string,string>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text); null text is empty."""
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _schema(MESSAGE)]).withColumn("text", F.coalesce("text", F.lit("")))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request logs as JSON lines, a row per message: (id, ts, model, headers, params, extras, open, idx, role, content).
    ``open``: fields that the schema doesn't name, each as a VARIANT, so that numbers, lists and nested objects keep their
    form; null for broken lines, whose ids are null."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    named = [f.name for f in _schema(REQUEST)]
    fields = F.map_filter(F.from_json("value", "map<string,variant>"), lambda k, _: ~k.isin(*named))
    rows = lines.select(F.from_json("value", REQUEST).alias("r"), fields.alias("open")).select("r.*", "open")
    return rows.select(*[c for c in rows.columns if c != "messages"], F.posexplode_outer("messages").alias("idx", "m")).select("*", "m.role", F.coalesce("m.content", F.lit("")).alias("content")).drop("m")


def read_sse(spark: SparkSession, folder: str) -> DataFrame:
    """S3: a stream of lines (request, value); the file's path is the request."""
    return spark.readStream.text(folder).select(F.input_file_name().alias("request"), "value")


def write_dictionary(dictionary: DataFrame, path: str, scope_cols: list[str] = [], prompt_chars: Column | None = None) -> None:  # noqa: B006
    """Parquet by scope, with what the header says: entries' lengths, when it was made, and where the dictionary has counts
    (n) the characters an entry saves and their share of the prompt. Entries that are the wrong way round (a short pattern
    for a long symbol) are turned."""
    turned = (F.length("pattern") <= 3) & (F.length("symbol") > 3)
    rows = dictionary.withColumn("s", F.when(turned, F.col("pattern")).otherwise(F.col("symbol"))).withColumn("p", F.when(turned, F.col("symbol")).otherwise(F.col("pattern")))
    rows = rows.drop("symbol", "pattern").withColumnRenamed("s", "symbol").withColumnRenamed("p", "pattern")
    rows = rows.withColumn("pattern_len", F.length("pattern")).withColumn("created_at", F.current_timestamp()).withColumn("prompt_chars", prompt_chars if prompt_chars is not None else F.lit(None).cast("long"))
    if "n" in rows.columns:
        rows = rows.withColumn("savings", (F.col("pattern_len") - F.length("symbol")) * F.col("n")).withColumn("ratio", F.col("savings") / F.nullif(F.col("prompt_chars"), F.lit(0)))
    rows.write.mode("append").partitionBy(*scope_cols).parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """S5"""
    return spark.read.parquet(path)


def expire(df: DataFrame, ts: str, now: Column, hours: int = 24) -> DataFrame:
    """Rows not older than so many hours."""
    return df.where(F.col(ts) >= now - F.expr(f"interval {int(hours)} hours"))


def expire_stored(spark: SparkSession, path: str, ts: str, now: Column, hours: int = 24, scope_cols: list[str] = []) -> DataFrame:  # noqa: B006
    """Removes stored rows older than so many hours and returns what is left. Only partitions that hold such rows are
    written anew, by dynamic partition overwrite; others keep their files, and partitions with nothing left go. What
    stays of a partition is in the shared folder before it is overwritten, so a job that is cut off loses nothing."""
    stored = spark.read.parquet(path)
    old = F.coalesce(F.col(ts) < now - F.expr(f"interval {int(hours)} hours"), F.lit(True))
    if not scope_cols:
        kept = settle(expire(stored, ts, now, hours), "kept")
        kept.write.mode("overwrite").parquet(path)
        return spark.read.schema(kept.schema).parquet(path)
    found = stored.select(*scope_cols, old.alias("old"), F.col("_metadata.file_path").alias("file")).groupBy(*scope_cols)
    touched = settle(found.agg(F.count_if("old").alias("gone"), F.count_if(~F.col("old")).alias("left"), F.min("file").alias("file")).where("gone > 0"), "touched")
    on = [stored[c].eqNullSafe(touched[c]) for c in scope_cols]
    kept = settle(stored.join(touched.hint("shuffle_merge"), on, "left_semi").where(~old), "kept")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope_cols).parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in touched.where(F.col("left") == 0).select("file").toLocalIterator():  # a row a partition that is gone
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.file)).getParent()
        folder.getFileSystem(conf).delete(folder, True)
    return spark.read.schema(stored.schema).parquet(path)


def read_op_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, level, phase, message, correlation_id, duration) of an events table."""
    rows = spark.read.parquet(path)
    return rows.select("ts", F.lit("INFO").alias("level"), F.col("event_type").alias("phase"), F.coalesce("props", F.lit("")).alias("message"), F.col("user_id").cast("string").alias("correlation_id"), F.col("value").alias("duration"))
