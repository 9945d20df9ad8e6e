"""Dictionaries (D*): symbols for patterns, their value, and the dictionary's own text.

A dictionary is a table (scope, seq, symbol, pattern, n, value): seq 1 is the longest pattern of its scope. It has at
most ``k`` rows a scope, so a scope's rules fit a row as an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexipress.functions import text as X
from lexipress.functions.pieces import pieces
from lexipress.sources import expire_stored
from lexipress.storage import settle


def _symbol_order() -> Column:
    return F.struct((F.col("cost") + F.when(F.col("kind") == "ascii", 1).otherwise(0)).cast("int").alias("cost"), F.length("symbol").alias("size"), "rank")


def rank_symbols(pool: DataFrame, costs: DataFrame | None = None, family: str = "gpt-4", k: int = 262, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, symbol, cost, srank): by token cost for the family, then length, then pool order. ASCII costs one more. A
    symbol without a figure for the family takes its average over families. A pool by scope is ranked in each."""
    if costs is not None:
        own = costs.groupBy("symbol").agg(F.max(F.when(F.col("family") == family, F.col("tokens"))).alias("own"), F.floor(F.avg("tokens")).alias("mean"))
        pool = pool.join(own.hint("shuffle_merge"), "symbol", "left").withColumn("cost", F.coalesce("own", "mean", "cost"))
    order = Window.partitionBy(*scope).orderBy(_symbol_order())  # a pool is a catalog
    ranked = pool.withColumn("srank", F.row_number().over(order)).where(F.col("srank") <= k)
    return ranked.select(*scope, "symbol", _symbol_order()["cost"].alias("cost"), "srank")


#: Bits of a bitmap of symbols, by their rank in the pool.
POOL_BITS = 32_768
#: Scopes whose symbols a task remembers so as not to pass them on twice.
SCOPES = 1_000


def used_bits(pool: DataFrame, df: DataFrame, scope: list[str] = [], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(scope, bits): which symbols of the pool occur in the texts of each scope, a bitmap by rank. One pass: a text's
    distinct characters beyond ASCII, and what it holds of the pool's other symbols; tasks pass on a bitmap a scope."""
    text = X.text_of(F.col(text_col))
    plain = [r.symbol for r in pool.where((F.length("symbol") > 1) | (F.col("symbol") <= "\x7f")).select("symbol").collect()]  # a catalog
    texts = df.select(text.alias("text"), *scope)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, tuple[set, list]] = {}  # by scope: what was passed on, symbols of ``plain`` still looked for
        for batch in batches:
            names, row = [batch.column(1 + i) for i in range(len(scope))], 0
            for piece in pieces(batch.column(0)):
                keys = zip(*(x.slice(row, len(piece)).to_pylist() for x in names), strict=True) if scope else [()] * len(piece)
                at, out = [], []
                for i, (one, key) in enumerate(zip(piece.to_pylist(), keys, strict=True)):
                    known, left = seen.setdefault(key, (set(), list(plain)))
                    new = set() if one.isascii() else {c for c in set(one) - known if c > "\x7f"}
                    new |= {x for x in left if x in one}
                    if new:
                        known |= new
                        left[:] = [x for x in left if x not in new]
                        at, out = at + [row + i] * len(new), out + list(new)
                    if len(seen) > SCOPES:
                        seen.clear()
                row += len(piece)
                if out:
                    yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in names), pa.array(out, pa.string())], names=[*scope, "symbol"])

    held = texts.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "symbol string"]))
    ranks = held.join(F.broadcast(pool.select("symbol", "rank")), "symbol")  # a catalog
    return ranks.groupBy(*scope).agg(F.bitmap_construct_agg(F.col("rank").cast("long")).alias("bits"))


def free_symbols(pool: DataFrame, df: DataFrame, text_col: str = "text", used: DataFrame | None = None, scope: list[str] = [], k: int | None = None) -> DataFrame:  # noqa: B006
    """(scope, symbol, rank, kind, cost): symbols of the pool that occur in no text of the scope and aren't in ``used``
    (symbol, or scope and symbol); with ``k`` about the first k of each scope by cost, length and rank. Symbols that only
    other scopes' texts hold stay free. Pools are catalogs of at most POOL_BITS symbols."""
    taken = used_bits(pool, df, scope, text_col)
    if scope:
        taken = df.select(*scope).distinct().join(taken.hint("shuffle_merge"), scope, "left")
    every = pool.agg(F.array_sort(F.collect_list(F.struct(_symbol_order().alias("o"), "symbol", "rank", "kind", "cost"))).alias("pool"), F.max("rank").alias("most"))
    every = every.withColumn("pool", F.when(F.col("most") < POOL_BITS, F.col("pool")).otherwise(F.raise_error("a pool of symbols holds at most 32,767")))
    byte = lambda rank: F.conv(F.hex(F.substring("bits", (rank / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    free = lambda x: F.col("bits").isNull() | (F.getbit(byte(x["rank"]), x["rank"] % 8) == 0)
    left = F.filter("pool", free)
    rows = taken.join(F.broadcast(every))  # one row
    some = k + (0 if used is None else POOL_BITS) if k is not None else None
    out = rows.select(*scope, F.inline(F.slice(left, 1, some) if some is not None else left)).drop("o")
    if used is not None:
        on = [*(c for c in scope if c in used.columns), "symbol"]
        out = out.join(used.select(*on).distinct().hint("shuffle_merge"), on, "left_anti")
    return out


def assignment_value(pattern: Column, n: Column, symbol: Column, method: str = "tokens") -> Column:
    """D3: net value of a pattern n times replaced by a symbol. tokens: tokens saved at each place, at most a third of the
    length, less those of the entry; chars: characters saved less the entry's, by four."""
    if method == "chars":
        return F.greatest(F.lit(0), (F.length(pattern) - F.length(symbol)) * n - (F.length(pattern) + F.length(symbol) + 3)) / 4.0
    each = F.least(X.token_estimate(pattern) - X.token_estimate(symbol), F.floor(F.length(pattern) / 3).cast("int"))
    net = each * n - X.token_estimate(F.concat(F.lit("\n"), pattern, F.lit("="), symbol))
    return F.when(each <= 0, F.lit(-1.0)).when((n >= 5) & (net > -2), F.greatest(net.cast("double"), F.lit(0.1))).otherwise(net.cast("double"))


def assign_symbols(patterns: DataFrame, symbols: DataFrame, scope: list[str] = [], k: int = 262, method: str = "chars") -> DataFrame:  # noqa: B006
    """The dictionary: patterns by value take the symbols in order, rank to rank, which is greedy where symbols are in
    order of cost; pairs of no value go. Ties: more characters saved, then the pattern. Symbols may be by scope."""
    probe = assignment_value(F.col("pattern"), F.col("n"), F.lit("α"), method)
    scored = patterns.withColumn("probe", probe).where("probe > 0")
    order = [F.col("probe").desc(), F.length("pattern").desc(), F.col("pattern")]
    ranked = scored.withColumn("srank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where(F.col("srank") <= k)
    some = symbols.where(F.col("srank") <= k)
    own = [c for c in scope if c in symbols.columns]
    pairs = ranked.join(some.select(*own, "symbol", "srank").hint("shuffle_merge"), [*own, "srank"]) if own else ranked.join(F.broadcast(some.groupBy("srank").agg(F.min("symbol").alias("symbol"))), "srank")  # k rows
    pairs = pairs.withColumn("value", F.round(assignment_value(F.col("pattern"), F.col("n"), F.col("symbol"), method), 4)).where("value > 0")
    seq = F.row_number().over(Window.partitionBy(*scope).orderBy(F.length("pattern").desc(), "pattern"))
    return pairs.select(*scope, seq.alias("seq"), "symbol", "pattern", "n", "value")


def assign_by_priority(patterns: DataFrame, symbols: DataFrame, priority: str = "priority", k: int = 262) -> DataFrame:
    """As D4, by priority * n; pairs stay where the symbol is one character."""
    rank = F.row_number().over(Window.orderBy((F.col(priority) * F.col("n")).desc(), "pattern"))
    ranked = patterns.orderBy((F.col(priority) * F.col("n")).desc(), "pattern").limit(k).withColumn("srank", rank)
    some = F.broadcast(symbols.where(F.col("srank") <= k).groupBy("srank").agg(F.min("symbol").alias("symbol")))  # k rows
    return ranked.join(some, "srank").where(F.length("symbol") == 1).select("srank", "symbol", "pattern", "n")


def dictionary_metrics(dictionary: DataFrame, totals: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, entries, chars_saved, tokens_saved, original_chars, ratio): tokens capped at a tenth of the text's for a
    pattern, at 80 % in all, and below the original; ratio at most 0.95. totals: (scope, original_chars)."""
    joined = dictionary.join(totals.hint("shuffle_merge"), scope) if scope else dictionary.join(F.broadcast(totals))
    tokens = F.floor(F.col("original_chars") / 4)
    each = F.least(F.greatest(assignment_value(F.col("pattern"), F.col("n"), F.col("symbol")), F.lit(0.0)), tokens * 0.1)
    rows = joined.groupBy(*scope, "original_chars").agg(F.count("*").alias("entries"), F.sum((F.length("pattern") - F.length("symbol")) * F.col("n")).alias("chars_saved"), F.sum(each).alias("t"))
    saved = F.least(F.floor("t"), F.floor(tokens * 0.8), tokens - 1)
    return rows.select(*scope, "entries", "chars_saved", F.greatest(F.lit(0), saved).cast("long").alias("tokens_saved"), "original_chars", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0), saved) / F.greatest(tokens, F.lit(1))), 4).alias("ratio"))


def rejected(patterns: DataFrame, dictionary: DataFrame, k: int = 20) -> DataFrame:
    """The k best patterns that have no symbol."""
    out = patterns.join(dictionary.select("pattern").hint("shuffle_merge"), "pattern", "left_anti")
    return out.withColumn("value", F.col("n") * F.length("pattern")).orderBy(F.col("value").desc(), "pattern").limit(k)


def accept(df: DataFrame, threshold: float, original: str = "text", compressed: str = "compressed_text") -> DataFrame:
    """The compressed text where both its characters and its tokens shrink by the threshold; else the original."""
    before, after = F.length(original), F.length(compressed)
    chars = 1 - after / F.greatest(before, F.lit(1))
    tokens = 1 - X.token_estimate(F.col(compressed)) / X.token_estimate(F.col(original))
    ok = (chars >= threshold - 1e-6) & (tokens >= threshold - 1e-6)
    return df.withColumn("accepted", ok).withColumn("final_text", F.when(ok, F.col(compressed)).otherwise(F.col(original)))


def token_efficiency(df: DataFrame, original: str = "text", compressed: str = "compressed_text", method: str = "chars", tokenizer=None) -> DataFrame:
    """Adds original_tokens, compressed_tokens, saved, ratio (4 places) and valid (something saved). ``tokenizer`` (U1):
    a Column function in place of the estimate."""
    count = tokenizer or (lambda c: X.token_estimate(c, method))
    out = df.withColumn("original_tokens", count(F.col(original))).withColumn("compressed_tokens", count(F.col(compressed)))
    out = out.withColumn("saved", F.col("original_tokens") - F.col("compressed_tokens"))
    return out.withColumn("ratio", F.round(F.col("saved") / F.greatest(F.col("original_tokens"), F.lit(1)), 4)).withColumn("valid", F.col("saved") > 0)


def symbol_stats(costs: DataFrame, k: int = 10) -> DataFrame:
    """Per family: symbols, least, most and mean tokens, how many take one token, best and worst k (joined by spaces)."""
    best = F.row_number().over(Window.partitionBy("family").orderBy("tokens", "symbol"))
    worst = F.row_number().over(Window.partitionBy("family").orderBy(F.col("tokens").desc(), "symbol"))
    rows = costs.withColumn("b", best).withColumn("w", worst)
    join = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= k, F.struct(F.col(r), F.col("symbol"))))), lambda x: x["symbol"]), " ")
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.round(F.avg("tokens"), 4).alias("mean"), F.count_if(F.col("tokens") == 1).alias("single"), F.count_if(F.col("tokens") > 1).alias("multi"), join("b").alias("best"), join("w").alias("worst"))


def compare_families(costs: DataFrame, a: str, b: str, k: int = 20) -> DataFrame:
    """(symbol, diff, better, worse, equal, mean_diff): the k largest differences a - b, each with the counts over all."""
    left = costs.where(F.col("family") == a).select("symbol", F.col("tokens").alias("x"))
    right = costs.where(F.col("family") == b).select("symbol", F.col("tokens").alias("y"))
    diff = left.join(right.hint("shuffle_merge"), "symbol").select("symbol", (F.col("x") - F.col("y")).alias("diff"))
    whole = diff.agg(F.count_if(F.col("diff") < 0).alias("better"), F.count_if(F.col("diff") > 0).alias("worse"), F.count_if(F.col("diff") == 0).alias("equal"), F.round(F.avg("diff"), 4).alias("mean_diff"))
    return diff.orderBy(F.abs("diff").desc(), "symbol").limit(k).join(F.broadcast(whole))


def context_efficiency(symbols: DataFrame, contexts: list[tuple[str, str]], tokenizer) -> DataFrame:
    """(symbol, efficiency): mean over contexts (before, after) of 1 / max(1, tokens that the symbol adds + 1).
    ``tokenizer`` (U1): a Column function, such as a pandas UDF that the caller registers."""
    spots = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in contexts])
    rows = symbols.select("symbol", F.inline(spots))
    added = tokenizer(F.concat("a", "symbol", "b")) - tokenizer(F.concat("a", "b"))
    return rows.withColumn("e", F.lit(1.0) / F.greatest(F.lit(1), added + 1)).groupBy("symbol").agg(F.round(F.avg("e"), 4).alias("efficiency"))


#: Separators of entries, and of an entry's symbol and pattern, in the plain form and in the other one.
PLAIN, OTHER = (";", ":"), ("‖", "⟦")
END = "#DICT_END"


def _escaped(col: Column) -> Column:
    """Backslashes and line ends; in the other form also its separators and what would end the dictionary."""
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), *((x, "\\" + x) for x in OTHER), (END, "\\" + END)):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def encode_dictionary(dictionary: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, dict_text): ``#DICT s:p;s:p;#DICT_END``. Where a symbol or pattern of the scope holds ; or : or the end
    mark, the separators are ‖ and ⟦; the one before the end tells which. Both forms escape backslashes, line ends,
    ‖, ⟦ and the end mark by a backslash, so any pattern comes back."""
    odd = F.bool_or(F.concat("symbol", F.lit(" "), "pattern").rlike("[;:]|" + END))
    entries = F.array_sort(F.collect_list(F.struct("seq", "symbol", "pattern")))
    rows = dictionary.groupBy(*scope).agg(odd.alias("odd"), entries.alias("e"))
    text = lambda form: F.concat(F.array_join(F.transform("e", lambda x: F.concat(_escaped(x["symbol"]), F.lit(form[1]), _escaped(x["pattern"]))), form[0]), F.lit(form[0] + END))
    return rows.select(*scope, F.concat(F.lit("#DICT "), F.when(F.col("odd"), text(OTHER)).otherwise(text(PLAIN))).alias("dict_text"))


def _plain(col: Column) -> Column:
    """Without escapes: a backslash stands for the character behind it, before an n for a line end."""
    parts = F.regexp_extract_all(col, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x == "\\n", F.lit("\n")).when(F.startswith(x, F.lit("\\")), F.substring(x, 2, 1)).otherwise(x)), "")


def decode_dictionary(df: DataFrame, col: str = "dict_text", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, seq, symbol, pattern) of ``encode_dictionary``'s texts, which may stand inside longer ones."""
    part = lambda i: F.regexp_extract(F.col(col), rf"(?s)#DICT (.*?[{PLAIN[0]}{OTHER[0]}]){END}", i)
    odd = F.endswith(part(1), F.lit(OTHER[0]))
    entries = lambda form: F.regexp_extract_all(part(1), F.lit(rf"(?s)((?:[^\\{form[0]}]|\\.)*){form[0]}"), F.lit(1))
    rows = df.select(*keys, odd.alias("odd"), F.posexplode(F.when(odd, entries(OTHER)).otherwise(entries(PLAIN))).alias("pos", "entry"))
    side = lambda i: F.when(F.col("odd"), F.regexp_extract("entry", rf"(?s)^((?:[^\\{OTHER[1]}]|\\.)*){OTHER[1]}(.*)$", i)).otherwise(F.regexp_extract("entry", rf"(?s)^((?:[^\\{PLAIN[1]}]|\\.)*){PLAIN[1]}(.*)$", i))
    return rows.select(*keys, (F.col("pos") + 1).alias("seq"), _plain(side(1)).alias("symbol"), _plain(side(2)).alias("pattern"))


def dictionary_prompt(dictionary: DataFrame, scope: list[str] = [], known: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(scope, prompt): the minimal text from 3 entries on, else a line an entry; ``known``: symbols that go without."""
    rows = dictionary if known is None else dictionary.join(known.select(*scope, "symbol").hint("shuffle_merge"), [*scope, "symbol"], "left_anti")
    lines = F.array_sort(F.collect_list(F.struct("seq", "symbol", "pattern")))
    verbose = rows.groupBy(*scope).agg(F.count("*").alias("k"), lines.alias("e")).withColumn("verbose", F.concat(F.lit("Symbols stand for text:\n"), F.array_join(F.transform("e", lambda x: F.concat(x["symbol"], F.lit(" = "), x["pattern"])), "\n")))
    both = verbose.drop("e").join(encode_dictionary(rows, scope).hint("shuffle_merge"), scope) if scope else verbose.drop("e").join(F.broadcast(encode_dictionary(rows, scope)))
    return both.select(*scope, F.when(F.col("k") >= 3, F.col("dict_text")).otherwise(F.col("verbose")).alias("prompt"))


def prompt_overhead(dictionary: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, overhead_tokens) of the dictionary's prompt."""
    return dictionary_prompt(dictionary, scope).select(*scope, X.token_estimate(F.col("prompt"), "prompt").alias("overhead_tokens"))


def update_token_counts(texts: DataFrame, store: DataFrame, now: Column, ttl_hours: int = 24, tokenizer: str = "chars", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The store (key, tokens, at) with what's new and without what's old, and a report (hits, misses). Each different
    text is counted once."""
    fresh = store.where(F.col("at") >= now - F.expr(f"interval {int(ttl_hours)} hours"))
    keyed = texts.select(F.md5(F.concat(F.lit(tokenizer), X.text_of(F.col(text_col)))).alias("key"), X.text_of(F.col(text_col)).alias("text"))
    marked = settle(keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("asked")).join(fresh.select("key", F.lit(True).alias("known")).hint("shuffle_merge"), "key", "left"), "token-keys")
    new = marked.where("known is null").select("key", X.token_estimate(F.col("text"), tokenizer).cast("long").alias("tokens"), now.alias("at"))
    report = marked.agg(F.coalesce(F.sum(F.when(F.col("known"), F.col("asked")).otherwise(F.col("asked") - 1)), F.lit(0)).alias("hits"), F.count_if(F.col("known").isNull()).alias("misses"))
    return fresh.select("key", F.col("tokens").cast("long").alias("tokens"), "at").unionByName(new), report


#: Folders of the store of token counts that keys are dealt to, by hash.
BUCKETS = 16
STORE = "key string, tokens long, at timestamp"


def read_token_store(spark: SparkSession, path: str, now: Column, ttl_hours: int = 24) -> DataFrame:
    """(key, tokens, at, day, bucket) of what a store holds that isn't older than so many hours; days before aren't read.
    A store that isn't there yet is empty."""
    limit = now - F.expr(f"interval {int(ttl_hours)} hours")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{STORE}, day date, bucket int")
    return spark.read.schema(f"{STORE}, day date, bucket int").parquet(path).where((F.col("day") >= F.to_date(limit)) & (F.col("at") >= limit))


def update_token_store(texts: DataFrame, path: str, now: Column, ttl_hours: int = 24, tokenizer: str = "chars", text_col: str = "text") -> DataFrame:
    """Counts the texts that a store on disk doesn't know, adds them to it, drops what is too old, and returns a report
    (hits, misses). Each different text is counted once; a second run over the same texts counts none.

    Keys lie in folders by day and by hash bucket. Counts of today are put there by overwriting only the buckets that
    gain some, with what they had, so a run that is repeated changes nothing; folders of days gone by leave with the
    rows that are too old."""
    spark = texts.sparkSession
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    text = X.text_of(F.col(text_col))
    asked = texts.select(F.md5(F.concat(F.lit(tokenizer + ":"), text)).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("asked"))
    fresh = read_token_store(spark, path, now, ttl_hours)
    marked = settle(asked.join(fresh.select("key", F.lit(True).alias("known")).hint("shuffle_merge"), "key", "left"), "token-keys")
    new = marked.where("known is null").select("key", X.token_estimate(F.col("text"), tokenizer).cast("long").alias("tokens"), now.alias("at"), F.to_date(now).alias("day"), bucket.alias("bucket"))
    new = settle(new, "new-tokens")
    gaining = new.select("day", "bucket").distinct()  # at most BUCKETS
    had = fresh.join(F.broadcast(gaining), ["day", "bucket"], "left_semi").select(*new.columns)
    both = settle(had.unionByName(new).groupBy("key", "day", "bucket").agg(F.max(F.struct("at", "tokens")).alias("x")).select("key", "x.tokens", "x.at", "day", "bucket"), "token-buckets")
    both.repartition("day", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "bucket").parquet(path)
    expire_stored(spark, path, "at", now, ttl_hours, ["day", "bucket"])
    return marked.agg(F.coalesce(F.sum(F.when(F.col("known"), F.col("asked")).otherwise(F.col("asked") - 1)), F.lit(0)).alias("hits"), F.count_if(F.col("known").isNull()).alias("misses"))
