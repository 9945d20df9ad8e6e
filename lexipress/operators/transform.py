"""Substitution, expansion and clean-up of text columns (C*)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexipress import catalogs
from lexipress.functions import text as X
from lexipress.functions.pieces import pieces
from lexipress.operators import dictionary as D
from lexipress.operators import mining as M
from lexipress.operators.conversations import gate_reason
from lexipress.storage import settle

RULES = "array<struct<seq:int,symbol:string,pattern:string>>"
#: Rules of one dictionary at most: they go to every task, or to every row of their scope.
MOST_RULES = 10_000


def rules_of(dictionary: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, rules): a scope's entries as an array by seq, at most MOST_RULES."""
    every = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "symbol", "pattern")))
    return dictionary.groupBy(*scope).agg(F.when(F.count("*") <= MOST_RULES, every).otherwise(F.raise_error(f"a dictionary has at most {MOST_RULES} rules")).alias("rules"))


def _with_rules(df: DataFrame, dictionary: DataFrame, scope: list[str]) -> DataFrame:
    rules = rules_of(dictionary, scope)
    if scope:
        out = df.join(rules.hint("shuffle_merge"), scope, "left")
    else:
        out = df.join(F.broadcast(rules), F.lit(True), "left")  # one row of MOST_RULES rules at most
    return out.withColumn("rules", F.coalesce("rules", F.array().cast(RULES)))


class RuleIndex:
    """Routes a text to the rules that it can hold: one pass over the text by an automaton of all patterns (or symbols)
    finds them, and only these are tried in turn. Where a pattern holds a symbol, replacing one may make another rule
    fit, so all rules are tried."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        marks = [s for s, _ in rules if s]
        self.nested = bool(marks) and any(s in p for _, p in rules for s in marks)
        self.patterns, self.symbols = self._automaton([p for _, p in rules]), self._automaton([s for s, _ in rules])

    def _automaton(self, keys: list[str]) -> tuple[ahocorasick.Automaton | None, dict[str, list[int]]]:
        found, at = ahocorasick.Automaton(), {}
        for i, key in enumerate(keys):
            if key:
                at.setdefault(key, []).append(i)
        for key in at:
            found.add_word(key, key)
        if at:
            found.make_automaton()
        return (found if at else None), at

    def _held(self, which: tuple, text: str) -> list[int]:
        automaton, at = which
        if automaton is None:
            return []
        return list(range(len(self.rules))) if self.nested else sorted(i for key in {k for _, k in automaton.iter(text)} for i in at[key])

    def substitute(self, text: str) -> tuple[str, list[str]]:
        used = []
        for i in self._held(self.patterns, text):
            symbol, pattern = self.rules[i]
            if len(pattern) >= 3 and len(pattern) > len(symbol) and pattern in text:
                text = text.replace(pattern, symbol)
                used.append(symbol)
        return text, used

    def expand(self, text: str) -> str:
        for i in reversed(self._held(self.symbols, text)):
            symbol, pattern = self.rules[i]
            text = text.replace(symbol, pattern) if symbol else text
        return text


def rule_list(dictionary: DataFrame) -> list[tuple[str, str]]:
    """(symbol, pattern) by seq of a dictionary without a scope, which has at most MOST_RULES rules."""
    rows = dictionary.select("seq", "symbol", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a dictionary has at most {MOST_RULES} rules")
    return [(r.symbol, r.pattern) for r in sorted(rows, key=lambda r: r.seq) if r.symbol is not None and r.pattern is not None]


USED = pa.struct([("text", pa.string()), ("used", pa.list_(pa.string()))])


def _substituted(rules: list[tuple[str, str]], text: Column) -> Column:
    """struct(text, used), as ``apply_rules`` gives it. Only a piece of a batch becomes Python objects at once."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = RuleIndex(rules)
        for part in parts:
            for piece in pieces(part):
                done = [index.substitute(t) for t in piece.to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([u for _, u in done], pa.list_(pa.string()))], fields=list(USED))
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, "text string, used array<string>")(text)


def expanded(rules: list[tuple[str, str]], text: Column) -> Column:
    """A text with its symbols expanded, as ``expand_text`` gives it; piece by piece."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = RuleIndex(rules)
        for part in parts:
            for piece in pieces(part):
                yield pa.array([index.expand(t) for t in piece.to_pylist()], pa.string())
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, "string")(text)


def _each(change: Callable[[RuleIndex, str], str], rules: list[tuple[str, str]], texts: Column) -> Column:
    """An array of texts with every one changed by the rules, null staying null; piece by piece."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = RuleIndex(rules)
        for part in parts:
            for piece in pieces(part):
                yield pa.array([None if some is None else [None if t is None else change(index, t) for t in some] for some in piece.to_pylist()], pa.list_(pa.string()))
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, "array<string>")(texts)


def apply_rules(text: Column, rules: Column) -> Column:
    """struct(text, used): each rule in turn replaces its pattern, of 3 characters at least, where that shortens the text."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("used"))
    fires = lambda acc, r: (F.length(r["pattern"]) >= 3) & (F.length(r["pattern"]) > F.length(r["symbol"])) & acc["text"].contains(r["pattern"])
    step = lambda acc, r: F.when(fires(acc, r), F.struct(F.replace(acc["text"], r["pattern"], r["symbol"]).alias("text"), F.array_append(acc["used"], r["symbol"]).alias("used"))).otherwise(acc)
    return F.aggregate(rules, start, step)


def substitute(df: DataFrame, dictionary: DataFrame, scope: list[str] = [], col: str = "text") -> DataFrame:  # noqa: B006
    """Adds compressed_text, used (symbols, in order of use), original_chars and compressed_chars. One dictionary for all
    is routed (``RuleIndex``): a text tries only the rules that it holds. With a scope each row folds its scope's rules."""
    text = X.text_of(F.col(col))
    if scope:
        done = _with_rules(df, dictionary, scope).withColumn("done", apply_rules(text, F.col("rules")))
    else:
        done = df.withColumn("done", _substituted(rule_list(dictionary), text))
    return done.select(*df.columns, F.col("done.text").alias("compressed_text"), F.col("done.used").alias("used"), F.length(text).alias("original_chars"), F.length("done.text").alias("compressed_chars"))


def expand_text(text: Column, rules: Column) -> Column:
    """The rules backwards: the exact inverse where no symbol occurs in texts or patterns."""
    step = lambda acc, r: F.when(acc.contains(r["symbol"]), F.replace(acc, r["symbol"], r["pattern"])).otherwise(acc)
    return F.aggregate(F.reverse(rules), text, step)


def expand(df: DataFrame, dictionary: DataFrame, scope: list[str] = [], col: str = "compressed_text") -> DataFrame:  # noqa: B006
    """Adds expanded_text; routed as C1."""
    text = X.text_of(F.col(col))
    if not scope:
        return df.withColumn("expanded_text", expanded(rule_list(dictionary), text))
    return _with_rules(df, dictionary, scope).withColumn("expanded_text", expand_text(text, F.col("rules"))).drop("rules")


def roundtrip_report(df: DataFrame, dictionary: DataFrame, by: list[str], scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, docs, broken): rows whose expansion isn't their text."""
    both = expand(substitute(df, dictionary, scope), dictionary, scope)
    return both.groupBy(*by).agg(F.count("*").alias("docs"), F.count_if(F.col("expanded_text") != X.text_of(F.col("text"))).alias("broken"))


LINE_COMMENT = r"""^((?:[^"'\\{0}]|\\.|"(?:[^"\\]|\\.)*+"?|'(?:[^'\\]|\\.)*+'?)*+)#.*$"""
SLASH_COMMENT = r"""^((?:[^"'\\/]|/(?!/)|\\.|"(?:[^"\\]|\\.)*+"?|'(?:[^'\\]|\\.)*+'?)*+)//.*$"""
DASH_COMMENT = r"""^((?:[^"'\\-]|-(?!-)|\\.|"(?:[^"\\]|\\.)*+"?|'(?:[^'\\]|\\.)*+'?)*+)--.*$"""


def strip_comments(text: Column, language: Column, min_len: int = 3, sql_comments: bool = False) -> Column:
    """C4: without comments: block comments, then line comments outside quotes; changed lines lose white space at their end,
    and those shorter than ``min_len`` then become empty. Texts of no known language stay."""
    rules = {"#": LINE_COMMENT.replace("{0}", "#"), "//": SLASH_COMMENT, "--": DASH_COMMENT}

    def line(x: Column, mark: str) -> Column:
        bare = F.regexp_replace(F.regexp_replace(x, rules[mark], "$1"), r"\s+$", "")
        return F.when(~F.contains(x, F.lit(mark)), x).when(F.length(X.strip(bare)) < min_len, F.lit("")).otherwise(bare)

    def stripped(blocks: tuple[str, ...], mark: str | None) -> Column:
        out = text
        for b in blocks:
            out = F.regexp_replace(out, b, "")
        return F.array_join(F.transform(F.split(out, "\n"), lambda x: line(x, mark)), "\n") if mark else out

    chain = F.when(F.lit(False), text)
    for name, _, _, blocks, mark in catalogs.LANGUAGES:
        chain = chain.when(language == name, stripped(blocks, "--" if name == "sql" and sql_comments else mark))
    return chain.otherwise(text)


def comment_savings(df: DataFrame, by: list[str], text_col: str = "text", language_col: str = "language") -> DataFrame:
    """(by, docs, original_chars, stripped_chars, saved_chars, saved_tokens, percent)."""
    text = X.text_of(F.col(text_col))
    rows = df.withColumn("stripped", strip_comments(text, F.col(language_col)))
    saved = F.col("original_chars") - F.col("stripped_chars")
    out = rows.groupBy(*by).agg(F.count("*").alias("docs"), F.sum(F.length(text)).alias("original_chars"), F.sum(F.length("stripped")).alias("stripped_chars"), F.sum(X.token_estimate(text) - X.token_estimate(F.col("stripped"))).alias("saved_tokens"))
    return out.withColumn("saved_chars", saved).withColumn("percent", F.round(100 * saved / F.greatest(F.col("original_chars"), F.lit(1)), 2))


def extract_tool_calls(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, call, name, fields, value): JSON objects of a text with a tool's name, over any number of lines and levels:
    fields as strings (nested ones as JSON) and all of it as a VARIANT. Raw line ends and tabs in strings are repaired."""
    rows = df.select(F.col(id_col), F.posexplode(X.tool_objects(X.text_of(F.col(text_col)))).alias("call", "object"))
    rows = rows.withColumn("fields", X.json_fields(F.col("object")))
    name = F.coalesce(*[F.col("fields")[k] for k in catalogs.TOOL_KEYS[:5]])
    value = F.coalesce(F.try_parse_json("object"), F.try_parse_json(X.repaired_json(F.col("object"))))
    return rows.withColumn("name", name).withColumn("value", value).where("name is not null").select(id_col, "call", "name", "fields", "value")


LARGE_FIELDS = ("content", "text", "code", "body", "data", "source", "script", "message", "description", "output", "input", "query", "file", "result")


def substitute_fields(calls: DataFrame, dictionary: DataFrame, min_size: int = 300, compressor: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Calls with ``compressed`` fields: those whose name holds a hint, of ``min_size`` characters and more, where it
    shortens them by a tenth; routed as C1. ``compressor`` (U2): text and rules to text, in place of C1."""
    fits = lambda k, v: F.coalesce(X.contains_any(F.lower(k), LARGE_FIELDS) & (F.length(v) >= min_size), F.lit(False))
    entries = F.map_entries("fields")
    large = F.transform(entries, lambda e: F.when(fits(e["key"], e["value"]), e["value"]))
    if compressor is None:
        rows = calls.withColumn("__small", _each(lambda index, t: index.substitute(t)[0], rule_list(dictionary), large))
    else:
        rows = _with_rules(calls, dictionary, []).withColumn("__small", F.transform(large, lambda v: F.when(v.isNotNull(), compressor(v, F.col("rules"))))).drop("rules")
    better = lambda e, v: F.when(F.length(v) * 10 <= F.length(e["value"]) * 9, v).otherwise(e["value"])
    changed = F.map_from_entries(F.zip_with(F.map_entries("fields"), F.col("__small"), lambda e, v: F.struct(e["key"].alias("key"), better(e, v).alias("value"))))
    return rows.withColumn("compressed", changed).drop("__small")


def expand_fields(calls: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The fields again; routed as C2."""
    texts = _each(lambda index, t: index.expand(t), rule_list(dictionary), F.map_values("compressed"))
    return calls.withColumn("fields", F.map_from_arrays(F.map_keys("compressed"), texts))


def _assigned(mined: DataFrame, pool: DataFrame, scope: list[str], k: int, min_n: int, min_len: int) -> DataFrame:
    """The dictionary of mined patterns with the symbols of a pool that is free."""
    ranked = M.rank_patterns(M.consolidate(M.rank_patterns(mined, scope, k=2 * k, min_n=min_n, min_len=min_len), scope), scope, k=2 * k, min_n=min_n, min_len=min_len)
    own = [c for c in scope if c in pool.columns]
    return settle(D.assign_symbols(ranked, D.rank_symbols(pool, k=k, scope=own), scope, k), "dictionary")


def build_dictionary(df: DataFrame, scope: list[str] = [], k: int = 262, min_n: int = 3, min_len: int = 3, private_use: bool = True, strategies=None) -> DataFrame:  # noqa: B006
    """The dictionary of a table of documents (doc_id, text); with a scope, one for each, with symbols
    that no text of that scope holds."""
    mined = M.best_patterns(df, 2 * k, scope, strategies, min_n=min_n, min_len=min_len)
    pool = settle(D.free_symbols(catalogs.symbol_pool(df.sparkSession, private_use), df, scope=scope, k=k), "pool")
    return _assigned(mined, pool, scope, k, min_n, min_len)


#: Reasons of F6 for which a text is analysed.
OPEN = ("repetitive", "structured", "default")


def compress(df: DataFrame, scope: list[str] = [], threshold: float = 0.01, strip: bool = False, **gate) -> DataFrame:  # noqa: B006
    """C11: documents with compressed_text, accepted, final_text, gate (F6's reason, with its options) and token figures. Texts
    with tool calls or markdown and short ones keep their text; so do those that don't shrink by the threshold."""
    text = X.text_of(F.col("text"))
    rows = df.withColumn("text", strip_comments(text, F.coalesce(X.detect_language(text), F.lit("")))) if strip else df.withColumn("text", text)
    rows = settle(rows.withColumn("gate", gate_reason(F.col("text"), **gate)), "gated")
    held = rows.where(F.col("gate").isin(*OPEN))
    done = substitute(held, build_dictionary(held, scope), scope).drop("used")
    kept = rows.where(~F.col("gate").isin(*OPEN)).withColumn("compressed_text", F.col("text")).withColumn("original_chars", F.length("text")).withColumn("compressed_chars", F.length("text"))
    return D.token_efficiency(D.accept(done.unionByName(kept), threshold))


HISTORY = "pass int, min_n int, min_len int, entries long, changed long, before long, after long"


def compress_multipass(df: DataFrame, passes: int = 3, adaptive: bool = False, min_chars: int = 100, ngrams: tuple[int, ...] = (8, 16, 32), recount: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents after several passes, and their history, a table (pass, min_n, min_len, entries, changed documents,
    characters before and after). Fixed: at most 3 passes, until one gains under 2 %. Adaptive: at most 10, with min_n
    max(2, 3 - p div 3) and min_len max(3, 8 - p), until one gains under 0.5 %, or after the third under 0.1 %. Texts
    shorter than ``min_chars`` stay as they are, and passes end where only such are left.

    Counts of patterns live from pass to pass: those of texts that a pass changed are taken off and those of their new
    texts put on; no other text is mined again. Where the old and new texts together are longer than all texts, these are
    counted anew, which gives the same (``recount``: always). Character n-grams are counted
    anew by each pass, those that can be among its patterns (``best_patterns``): a pass changes most texts, and what changes
    in them would have to go on as text. The pool loses the symbols that a pass used."""
    passes, least = (min(passes, 10), 0.005) if adaptive else (min(passes, 3), 0.02)
    spark = df.sparkSession
    rows = settle(df.withColumn("text", X.text_of(F.col("text"))), "pass")
    long = F.length("text") >= min_chars
    held = lambda text: F.when(F.length(text) >= min_chars, F.col(text)).otherwise(F.lit(""))
    count = lambda some: settle(M.raw_counts(some.where(long)), "counts")
    counts = count(rows)
    pool = settle(D.free_symbols(catalogs.symbol_pool(spark, private_use=True), rows), "pool")
    history: list[tuple] = []
    for p in range(passes):
        min_n, min_len = (max(2, 3 - p // 3), max(3, 8 - p)) if adaptive else (3, 3)
        active = rows.where(long)
        mined = M.best_patterns(active, 2 * 262, counts=counts, min_n=min_n, min_len=min_len, ngrams=ngrams)
        dictionary = _assigned(mined, pool, [], 262, min_n, min_len)
        done = settle(substitute(active, dictionary), "pass")
        sums = done.agg(F.count("*").alias("rows"), F.coalesce(F.sum("original_chars"), F.lit(0)).alias("before"), F.coalesce(F.sum("compressed_chars"), F.lit(0)).alias("after"), F.count_if(F.size("used") > 0).alias("changed"), F.coalesce(F.sum(F.when(F.size("used") > 0, F.col("original_chars") + F.col("compressed_chars"))), F.lit(0)).alias("touched")).first()
        entries = dictionary.count()
        if not sums.rows:
            break
        history.append((p + 1, min_n, min_len, entries, sums.changed, sums.before, sums.after))
        new = done.drop("text").withColumnRenamed("compressed_text", "text").select(*df.columns)
        rows = new.unionByName(rows.where(~long))
        gain = (sums.before - sums.after) / max(sums.before, 1)
        if not entries or gain < least or (adaptive and p >= 3 and gain < 0.001) or p + 1 == passes:
            break
        touched = done.where(F.size("used") > 0)
        if recount or sums.touched > sums.after:
            counts = count(rows)
        else:
            counts = settle(M.add_counts(counts, M.count_changes(touched.select(F.col("text").alias("before"), held("compressed_text").alias("after")))), "counts")
        pool = settle(pool.join(dictionary.select("symbol").hint("shuffle_merge"), "symbol", "left_anti"), "pool")
    return rows, spark.createDataFrame(history, HISTORY)


def renest_content(parts: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts): part arrays (keys, parts) whose text parts take the texts of (keys, idx, text); others stay."""
    rows = parts.select(*keys, F.posexplode("parts").alias("idx", "p")).join(texts.select(*keys, "idx", F.col("text").alias("new")).hint("shuffle_merge"), [*keys, "idx"], "left")
    part = F.when((F.col("p.type") == "text") & F.col("new").isNotNull(), F.col("p").withField("text", F.col("new"))).otherwise(F.col("p"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", part.alias("part")))), lambda x: x["part"]).alias("parts"))


def estimate_ratio(df: DataFrame, dictionary: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ratio: what compression saved, from the compressed text alone, 0 to 1."""
    out = expand(df, dictionary, scope)
    return out.withColumn("ratio", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length("compressed_text") / F.greatest(F.length("expanded_text"), F.lit(1)))), 4))
