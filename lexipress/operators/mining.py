"""Pattern mining (A*): corpus-wide frequencies per scope as aggregations.

Every operator takes documents with ``id_col`` and ``text_col`` and scope columns (none: the whole corpus). ``n`` is the
number of occurrences and ``df`` that of documents. Counts are partial in each task before the shuffle, so a pattern or
scope that holds a third of all rows doesn't fill a task.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexipress import catalogs
from lexipress.functions import text as X
from lexipress.functions.pieces import Words, newer_letters, pieces
from lexipress.operators.graph import connected_components
from lexipress.operators.ngrams import contexts, gram_changes, mine_char_ngrams, mine_word_ngrams  # noqa: F401
from lexipress.storage import settle


def _counted(df: DataFrame, scope: list[str], items: Column, by: tuple[str, ...] = ("pattern",)) -> DataFrame:
    """(scope, by, n, df) of the items of each row, an array: of strings, or of structs with the fields ``by``.

    A row's items are sorted and its first one of each kind is marked, so that counts of items and of rows with them
    come from one aggregation, which is partial in each task."""
    rows = df.select(*scope, F.sort_array(items).alias("__items"))
    marked = F.transform("__items", lambda x, i: F.struct(x.alias("item"), (~F.get("__items", i - 1).eqNullSafe(x)).cast("int").alias("first")))
    each = rows.select(*scope, F.inline(marked))
    each = each.withColumnRenamed("item", "pattern") if by == ("pattern",) else each.select(*scope, "item.*", "first")
    return each.groupBy(*scope, *by).agg(F.count("*").alias("n"), F.sum("first").alias("df"))


def tokens(text: Column) -> Column:
    """A1's tokens of a text: identifiers of 3 characters and more, and pairs joined by a dot whose left part isn't one."""
    text = X.text_of(text)
    single = F.filter(X.words(text), lambda x: x.rlike(r"^[\p{L}_].{2,}$"))
    dotted = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+"), F.lit(0)), lambda x: ~x.rlike(r"^[\p{L}_][\p{L}\p{N}_]{2,}\."))
    return F.concat(single, dotted)


#: Different tokens that a task counts before it passes them on, and characters of texts, about.
COUNTED_TOKENS, COUNTED_CHARS = 200_000, 1 << 25


def _tokens_of(words: Words, text: str) -> list[str]:
    """Words and pairs of words of a text, of which ``_is_token`` tells those of ``tokens``."""
    found, pairs = words.of(text)
    return found + pairs


def _is_token(x: str) -> bool:
    starts = x[0].isalpha() or x[0] == "_"
    return not starts or x.index(".") < 3 if "." in x else starts and len(x) > 2


SPACE, ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"


def _lines_of(text: str, min_len: int) -> list[str]:
    """``_lines`` in Python. White space is the JVM's, which at a line's end also goes before a line end of Unicode's."""
    out = []
    for x in text.split("\n"):
        bare = x.strip(SPACE)
        if x and x[-1] in ENDS:
            bare = bare[:-1].rstrip(SPACE) + bare[-1]
        if len(bare) >= min_len:
            out.append(bare)
    return out


def _counted_in_tasks(df: DataFrame, scope: list[str], text_col: str, found: Callable[[Words, str], dict[str, list[str]]]) -> DataFrame:
    """(scope, strategy, pattern, n, df) of what each text holds, by strategy; tasks count by scope before the shuffle. What is
    found as a token and isn't one goes when it has been counted, as there are few different ones."""
    texts = df.select(X.text_of(F.col(text_col)).alias("text"), *scope)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    newer = newer_letters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(newer)
        n: dict[tuple, Counter] = {}
        rows: dict[tuple, Counter] = {}
        chars = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for key in n:
                if key[-1] == "token":
                    n[key] = {x: k for x, k in n[key].items() if _is_token(x)}
                cols = [pa.array([x] * len(n[key]), of) for x, of in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n[key].keys(), pa.string()), pa.array(n[key].values(), pa.int64()), pa.array([rows[key][x] for x in n[key]], pa.int64())], names=[*scope, "strategy", "pattern", "n", "df"])
            n.clear()
            rows.clear()

        for batch in batches:
            types = [*(batch.column(1 + i).type for i in range(len(scope))), pa.string()]
            row = 0
            for piece in pieces(batch.column(0)):
                keys = zip(*(batch.column(1 + i).slice(row, len(piece)).to_pylist() for i in range(len(scope))), strict=True) if scope else [()] * len(piece)
                for text, key in zip(piece.to_pylist(), keys, strict=True):
                    for strategy, held in found(words, text).items():
                        n.setdefault((*key, strategy), Counter()).update(held)
                        rows.setdefault((*key, strategy), Counter()).update(set(held))
                    chars += len(text)
                row += len(piece)
                if sum(map(len, n.values())) > COUNTED_TOKENS or chars > COUNTED_CHARS:
                    yield from counted()
                    chars = 0
        yield from counted()

    each = texts.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in scope), "strategy string, pattern string, n long, df long"]))
    return each.groupBy(*scope, "strategy", "pattern").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def mine_tokens(df: DataFrame, scope: list[str] = [], id_col: str = "doc_id", text_col: str = "text", min_n: int = 1) -> DataFrame:  # noqa: B006
    """A1: (scope, pattern, n, df) of ``tokens``, which tasks find and count by scope before the shuffle."""
    return _counted_in_tasks(df, scope, text_col, lambda words, text: {"token": _tokens_of(words, text)}).drop("strategy").where(F.col("n") >= min_n)


def _lines(text: Column, min_len: int) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: F.length(x) >= min_len)


def mine_lines(df: DataFrame, scope: list[str] = [], id_col: str = "doc_id", text_col: str = "text", min_len: int = 3, min_n: int = 2) -> DataFrame:  # noqa: B006
    """A3: (scope, pattern, n, df) of repeated lines, white space at the ends aside."""
    return _counted(df, scope, _lines(X.text_of(F.col(text_col)), min_len)).where(F.col("n") >= min_n)


def line_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lookahead: int = 50, min_len: int = 3) -> DataFrame:
    """A3's other count: (pattern, pairs) of equal lines of a document at most ``lookahead`` lines apart."""
    rows = df.select(id_col, F.posexplode(F.split(X.text_of(F.col(text_col)), "\n")).alias("pos", "line")).select(id_col, "pos", X.strip(F.col("line")).alias("pattern")).where(F.length("pattern") >= min_len)
    w = Window.partitionBy(id_col, "pattern").orderBy("pos").rangeBetween(1, lookahead)
    return rows.withColumn("later", F.count("*").over(w)).groupBy("pattern").agg(F.sum("later").alias("pairs")).where("pairs > 0")


def literal_of(pattern: str) -> str:
    """The longest plain text that every match of a pattern holds, "" if there is none: runs of characters that are neither
    optional nor in a class or group."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            return ""
        if c in "[(":  # a class or group: anything may stand there
            depth, opened = 1, c
            while depth:
                i += 1
                if pattern[i] == "\\":
                    i += 1
                elif opened == "(" and pattern[i] == "(":
                    depth += 1
                elif pattern[i] == ("]" if opened == "[" else ")"):
                    depth -= 1
            run, runs = "", [*runs, run]
        elif c in "?*{":  # what stands before it may be absent
            run, runs = "", [*runs, run[:-1]]
            i = pattern.index("}", i) if c == "{" else i
        elif c in ".^$+" or (c == "\\" and pattern[i + 1].isalnum()):
            run, runs = "", [*runs, run]
            if c == "\\":
                i = pattern.index("}", i) if pattern[i + 1] == "p" else i + 1
        else:
            i += c == "\\"
            run += pattern[i]
        i += 1
    return max([*runs, run], key=len)


def _constructs(text: Column, simple: bool = False) -> Column:
    """Array of (kind, pattern) of a text's code constructs: a fold over the catalog, an array of rules. A text is scanned
    for a rule only where it holds the rule's plain part."""
    listed = [{"kind": kind, "p": p, "part": literal_of(p), "lo": lo, "hi": hi} for kind, p, lo, hi in (catalogs.SIMPLE_CODE_PATTERNS if simple else catalogs.CODE_PATTERNS)]
    rules = F.from_json(F.lit(json.dumps(listed)), "array<struct<kind:string,p:string,part:string,lo:int,hi:int>>")  # one constant
    fit = lambda r: F.filter(F.regexp_extract_all(text, r["p"], F.lit(0)), lambda m: F.length(m).between(r["lo"], r["hi"]))
    return F.flatten(F.transform(F.filter(rules, lambda r: F.contains(text, r["part"])), lambda r: F.transform(fit(r), lambda m: F.struct(r["kind"].alias("kind"), m.alias("pattern")))))


def mine_code(df: DataFrame, scope: list[str] = [], id_col: str = "doc_id", text_col: str = "text", simple: bool = False, min_n: int = 2) -> DataFrame:  # noqa: B006
    """(scope, kind, pattern, n, df) of code constructs of the catalog, all in one pass over the texts."""
    return _counted(df, scope, _constructs(X.text_of(F.col(text_col)), simple), ("kind", "pattern")).where(F.col("n") >= min_n)


TEMPLATES = (("call", r"([A-Za-z0-9_]+)\(([^()\n]{1,100})\)", "{}({{}})"), ("subscript", r"([A-Za-z0-9_]+)\[([^\[\]\n]{1,50})\]", "{}[{{}}]"), ("logger", r"((?:logger|log)\.[a-z]+)\(([^()\n]{11,119})\)", "{}({{}})"))


def _instances(text: Column) -> Column:
    """Array of (kind, template, instance) of a text's parameterized constructs."""

    def found(kind: str, p: str, form: str) -> Column:
        stems, whole = F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(0))
        head, tail = form.split("{}", 1)
        template = lambda s: F.concat(F.lit(head), s, F.lit(tail.replace("{{}}", "{}")))
        return F.zip_with(stems, whole, lambda s, m: F.struct(F.lit(kind).alias("kind"), template(s).alias("template"), m.alias("instance")))

    return F.concat(*[found(*rule) for rule in TEMPLATES])


def _worth(templates: DataFrame, min_n: int) -> DataFrame:
    """Templates (kind, template, n, total_len) with their savings, where these are above 0."""
    size = F.length("template")
    saved = F.greatest(F.lit(0), F.col("total_len") - size * F.col("n")) - (size + F.lit(len("=SYMBOL, ")))
    return templates.where((F.col("n") >= min_n) & (size >= 8)).withColumn("savings", saved).where("savings > 0")


def mine_templates(df: DataFrame, scope: list[str] = [], id_col: str = "doc_id", text_col: str = "text", min_n: int = 3) -> DataFrame:  # noqa: B006
    """(scope, kind, template, n, total_len, savings): calls, subscripts and log calls grouped by what stands before
    the parameter; savings = (mean length - template length) * n - the entry's own cost, where that's above 0."""
    rows = df.select(*scope, F.inline(_instances(X.text_of(F.col(text_col)))))
    return _worth(rows.groupBy(*scope, "kind", "template").agg(F.count("*").alias("n"), F.sum(F.length("instance")).alias("total_len")), min_n)


def _shown(instances: DataFrame, templates: DataFrame, k: int, scope: list[str]) -> DataFrame:
    """Templates, and of their instances (kind, template, pattern, n) the k most frequent of at least max(2, n div 4)."""
    keys = [*scope, "kind", "template"]
    least = templates.select(*keys, F.greatest(F.lit(2), F.floor(F.col("n") / 4)).alias("least"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "pattern"))
    top = instances.join(least.hint("shuffle_merge"), keys).where("n >= least").withColumn("r", rank).where(F.col("r") <= k)
    return templates.select(*keys, F.col("template").alias("pattern"), "n").unionByName(top.select(*keys, "pattern", "n"))


def expand_templates(df: DataFrame, templates: DataFrame, text_col: str = "text", k: int = 3, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, kind, template, pattern, n): each template, and its k most frequent instances of at least max(2, n div 4)."""
    rows = df.select(*scope, F.inline(_instances(X.text_of(F.col(text_col)))))
    return _shown(rows.groupBy(*scope, "kind", "template", F.col("instance").alias("pattern")).agg(F.count("*").alias("n")), templates, k, scope)


def rank_patterns(patterns: DataFrame, scope: list[str] = [], k: int | None = None, min_n: int = 3, min_len: int = 3) -> DataFrame:  # noqa: B006
    """Adds value = n * length and rank: frequent, long enough patterns of quality, best first, ties by pattern."""
    good = patterns.where((F.col("n") >= min_n) & (F.length("pattern") >= min_len)).where(X.quality(F.col("pattern"))).withColumn("value", F.col("n") * F.length("pattern"))
    order = [F.col("value").desc(), F.col("pattern")]
    if k is not None and not scope:
        good = good.orderBy(*order).limit(k)  # a bounded report; ranks below are within it
    if k is None and not scope:
        return _ranked_in_parts(good, order)
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _ranked_in_parts(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank over all rows: ranges of the order rank their own, then add what is in ranges before (a row a range)."""
    parts = settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return inner.join(F.broadcast(sizes.select("part", "before")), "part").withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).drop("part", "before")


def merge_whitespace(patterns: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """A10: patterns that differ in white space at the ends become one: counts add up, the best variant stands for them."""
    best = F.max_by("pattern", F.struct("n", F.length("pattern"), "pattern"))
    return patterns.groupBy(*scope, X.strip(F.col("pattern")).alias("bare")).agg(best.alias("pattern"), F.sum("n").alias("n"), F.max("df").alias("df")).drop("bare")


#: Lengths of the beginnings by which patterns meet longer ones: a pattern has its longest such beginning in common with
#: all that hold it, and little of it is left to differ.
BEGINNINGS = (4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32)


def _met(rows: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, inner, inner_n, outer, outer_n): patterns of 4 characters and more, and those that hold their longest beginning
    of BEGINNINGS: few that don't hold the pattern."""
    text, size = F.col("pattern"), F.length("pattern")
    starts = lambda k: F.when(size > k, F.transform(F.sequence(F.lit(1), size - F.lit(k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    own = reduce(lambda c, k: c.when(size >= k, F.left(text, F.lit(k))), reversed(BEGINNINGS[:-1]), F.when(size >= BEGINNINGS[-1], F.left(text, F.lit(BEGINNINGS[-1]))))
    inner = rows.where(size >= 4).select(*scope, text.alias("inner"), F.col("n").alias("inner_n"), own.alias("key"))
    outer = rows.where(size >= 5).select(*scope, text.alias("outer"), F.col("n").alias("outer_n"), F.explode(F.array_distinct(F.concat(*[starts(k) for k in BEGINNINGS]))).alias("key"))
    return inner.join(outer.hint("shuffle_merge"), [*scope, "key"]).drop("key")


def _inside(rows: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, inner, inner_n, outer, outer_n): patterns of 4 characters and more inside longer ones."""
    return _met(rows, scope).where((F.length("outer") > F.length("inner")) & F.col("outer").contains(F.col("inner")))


def resolve_containment(patterns: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """A pattern inside a longer one goes, and its count with it to the longest such one, unless it's over twice as
    frequent. Lists of any length: patterns meet longer ones by a join on their first characters."""
    rows = settle(patterns.select(*scope, "pattern", "n"), "ranked")
    inside = _inside(rows, scope).where(F.col("inner_n") <= 2 * F.col("outer_n"))
    home = inside.groupBy(*scope, "inner", "inner_n").agg(F.min_by("outer", F.struct(-F.length("outer"), "outer")).alias("outer"))
    gain = home.groupBy(*scope, F.col("outer").alias("pattern")).agg(F.sum("inner_n").alias("gain"))
    gone = home.select(*scope, F.col("inner").alias("pattern"))
    kept = rows.join(gone.hint("shuffle_merge"), [*scope, "pattern"], "left_anti").join(gain.hint("shuffle_merge"), [*scope, "pattern"], "left")
    return kept.select(*scope, "pattern", (F.col("n") + F.coalesce("gain", F.lit(0))).alias("n"))


def merge_similar(patterns: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Patterns of similar length (30 %) and characters (Jaccard over 0.7; 0.8 for short ones) join the best-ranked
    similar pattern that itself joins none. Patterns meet in a band of lengths by one of their rarest characters: two sets
    of which over 0.7 is shared have one of the first floor(0.3 * size) + 1 of both in common."""
    chars = F.array_distinct(F.filter(F.split(F.lower("pattern"), ""), lambda x: x != ""))
    order = F.struct(-F.col("n") * F.length("pattern"), F.col("pattern"))
    band = F.floor(F.log(F.length("pattern").cast("double")) / F.log(F.lit(1.5))).cast("int")
    base = settle(patterns.select(*scope, "pattern", "n", chars.alias("chars"), F.length("pattern").alias("len"), order.alias("o"), band.alias("band")), "similar")
    seen = base.select(F.explode("chars").alias("c")).groupBy("c").agg(F.count("*").alias("k"))  # a row a character in use
    rarity = seen.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("rarity"))
    first = F.slice(F.array_intersect("rarity", "chars"), 1, F.ceil(F.size("chars") * 0.3 + 1e-9).cast("int"))
    rows = base.join(F.broadcast(rarity)).withColumn("key", F.explode(first)).drop("rarity")  # one row
    other = rows.select(*scope, "key", *[F.col(c).alias(f"{c}2") for c in ("pattern", "chars", "len", "o")], F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    jaccard = F.size(F.array_intersect("chars", "chars2")) / F.size(F.array_union("chars", "chars2"))
    most = F.greatest("len", "len2")
    near = rows.join(other.hint("shuffle_merge"), [*scope, "band", "key"]).where((F.col("o2") < F.col("o")) & (F.abs(F.col("len") - F.col("len2")) <= 0.3 * most) & (jaccard > F.when(most < 10, 0.8).otherwise(0.7)))
    joined = near.select(*scope, "pattern").distinct()
    homes = near.join(joined.select(*scope, F.col("pattern").alias("pattern2")).hint("shuffle_merge"), [*scope, "pattern2"], "left_anti")
    home = homes.groupBy(*scope, "pattern").agg(F.min_by("pattern2", "o2").alias("home"))
    return base.select(*scope, "pattern", "n").join(home.hint("shuffle_merge"), [*scope, "pattern"], "left").groupBy(*scope, F.coalesce("home", "pattern").alias("pattern")).agg(F.sum("n").alias("n"))


def scope_entropy(df: DataFrame, scope: list[str] = [], id_col: str = "doc_id", text_col: str = "text", chars: int = 1000) -> DataFrame:  # noqa: B006
    """(scope, entropy) of the first characters of each scope's first text that isn't empty, by id: what A14 compares with."""
    head = F.left(X.text_of(F.col(text_col)), F.lit(chars))
    first = df.where(head != "").groupBy(*scope).agg(F.min_by(head, F.struct(id_col, head)).alias("head"))
    return X.char_entropy(first.where("head is not null"), "head", scope)


def filter_entropy(patterns: DataFrame, entropy: DataFrame, least: float = 0.3, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds entropy; patterns whose characters' entropy is at least a share of their scope's: of ``scope_entropy``'s rows
    (scope, entropy), or without a scope the mean over the rows given. Patterns of scopes without a row stay."""
    own = X.char_entropy(patterns.select("pattern").distinct().withColumn("p", F.col("pattern")), "p", ["pattern"])
    rows = patterns.join(own.hint("shuffle_merge"), "pattern")
    base = entropy.groupBy(*scope).agg(F.avg("entropy").alias("base"))
    both = rows.join(base.hint("shuffle_merge"), scope, "left") if scope else rows.join(F.broadcast(base))  # one row
    return both.where(F.col("entropy") >= least * F.coalesce("base", F.lit(0.0))).select(*patterns.columns, "entropy")


def structural_score(col: Column) -> Column:
    """+0.4 constructs, +0.3 formatting, +0.3 calls, -0.3 for what is particular to one text; from 0 to 1."""
    score = (
        F.when(col.rlike(r"\b(def|class|import|return|if|for|while|function)\b"), 4).otherwise(0) + F.when(col.rlike(r"[:;{}\[\]]|\n"), 3).otherwise(0)
        + F.when(col.rlike(r"[A-Za-z0-9_]\("), 3).otherwise(0) - F.when(col.rlike(r"[0-9]{3,}|@|https?:"), 3).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(10), score)) / F.lit(10.0)


def similar_patterns(patterns: DataFrame, eps: float = 0.5) -> DataFrame:
    """(src, dst, cosine): pairs of patterns (id, pattern) whose character 2- to 4-gram TF-IDF vectors are within ``eps``
    cosine distance, all of them.

    A vector's grams are put in order of rarity; what follows the first grams has a length below 1 - eps, so a pair that
    shares none of the first grams of both can't reach it. Pairs that do are summed over all their common grams."""
    least = 1 - eps
    gram = lambda k: F.regexp_extract_all(F.lower("pattern"), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    tf = settle(patterns.select("id", F.explode(F.concat(gram(2), gram(3), gram(4))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf")), "grams")
    total = tf.select("id").distinct().count()
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    w = tf.join(df.hint("shuffle_merge"), "gram").withColumn("w", F.col("tf") * (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0))
    whole = Window.partitionBy("id")
    rare = whole.orderBy(F.col("df").desc(), F.col("gram").desc()).rowsBetween(Window.unboundedPreceding, 0)
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))
    unit = settle(unit.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rare))).select("id", "gram", "w", "rest"), "vectors")
    first = unit.where(F.col("rest") >= least - 1e-9)  # the gram and all more common ones still reach the threshold
    met = first.select("gram", F.col("id").alias("src")).join(first.select("gram", F.col("id").alias("dst")).hint("shuffle_merge"), "gram").where("src < dst").select("src", "dst").distinct()
    a, b = unit.select(F.col("id").alias("src"), "gram", F.col("w").alias("w1")), unit.select(F.col("id").alias("dst"), "gram", F.col("w").alias("w2"))
    both = settle(met, "met").join(a.hint("shuffle_merge"), "src").join(b.hint("shuffle_merge"), ["dst", "gram"])
    return both.groupBy("src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).alias("cosine")).where(F.col("cosine") >= least)


def cluster_patterns(patterns: DataFrame, eps: float = 0.5) -> DataFrame:
    """(cluster pattern, size, n, confidence): patterns whose character 2- to 4-gram TF-IDF vectors are within ``eps``
    cosine distance, closed transitively (density clusters of at least 2 are these components); the most frequent stands
    for its cluster, confidence is its share of all patterns."""
    rows = settle(patterns.groupBy("pattern").agg(F.sum("n").alias("n")).where(F.length("pattern") >= 4).withColumn("id", F.xxhash64("pattern")), "to-cluster")
    comp = connected_components(similar_patterns(rows, eps).select("src", "dst")).withColumnRenamed("node", "id")
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    joined = rows.join(comp.hint("shuffle_merge"), "id").groupBy("component").agg(F.max_by("pattern", F.struct("n", "pattern")).alias("pattern"), F.count("*").alias("size"), F.sum("n").alias("n"))
    return joined.join(total).select("pattern", "size", "n", (F.col("size") / F.col("total")).alias("confidence"))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """One row a pattern, without those inside a longer one of the list (a ranked list), quality = .3 confidence + .4 structure + .2 min(1, n/10) + .1 min(1, entropy/5), best first."""
    one = candidates.groupBy("pattern").agg(F.max("n").alias("n"), F.max("confidence").alias("confidence"), F.max("entropy").alias("entropy"))
    score = 0.3 * F.col("confidence") + 0.4 * structural_score(F.col("pattern")) + 0.2 * F.least(F.lit(1.0), F.col("n") / 10) + 0.1 * F.least(F.lit(1.0), F.col("entropy") / 5)
    gone = _inside(one).select(F.col("inner").alias("pattern")).distinct()
    return one.join(gone.hint("shuffle_merge"), "pattern", "left_anti").withColumn("quality", F.round(score, 4))


def chunk_text(df: DataFrame, size: int = 2000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start from 1, chunk): overlapping pieces of each text."""
    text = X.text_of(F.col(text_col))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(size - overlap))
    return df.select(id_col, text.alias("t"), F.explode(starts).alias("start")).select(id_col, "start", F.substring(F.col("t"), F.col("start"), F.lit(size)).alias("chunk"))


def _built(text: Column) -> Column:
    """Array of (strategy, kind, template, pattern) of a text's constructs and templates' instances."""
    item = lambda strategy, kind, template, x: F.struct(F.lit(strategy).alias("strategy"), kind.alias("kind"), template.alias("template"), x.alias("pattern"))
    code = F.transform(_constructs(text), lambda x: item("code", x["kind"], F.lit(None).cast("string"), x["pattern"]))
    return F.concat(code, F.transform(_instances(text), lambda x: item("instance", x["kind"], x["template"], x["instance"])))


COUNT_KEYS = ("strategy", "kind", "template", "pattern")


def raw_counts(df: DataFrame, scope: list[str] = [], text_col: str = "text") -> DataFrame:  # noqa: B006
    """(scope, strategy, kind, template, pattern, n, df): all that A20 counts but n-grams, without thresholds: tokens and lines of
    all texts, which tasks count, constructs and templates' instances of those that look like code."""
    none = F.lit(None).cast("string")
    plain = _counted_in_tasks(df, scope, text_col, lambda words, text: {"token": _tokens_of(words, text), "line": _lines_of(text, 3)})
    code = df.where(X.looks_like_code(F.col(text_col)))
    return plain.select(*scope, "strategy", none.alias("kind"), none.alias("template"), "pattern", "n", "df").unionByName(_counted(code, scope, _built(X.text_of(F.col(text_col))), COUNT_KEYS))


def count_changes(texts: DataFrame, ngrams: tuple[int, ...] = ()) -> DataFrame:
    """(strategy, kind, template, pattern, n, df): by how much ``raw_counts``, with character n-grams of ``ngrams`` lengths,
    change if texts (before, after) do; null before: a text that is new."""
    off = raw_counts(texts.select("before").where("before is not null"), text_col="before").withColumn("n", -F.col("n")).withColumn("df", -F.col("df"))
    parts = [off, raw_counts(texts.select("after"), text_col="after")]
    if ngrams:
        none = F.lit(None).cast("string")
        parts.append(gram_changes(texts, ngrams).select(F.concat(F.lit("gram"), F.col("length").cast("string")).alias("strategy"), none.alias("kind"), none.alias("template"), "pattern", "n", "df"))
    return reduce(DataFrame.unionByName, parts)


def add_counts(*parts: DataFrame) -> DataFrame:
    """Counts and changes of counts added up."""
    return reduce(DataFrame.unionByName, parts).groupBy(*COUNT_KEYS).agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where("n <> 0")


def patterns_of(counts: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """(scope, pattern, n, df) that A20 takes from ``raw_counts``: tokens; lines, constructs and n-grams that come twice; templates
    worth an entry, and their most frequent instances."""
    some = lambda *which: counts.where(F.col("strategy").isin(*which))
    grams = counts.where(F.startswith("strategy", F.lit("gram")) & (F.col("n") >= 2) & X.meaningful(F.col("pattern")))
    twice = some("line", "code").where("n >= 2")
    instances = some("instance").select(*scope, "kind", "template", F.col("pattern").alias("instance"), "n")
    templates = _worth(instances.groupBy(*scope, "kind", "template").agg(F.sum("n").alias("n"), F.sum(F.length("instance") * F.col("n")).alias("total_len")), 3)
    shown = _shown(instances.select(*scope, "kind", "template", F.col("instance").alias("pattern"), "n"), templates, 3, scope).withColumn("df", F.lit(None).cast("long"))
    return reduce(DataFrame.unionByName, [x.select(*scope, "pattern", "n", "df") for x in (some("token"), twice, grams, shown)])


def mine_patterns(df: DataFrame, scope: list[str] = [], id_col: str = "doc_id", text_col: str = "text", strategies=None, min_n: int = 3, ngrams: tuple[int, ...] = (8, 16, 32), only: bool = False) -> DataFrame:  # noqa: B006
    """(scope, pattern, n, df): tokens, character n-grams, lines, code constructs and templates' instances (of texts
    that look like code), and what further strategies (U3: DataFrame to rows (scope, pattern, n, df)) find; counts of a
    pattern add up, df is the largest. ``only``: the further strategies alone."""
    found = [s(df) for s in strategies or ()]
    if not only:
        found.append(patterns_of(settle(raw_counts(df, scope, text_col), "raw-counts"), scope))
        if ngrams:
            found.append(mine_char_ngrams(df, ngrams, scope, id_col, text_col))
    return sum_patterns(reduce(DataFrame.unionByName, [f.select(*scope, "pattern", "n", "df") for f in found]), scope, min_n)


def best_patterns(df: DataFrame, k: int, scope: list[str] = [], strategies=None, counts: DataFrame | None = None, min_n: int = 3, min_len: int = 3, ngrams: tuple[int, ...] = (8, 16, 32)) -> DataFrame:  # noqa: B006
    """Rows of ``mine_patterns`` among which are the k best of ``rank_patterns`` with their exact counts; ``counts``:
    ``raw_counts``, where they are known.

    What the k-th best is worth without character n-grams (A2) is a bound: a pattern of the k best with them is worth that or
    more, and so half of it by n-grams or half by the others. Only n-grams that can be are counted. With a scope all are."""
    if scope:
        return mine_patterns(df, scope, strategies=strategies, min_n=min_n, ngrams=ngrams)
    found = [*(s(df).select("pattern", "n", "df") for s in strategies or ()), patterns_of(settle(raw_counts(df), "raw-counts") if counts is None else counts)]
    plain = sum_patterns(reduce(DataFrame.unionByName, found), min_n=1)
    if not ngrams:
        return plain.where(F.col("n") >= min_n)
    plain = settle(plain, "patterns")
    last = rank_patterns(plain, k=k, min_n=min_n, min_len=min_len).agg(F.count("*").alias("rows"), F.min("value").alias("value")).first()
    worth = last["value"] if last["rows"] == k else 0
    known = plain.where(F.length("pattern").isin(*ngrams) & (2 * F.col("n") * F.length("pattern") >= worth))
    return sum_patterns(plain.unionByName(mine_char_ngrams(df, ngrams, worth=worth, known=known)), min_n=min_n)


def sum_patterns(rows: DataFrame, scope: list[str] = [], min_n: int = 3) -> DataFrame:  # noqa: B006
    """(scope, pattern, n, df): counts of a pattern from several strategies add up, df is the largest."""
    return rows.groupBy(*scope, "pattern").agg(F.sum("n").alias("n"), F.max("df").alias("df")).where(F.col("n") >= min_n)


def consolidate(ranked: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """A10 to A12 on a ranked list: (scope, pattern, n) without variants in white space, contained and similar patterns."""
    return merge_similar(resolve_containment(merge_whitespace(ranked, scope), scope), scope)
