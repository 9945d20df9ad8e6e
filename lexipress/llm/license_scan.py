"""License scans by canonical digest lookup, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexipress.llm import licences

#: Spellings that count as the same; the left one is read as the right one.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("artefact", "artifact"), ("authoris", "authoriz"), ("catalogue", "catalog"), ("favour", "favor"), ("https", "http"),
    ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("organis", "organiz"), ("practise", "practice"), ("recognis", "recogniz"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
)
#: In lower case: lines that say who has the copyright, and that rights are reserved.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}©\n]*(copyright[ \t]*(\(c\)|©|[0-9]|by )|\(c\)|©|all rights reserved)[^\n]*"
#: What such a line has in it.
COPYRIGHT_SIGNS: tuple[str, ...] = ("copyright", "(c)", "©", "all rights reserved")
PUNCTUATION = r"[^\p{L}\p{N}]+"
PUNCTUATION_IN_LINES = r"[^\p{L}\p{N}\n]+"
#: Equivalent spellings shorten a text to no less than this share of it (and lengthen it by a sixteenth at most).
SHRINK = 0.75
#: Lengths and first words of known texts filter units where there are at most so many; characters of a unit's start.
FILTER_VALUES, HEAD = 1000, 80
#: A table of known texts of at most this many rows is broadcast.
BROADCAST_ROWS = 100_000


def _plain(text: Column) -> Column:
    """Lower case, without copyright lines, with punctuation other than line ends as one space."""
    low = F.lower(text)
    marked = F.lit(False)
    for sign in COPYRIGHT_SIGNS:
        marked = marked | F.contains(low, F.lit(sign))
    return F.regexp_replace(F.when(marked, F.regexp_replace(low, COPYRIGHT_LINE, "\n")).otherwise(low), PUNCTUATION_IN_LINES, " ")


def _joined(plain: Column) -> Column:
    return F.trim(F.regexp_replace(plain, "[ \n]+", " "))


def _spelled(unit: Column) -> Column:
    for a, b in EQUIVALENT:
        unit = F.replace(unit, F.lit(a), F.lit(b))
    return unit


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as one space, equivalent spellings as one."""
    return _spelled(_joined(_plain(text)))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id, size: characters, head: first word of the canonical text) of the known licences, or of a table
    (license_id, text) in their place."""
    more = known is None
    if more:
        known = spark.createDataFrame([(i, t) for i, _, t in licences.known()], "license_id string, text string")
    texts = known.where("text is not null and license_id is not null").select("license_id", canonical(F.col("text")).alias("t")).where("t <> ''")
    rows = texts.select(F.sha2("t", 256).alias("digest"), "license_id", F.length("t").alias("size"), _head(F.col("t")).alias("head"))
    if more:
        rows = rows.unionByName(spark.createDataFrame([(d, i, n, h) for i, n, h, d in licences.DIGESTS], "digest string, license_id string, size int, head string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("size").alias("size"), F.min("head").alias("head"))


def _head(canon: Column) -> Column:
    return F.substring_index(canon, " ", 1)


def _may_be_known(unit: Column, digests: DataFrame) -> Column:
    """Whether a unit, before equivalent spellings, can be a known text: its length is near one's, and its first word,
    with equivalent spellings (which reach less than HEAD characters), is one's. Nothing known is left out."""
    sizes = [r.size for r in digests.select("size").distinct().orderBy("size").limit(FILTER_VALUES + 1).collect()]
    heads = [r.head for r in digests.select("head").distinct().limit(FILTER_VALUES + 1).collect()]
    fits = F.lit(bool(sizes))
    if 0 < len(sizes) <= FILTER_VALUES:
        spans: list[list[float]] = []
        for n in sizes:
            low, high = n * 15 / 16 - 1, n / SHRINK + 1
            if spans and low <= spans[-1][1]:
                spans[-1][1] = high
            else:
                spans.append([low, high])
        near = F.lit(False)
        for low, high in spans:
            near = near | F.length(unit).between(int(low), int(high))
        fits = fits & near
    if len(heads) <= FILTER_VALUES and max(map(len, heads), default=0) < HEAD // 2:
        fits = fits & _head(_spelled(F.left(unit, F.lit(HEAD)))).isin(heads)
    return fits


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_license, notice_licenses, n_notices), a row per row of ``docs``.

    ``text_license``: the licence whose canonical text the whole document is, else null. ``notice_licenses``: ids of
    the licences that a line of it, as an entire text, is a notice of, in order, joined by commas, else empty;
    ``n_notices``: how many lines. Every text and every line, however long, is normalised and looked up whole.
    Known texts that become equal count for the first id. Null and empty texts find nothing; null ids and repeated
    rows stay rows; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = known_digests(spark, known)
    fits = _may_be_known(F.col("unit"), digests)
    small = digests.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    digests = digests.drop("size", "head")
    digests = F.broadcast(digests) if small else digests.hint("shuffle_merge")
    key = F.xxhash64("id", "text").alias("row")
    unit = lambda whole, text: F.struct(F.lit(whole).alias("whole"), text.alias("unit"))
    units = F.flatten(F.transform(F.array(_plain(F.col("text"))), lambda p: F.concat(F.array(unit(True, _joined(p))), F.transform(F.split(p, "\n"), lambda x: unit(False, F.trim(x))))))
    rows = source.where("text is not null").select("id", key, F.inline(units))
    rows = rows.where("unit <> ''").where(fits)
    rows = rows.select("id", "row", "whole", F.sha2(_spelled(F.col("unit")), 256).alias("digest"))
    hits = rows.join(digests, "digest").groupBy(F.col("row"), F.col("id").alias("hit_id")).agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notice_licenses"),
        F.count_if(~F.col("whole")).alias("n_notices"),
    )
    repeats = source.select("id", key).groupBy("row", "id").agg(F.count("*").alias("times"))
    same = (F.col("h.row") == F.col("s.row")) & F.col("s.id").eqNullSafe(F.col("h.hit_id"))
    found = repeats.alias("s").join(hits.hint("shuffle_merge").alias("h"), same, "left")
    one = found.select(F.col("s.id").alias(id_col), "text_license", F.coalesce("notice_licenses", F.lit("")).alias("notice_licenses"), (F.coalesce("n_notices", F.lit(0)) / F.col("times")).cast("long").alias("n_notices"), "times")
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("copy", "times")


def _sql_canonical(text: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g'), '{PUNCTUATION}', ' ', 'g'))"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({quote(i)}, {quote(t)})" for i, _, t in licences.known())
    digests = ", ".join(f"('{d}', '{i}')" for i, _, _, d in licences.DIGESTS)
    return f"""
with known(license_id, t) as (values {values}),
digests as (select digest, min(license_id) as license_id from (select sha256({_sql_canonical("t")}) as digest, license_id from known union all values {digests}) x group by 1),
units as (
  select doc_id, true as whole, text as unit from documents where text is not null
  union all select doc_id, false, unnest(string_split(text, chr(10))) from documents where text is not null
),
hits as (
  select doc_id, min(case when whole then license_id end) as text_license,
    coalesce(string_agg(distinct case when not whole then license_id end, ',' order by case when not whole then license_id end), '') as notice_licenses,
    count(*) filter (not whole) as n_notices
  from (select doc_id, whole, sha256({_sql_canonical("unit")}) as digest from units) u join digests using (digest)
  group by doc_id
)
select d.doc_id, text_license, coalesce(notice_licenses, '') as notice_licenses, coalesce(n_notices, 0) as n_notices
from documents d left join hits using (doc_id)
"""
