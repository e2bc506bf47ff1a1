"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. Each benchmark item is cut into windows of 13
consecutive words (an item with fewer words, but not none, is one window). A document contains a window only if it contains all of
the window's words, so the prefix of one token is enough to find it: the words of a window are ordered by rarity over all documents
and the rarest is joined with the documents' word positions. The token's place in its window bounds where the window starts and the
document's length where it ends; candidates within these bounds are compared word by word.

The join table has one row per distinct window, without the items that hold it: these are joined with the windows that were found. Up to `broadcast_windows` windows, and BROADCAST_BYTES of
them, it is broadcast; beyond that only the positions of prefix words are shuffled by word, each with the words around it. Up to `broadcast_tokens` of these words (and as many bytes) a broadcast sifts
the positions; beyond that they are joined without their texts first.

Edge cases: null or empty texts have no words (n_words 0, n_hit 0, not contaminated); items without words have no windows; an empty
benchmark leaves every document clean; every input row gives one output row and is judged by itself, whether or not other rows have its id (null included); texts of any length
are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Each window holds 13 words: this many take some tens of MB.
BROADCAST_WINDOWS = 100_000
#: Words may be of any length, so their bytes are counted as well.
BROADCAST_BYTES = 48 << 20
#: Words of a dozen bytes: as many take less than 100 MB.
BROADCAST_TOKENS = 500_000
#: Names a row's id and text.
KEY = ["k1", "k2"]
#: Names a window.
NAME = ["w1", "w2"]


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 1)


def raw_words(text: Column) -> Column:
    """The words as written, perhaps with one empty string before the first and one after the last; split is the cheapest way to get them."""
    return F.split(F.coalesce(text, F.lit("")), NOT_WORD)


def n_words(w: Column) -> Column:
    """The number of words in what raw_words() gives."""
    n = F.size(w)
    return (n - (F.element_at(w, 1) == "").cast("int") - ((n > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long")


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """win array<string>, w1, w2 (hashes that name it), item: each window of each item once."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w")).filter(F.size("w") > 0)
    at = items.withColumn("s", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))))
    text = F.array_join("win", " ")
    return at.select(F.slice("w", F.col("s"), window).alias("win"), "item").select("win", F.xxhash64(text).alias("w1"), F.xxhash64(F.lit(7), text).alias("w2"), "item").distinct()


def bounded(df: DataFrame, rows: int, size: Column) -> bool:
    """Whether a table has so many rows at most, and BROADCAST_BYTES."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return seen.n <= rows and seen.bytes <= BROADCAST_BYTES


def prefixes(docs: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """Each window (win, w1, w2) with its rarest word (tok) and that word's place (off) in it. Rarity counts all words of all documents.

    Here tok is in lower case throughout, not only A-Z: equal words stay equal, and the full comparison comes later.
    """
    hint = F.broadcast if small else (lambda df: df)
    tokens = wins.select(*NAME, F.posexplode("win").alias("off", "tok")).withColumn("tok", F.lower("tok"))
    seen = docs.select(F.explode_outer("w").alias("tok")).select(F.lower("tok").alias("tok")).join(hint(tokens.select("tok").distinct()), "tok").groupBy("tok").agg(F.count("*").alias("n"))
    ranked = tokens.join(seen, "tok", "left").groupBy(*NAME).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok", "off")).alias("p"))
    return wins.join(ranked, NAME).filter("p.n > 0").select("win", *NAME, F.col("p.tok").alias("tok"), F.col("p.off").alias("off"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_tokens: int = BROADCAST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Every occurrence of a window: k1, k2, start (in raw_words), len, w1, w2; and the windows' items: w1, w2, item. docs: k1, k2, w (raw_words)."""
    held = common.written(windows(benchmark, window), "windows")
    wins = held.select("win", *NAME).dropDuplicates(NAME)
    small = bounded(wins, broadcast_windows, F.octet_length(F.array_join("win", " ")))
    keys = common.written(prefixes(docs, wins, small), "prefixes")
    start, size = F.col("pos") - F.col("off"), F.size("win")

    def spots(*columns: str) -> DataFrame:
        # the outer form: else a filter would split every text twice
        return docs.select(*columns, F.posexplode_outer("w").alias("pos", "tok")).withColumn("tok", F.lower("tok"))

    def same(words: Column, at: Column) -> Column:
        return F.translate(F.array_join(F.slice(words, at + 1, size), " "), UPPER, LOWER) == F.array_join("win", " ")

    if small:
        found = spots(*KEY, "w").join(F.broadcast(keys), "tok").filter((start >= 0) & (start + size <= F.size("w"))).filter(same(F.col("w"), start))
    else:
        tokens = common.written(keys.select("tok").distinct(), "prefix-tokens")
        if bounded(tokens, broadcast_tokens, F.octet_length("tok")):
            sifted = spots(*KEY, "w").join(F.broadcast(tokens), "tok", "left_semi")
        else:
            sifted = spots(*KEY).join(tokens, "tok", "left_semi").join(docs.dropDuplicates(KEY), KEY)
        first = F.greatest(F.col("pos") - (window - 1), F.lit(0))
        near = sifted.select(*KEY, "pos", "tok", first.alias("first"), F.slice("w", first + 1, 2 * window - 1).alias("near"))
        at = start - F.col("first")
        found = near.join(keys, "tok").filter((at >= 0) & (at + size <= F.size("near"))).filter(same(F.col("near"), at))
    return found.select(*KEY, start.alias("start"), size.alias("len"), *NAME), held.select(*NAME, "item")


def key(id_: Column, text: Column) -> list[Column]:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(F.lit(7), id_, text).alias("k2")]


def judged(base: DataFrame, benchmark: DataFrame, window: int, percent: int, **options) -> DataFrame:
    """base (k1, k2, w and more) with n_words, n_hit, n_items, items, contaminated in place of w."""
    found, items_of = hits(base.select(*KEY, "w"), benchmark, window, **options)
    found = common.written(found, "window-hits")
    covered = found.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    named = found.select(*KEY, *NAME).distinct().join(items_of, NAME).select(*KEY, "item").distinct()
    counted = covered.groupBy(*KEY).agg(F.count("*").alias("n_hit")).join(named.groupBy(*KEY).agg(F.array_sort(F.collect_list("item")).alias("items")), KEY)
    sizes = base.withColumn("n_words", n_words(F.col("w"))).drop("w")
    all_docs = sizes.join(counted, KEY, "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    rest = [c for c in sizes.columns if c not in KEY]
    return all_docs.select(*KEY, *rest, n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    percent: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    **options,
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items (sorted as strings), contaminated (at least `percent` of the words hit)."""
    base = documents.select(F.col(id_col).alias("doc_id"), *key(F.col(id_col), F.col(text_col)), raw_words(F.col(text_col).cast("string")).alias("w"))
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    return judged(base, bench, window, percent, **options).drop(*KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, list_slice(w, s, s + 12) AS win FROM b, range(1, greatest(len(w) - 12, 1) + 1) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS k FROM wins),
spot AS (SELECT r, s, list_slice(w, s, s + k - 1) AS win FROM d, sizes, range(1, greatest(len(w) - k + 1, 0) + 1) t(s)),
hit AS (SELECT spot.r, spot.s, len(spot.win) AS k, item FROM spot JOIN wins USING (win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, range(s, s + k) t(p) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns."""
    k1, k2 = key(F.col(id_col), F.col(text_col))
    base = documents.select(k1, k2, raw_words(F.col(text_col).cast("string")).alias("w"))
    gone = judged(base, benchmark, window, percent, **options).filter("contaminated").select(F.col("k1").alias("g1"), F.col("k2").alias("g2")).distinct()
    keyed = documents.select("*", k1.alias("__k1"), k2.alias("__k2"))
    return keyed.join(gone, (F.col("__k1") == F.col("g1")) & (F.col("__k2") == F.col("g2")), "left_anti").drop("__k1", "__k2")
