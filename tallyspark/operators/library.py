"""Library queries: faceted filters, relevance, sorts, group collapse, facet counts. Rows carry pos, their place in the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import search_normal
from tallyspark.operators.ordering import first

# Difficulty names in order; anything else is unknown.
DIFFICULTY = {"Basic": 0, "Easy": 1, "Medium": 2, "Moderate": 2, "Hard": 3, "Difficult": 3, "Ninja": 4, "Expert": 4, "Unknown": 5}


def text_match(fields: Column, query: str) -> Column:
    """Whether one field holds every term of the query as a substring."""
    terms = [w for w in query.split() if w]
    return F.exists(F.transform(fields, search_normal), lambda f: F.forall(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>"), lambda w: F.contains(f, w)))


def relevance(title: Column, native_id: Column, query: str) -> Column:
    """0 exact title or id, 1 beginning, 2 inside, 3 all terms in the title, 4 other."""
    title = search_normal(title)
    all_terms = F.lit(True)
    for term in query.split():
        all_terms = all_terms & title.contains(term)
    return F.when((title == query) | (search_normal(native_id) == query), 0).when(title.startswith(query), 1).when(title.contains(query), 2).when(all_terms, 3).otherwise(4)


def natural_key(title: Column) -> Column:
    """A sort key in which runs of digits, however long, compare as numbers: each becomes its length without leading zeros, in ten digits, and the digits."""
    parts = F.regexp_extract_all(F.lower(title), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)), "")


def difficulty_rank(difficulty: Column, hardest_first: bool = False) -> Column:
    """Unknown comes last in both directions."""
    table = F.create_map(*[F.lit(x) for pair in DIFFICULTY.items() for x in pair])
    rank = F.coalesce(F.element_at(table, difficulty), F.lit(5))
    return F.when(rank == 5, 5).otherwise(-rank if hardest_first else rank)


def in_group(df: DataFrame, keys: DataFrame, keep: bool) -> DataFrame:
    """Rows whose group (canonical_id, or the row itself) has a version among keys - or has none."""
    group = F.coalesce("canonical_id", "key")
    hit = df.join(keys.select("key").distinct(), "key", "left_semi").select(group.alias("g")).distinct()
    return df.join(hit, group == F.col("g"), "left_semi" if keep else "left_anti")


def filter_library(df: DataFrame, accounts: DataFrame | None = None, platform: str | None = None, difficulty: str | None = None, topics: list[str] = (), access: str = "all", query: str = "", status: str = "all", solved: DataFrame | None = None, starred: DataFrame | None = None) -> DataFrame:
    """Rows on connected platforms that pass every facet; statuses look at all versions of the group."""
    out = df if accounts is None else df.join(F.broadcast(accounts.select("platform").distinct()), "platform", "left_semi")
    if platform:
        out = out.filter(F.col("platform") == platform)
    if difficulty:
        out = out.filter(F.col("difficulty") == difficulty)
    if topics:
        out = out.filter(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if access != "all":
        out = out.filter(F.coalesce("is_premium", F.lit(False)) == (access == "premium"))
    if query:
        fields = F.filter(F.array("title", "canonical_title", F.col("id").cast("string"), F.array_join("topics", " ")), lambda f: f.isNotNull())
        out = out.filter(text_match(fields, query))
    group = F.coalesce("canonical_id", "key")
    if status in ("solved", "unsolved"):
        done = df.join(solved.select("key").distinct(), "key", "left_semi").select(group.alias("g")).distinct()
        out = out.join(done, group == F.col("g"), "left_semi" if status == "solved" else "left_anti")
    if status == "starred":
        hit = df.join(starred.select("key").distinct(), "key", "left_semi").select(group.alias("g")).distinct()
        out = out.join(hit, group == F.col("g"), "left_semi")
    return out


def collapse(df: DataFrame) -> DataFrame:
    """One row a canonical group: the first row's fields under the canonical title, all topics, the highest frequency; others as they are."""
    group = F.coalesce("canonical_id", F.concat(F.lit("row:"), F.col("pos").cast("string")))
    first = F.min_by(F.struct("id", "platform", F.coalesce("canonical_title", "title").alias("title")), "pos")
    topics = F.array_sort(F.array_distinct(F.flatten(F.collect_list("topics"))))
    sound = F.when(~F.isnan("frequency"), F.col("frequency"))
    sources = F.size(F.collect_list(sound))
    return df.groupBy(group.alias("grp")).agg(first.alias("f"), F.min("pos").alias("pos"), topics.alias("topics"), F.max(sound).alias("frequency"), sources.cast("long").alias("n_sources"), F.count("*").alias("n_versions")).select("f.*", "pos", "topics", "frequency", "n_sources", "n_versions")


def difficulty_facets(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("canonical_id", "key").alias("g"), "difficulty").distinct().groupBy("difficulty").agg(F.count("*").alias("n"))


def topic_facets(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("canonical_id", "key").alias("g"), F.explode(F.array_distinct("topics")).alias("topic")).distinct().groupBy("topic").agg(F.count("*").alias("n"))


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """One page of an order; a number past the end is the last page."""
    last = max(1, -(-df.count() // size))
    at = min(max(1, number), last)
    return first(df, order, at * size).filter(F.col("rn") > (at - 1) * size)


def attach_catalog(rows: DataFrame, versions: DataFrame, verified: DataFrame) -> DataFrame:
    """rows (source_id, platform, title) with the canonical id of groups that hold together: two versions at least, all present, on verified platforms, titles unchanged."""
    seen = versions.join(rows.select("source_id", F.col("title").alias("now"), "platform"), "source_id", "left").join(F.broadcast(verified.select("platform", F.lit(True).alias("ok"))), "platform", "left")
    good = F.coalesce(F.col("ok") & (F.col("now") == F.col("title")), F.lit(False))
    whole = seen.groupBy("canonical_id").agg(F.count("*").alias("n"), F.bool_and(good).alias("good")).filter("good AND n >= 2").select("canonical_id")
    kept = versions.join(whole, "canonical_id", "left_semi").select("source_id", "canonical_id")
    return rows.join(kept, "source_id", "left")


def solve_links(versions: DataFrame) -> DataFrame:
    """A row for each group and platform: a version that matched the filter if there is one, and whether any version is done."""
    pick = F.min_by("key", F.struct(~F.col("matched"), "pos"))
    return versions.groupBy("canonical_id", "platform").agg(pick.alias("key"), F.bool_or("done").alias("done"))


def corpus(parts: dict[str, DataFrame]) -> DataFrame:
    """source, id, title of several bundled tables (id, title)."""
    out = None
    for source, df in parts.items():
        own = df.select(F.lit(source).alias("source"), F.col("id").cast("long").alias("id"), "title")
        out = own if out is None else out.unionByName(own)
    return out


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all the columns."""
    return df.dropna(subset=list(columns))


def list_counts(df: DataFrame, lists: str) -> DataFrame:
    """list, n: how many rows are in each list of an array column."""
    return df.select(F.explode(lists).alias("list")).groupBy("list").agg(F.count("*").alias("n"))


def row_actions(df: DataFrame, solved: DataFrame, starred: Column, lists: Column) -> DataFrame:
    """grp, solved, starred, lists: over the versions of each question, whether any is solved or starred, and how many different lists they are in."""
    rows = df.join(solved.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    return rows.groupBy(F.coalesce("canonical_id", "key").alias("grp")).agg(F.bool_or(F.col("_hit").isNotNull()).alias("solved"), F.bool_or(F.coalesce(starred, F.lit(False))).alias("starred"), F.countDistinct(lists).alias("lists"))


def by_source(df: DataFrame) -> DataFrame:
    """platform, n of a result."""
    return df.groupBy("platform").agg(F.count("*").alias("n"))


def corpus_counts(df: DataFrame) -> DataFrame:
    """One row: all rows, questions counted once over their versions, platforms."""
    return df.agg(F.count("*").alias("total"), F.countDistinct(F.coalesce("canonical_id", "key")).alias("unique_questions"), F.countDistinct("platform").alias("platforms"))


def ordered_platforms(saved: Column, known: Column) -> Column:
    """The saved order without platforms that are not known (any more), then the others."""
    return F.filter(F.array_distinct(F.concat(saved, known)), lambda x: F.array_contains(known, x))


def migrated_lists(given: Column, known: Column) -> Column:
    """Lists of an old bookmark: those that are known, once each; a bookmark from before lists is starred."""
    return F.when(given.isNotNull(), F.filter(F.array_distinct(given), lambda x: F.array_contains(known, x))).otherwise(F.array(F.lit("saved")))


def with_defaults(df: DataFrame) -> DataFrame:
    """Questions with a difficulty and distinct topics."""
    return df.withColumn("difficulty", F.coalesce("difficulty", F.lit("Unknown"))).withColumn("topics", F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))))


def random_pick(df: DataFrame, key: str, seed: str, last: int | str | None = None) -> DataFrame:
    """One row, drawn by a hash of the seed and the key; never the last one drawn. The same seed draws the same row."""
    rest = df if last is None else df.filter(F.col(key) != last)
    return rest.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(1)


def runtime_projection(df: DataFrame) -> DataFrame:
    """canonical_id, versions of questions that have several."""
    return df.filter("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.count("*").alias("versions")).filter("versions > 1")


def clashing_names(lists: DataFrame, name: str) -> DataFrame:
    """name, n: names that several lists share, case aside."""
    return lists.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
