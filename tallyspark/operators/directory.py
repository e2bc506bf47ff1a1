"""Organizations and what is asked there, harvested lists, and metadata merges.

links: company_id, window, question, frequency, and whatever a caller carries along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def company_index(links: DataFrame, library: DataFrame) -> DataFrame:
    """Links whose question is in the library (question and more); the others are dropped."""
    return links.join(library, "question")


def categories(companies: DataFrame, groups: DataFrame, default: str = "Other") -> DataFrame:
    """companies with the category of their group (grp, category; of several the least), or the default."""
    return companies.join(groups.groupBy("grp").agg(F.min("category").alias("category")), "grp", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def tagged(tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """record, company_id: the organizations of each record, once each. tags: record, name, slug; dictionary: slug, company_id. A name that isn't there becomes an organization under its slug."""
    known = tags.join(dictionary, "slug", "left")
    return known.select("record", F.coalesce("company_id", "slug").alias("company_id")).distinct()


def associations(links: DataFrame) -> DataFrame:
    """question, companies: the organizations that ask it, sorted."""
    return links.groupBy("question").agg(F.array_sort(F.collect_set("company_id")).alias("companies"))


def counts(rows: DataFrame, window: str, levels: tuple[str, ...] = ("Easy", "Medium", "Hard")) -> DataFrame:
    """company_id, total and how many questions of each level; other levels count in the total only. rows: links with difficulty."""
    own = rows.filter(F.col("window") == window).select("company_id", "question", "difficulty").distinct()
    return own.groupBy("company_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("difficulty") == x).alias(x.lower()) for x in levels))


def summary(links: DataFrame, window: str) -> DataFrame:
    return links.filter(F.col("window") == window).agg(F.countDistinct("question").alias("questions"), F.countDistinct("company_id").alias("companies"))


def questions(links: DataFrame, window: str, sound: Column | None = None) -> DataFrame:
    """company_id, question, frequency (the greatest; null if none is known) in a window."""
    own = links.filter(F.col("window") == window)
    return (own if sound is None else own.filter(sound)).groupBy("company_id", "question").agg(F.max("frequency").alias("frequency"))


def topics(links: DataFrame, library: DataFrame) -> DataFrame:
    """company_id, topic, once each. library: question, topics."""
    return company_index(links, library).select("company_id", F.explode("topics").alias("topic")).distinct()


def solved_scope(links: DataFrame, *done: DataFrame) -> DataFrame:
    """Links whose question is in any of the tables of done questions."""
    all_ = done[0].select("question")
    for more in done[1:]:
        all_ = all_.unionByName(more.select("question"))
    return links.join(all_.distinct(), "question", "left_semi")


def by_frequency(rows: DataFrame, tie: str = "question") -> list[Column]:
    """Most frequent first, unknown frequencies last."""
    return [F.desc_nulls_last("frequency"), F.asc(tie)]


def ranked_in_category(companies: DataFrame) -> DataFrame:
    """companies (category, name, n) with their place in the category: most questions first, then by name."""
    return companies.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "name")).cast("long"))


def named(companies: DataFrame, term: str, names: list[Column]) -> DataFrame:
    """Companies of which any name holds the term, case aside."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.coalesce(F.lower(name.cast("string")).contains(term.lower()), F.lit(False))
    return companies.filter(hit)


def windows_sink(links: DataFrame) -> DataFrame:
    """company_id, windows: a text of window=count, for the organizations' files."""
    n = links.groupBy("company_id", "window").agg(F.count("*").alias("n"))
    return n.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "n"))), lambda x: F.concat_ws("=", x["window"], x["n"].cast("string"))), ",").alias("windows"))


def percentage(text: Column) -> Column:
    """A frequency written as a percentage; the job fails beyond 0 to 100."""
    value = F.rtrim(text, F.lit("%")).cast("double")
    return F.when(value.between(0, 100), value).otherwise(F.raise_error(F.concat(F.lit("invalid frequency: "), F.coalesce(text, F.lit("null")))).cast("double"))


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Harvested rows whose id isn't there yet."""
    return rows.join(known.select(key), key, "left_anti")


def titled(rows: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """rows with a title (key, title), or their key where none is known."""
    return rows.join(titles.select(key, "title"), key, "left").withColumn("title", F.coalesce("title", F.col(key).cast("string")))


def merged_metadata(problems: DataFrame, contests: DataFrame, models: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Problems of closed contests with their model's difficulty and what was saved of them: id, title, contest_id, start, difficulty, description, constraints.

    problems: id, contest_id, title, pos (of equal ids the first stays); contests: contest_id, start, seconds; models: id, difficulty; previous: id, description, constraints.
    """
    sound = F.col("id").isNotNull() & (F.trim("title") != "")
    once = problems.filter(sound).groupBy("id").agg(F.min(F.struct("pos", "contest_id", "title")).alias("p")).select("id", "p.contest_id", F.trim("p.title").alias("title"))
    closed = contests.filter(F.unix_seconds("start") + F.col("seconds") <= F.unix_seconds(now)).select("contest_id", "start")
    full = once.join(closed, "contest_id").join(models.select("id", F.round("difficulty").cast("long").alias("difficulty")), "id", "left").join(previous.select("id", "description", "constraints"), "id", "left")
    return full.select("id", "title", "contest_id", "start", "difficulty", *(F.coalesce(c, F.lit("")).alias(c) for c in ("description", "constraints")))


def index_order(first_contests: list[str]) -> list[Column]:
    """Educational sets first, then the newest contests, then by id."""
    return [F.desc(F.col("contest_id").isin(first_contests)), F.desc("start"), F.asc("id")]


def current_record(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Each page with the first record (the least key) of its address, query and fragment aside."""
    place = F.regexp_replace(url, "[?#].*$", "")
    first = pages.groupBy(place.alias("_place")).agg(F.min(key).alias("record"))
    return pages.join(first, place == F.col("_place")).select(key, "record")


def recovered(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """rows (id, description) with outcome: those with a blank statement take the answer's (id, answer), if it has 80 characters; sound ones are 'present' and not asked for."""
    blank = F.trim(F.coalesce("description", F.lit(""))) == ""
    both = rows.withColumn("_blank", blank).join(answers.select("id", "answer"), "id", "left")
    outcome = F.when(~F.col("_blank"), "present").when(F.col("answer").isNull(), "not-found").when(F.length("answer") < 80, "insufficient-statement").otherwise("recovered")
    out = both.withColumn("outcome", outcome)
    return out.withColumn("description", F.when(F.col("outcome") == "recovered", F.col("answer")).otherwise(F.col("description"))).drop("answer", "_blank")


def problem_list(lists: list[DataFrame], hidden: Column) -> DataFrame:
    """Pages of a list put together, once an id, without hidden ones. lists: id and more."""
    all_ = lists[0]
    for more in lists[1:]:
        all_ = all_.unionByName(more)
    return all_.filter(~F.coalesce(hidden, F.lit(False))).dropDuplicates(["id"])


def reconciled(wanted: DataFrame, present: DataFrame, key: str = "id") -> DataFrame:
    """What must be created and what dropped, so that the present alarms become the wanted ones."""
    create = wanted.select(key).join(present.select(key), key, "left_anti").withColumn("action", F.lit("create"))
    return create.unionByName(present.select(key).join(wanted.select(key), key, "left_anti").withColumn("action", F.lit("drop")))
