"""Contest schedules from captured answers: pages are read as far as they go on, a listing that a provider has removed falls back to a shorter one, and a source that fails keeps what was saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.times import india_time
from tallyspark.operators.nested import at, children, kind

# How many pages are read, the listing that may be gone with the one in its place, how a provider says so, and what a failed source reports.
MOST_PAGES = 20
FULL, SHORT = "allContests", "topTwoContests"
GONE = r"""Cannot query field ["']allContests["']"""
UNAVAILABLE = "Schedule unavailable. Showing saved times."


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _number(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "double").cast("long")


def _listed(answers: DataFrame) -> DataFrame:
    """answers with doc, gone (the provider says that the full listing is no more), rows (an array, null in an unsound answer) and more (whether another page follows, but for what the rows say)."""
    doc = F.try_parse_json("body")
    messages = F.try_variant_get("doc", "$.errors", "array<struct<message:string>>")
    gone = F.coalesce(F.exists(messages, lambda m: F.coalesce(m["message"].rlike(GONE), F.lit(False))), F.lit(False))
    array = lambda path: F.when(kind(at(F.col("doc"), path)) == "ARRAY", F.try_variant_get("doc", path, "array<variant>"))
    both = lambda a, b: F.concat(F.coalesce(array(a), F.array().cast("array<variant>")), F.coalesce(array(b), F.array().cast("array<variant>")))
    lists = F.when(F.col("platform") == "leetcode", F.coalesce(array(f"$.data.{FULL}"), array(f"$.data.{SHORT}"))).when(F.col("platform") == "code360", array("$.data.events"))
    lists = lists.when(F.col("platform") == "geeksforgeeks", F.when(kind(at(F.col("doc"), "$.results")) == "OBJECT", both("$.results.upcoming", "$.results.past")))
    more = F.when(F.col("platform") == "code360", F.col("page") < _number(F.col("doc"), "$.data.total_pages")).when(F.col("platform") == "geeksforgeeks", F.try_variant_get("doc", "$.next_upcoming", "boolean"))
    return answers.withColumn("doc", doc).withColumns({"gone": gone, "rows": lists, "more": F.coalesce(more, F.lit(False))})


def _contests(listed: DataFrame) -> DataFrame:
    """platform, page, listing, slug, title, start_s, end_s of the answers' rows."""
    item = F.col("value")
    rows = listed.select("platform", "page", "listing", F.explode("rows").alias("value"))
    seconds = {"leetcode": (_number(item, "$.startTime"), _number(item, "$.startTime") + _number(item, "$.duration")), "code360": (_number(item, "$.event_start_time"), _number(item, "$.event_end_time"))}
    india = lambda path: F.unix_seconds(india_time(_text(item, path)))
    seconds["geeksforgeeks"] = (india("$.start_time"), india("$.end_time"))
    pick = lambda k: F.when(F.col("platform") == "leetcode", seconds["leetcode"][k]).when(F.col("platform") == "code360", seconds["code360"][k]).otherwise(seconds["geeksforgeeks"][k])
    slug = F.coalesce(_text(item, "$.titleSlug"), _text(item, "$.slug"))
    title = F.coalesce(_text(item, "$.title"), _text(item, "$.name"))
    wanted = F.when(F.col("platform") == "code360", _text(item, "$.event_category") == "CONTEST").when(F.col("platform") == "geeksforgeeks", _number(item, "$.type") == 3).otherwise(True)
    return rows.filter(F.coalesce(wanted, F.lit(False))).select("platform", "page", "listing", slug.alias("slug"), title.alias("title"), pick(0).alias("start_s"), pick(1).alias("end_s"))


def fetched(answers: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """The contests of captured answers (platform, slug, title, start_s, end_s), and platform, limited, error.

    answers: platform, listing (the name that was asked for, null for paged ones), page (from 1), body. Pages count up to the first that says it is the last (or, where a listing puts coming events first, whose events are
    all over), MOST_PAGES at most; a platform with an unsound answer among them has an error and no contests.
    """
    listed = _listed(answers.filter(F.col("page") <= MOST_PAGES))
    full = listed.filter(F.col("listing") == FULL).select("platform", F.col("gone").alias("fallen")).distinct()
    used = listed.join(full, "platform", "left").filter(F.col("listing").isNull() | (F.col("listing") == F.when(F.coalesce("fallen", F.lit(False)), SHORT).otherwise(FULL)))
    contests = _contests(used)
    ahead = contests.filter(F.col("end_s") > now).select("platform", "page").distinct().withColumn("ahead", F.lit(True))
    goes_on = F.col("more") & ((F.col("platform") != "code360") | F.coalesce("ahead", F.lit(False)))
    pages = used.join(ahead, ["platform", "page"], "left").select("platform", "page", F.col("rows").isNull().alias("unsound"), goes_on.alias("goes_on"), F.coalesce("fallen", F.lit(False)).alias("fallen"))
    last = pages.groupBy("platform").agg(F.coalesce(F.min(F.when(~F.col("goes_on"), F.col("page"))), F.max("page")).alias("last"))
    seen = pages.join(last, "platform").filter(F.col("page") <= F.col("last"))
    # limited: the shorter listing, or pages that would have gone on
    status = seen.groupBy("platform").agg(F.bool_or(F.col("fallen") | ((F.col("page") == F.col("last")) & F.col("goes_on"))).alias("limited"), F.bool_or("unsound").alias("bad"))
    good = status.filter("NOT bad").select("platform")
    rows = contests.join(last, "platform").filter(F.col("page") <= F.col("last")).join(good, "platform", "left_semi").select("platform", "slug", "title", "start_s", "end_s")
    return rows, status.select("platform", "limited", F.when(F.col("bad"), UNAVAILABLE).alias("error"))


def refreshed(saved: DataFrame, contests: DataFrame, status: DataFrame, now: int) -> DataFrame:
    """platform, slug, title, start_s, end_s after a refresh: of sources that answered, past contests stay and coming ones are replaced, so that cancelled ones go; a failed source, or one not asked, keeps all."""
    answered = status.filter("error IS NULL").select("platform")
    kept = saved.join(answered, "platform", "left_anti").unionByName(saved.join(answered, "platform", "left_semi").filter(F.col("end_s") <= now))
    key = ["platform", "slug"]
    return kept.join(contests.select(*key), key, "left_anti").select(contests.columns).unionByName(contests)
