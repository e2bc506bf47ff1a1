"""Tracked accounts as tables: connections and their archive, import jobs, observations, lists, settings and daily status.

accounts: platform, handle, generation, status, error, synced_at, and whatever else a caller keeps. Every function takes tables and returns tables; clocks are
parameters. Checks that must hold for a whole request fail the job, as half a request is never applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.graphs import cut
from tallyspark.operators.similarity import TASK_ROWS, pairs_across

# The states of an import job, and the error codes that mean a closed tab.
RUNNING, COMPLETE, ERROR, WAITING, PAUSED = "running", "complete", "error", "waiting-tab", "paused"
CLOSED_TABS = ["LEETCODE_TAB_CLOSED", "CODE360_TAB_CLOSED"]
PAGES_PER_WAKE = 5
IMPORT_ROWS = 20_000
EVIDENCE = ["accepted", "solved"]


def required(df: DataFrame, sound: Column, message: str | Column) -> DataFrame:
    """The rows; the job fails where one isn't sound."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def current(events: DataFrame, accounts: DataFrame) -> DataFrame:
    """The events whose account is still the one they were made for: same platform, generation, and handle in any case."""
    now = accounts.select("platform", F.col("generation").alias("_generation"), F.lower("handle").alias("_handle"))
    fits = (F.col("generation") == F.col("_generation")) & (F.lower("handle") == F.col("_handle"))
    return events.join(now, "platform").filter(fits).drop("_generation", "_handle")


def merged_snapshot(saved: DataFrame, incoming: DataFrame, keep: int = 15_000) -> DataFrame:
    """The records of each (platform, id), incoming ones over saved ones, no longer pending, source provider unless it is named; the newest `keep` a platform, and whether any were cut.

    saved, incoming: platform, id, key, ts, pending, source.
    """
    both = saved.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = both.groupBy("platform", "id").agg(F.max_by(F.struct("key", "ts", "pending", "source"), F.struct("_new", "ts")).alias("r"), F.max("_new").alias("fresh"))
    rows = latest.select("platform", "id", "r.key", "r.ts", F.when(F.col("fresh") == 1, False).otherwise(F.coalesce("r.pending", F.lit(False))).alias("pending"), F.coalesce("r.source", F.lit("provider")).alias("source"))
    place = F.row_number().over(Window.partitionBy("platform").orderBy(F.desc("ts"), "id"))
    cut = rows.groupBy("platform").agg((F.count("*") > keep).alias("partial"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= keep).drop("_place").join(cut, "platform")


def merged_solved(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest record of each (platform, key); of equal instants the incoming one; undated ones come last. Columns: platform, key, id, ts, source."""
    both = saved.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct("id", "ts", "source"), F.struct(F.coalesce(F.col("ts").cast("double"), F.lit(0.0)), F.col("_new"), F.col("id")))
    return both.groupBy("platform", "key").agg(best.alias("r")).select("platform", "key", "r.*")


def connect(accounts: DataFrame, archive: DataFrame, requests: DataFrame) -> DataFrame:
    """accounts after requests (platform, handle, generation): a new handle replaces the account, with the archived snapshot and job where that handle was here before; the same handle changes nothing.

    accounts and archive share their columns.
    """
    rest = [c for c in accounts.columns if c not in ("platform", "handle", "generation", "status", "error")]
    unchanged = accounts.select("platform", "handle").join(requests.select("platform", "handle"), ["platform", "handle"], "left_semi")
    new = requests.join(unchanged, ["platform", "handle"], "left_anti").select("platform", "handle", "generation")
    kept = accounts.join(new.select("platform"), "platform", "left_anti")
    restored = new.join(archive.select("platform", "handle", *rest), ["platform", "handle"], "left").withColumn("status", F.lit("idle")).withColumn("error", F.lit(None).cast("string"))
    return kept.unionByName(restored.select(accounts.columns))


def disconnect(accounts: DataFrame, archive: DataFrame, platforms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accounts without the platforms, and the archive with these, idle and without error."""
    leaving = accounts.join(platforms.select("platform"), "platform", "left_semi").select(accounts.columns)
    moved = leaving.withColumn("status", F.lit("idle")).withColumn("error", F.lit(None).cast("string"))
    return accounts.join(platforms.select("platform"), "platform", "left_anti").select(accounts.columns), archive.join(leaving.select("platform"), "platform", "left_anti").select(accounts.columns).unionByName(moved)


def restored(accounts: DataFrame, seed: str) -> DataFrame:
    """accounts of a backup: new generations (named by the restore's seed, so that a lost task makes the same ones again), idle, no errors, their running jobs paused under new ids."""
    name = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(c), "platform", "handle"), 256)
    out = accounts.withColumn("generation", name("generation")).withColumn("status", F.lit("idle")).withColumn("error", F.lit(None).cast("string"))
    if "job_id" in accounts.columns:
        has = F.col("job_id").isNotNull()
        out = out.withColumn("job_status", F.when(has, PAUSED)).withColumn("job_id", F.when(has, name("job")))
    return out


def advanced(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Import jobs after one page each: the cursor moves with the page's records, or not at all.

    jobs: platform, job_id, generation, status, cursor, pages, accepted, skipped, error. pages: platform, job_id, generation, cursor, accepted, skipped, complete, warning, code (of a failure).
    A page counts only for the running job of its generation.
    """
    names = [c for c in pages.columns if c not in ("platform", "job_id", "generation")]
    both = jobs.join(pages.select("platform", "job_id", "generation", F.lit(True).alias("_came"), *(F.col(c).alias(f"_{c}") for c in names)), ["platform", "job_id", "generation"], "left")
    came = F.coalesce("_came", F.lit(False)) & (F.col("status") == RUNNING)
    failed = came & F.col("_code").isNotNull()
    good = came & F.col("_code").isNull()
    waiting = F.col("_code").isin(CLOSED_TABS)
    after = F.when(failed, F.when(waiting, WAITING).otherwise(ERROR)).when(good, F.when(F.col("_warning").isNotNull(), ERROR).when(F.col("_complete"), COMPLETE).otherwise(RUNNING)).otherwise(F.col("status"))
    error = F.when(failed, F.when(~waiting, F.substring("_code", 1, 400))).when(good, F.col("_warning")).otherwise(F.col("error"))
    return both.select(
        "platform", "job_id", "generation", after.alias("status"), F.when(good, F.col("_cursor")).otherwise(F.col("cursor")).alias("cursor"), (F.col("pages") + good.cast("long")).alias("pages"),
        (F.col("accepted") + F.when(good, F.coalesce("_accepted", F.lit(0))).otherwise(0)).alias("accepted"), (F.col("skipped") + F.when(good, F.coalesce("_skipped", F.lit(0))).otherwise(0)).alias("skipped"), error.alias("error"),
    )


def wake(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """One wake of all running jobs: PAGES_PER_WAKE pages at most, in order of n; a job that stops takes none of the pages after."""
    for n in range(1, PAGES_PER_WAKE + 1):
        jobs = advanced(jobs, pages.filter(F.col("n") == n).drop("n"))
    return jobs


def single_flight(requests: DataFrame, running: DataFrame) -> DataFrame:
    """One request a platform, the first (at, id), and none where one is running."""
    best = requests.groupBy("platform").agg(F.min(F.struct("at", "id")).alias("r")).select("platform", "r.*")
    return best.join(running.select("platform"), "platform", "left_anti")


def claimed(accounts: DataFrame, now: Column, cooldown: int = 60) -> DataFrame:
    """The accounts whose recovery may be tried: not in the last `cooldown` seconds. Their attempt is set to now, so that a second claim gets none."""
    free = F.col("attempted_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("attempted_at") >= cooldown)
    return accounts.filter(free).withColumn("attempted_at", now)


def accepted_events(events: DataFrame, accounts: DataFrame, recent: DataFrame, now: Column, skew_minutes: int = 5) -> DataFrame:
    """Browser acceptances as pending records: a number as id, a sound slug and title, a clock within `skew_minutes`, the connected account, an id not seen before; the first of equal ids.

    events: platform, handle, generation, id, slug, title, ts.
    """
    sound = F.col("id").rlike(r"^\d{1,30}$") & F.col("slug").rlike("^[a-zA-Z0-9-]{1,200}$") & (F.trim("title") != "") & (F.length("title") <= 300) & (F.abs(F.unix_seconds(now) - F.unix_seconds("ts")) <= skew_minutes * 60)
    named = current(events.filter(sound), accounts).select("platform", F.concat_ws(":", "platform", "id").alias("id"), F.concat(F.col("platform"), F.lit(":"), F.lower("slug")).alias("key"), "title", "ts")
    once = named.groupBy("platform", "id").agg(F.min(F.struct("ts", "key", "title")).alias("r")).select("platform", "id", "r.*")
    return once.join(recent.select("platform", "id"), ["platform", "id"], "left_anti").withColumn("pending", F.lit(True)).withColumn("source", F.lit("browser"))


def observed_pages(events: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """Pages that show a problem as solved: an undated solved identity for each (platform, key). events: platform, handle, generation, key, page_key, evidence."""
    sound = F.col("evidence").isin(EVIDENCE) & (F.col("key") == F.col("page_key")) & (F.col("platform") != "tuf")
    return current(events.filter(sound), accounts).select("platform", "key").distinct().withColumn("ts", F.lit(None).cast("timestamp")).withColumn("source", F.lit("page")).withColumn("observed_at", now)


def imported(records: DataFrame, accounts: DataFrame, generations: DataFrame) -> DataFrame:
    """Solved identities of a bulk import, all or none: the job fails if a platform can't be imported to, has no account, or its account is another than the preview's. Of equal keys the last (pos) stays.

    records: platform, key, title, pos; generations: platform, generation as previewed.
    """
    now = accounts.select("platform", F.col("generation").alias("_now"))
    seen = records.join(now, "platform", "left").join(generations.select("platform", F.col("generation").alias("_then")), "platform", "left")
    seen = required(seen, F.col("platform") != "tuf", F.concat(F.col("platform"), F.lit(" is not supported")))
    seen = required(seen, F.col("_now") == F.col("_then"), "Connected account changed. Preview the import again.")
    return seen.groupBy("platform", "key").agg(F.max_by("title", "pos").alias("title")).withColumn("source", F.lit("import"))


def created_lists(lists: DataFrame, names: DataFrame, seed: str) -> DataFrame:
    """lists (id, name) with new ones; the job fails if a name is empty, longer than 80 or taken, case aside."""
    new = required(names.select(F.trim("name").alias("name")), F.length("name").between(1, 80), "Enter a list name between 1 and 80 characters.")
    all_ = lists.select("id", "name").unionByName(new.select(F.sha2(F.concat_ws("|", F.lit(seed), F.lower("name")), 256).alias("id"), "name"))
    taken = F.count("*").over(Window.partitionBy(F.lower("name")))
    return required(all_.withColumn("_n", taken), F.col("_n") == 1, F.concat(F.lit("A list with that name already exists: "), F.col("name"))).drop("_n")


def list_membership(workspace: DataFrame, lists: DataFrame, entries: DataFrame, custom_only: bool = False, at: Column | None = None) -> DataFrame:
    """workspace (key, platform, title, list_ids, updated_at) after entries (key, platform, title, list_ids): the job fails for a list that isn't there. custom_only: the star is left as it was."""
    known = entries.select("key", F.explode("list_ids").alias("id")).join(lists.select("id", F.lit(True).alias("_here")), "id", "left").groupBy("key").agg(F.bool_and(F.col("_here").isNotNull()).alias("_sound"))
    checked = required(entries.join(known, "key", "left"), F.coalesce("_sound", F.lit(True)), "List not found.").drop("_sound")
    if custom_only:
        checked = required(checked, ~F.array_contains("list_ids", "saved"), "Use the star to change Starred membership.")
    before = workspace.select("key", F.col("list_ids").alias("_before"))
    star = F.when(F.array_contains("_before", "saved"), F.array(F.lit("saved"))).otherwise(F.array().cast("array<string>")) if custom_only else F.array().cast("array<string>")
    ids = F.array_distinct(F.concat("list_ids", F.coalesce(star, F.array().cast("array<string>"))))
    new = checked.join(before, "key", "left").select("key", "platform", F.substring("title", 1, 300).alias("title"), ids.alias("list_ids"), (F.current_timestamp() if at is None else at).alias("updated_at"))
    return workspace.join(new.select("key"), "key", "left_anti").select(new.columns).unionByName(new)


def starred(workspace: DataFrame, toggles: DataFrame, at: Column) -> DataFrame:
    """workspace after toggles (key, platform, title, starred): only the star changes."""
    before = workspace.select("key", F.col("list_ids").alias("_before"))
    rest = F.filter(F.coalesce("_before", F.array().cast("array<string>")), lambda x: x != "saved")
    new = toggles.join(before, "key", "left").select("key", "platform", F.substring("title", 1, 300).alias("title"), F.when(F.col("starred"), F.concat(rest, F.array(F.lit("saved")))).otherwise(rest).alias("list_ids"), at.alias("updated_at"))
    return workspace.join(new.select("key"), "key", "left_anti").select(new.columns).unionByName(new)


def settings(saved: DataFrame, patch: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """saved (name, value) with the patch's values; the job fails for a name without a rule or a value that breaks it. rules: conditions on the column value."""
    sound = F.lit(False)
    for name, rule in rules.items():
        sound = F.when(F.col("name") == name, rule).otherwise(sound)
    good = required(patch.select("name", "value"), sound, F.concat(F.lit("Invalid setting: "), F.col("name")))
    return saved.join(good.select("name"), "name", "left_anti").select("name", "value").unionByName(good)


def platform_order(wanted: DataFrame, platforms: DataFrame) -> DataFrame:
    """wanted (platform, place); the job fails unless it holds every platform once."""
    both = wanted.groupBy("platform").agg(F.count("*").alias("_n"), F.min("place").alias("place")).join(platforms.select("platform", F.lit(True).alias("_known")), "platform", "full")
    return required(both, (F.col("_n") == 1) & F.col("_known"), "Invalid platform order.").select("platform", "place")


def daily_status(saved: DataFrame, verified: DataFrame) -> DataFrame:
    """platform, day, done: what was verified, else what was saved for the same day; once done stays done. Both: platform, handle, day, done."""
    mine = saved.select("platform", F.lower("handle").alias("handle"), "day", F.col("done").alias("_saved"))
    new = verified.select("platform", F.lower("handle").alias("handle"), "day", F.col("done").alias("_new"))
    return mine.join(new, ["platform", "handle", "day"], "full").select("platform", "handle", "day", (F.coalesce("_saved", F.lit(False)) | F.coalesce("_new", F.lit(False))).alias("done"))


def daily_done(items: DataFrame, day: Column) -> DataFrame:
    """platform, done: any current coding item that is complete, or the track of exactly that day solved. items: platform, kind (coding or track), day, current, complete."""
    coding = (F.col("kind") == "coding") & F.col("current") & F.col("complete")
    track = (F.col("kind") == "track") & (F.col("day") == day) & F.col("complete")
    return items.groupBy("platform").agg(F.bool_or(F.coalesce(coding | track, F.lit(False))).alias("done"))


def matches(versions: DataFrame, asked: DataFrame, reviewed: DataFrame, hits: DataFrame, limit: int = 12, task_rows: int = TASK_ROWS) -> DataFrame:
    """asked_id, question_id, version, relationship, place: what goes with each asked source.

    versions: id, question_id, contract (null: base); asked: asked_id (a version's id); reviewed: question_id, other_id (variants between questions);
    hits: asked_id, question_id, score (ranked heuristics). Versions of the same question are equivalent or platform variants by contract; then come
    reviewed variants, and suggestions that are neither the question itself nor reviewed, `limit` related ones in all.
    """
    base = F.coalesce("contract", F.lit("base"))
    own = asked.join(versions.select(F.col("id").alias("asked_id"), "question_id", base.alias("_contract")), "asked_id")
    other = versions.select("question_id", F.col("id").alias("version"), base.alias("_other"))
    # their number is that of the asked times that of the versions of a question, whatever is read, so they are dealt out by what they make
    both = pairs_across(cut(own), other, "question_id", task_rows).select("l.*", "r.version", "r._other")
    same = both.filter("version <> asked_id").select("asked_id", "question_id", "version", F.when(F.col("_contract") == F.col("_other"), "equivalent").otherwise("platform-variant").alias("relationship"), F.lit(None).cast("long").alias("place"))
    variant = own.join(reviewed.select("question_id", "other_id").distinct(), "question_id").select("asked_id", F.col("other_id").alias("question_id"), F.lit(0).alias("_kind"), F.lit(0.0).alias("score"))
    taken = own.select("asked_id", "question_id").unionByName(variant.select("asked_id", "question_id"))
    guess = hits.join(taken, ["asked_id", "question_id"], "left_anti").select("asked_id", "question_id", F.lit(1).alias("_kind"), "score")
    place = F.row_number().over(Window.partitionBy("asked_id").orderBy("_kind", F.desc("score"), "question_id")).cast("long")
    related = variant.unionByName(guess).withColumn("place", place).filter(F.col("place") <= limit)
    names = F.when(F.col("_kind") == 0, "variant").otherwise("related-suggestion")
    return same.unionByName(related.select("asked_id", "question_id", F.lit(None).cast(dict(versions.dtypes)["id"]).alias("version"), names.alias("relationship"), "place"))
