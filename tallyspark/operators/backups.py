"""Backups (a JSON text each) are validated whole before anything is restored: shapes, ranges, identities, depth and forbidden keys at any level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import urls
from tallyspark.operators.graphs import cut
from tallyspark.operators.nested import at, children, kind, levels

# The format's version, how deep a document may be, keys that no object may have, the parts that must be objects, the switches, the greatest goal and history.
VERSION = 1
DEEPEST = 40
FORBIDDEN = ["__proto__", "prototype", "constructor"]
PARTS = ["accounts", "workspace", "lists", "settings"]
SWITCHES = ["autoSync", "contestsEnabled", "contestReminders"]
MOST_GOAL, MOST_DAYS = 50, 366

INTEGERS = ["BIGINT", "INT", "SMALLINT", "TINYINT"]
NUMBERS = ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"]


def is_(node: Column, *kinds: str) -> Column:
    return F.coalesce(kind(node).isin(*kinds), F.lit(False))


def absent(node: Column) -> Column:
    """Not there, or JSON null."""
    return node.isNull() | is_(node, "VOID")


def string(node: Column, path: str) -> Column:
    """The string at a path; null where something else is."""
    here = at(node, path)
    return F.when(is_(here, "STRING"), F.try_variant_get(here, "$", "string"))


def strings(node: Column) -> Column:
    """Whether a variant is an array of strings."""
    each = F.try_variant_get(node, "$", "array<variant>")
    return is_(node, "ARRAY") & F.coalesce(F.forall(each, lambda x: kind(x) == "STRING"), F.lit(False))


def known(platform: Column) -> Column:
    return F.coalesce(platform.isin(*urls.HOSTS), F.lit(False))


def with_question(rows: DataFrame, entry: str, platform: Column | None = None) -> DataFrame:
    """rows with q_key, q_platform, q_lists (a variant) and q_sound of an entry: a question is of its platform, has a title, a safe URL and the key that its URL gives; a timestamp is a number,
    topics are strings. platform: the one that it must be of; without it any that is known."""
    fields = "struct<platform:variant,title:variant,url:variant,key:variant,timestamp:variant,topics:variant,listIds:variant>"
    text = lambda c: F.when(kind(F.col(f"_q.{c}")) == "STRING", F.try_variant_get(F.col(f"_q.{c}"), "$", "string"))
    own = rows.withColumn("_q", F.when(is_(F.col(entry), "OBJECT"), F.try_variant_get(entry, "$", fields)))
    own = own.withColumns({"_url": text("url"), "q_key": text("key"), "q_platform": text("platform"), "_title": text("title"), "q_lists": F.col("_q.listIds")})
    own = own.withColumn("_must", platform if platform is not None else F.col("q_platform"))
    own = own.withColumns({"_safe": urls.safe_problem_url(F.col("_url"), F.col("_must")).isNotNull(), "_made": urls.problem_key(F.col("_must"), F.col("_url"))})
    stamp, topics = F.col("_q.timestamp"), F.col("_q.topics")
    tests = [known(F.col("_must")), F.col("q_platform") == F.col("_must"), F.col("_title").isNotNull(), F.col("_safe"), F.col("_made") == F.col("q_key"), absent(stamp) | is_(stamp, *NUMBERS), topics.isNull() | strings(topics)]
    sound = reduce(lambda x, y: x & F.coalesce(y, F.lit(False)), tests, F.lit(True))
    return own.withColumn("q_sound", sound).drop("_q", "_url", "_title", "_must", "_safe", "_made")


def _first(tests: list[tuple[Column, str]]) -> Column:
    """The first reason whose test does not hold."""
    out = None
    for good, reason in tests:
        bad = ~F.coalesce(good, F.lit(False))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out


def _faults(rows: DataFrame, tests: list[tuple[Column, str]]) -> DataFrame:
    return rows.select("id", _first(tests).alias("fault")).filter("fault IS NOT NULL")


def _zone(name: Column) -> Column:
    """Whether a name has the form of a time zone's."""
    return F.coalesce(name.rlike(r"^(UTC|GMT|[A-Z][A-Za-z_+-]+(/[A-Z][A-Za-z0-9_+-]+){0,2})$"), F.lit(False))


def faults(backups: DataFrame) -> DataFrame:
    """id, fault: what is wrong with each backup (id, text), a row for each different fault; sound ones have none. A text is read once; its parts are exploded, never collected."""
    parsed = cut(backups.select("id", F.try_parse_json("text").alias("doc")))
    doc = F.col("doc")
    settings, order = at(doc, "$.settings"), at(doc, "$.settings.platformOrder")
    goal, off = at(doc, "$.settings.dailyGoal"), at(doc, "$.disconnectedAccounts")
    whole = F.try_variant_get(goal, "$", "long")
    top = [(is_(doc, "OBJECT"), "not an object"), (is_(at(doc, "$.version"), *INTEGERS) & (F.try_variant_get(doc, "$.version", "long") == VERSION), "version")]
    top += [(is_(at(doc, f"$.{p}"), "OBJECT"), p) for p in PARTS] + [(off.isNull() | is_(off, "OBJECT"), "disconnectedAccounts")]
    names = F.try_variant_get(order, "$", "array<string>")
    out, chosen = [_faults(parsed, top)], parsed.filter(is_(settings, "OBJECT"))  # in small groups: a test on a variant takes much generated code
    out.append(_faults(chosen, [(is_(goal, *INTEGERS) & whole.between(1, MOST_GOAL), "daily goal"), (_zone(string(settings, "$.timeZone")), "time zone"), (order.isNull() | (strings(order) & F.forall(names, known)), "platform order")]))
    out.append(_faults(chosen, [(at(settings, f"$.{s}").isNull() | is_(at(settings, f"$.{s}"), "BOOLEAN"), s) for s in SWITCHES]))

    deep = None
    for n, level in enumerate(levels(parsed, "id", "doc", DEEPEST + 1)):
        bad = level.filter(F.col("name").isin(*FORBIDDEN)).select("id", F.lit("forbidden key").alias("fault"))
        if n == DEEPEST:
            bad = bad.unionByName(level.select("id", F.lit("too deep").alias("fault")))
        deep = bad if deep is None else deep.unionByName(bad)
    if deep is not None:
        out.append(deep)

    def part(df: DataFrame, path: str, name: str, node: str = "doc") -> DataFrame:
        """df with `name` and `name`_key for each child at a path."""
        here = df.withColumn("_part", at(F.col(node), path))
        return children(here, "_part").withColumnsRenamed({"key": f"{name}_key", "value": name}).drop("_part", "pos")

    accounts = cut(part(parsed, "$.accounts", "account").unionByName(part(parsed, "$.disconnectedAccounts", "account")).drop("doc"))
    account, platform = F.col("account"), F.col("account_key")
    handle = string(account, "$.handle")
    own = reduce(lambda rest, name: F.when(platform == name, urls.clean_handle(name, handle)).otherwise(rest), urls.HOSTS, F.lit(None).cast("string"))
    snapshot, job = at(account, "$.snapshot"), at(account, "$.historyImport")
    recent, solved = at(account, "$.snapshot.recent"), at(account, "$.snapshot.solved")
    days = at(account, "$.dailyHistory")
    out.append(_faults(accounts, [(known(platform) & is_(account, "OBJECT"), "account"), (days.isNull() | is_(days, "OBJECT"), "daily history"), (absent(snapshot) | is_(snapshot, "OBJECT"), "snapshot")]))
    out.append(_faults(accounts.filter(known(platform)), [(own == handle, "handle")]))
    out.append(_faults(accounts, [(recent.isNull() | is_(recent, "ARRAY"), "recent"), (solved.isNull() | is_(solved, "OBJECT"), "solved"), (absent(job) | is_(job, "OBJECT"), "history import")]))
    history = part(accounts, "$.dailyHistory", "day", "account")
    day = F.col("day")
    done = is_(at(day, "$.done"), "BOOLEAN") & is_(at(day, "$.verifiedAt"), *NUMBERS) & (string(day, "$.handle") == F.lower(handle))
    out += [_faults(history, [(F.col("day_key").rlike(r"^\d{4}-\d{2}-\d{2}$") & done, "daily history")]), history.groupBy("id", "account_key").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_DAYS).select("id", F.lit("daily history").alias("fault"))]
    for path, keyed in (("$.snapshot.recent", False), ("$.snapshot.solved", True)):
        rows = with_question(part(accounts, path, "entry", "account"), "entry", platform)
        same = (F.col("entry_key") == F.col("q_key")) if keyed else F.lit(True)
        out.append(_faults(rows, [(F.col("q_sound"), "question"), (same, "question key")]))
    for path in ("$.snapshot.ratings", "$.snapshot.scoreHistory"):
        point = F.col("point")
        rows = part(accounts.filter(~F.coalesce(absent(at(account, path)), F.lit(True))), path, "point", "account")
        out += [_faults(rows, [(is_(at(point, "$.timestamp"), *NUMBERS) & is_(at(point, "$.rating"), *NUMBERS), "ratings")]), _faults(accounts, [(at(account, path).isNull() | is_(at(account, path), "ARRAY"), "ratings")])]
    for path in ("$.snapshot.calendar", "$.snapshot.breakdown"):
        out += [_faults(part(accounts, path, "n", "account"), [(is_(F.col("n"), *NUMBERS), "counts")]), _faults(accounts, [(at(account, path).isNull() | is_(at(account, path), "OBJECT"), "counts")])]

    lists = part(parsed, "$.lists", "list").drop("doc")
    one = F.col("list")
    out.append(_faults(lists, [(is_(one, "OBJECT") & (string(one, "$.id") == F.col("list_key")) & (F.length(F.trim(string(one, "$.name"))) > 0), "list")]))
    work = with_question(cut(part(parsed, "$.workspace", "entry").drop("doc")), "entry")
    out.append(_faults(work, [(F.col("q_sound"), "question"), (F.col("entry_key") == F.col("q_key"), "question key"), (strings(F.col("q_lists")), "list ids")]))
    used = work.select("id", F.explode(F.try_variant_get("q_lists", "$", "array<string>")).alias("list_key"))
    out.append(used.join(lists.select("id", "list_key"), ["id", "list_key"], "left_anti").select("id", F.lit("list ids").alias("fault")))
    return reduce(DataFrame.unionByName, out).distinct()


def validated(backups: DataFrame) -> DataFrame:
    """id, faults (sorted; empty for a sound backup) of backups (id, text)."""
    found = faults(backups).groupBy("id").agg(F.array_sort(F.collect_set("fault")).alias("faults"))
    return backups.select("id").join(found, "id", "left").withColumn("faults", F.coalesce("faults", F.array().cast("array<string>")))
