"""Corpus normalization: quarantine, exact-evidence grouping, reviewed decisions with fingerprint pins, stable canonical identities.

Versions are rows (id, platform, title, url, description, constraints, fingerprint, review_fingerprint, title_key).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.graphs import chain_ends, components, cut
from tallyspark.operators.similarity import pairs_within

# What marks a variant in a title, a statement that was cut off, a contest's number in a path, a numbered contest title, and the reasons as they are reported.
VARIANT_WORDS = r"(?i)(?<![A-Za-z0-9_])(easy|medium|hard|version|subtask|dataset|interactive|output.only|small|large)(?![A-Za-z0-9_])"
CUT_OFF = r"(?i)(?<![A-Za-z0-9_])(?:for|note|example|input|output)\s*:?\s*$|(?:\.\.\.|…)\s*$"
# What a text ends in that may have been cut off, blanks aside: few texts have to be searched for CUT_OFF. Blanks alone tell nothing.
CUT_OFF_END = r"(?i)(?:or|te|le|ut|:|\.\.\.|…)[\s\x{85}\x{2028}\x{2029}]*\z|\A[\s\x{85}\x{2028}\x{2029}]*\z"
# At least fifteen words.
ENOUGH = r"\A(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){15}"
CONTEST = r"/(?:problemset/problem|contest|gym)/(\d+)"
NUMBERED = r"(?i)^[a-z]\d+\."
REASONS = [
    "Statements or constraints differ",
    "Titles need semantic review",
    "Insufficient statement evidence",
    "Possibly truncated cached statement",
    "Explicit task variant in title",
    "Different tasks in the same contest",
    "Numbered contest variants",
]


def quarantine(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and rejected ones with the first reason that holds."""
    reason = None
    for text, bad in reasons.items():
        reason = F.when(bad, text) if reason is None else reason.when(bad, text)
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def unique_or_fail(rows: DataFrame, key: str) -> DataFrame:
    """The rows; the job fails if a key is there twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("n", n).filter(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")).drop("n")


def cut_off(statement: Column) -> Column:
    """Whether CUT_OFF is found, which lies at the end: of most texts only that is looked at."""
    return F.right(statement, F.lit(40)).rlike(CUT_OFF_END) & statement.rlike(CUT_OFF)


def judged(versions: DataFrame) -> DataFrame:
    """id, fingerprint, title_key and what the merge rules ask about a version: thin (too little of a statement), cut_off, missing, variant, output and only (a title's last and first word, which
    make a variant's word together), forces, contest, numbered. Statements are read once and left behind."""
    statement = F.coalesce("description", F.lit(""))
    forces = F.coalesce(F.col("platform") == "codeforces", F.lit(False))
    has = lambda pattern: F.coalesce(F.col("title").rlike(pattern), F.lit(False))
    return versions.select(
        "id", "fingerprint", "title_key", ((F.length(statement) < 80) | ~statement.rlike(ENOUGH)).alias("thin"), cut_off(statement).alias("cut_off"), (statement == "").alias("missing"), has(VARIANT_WORDS).alias("variant"),
        has(r"(?i)(?<![A-Za-z0-9_])output\z").alias("output"), has(r"(?i)\Aonly(?![A-Za-z0-9_])").alias("only"), forces.alias("forces"), F.when(forces, F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), CONTEST, 1), F.lit(""))).alias("contest"), (forces & has(NUMBERED)).alias("numbered"),
    )


def merge_blockers(a: str = "a", b: str = "b") -> Column:
    """Why two versions (as of judged()) may not be merged without review; empty if they may."""
    l, r = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))  # noqa: E731, E741
    contest = l("forces") & r("forces")
    rules = [
        (l("fingerprint") != r("fingerprint"), REASONS[0]),
        (l("title_key") != r("title_key"), REASONS[1]),
        (l("thin"), REASONS[2]),
        (l("cut_off"), REASONS[3]),
        (l("variant") | r("variant") | (l("output") & r("only")), REASONS[4]),
        (contest & (l("contest") == r("contest")), REASONS[5]),
        (contest & (l("numbered") | r("numbered")), REASONS[6]),
    ]
    return F.filter(F.array(*(F.when(c, t) for c, t in rules)), lambda x: x.isNotNull())


def exact_groups(versions: DataFrame, blocked: DataFrame, occupied: DataFrame) -> DataFrame:
    """id, grp: members of buckets with one fingerprint and title key in which every pair may merge and none is blocked; one bad pair dissolves its bucket."""
    return buckets_of(cut(judged(versions.join(occupied.select("id"), "id", "left_anti"))), blocked)


def buckets_of(marked: DataFrame, blocked: DataFrame) -> DataFrame:
    """exact_groups() of versions that were judged already.

    Within a bucket fingerprints and title keys agree, and the other rules ask about single versions or a shared contest, so a bucket is
    judged from its members' own marks and counts; no pairs are made.
    """
    key = ["fingerprint", "title_key"]
    pairs = blocked.select(F.col("left").alias("l"), F.col("right").alias("r"))
    inside = marked.select(F.col("id").alias("l"), *(F.col(k).alias(f"l_{k}") for k in key)).join(pairs, "l").join(marked.select(F.col("id").alias("r"), *key), "r")
    torn = inside.filter(" AND ".join(f"l_{k} = {k}" for k in key)).select(*key).distinct()
    bad = F.col("thin") | F.col("cut_off") | F.col("variant")
    buckets = marked.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.count("contest").alias("c"), F.countDistinct("contest").alias("cd"), F.count_if("forces").alias("f"), F.bool_or("numbered").alias("numbered"), F.min("id").alias("grp"))
    good = buckets.filter("n > 1 AND NOT bad AND c = cd AND NOT (numbered AND f > 1)").join(torn, key, "left_anti")
    return marked.join(good.select(*key, "grp"), key).select("id", "grp")


def reviewed_groups(groups: DataFrame, versions: DataFrame) -> DataFrame:
    """groups (group_id, member, pin) with stale: a member is gone or its pin differs. Stale groups stay occupied but are not applied."""
    now = groups.join(versions.select(F.col("id").alias("member"), "review_fingerprint"), "member", "left")
    stale = F.bool_or(F.coalesce(F.col("pin") != F.col("review_fingerprint"), F.lit(True)))
    return now.withColumn("stale", stale.over(Window.partitionBy("group_id"))).drop("review_fingerprint")


def claim_ids(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """grp, question_id: groups with an explicit id keep it; others claim, in order of their least member, the first unclaimed of their sorted old ids, else one made of the least member.

    members: grp, id, explicit (null or an id). assigned: id, old_id. Claims depend on each other only through ids that several groups may claim, so the components of groups and such ids
    are settled apart from each other; groups with no such id take their first choice. A component's groups are sorted, and read as a stream that keeps the ids already claimed. Two groups
    that end up with one id fail the job.
    """
    old = members.join(assigned, "id", "left")
    groups = old.groupBy("grp").agg(F.min("id").alias("least"), F.max("explicit").alias("explicit"), F.array_sort(F.collect_set("old_id")).alias("olds"))
    fresh = F.concat(F.lit("q_"), F.substring(F.sha2("least", 256), 1, 32))
    choices = F.when(F.col("explicit").isNotNull(), F.array("explicit")).otherwise(F.array_distinct(F.concat("olds", F.array(fresh))))
    groups = cut(groups.select("grp", "least", F.col("explicit").isNull().alias("late"), choices.alias("choices")))
    ids = groups.select("grp", F.explode("choices").alias("i"))
    contended = ids.groupBy("i").agg(F.count("*").alias("k")).filter("k > 1")
    # vertices: groups as g:..., ids as i:...; an id's edges lead to its groups, so no pairs of groups are made
    edges = ids.join(contended, "i").select(F.concat(F.lit("g:"), "grp").alias("u"), F.concat(F.lit("i:"), "i").alias("v"))
    ties = components(edges, "u", "v").filter("vertex LIKE 'g:%'").select(F.substring("vertex", 3, 1 << 30).alias("grp"), "component")
    alone = groups.join(ties, "grp", "left_anti").select("grp", F.get("choices", F.lit(0)).alias("question_id"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, set()
        for batch in batches:
            out = []
            for component, grp, choices in zip(*(batch.column(c).to_pylist() for c in ("component", "grp", "choices")), strict=True):
                if component != now:
                    now, taken = component, set()
                found = next((c for c in choices if c not in taken), choices[-1])
                taken.add(found)
                out.append((grp, found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["grp", "question_id"])

    fought = groups.join(ties, "grp").repartition("component").sortWithinPartitions("component", "late", "least").select("component", "grp", "choices")
    return unique_or_fail(alone.unionByName(fought.mapInArrow(settle, "grp string, question_id string")), "question_id")


def redirects(before: DataFrame, after: DataFrame) -> DataFrame:
    """old_id, target: retired ids lead on only if all their surviving members are in one question, else to null; active ids have none."""
    moved = before.join(after, "id").groupBy("old_id").agg(F.collect_set("question_id").alias("to"))
    return moved.join(after.select(F.col("question_id").alias("old_id")).distinct(), "old_id", "left_anti").select("old_id", F.when(F.size("to") == 1, F.get("to", F.lit(0))).alias("target"))


def resolve(links: DataFrame) -> DataFrame:
    """Every id with the end of its redirect chain, however long; a cycle fails. links: old_id, target (null: leads nowhere)."""
    return chain_ends(links.filter("target IS NOT NULL"), "old_id", "target")


def variant_edges(pairs: DataFrame, after: DataFrame) -> DataFrame:
    """Reviewed variants between questions, in both directions, once each."""
    l, r = after.select(F.col("id").alias("left"), F.col("question_id").alias("a")), after.select(F.col("id").alias("right"), F.col("question_id").alias("b"))  # noqa: E741
    one = pairs.filter("relation = 'variant'").join(l, "left").join(r, "right").select("a", "b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def audit(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """id, state of each audited or current source: removed-source, changed-source, new-source or the ledger's status. current: id, pin; ledger: id, pin, status."""
    both = current.select("id", F.col("pin").alias("now"), F.lit(True).alias("here")).join(ledger.select("id", "pin", "status", F.lit(True).alias("seen")), "id", "full_outer")
    state = F.when(F.col("here").isNull(), "removed-source").when(F.col("seen").isNull(), "new-source").when(~F.col("now").eqNullSafe(F.col("pin")), "changed-source").otherwise(F.col("status"))
    return both.select("id", state.alias("state"))


def question_titles(members: DataFrame, order: list[str]) -> DataFrame:
    """grp, title: the first member's title in the order. members: grp, title and more."""
    return members.groupBy("grp").agg(F.min_by("title", F.struct(*order)).alias("title"))


def aliases(members: DataFrame, *names: str) -> DataFrame:
    """grp, aliases: every name a question ever had, sorted."""
    held = F.collect_set(names[0])
    for name in names[1:]:
        held = F.array_union(held, F.collect_set(name))
    return members.groupBy("grp").agg(F.array_sort(held).alias("aliases"))


def ambiguous(members: DataFrame, alias: str, question: str) -> DataFrame:
    """alias, n: names that lead to several questions."""
    return members.groupBy(F.col(alias).alias("alias")).agg(F.countDistinct(question).alias("n")).filter("n > 1")


def interned(df: DataFrame, text: str, ref: str = "ref") -> tuple[DataFrame, DataFrame]:
    """df with a reference in place of the text, and the texts (ref, text), once each."""
    key = F.sha2(F.col(text), 256)
    return df.withColumn(ref, key).drop(text), df.select(key.alias(ref), F.col(text).alias("text")).filter(F.col(ref).isNotNull()).dropDuplicates([ref])


def with_texts(df: DataFrame, texts: DataFrame, ref: str = "ref") -> DataFrame:
    """df with the texts its references stand for; a reference without a text gives null."""
    return df.join(texts, ref, "left")


def schema_faults(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows break any rule (bad), of how many (n). A rule that is null is broken."""
    sound = F.lit(True)
    for rule in rules.values():
        sound = sound & F.coalesce(rule, F.lit(False))
    return df.agg(F.count_if(~sound).alias("bad"), F.count("*").alias("n"))


def names_of(df: DataFrame, by: str, name: str) -> DataFrame:
    """by, names: the distinct names of each key, sorted."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(name)).alias("names"))


def grouped_pairs(groups: DataFrame) -> DataFrame:
    """left_id, right_id: all pairs of members of each group (id, grp). Their number grows with the square of a group, so a group's pairs are dealt out over tasks; nothing else here needs them."""
    return pairs_within(cut(groups.select("id", "grp")), "grp").select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"))
