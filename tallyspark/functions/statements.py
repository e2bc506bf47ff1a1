"""Problem statements: database detectors, splitting into description and constraints, difficulty, match and review labels. All are column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a database problem, by platform.
DATABASE_MARKS = {
    "leetcode": [r"Table:\s*\w+", r"Column Name.*Type", r"\+[-+]+\+", r"employee_id.*int", r"varchar\(\d+\)", r"Write a.*solution", r"Select.*from", r"database"],
    "code360": [r"Table:\s*\w+", r"Column Name.*Type", r"\+[-+]+\+", r"varchar\(\d+\)", r"create table", r"insert into", r"select\s+.*\s+from", r"database", r"SQL Query"],
    "codechef": [r"create table", r"insert into", r"select\s+.*\s+from", r"varchar\s*\(", r"database\s+schema", r"sql\s+query"],
    "codeforces": [r"create table", r"insert into", r"select .* from", r"varchar\s*\(", r"database schema", r"sql\x20query"],
    "geeksforgeeks": [r"create table", r"insert into", r"select .* from", r"varchar\s*\(", r"schema", r"sql\x20query"],
}
# The headings at which a statement is cut, by platform (example, constraints, what comes after the constraints).
HEADINGS = {
    "leetcode": (r"(?i)Example\s*\d*\s*:", r"(?i)Constraints?\s*:", r"(?i)Follow-up\s*:"),
    "geeksforgeeks": (r"Examples?:", r"(?i)Constraints?:", None),
    "codechef": (r"(?i)Sample\s+Input\s*:", r"(?i)Constraints\s*:", r"(?i)Sample\s+Input\s*:"),
}
# The review reasons, and titles that may name a variant.
MISSING, DIFFERENT, VERIFY, VARIANT = "Missing statement: review originals", "Constraints differ: compare feasible solutions, not literal bounds", "Verify objective, output contract and edge cases", "Possible task variant"
VARIANT_TITLE, NUMBERED_TITLE = r"(?i)(?<![A-Za-z0-9_])(easy|hard|version|dataset|subtask)(?![A-Za-z0-9_])", r"(?i)^[a-z]\d+\."


def is_database(text: Column, platform: str) -> Column:
    """Whether any mark of the platform is in the text, in any case; a mark doesn't reach over line ends."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{m})" for m in DATABASE_MARKS[platform])), F.lit(False))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_dollars(text: Column) -> Column:
    """Formula marks and runs of white space become single spaces; null counts as empty."""
    return one_line(F.regexp_replace(F.coalesce(text, F.lit("")), r"\$+", " "))


def _at(text: Column, pattern: str) -> Column:
    """Where a pattern begins, from 1; null where it isn't."""
    return F.nullif(F.regexp_instr(text, F.lit(pattern)), F.lit(0))


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match of a pattern; null where it isn't."""
    at = _at(text, pattern)
    return F.when(at.isNotNull(), F.substr(text, at + F.length(F.regexp_substr(text, F.lit(pattern)))))


def split_statement(text: Column, platform: str) -> Column:
    """struct<description, constraints> of a statement's plain text: up to the first example, else up to the constraints; and what follows their heading. Each on one line."""
    example, heading, end = HEADINGS[platform]
    text = F.coalesce(text, F.lit(""))
    cut = F.coalesce(_at(text, example), _at(text, heading))
    description = F.when(cut.isNotNull(), F.substr(text, F.lit(1), cut - 1)).otherwise(F.regexp_replace(text, r"(?is)Follow-up:.*$", "") if platform == "leetcode" else text)
    rest = F.coalesce(_after(text, heading), F.lit(""))
    if end:
        stop = _at(rest, end)
        rest = F.when(stop.isNotNull(), F.substr(rest, F.lit(1), stop - 1)).otherwise(rest)
    return F.struct(one_line(description).alias("description"), one_line(rest).alias("constraints"))


def from_components(statement: Column, input_format: Column, constraints: Column) -> Column:
    """struct<description, constraints> of a statement given in parts; nothing without the statement itself."""
    own, given = without_dollars(statement), without_dollars(input_format)
    described = F.concat(own, F.when(given != "", F.concat(F.lit(" Input: "), given)).otherwise(""))
    return F.struct(F.when(own != "", described).otherwise("").alias("description"), F.when(own != "", without_dollars(constraints)).otherwise("").alias("constraints"))


def difficulty_from_rating(rating: Column) -> Column:
    return F.when(rating.isNull() | (rating <= 1200), "Easy").when(rating <= 2000, "Medium").otherwise("Hard")


def difficulty_name(code: Column, names: dict[str, str], default: str = "Unknown") -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code), F.lit(default))


def topic_union(*tags: Column) -> Column:
    """Distinct trimmed tags of several lists, sorted, without empty ones."""
    all_ = F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in tags))
    return F.array_sort(F.array_distinct(F.filter(F.transform(all_, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))


def topic_aliases(topics: Column, names: dict[str, str]) -> Column:
    """Topics under their canonical names, distinct and sorted."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(topics, lambda x: F.coalesce(F.element_at(table, x), x))))


def relationship(contract: Column, other: Column) -> Column:
    """Versions of a question are equivalent if their contracts are one; none counts as base."""
    return F.when(F.coalesce(contract, F.lit("base")) == F.coalesce(other, F.lit("base")), "equivalent").otherwise("platform-variant")


def match_type(same_question: Column, same_contract: Column, score: Column) -> Column:
    return F.when(F.coalesce(same_question, F.lit(False)), F.when(same_contract, "confirmed").otherwise("platform-variant")).when(score > 0.6, "exact").otherwise("similar")


def review_reasons(missing: Column, constraints_differ: Column, exact: Column, titles: Column) -> Column:
    """Why a candidate needs a review, in order. titles: an array of the two titles."""
    variant = F.array_join(titles, " ").rlike(VARIANT_TITLE) | F.exists(titles, lambda x: x.rlike(NUMBERED_TITLE))
    return F.filter(F.array(F.when(missing, MISSING), F.when(constraints_differ, DIFFERENT), F.when(~exact, VERIFY), F.when(variant, VARIANT)), lambda x: x.isNotNull())


def recovery_outcome(asked: Column, got: Column, identity: Column, content: Column, premium: Column, description: Column, failed: Column) -> Column:
    """What became of a blank statement that was asked for again. got: whether an answer for it came; failed: whether the request had errors."""
    return (
        F.when(~asked, "not-attempted-after-request-failure").when(~got, F.when(failed, "api-error").otherwise("not-found")).when(~identity, "identity-mismatch")
        .when(F.coalesce(content, F.lit("")) == "", F.when(premium, "premium-locked").otherwise("empty-content")).when(F.length(description) < 80, "insufficient-statement").otherwise("recovered")
    )
