"""Organizations: canonical ids, categories, splitting mixed tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic names that mixed tag lists may hold.
PRACTICE_TOPICS = ["Arrays", "Strings", "Dynamic Programming", "Math", "Number Theory", "Sorting", "Greedy", "Recursion", "Depth-first Search", "Matrices (2D Arrays)", "Binary Trees", "Linked List", "Binary Search", "Graph", "SQL", "Hash Table", "Stacks & Queues", "Two Pointers", "Trees", "Bit Manipulation", "Binary Search Trees", "Breadth-first Search", "Ad-Hoc", "Heap", "Backtracking", "Computational Geometry", "Tries"]
PLACEHOLDERS = ["unknown", "not available", "faang"]
# Tags that stand for several organizations.
COMPOUND = {"Amazon Microsoft": ["Amazon", "Microsoft"], "Amazon, Google, microsoft,": ["Amazon", "Google", "Microsoft"], "google, microsoft, amazon": ["Google", "Microsoft", "Amazon"], "Microsoft,Google": ["Microsoft", "Google"], "Infosys, Walmart": ["Infosys", "Walmart"], "DE Shaw India , Amazon": ["D.E.Shaw", "Amazon"]}


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def canonical_id(name: Column, aliases: dict[str, str]) -> Column:
    """The id that a name's slug stands for; aliases maps slugs to ids and is a parameter, as dictionaries differ between corpora."""
    if not aliases:
        return slug(name)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), slug(name)), slug(name))


def split_tags(topics: Column, companies: Column) -> tuple[Column, Column]:
    """Topics and organizations of a record: an explicit organization list wins; else tags that are no practice topics are organizations."""
    practice, distinct = F.array(*map(F.lit, PRACTICE_TOPICS)), F.array_distinct(F.coalesce(topics, F.array().cast("array<string>")))
    raw = F.coalesce(companies, F.array_except(distinct, practice))
    sound = F.filter(raw, lambda x: x.isNotNull() & (F.trim(x) != "") & ~F.lower(F.trim(x)).isin(PLACEHOLDERS))
    table = F.create_map(*[x for k, v in COMPOUND.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    split = F.array_distinct(F.flatten(F.transform(sound, lambda x: F.coalesce(F.element_at(table, x), F.array(x)))))
    return F.when(companies.isNotNull(), distinct).otherwise(F.array_intersect(distinct, practice)), split
