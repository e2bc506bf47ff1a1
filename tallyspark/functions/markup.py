"""Elements of HTML by their start tags, with nesting: a scan over the tags of one kind, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions import text as T


def attribute(name: str, value: str) -> str:
    """A mark: the start tag has the attribute with this value."""
    return rf"""\b{name}\s*=\s*["']?{value}(?=["'\s>])"""


def classed(name: str) -> str:
    """A mark: the start tag has the class among others."""
    return rf"""\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?=["'\s])"""


def start(tag: str, mark: str | None = None, without: str | None = None) -> str:
    """A start tag with one mark and without another. tag: a name, or a pattern of names."""
    return rf"<{tag}(?=[\s>/])" + (rf"(?=[^>]*{mark})" if mark else "") + (rf"(?![^>]*{without})" if without else "") + r"[^>]*>"


def _inside(rest: Column, tag: Column) -> Column:
    """What comes before the end tag of an element whose start tag was just read. tag: its name; elements of the same name inside it are counted."""
    parts = F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"[\s>/])")))
    ends, begins = F.concat(F.lit("(?i)^</"), tag, F.lit(r"[\s>/]")), F.concat(F.lit("(?i)^<"), tag, F.lit(r"[\s>/]"))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))

    def walk(s: Column, p: Column) -> Column:
        depth = F.when(s["depth"] < 0, s["depth"]).otherwise(s["depth"] + F.when(F.regexp_like(p, ends), -1).when(F.regexp_like(p, begins), 1).otherwise(0))
        return F.struct(depth.alias("depth"), (s["n"] + F.when(depth < 0, 0).otherwise(1)).alias("n"))

    return F.array_join(F.slice(parts, 1, F.aggregate(parts, state, walk, lambda s: s["n"])), "")


def element(html: Column, tag: str, mark: str | None = None, without: str | None = None) -> Column:
    """What is inside the first such element, up to its own end tag. Null without one; an element that isn't closed reaches to the end."""
    begin = "(?is)" + start(tag, mark, without)
    return F.when(html.rlike(begin), _inside(F.regexp_extract(html, begin + "(.*)", 1), F.lit(tag)))


def marked(html: Column, mark: str) -> Column:
    """What is inside the first element with a mark, whatever its name."""
    begin = "(?is)" + start("([a-z][a-z0-9-]*)", mark)
    return F.when(html.rlike(begin), _inside(F.regexp_extract(html, begin + "(.*)", 2), F.regexp_extract(html, begin, 1)))


def attribute_of(html: Column, tag: str, mark: str, name: str) -> Column:
    """An attribute of the first such element, decoded; null without it."""
    found = F.regexp_extract(F.regexp_extract(html, "(?is)" + start(tag, mark), 0), rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 0)
    return F.nullif(T.decoded(F.regexp_replace(found, rf"""(?is)^\b{name}\s*=\s*["']|["']$""", "")), F.lit(""))


def text_of(html: Column) -> Column:
    """The text of a fragment on one line: tags and comments vanish, entities are decoded; empty for null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", ""), r"(?s)<[a-zA-Z/!?][^>]*>", "")
    return T.squeeze(T.decoded(bare))


def texts_of(html: Column, tag: str) -> Column:
    """The texts of all elements of a kind that does not nest, without empty ones."""
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<{tag}\b(?=[\s>/])[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    bare = F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[a-zA-Z/!?][^>]*>", ""), r"(?U)\s+", " ")))
    return F.filter(bare, lambda x: x != "")
