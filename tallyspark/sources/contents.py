"""What a problem page says, by platform: title and statement from the places where each platform has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.markup import attribute, attribute_of, classed, element, marked, text_of, texts_of
from tallyspark.functions.text import decoded, squeeze
from tallyspark.operators.nested import at, found, kind

# Where the platforms' pages have their titles, statements, script data and sections.
DESCRIPTION = attribute("data-track-load", "description_content")
PROBLEM_LINK = r"""\bhref\s*=\s*["']/problems/"""
STATEMENT = "problem-statement"
SCRIPT_DATA = attribute("id", "__NEXT_DATA__")
TASK = attribute("id", "task-statement")
SECTIONS = r"(?i)^(?:Problem Statement|Constraints|Input|Output)$"
PLAIN_PLACES = [classed("tuf-text-14"), classed("tuf-example"), r"\bdata-problem-description\b"]
LIMITS = [classed("tuf-dark-content-box"), r"\bdata-constraints\b"]
SEPARATOR = r"\s*[|–-].*"


def joined(*parts: Column) -> Column:
    return F.trim(F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != ""), " "))


def described(html: Column) -> Column:
    return attribute_of(html, "meta", attribute("name", "description"), "content")


def page_title(html: Column) -> Column:
    return text_of(element(html, "title"))


def leetcode(html: Column) -> Column:
    own = joined(text_of(element(html, "a", PROBLEM_LINK)), text_of(marked(html, DESCRIPTION)))
    return F.when(own != "", own).otherwise(F.coalesce(described(html), F.lit("")))


def codeforces(html: Column) -> Column:
    """The title and the first block without a class; the blocks with classes are limits, input, output and notes."""
    statement = element(html, "div", classed(STATEMENT))
    return F.coalesce(joined(text_of(element(element(statement, "div", classed("header")), "div", classed("title"))), text_of(element(statement, "div", without=r"\bclass\b"))), F.lit(""))


def codechef(html: Column) -> Column:
    box = F.coalesce(marked(html, attribute("id", STATEMENT)), marked(html, classed(STATEMENT)), marked(html, rf"""\bid\s*=\s*["'][^"']*{STATEMENT}"""))
    return F.when(box.isNotNull(), text_of(box)).otherwise(F.coalesce(described(html), page_title(html)))


def code360(html: Column) -> Column:
    box = F.coalesce(marked(html, r"""\bclass\s*=\s*["'][^"']*problem-"""), element(html, "codestudio-single-problem"), element(html, "pre"))
    own = joined(page_title(html), text_of(box))
    return F.when(own != "", own).otherwise(F.coalesce(described(html), F.lit("")))


def atcoder(html: Column) -> Column:
    """The English statement's sections with known headings; an old task without sections is taken whole if it has the first heading."""
    task = marked(html, TASK)
    root = F.coalesce(marked(task, classed("lang-en")), task)
    sections = F.regexp_extract_all(F.coalesce(root, F.lit("")), F.lit(r"(?is)<section\b[^>]*>(.*?)</section\s*>"), F.lit(1))
    heading = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"(?is)<h3\b[^>]*>(.*?)</h3\s*>", 1), "<[^>]*>", ""))
    known = F.filter(sections, lambda x: heading(x).rlike(SECTIONS))
    old = F.exists(F.regexp_extract_all(F.coalesce(root, F.lit("")), F.lit(r"(?is)<h3\b[^>]*>(.*?)</h3\s*>"), F.lit(1)), lambda h: F.trim(h).rlike("(?i)^Problem Statement$"))
    # sections are set apart before tags vanish, so that their texts do not run together
    return F.when(F.size(known) > 0, text_of(F.array_join(known, " "))).when(old, text_of(root)).otherwise("")


def plain(html: Column) -> Column:
    """The paragraphs and items of the statement's block, or of the page's main part, and the items of the limits."""
    box = F.coalesce(*(marked(html, m) for m in PLAIN_PLACES), element(html, "main"), element(html, "article"))
    paragraphs = F.concat(texts_of(box, "p"), texts_of(box, "li"))
    limits = texts_of(element(F.coalesce(*(marked(html, m) for m in LIMITS)), "ul"), "li")
    return squeeze(decoded(joined(text_of(element(html, "h1")), F.array_join(paragraphs, " "), F.array_join(limits, " "))))


READERS = {"leetcode": leetcode, "codeforces": codeforces, "codechef": codechef, "code360": code360, "atcoder": atcoder}


def script_problems(pages: DataFrame) -> DataFrame:
    """id, name, question: the first object with both in a page's script data, at any depth. pages: id, html."""
    docs = pages.select("id", F.try_parse_json(element(F.col("html"), "script", SCRIPT_DATA)).alias("doc")).filter("doc IS NOT NULL")
    node = F.col("node")
    both = (kind(at(node, "$.problem_name")) == "STRING") & (kind(at(node, "$.problem_question")) == "STRING")
    hits = found(docs, "id", "doc", F.coalesce(both, F.lit(False)))
    text = lambda c: F.try_variant_get("node", f"$.{c}", "string")
    return hits.groupBy("id").agg(F.min_by(F.struct(text("problem_name").alias("name"), text("problem_question").alias("question")), "place").alias("p")).select("id", "p.*")


def page_contents(pages: DataFrame) -> DataFrame:
    """id, content of problem pages (id, platform, html). Each platform's pages are read in their own way; of others the paragraphs are taken. Null html has an empty content."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("id", "platform", html.alias("html"))
    out = None
    named = "geeksforgeeks"
    for platform, read in READERS.items():
        own = pages.filter(F.col("platform") == platform).select("id", read(F.col("html")).alias("content"))
        out = own if out is None else out.unionByName(own)
    rest = pages.filter(~F.coalesce(F.col("platform").isin(*READERS, named), F.lit(False))).select("id", plain(F.col("html")).alias("content"))
    data = pages.filter(F.col("platform") == named)
    title = F.coalesce(F.col("name"), attribute_of(F.col("html"), "meta", attribute("property", "og:title"), "content"), F.regexp_replace(page_title(F.col("html")), SEPARATOR, ""))
    scripted = data.join(script_problems(data), "id", "left").select("id", joined(title, text_of(F.col("question"))).alias("content"))
    return out.unionByName(rest).unionByName(scripted)
