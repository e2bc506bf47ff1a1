"""Parsers of captured provider pages: accepted-record feeds, calendars, profiles, solved histories, contest schedules, statements."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyspark.functions import text, urls
from tallyspark.functions.times import INDIA, india_time

# How the providers' pages write what is read from them, and the hosts and paths of one of them.
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
ACCEPTED = r"(?i)title\s*=\s*['\"]accepted['\"]"
PROBLEM_LINK = r"(?i)href\s*=\s*['\"][^'\"]*/problems/([a-z0-9_]+)['\"]"
SOLUTION_LINK = r"(?i)href\s*=\s*['\"][^'\"]*/(?:viewsolution|status)/(\d+)['\"]"
CLOCK_AND_DAY = r"(?i)(\d{1,2}:\d{2}\s*(?:AM|PM)\s+\d{2}/\d{2}/\d{2,4})"
CALENDAR = r"(?s)\b(?:var|let|const)\s+userDailySubmissionsStats\s*=\s*(\[.*?\])\s*;"
OFFSET_TIME = r"(?i)<time\b[^>]*>(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d[+-]\d{4})</time>"
CONTEST_LINK = r"(?is)<a\b[^>]*href=[\"']/contests/([a-zA-Z0-9_-]+)[\"'][^>]*>(.*?)</a>"
DURATION = r"(?i)<td\b[^>]*>\s*(\d{1,3}:\d\d)\s*</td>"
CELL = r"(?is)<th\b[^>]*>\s*{}\s*</th>\s*<td\b[^>]*>(.*?)</td>"
HOST, FORMER_HOST = "https://www.naukri.com", r"^https://(?:www\.)?codingninjas\.com/(?:studio|codestudio)/problems/"
PROBLEM_PATH, ZONED = r"^/code360/problems/[a-zA-Z0-9_-]+/?$", r"(?i)^\d{4}-\d{2}-\d{2}T.*(?:Z|[+-]\d{2}:\d{2})$"


@dataclass(frozen=True)
class Field:
    """One value of a record: where it is in the source, how its text is read, and whether a record may lack it."""

    name: str
    pattern: str
    read: Callable[[Column], Column] = lambda x: x
    group: int = 1
    needed: bool = True


def records(rows: DataFrame, source: str, fields: list[Field], *kept: str) -> DataFrame:
    """A row for each source text that has all its needed fields: the kept columns and the fields."""
    columns = [f.read(F.nullif(F.regexp_extract(source, f.pattern, f.group), F.lit(""))).alias(f.name) for f in fields]
    return rows.select(*kept, *columns).dropna(subset=[f.name for f in fields if f.needed])


def table_rows(pages: DataFrame, html: str) -> DataFrame:
    """pos, row: the table rows of the pages, in order."""
    return pages.select(F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ROW), F.lit(1))).alias("pos", "row"))


def _indian_clock(value: Column) -> Column:
    """An instant from a clock with AM or PM and a day, years of two or four digits."""
    plain = F.upper(F.regexp_replace(F.regexp_replace(value, r"\s+", ""), r"(?i)([AP]M)", " $1 "))
    four = F.length(F.substring_index(plain, "/", -1)) == 4
    return F.to_utc_timestamp(F.when(four, F.try_to_timestamp(plain, F.lit("h:mm a dd/MM/yyyy"))).otherwise(F.try_to_timestamp(plain, F.lit("h:mm a dd/MM/yy"))), INDIA)


def _seconds(duration: Column) -> Column:
    """Hours and minutes in seconds."""
    parts = F.split(duration, ":")
    return F.get(parts, F.lit(0)).cast("long") * 3600 + F.get(parts, F.lit(1)).cast("long") * 60


FEED = [Field("code", PROBLEM_LINK), Field("ts", CLOCK_AND_DAY, _indian_clock), Field("solution", SOLUTION_LINK, needed=False)]
SCHEDULE = [Field("slug", CONTEST_LINK), Field("title", CONTEST_LINK, text.html_text, 2, False), Field("start_s", OFFSET_TIME, lambda x: F.unix_seconds(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ssxx")))), Field("long_s", DURATION, _seconds)]


def accepted_feed(pages: DataFrame, html: str = "html") -> DataFrame:
    """id, key, code, ts of accepted rows; times are Indian; rows without link or time are no records. A row without a solution's number is named by its problem and instant."""
    found = records(table_rows(pages, html).filter(F.col("row").rlike(ACCEPTED)), "row", FEED)
    own = F.concat_ws(":", "code", F.unix_millis("ts").cast("string"))
    return found.select(F.coalesce("solution", own).alias("id"), F.concat(F.lit("codechef:"), "code").alias("key"), "code", "ts")


def embedded_calendar(pages: DataFrame, html: str = "html") -> DataFrame:
    """day, count of a calendar held in a script; days need no padding, the last entry of a day wins, and a missing calendar and impossible days or counts fail the job."""
    held = F.from_json(F.nullif(F.regexp_extract(html, CALENDAR, 1), F.lit("")), "array<struct<date string, value string>>")
    entries = pages.select(F.posexplode(F.coalesce(held, F.raise_error(F.lit("calendar is unavailable")))).alias("pos", "e"))
    read = entries.select("pos", F.try_to_date("e.date", "yyyy-M-d").alias("day"), F.when(F.col("e.value").rlike(r"^\s*\d{1,15}\s*$"), F.trim("e.value").cast("long")).alias("count"))
    sound = F.when(F.col("day").isNotNull() & F.col("count").isNotNull(), F.col("day")).otherwise(F.raise_error(F.lit("invalid calendar data")))
    return read.withColumn("day", sound).groupBy("day").agg(F.max_by("count", "pos").alias("count"))


def difficulty_map(responses: DataFrame, json: str = "json") -> DataFrame:
    """id, key, title, difficulty, day (null where undated) of a map of difficulty to id to record."""
    kind = "map<string, map<string, struct<slug string, pname string, user_subtime string>>>"
    levels = responses.select(F.explode(F.from_json(json, kind)).alias("difficulty", "group"))
    rows = levels.select("difficulty", F.explode("group").alias("id", "p")).filter("p.slug IS NOT NULL AND p.slug <> ''")
    day = F.substring(F.coalesce("p.user_subtime", F.lit("")), 1, 10)
    return rows.select("id", F.concat(F.lit("geeksforgeeks:"), "p.slug").alias("key"), F.coalesce(F.nullif("p.pname", F.lit("")), "p.slug").alias("title"), "difficulty", F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd")).alias("day"))


def history_page(rows: DataFrame, now: Column) -> DataFrame:
    """key, url, title, ts of rows (link, title, solved_at); old hosts are rewritten, other links skipped; instants need a zone; the latest row of a key stays."""
    whole = F.regexp_replace(F.concat(F.when(F.col("link").startswith("/"), HOST).otherwise(""), "link"), FORMER_HOST, HOST + "/code360/problems/")
    path = urls.path_of(urls.safe_problem_url(whole, F.lit("code360")))
    ours = path.rlike(PROBLEM_PATH) & ~whole.rlike(r"^https://[^/]*[@:]")  # neither a user nor a port in the address
    past = F.when(F.col("solved_at").rlike(ZONED), F.try_to_timestamp("solved_at"))
    read = rows.select(F.when(ours, F.concat(F.lit(HOST), F.rtrim(path, F.lit("/")))).alias("url"), F.substring(F.trim("title"), 1, 300).alias("title"), past.alias("ts")).dropna(subset=["url"]).filter("title <> ''")
    dated = read.withColumn("ts", F.when(F.col("ts").between(F.timestamp_micros(F.lit(1)), now + F.expr("INTERVAL 60 SECONDS")), F.col("ts")))
    # of a key the latest row, dated ones first; of equal instants the first title
    order = F.struct(F.col("ts").isNull().alias("undated"), (-F.unix_micros("ts")).alias("back"), "title", "url")
    best = dated.groupBy(urls.problem_key(F.lit("code360"), F.col("url")).alias("key")).agg(F.min(F.struct(order.alias("o"), "url", "title", "ts")).alias("r"))
    return best.select("r.url", "r.title", "r.ts", "key")


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, href: the targets of a page's links, in order, repeated ones too; only links whose first attribute is a double-quoted href."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('<a href="([^"]*)">'), F.lit(1))).alias("href"))


def page_content(html: Column, element: str = "article") -> Column:
    """The text of a page's first element of a kind, tags as spaces and on one line; empty without it."""
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), f"(?s)<{element}>(.*?)</{element}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"\s+", " "))


def page_fingerprint(rows: DataFrame) -> DataFrame:
    """One hash of a history page's links and instants, whatever their order; an equal one means that paging stands still. Sums and a count stand for the rows, so none are gathered."""
    one = F.xxhash64("link", "solved_at")
    sums = [F.sum(F.pmod(h, F.lit(1 << 31))).cast("string") for h in (one, F.xxhash64(F.lit(1), "link", "solved_at"))]
    return rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("fingerprint"))


def profile_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """rating, highest_rating, rank of a profile's table; null where a cell is missing or holds no number."""

    def number(cell: Column) -> Column:
        return F.replace(F.nullif(F.regexp_extract(F.trim(F.regexp_replace(cell, "<[^>]+>", "")), r"^([\d,]+)", 1), F.lit("")), F.lit(","), F.lit("")).cast("long")

    cells = [Field(label.lower().replace(" ", "_"), CELL.format(label), number, needed=False) for label in ("Rating", "Highest Rating", "Rank")]
    return pages.select("*", *(f.read(F.regexp_extract(html, f.pattern, f.group)).alias(f.name) for f in cells))


def schedule_table(pages: DataFrame, html: str = "html") -> DataFrame:
    """slug, title, start_s, end_s, pos of upcoming contests: an instant with offset, a link and a duration of hours and minutes."""
    found = records(table_rows(pages, html), "row", SCHEDULE, "pos")
    return found.select("slug", "title", "start_s", (F.col("start_s") + F.col("long_s")).alias("end_s"), "pos")


def schedule_json(items: DataFrame, kind: str) -> DataFrame:
    """slug, title, start_s, end_s, pos of one provider's rows: iso (contest_code, ISO instants), seconds (event rows of category CONTEST), india (type 3, local Indian times)."""
    if kind == "iso":
        s = lambda c: F.unix_seconds(F.try_to_timestamp(c))
        return items.select(F.col("contest_code").alias("slug"), F.col("contest_name").alias("title"), s("contest_start_date_iso").alias("start_s"), s("contest_end_date_iso").alias("end_s"), "pos")
    if kind == "seconds":
        return items.filter("event_category = 'CONTEST'").select("slug", F.col("name").alias("title"), F.col("event_start_time").cast("long").alias("start_s"), F.col("event_end_time").cast("long").alias("end_s"), "pos")
    s = lambda c: F.unix_seconds(india_time(F.col(c)))
    return items.filter("type = 3").select("slug", F.coalesce("name", "title").alias("title"), s("start_time").alias("start_s"), s("end_time").alias("end_s"), "pos")


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Sections(HTMLParser):
    """Texts of the children of one element: the class of each child, or the h3 heading before it."""

    def __init__(self, wanted: str, value: str):
        super().__init__()
        self.wanted, self.value, self.depth, self.quiet = wanted, value, 0, 0
        self.parts: list[tuple[str, list[str]]] = []
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if self.depth == 0:
            if self.value in (own.get(self.wanted) or "").split():
                self.depth = 1
            return
        if tag in ("script", "style"):
            self.quiet += 1
        if self.depth == 1 and self.wanted == "class":
            self.parts.append((own.get("class") or "", []))
        if tag == "h3" and self.wanted == "id":
            self.heading = []
        if tag not in VOID:
            self.depth += 1

    def handle_endtag(self, tag):
        if self.depth and tag not in VOID:
            self.depth -= 1
            if tag in ("script", "style") and self.quiet:
                self.quiet -= 1
            if tag == "h3" and self.heading is not None:
                self.parts.append((" ".join(self.heading).strip().lower(), []))
                self.heading = None

    def handle_data(self, data):
        if self.depth and not self.quiet and data.strip():
            if self.heading is not None:
                self.heading.append(data.strip())
            elif self.parts:
                self.parts[-1][1].append(data.strip())


def _squeezed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\$+", " ", " ".join(parts))).strip()


def _by_class(html: str | None) -> tuple[str, str]:
    p = _Sections("class", "problem-statement")
    p.feed(html or "")
    kinds = [(set(c.split()), _squeezed(t)) for c, t in p.parts]
    skipped = {"header", "input-specification", "sample-tests", "note", "output-specification"}
    return next((t for c, t in kinds if not c & skipped and t), ""), next((t for c, t in kinds if "input-specification" in c), "")


def _by_heading(html: str | None) -> tuple[str, str]:
    p = _Sections("id", "task-statement")
    p.feed(html or "")
    named = {h: re.sub(r"\s+", " ", " ".join(t)).strip() for h, t in p.parts}
    return named.get("problem statement", ""), named.get("constraints", "")


def statement_sections(html: Column, how: str) -> Column:
    """struct(description, constraints) of a statement page, by the classes of its parts (class) or by its headings (heading). A tree is needed, so this runs in Arrow batches."""
    pick = _by_class if how == "class" else _by_heading

    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pick(x) for x in pages], columns=["description", "constraints"])

    return pandas_udf(run, "description string, constraints string")(html)
