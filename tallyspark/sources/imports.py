"""Solved lists that users paste or upload: each text is told apart as JSON, CSV or a list of URLs, read to rows, and every row is matched, counted as a duplicate, or given a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import urls
from tallyspark.operators.nested import at, kind

# What an import may hold, how a CSV begins, and the faults and reasons as they are reported.
MOST_CHARS, MOST_ROWS = 2_000_000, 20_000
CSV = r'(?i)^"?(?:url|platform|title)"?[,\r\n]'
TOO_LONG = "Import must be smaller than 2 MB."
TOO_MANY = "Import at most 20,000 questions at a time."
NOT_JSON = "Import is not valid JSON."
NO_ARRAY = "JSON must be an array or an object containing a questions array."
NO_URL = "CSV needs a url column."
UNCLOSED = "CSV contains an unclosed quote."
EXPECTED = "Expected a problem URL."
INVALID = "Invalid URL"
INSECURE = "Use an HTTPS problem URL."
UNSUPPORTED = "Unsupported problem URL or mismatched platform."
NOT_DONE = "This platform is not supported in Done Questions."
NOT_CONNECTED = "Connect the account first."
LEFT_OUT = "tuf"

#: A CSV field with what ends it: unquoted characters and quoted parts, in which quotes are doubled and separators are text.
FIELD = r'((?:[^",\r\n]|"(?:[^"]|"")*")*)(,|\r\n|\r|\n|\z)'


def told_apart(imports: DataFrame) -> DataFrame:
    """id, text (without a byte order mark and blanks at the ends), form (json, csv or urls), fault (null, or why the import cannot be read). imports: id, text."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    rows = imports.select("id", (F.length(F.coalesce("text", F.lit(""))) > MOST_CHARS).alias("long"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"))
    form = F.when(F.col("text").rlike(r"^[\[{]"), "json").when(F.col("text").rlike(CSV), "csv").otherwise("urls")
    rows = rows.withColumn("form", form).withColumn("doc", F.when(F.col("form") == "json", F.try_parse_json("text")))
    items = F.when(kind(F.col("doc")) == "OBJECT", at(F.col("doc"), "$.questions")).otherwise(F.col("doc"))
    rows = rows.withColumn("items", items)
    # a quote that is open at the end leaves an odd number of them
    odd = F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 1
    names = F.transform(F.split(F.regexp_replace(F.regexp_extract("text", r"^[^\r\n]*", 0), '"', ""), ","), lambda n: F.lower(F.trim(n)))
    csv = F.when(odd, UNCLOSED).when(~F.array_contains(names, "url"), NO_URL)
    json = F.when(F.col("doc").isNull(), NOT_JSON).when(~F.coalesce(kind(F.col("items")) == "ARRAY", F.lit(False)), NO_ARRAY)
    fault = F.when(F.col("long"), TOO_LONG).when(F.col("form") == "json", json).when(F.col("form") == "csv", csv)
    return rows.select("id", "text", "form", "items", fault.alias("fault"))


def _json_rows(sound: DataFrame) -> DataFrame:
    """A row for each item: an object with a URL, or a URL itself."""
    each = sound.filter("form = 'json'").select("id", F.posexplode(F.try_variant_get("items", "$", "array<variant>")).alias("pos", "item"))
    text = lambda path: F.when(kind(at(F.col("item"), path)) == "STRING", F.try_variant_get("item", path, "string"))
    title = F.try_variant_get("item", "$.title", "string")
    return each.select("id", (F.col("pos") + 1).alias("row"), F.coalesce(text("$"), text("$.url")).alias("url"), F.when(kind(F.col("item")) == "OBJECT", title).alias("title"), text("$.platform").alias("platform"))


def _csv_rows(sound: DataFrame) -> DataFrame:
    """A row for each record after the header; records without any value are passed over. Fields are put into records by counting line ends, within one import."""
    # the last field's pattern matches once more, with nothing, at the end of the text
    fields = F.regexp_extract_all("text", F.lit(FIELD), F.lit(0))
    each = sound.filter("form = 'csv'").select("id", F.posexplode(fields).alias("pos", "raw"))
    by = Window.partitionBy("id").orderBy("pos")
    each = each.withColumn("ends", F.col("raw").rlike(r'(?s)^(?:[^",\r\n]|"(?:[^"]|"")*")*[\r\n]'))
    each = each.withColumn("line", F.coalesce(F.sum(F.col("ends").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    body = F.regexp_replace(F.regexp_extract("raw", FIELD, 1), '"((?:[^"]|"")*)"', "$1")
    value = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r"(?U)^\s+|\s+$", "")
    lines = each.select("id", "line", "pos", value.alias("value")).groupBy("id", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    lines = lines.filter(F.exists("values", lambda v: v != "")).withColumn("row", F.row_number().over(Window.partitionBy("id").orderBy("line")) - 1)
    header = lines.filter("row = 0").select("id", F.transform("values", F.lower).alias("names"))
    record = F.map_from_arrays(F.array_distinct("names"), F.transform(F.array_distinct("names"), lambda n: F.get("values", F.array_position("names", n).cast("int") - 1)))
    rows = lines.filter("row > 0").join(header, "id").withColumn("record", record)
    pick = lambda name: F.try_element_at("record", F.lit(name))
    return rows.select("id", "row", pick("url").alias("url"), pick("title").alias("title"), F.nullif(pick("platform"), F.lit("")).alias("platform"))


def _url_rows(sound: DataFrame) -> DataFrame:
    each = sound.filter("form = 'urls'").select("id", F.posexplode(F.filter(F.split("text", r"(?U)\s+"), lambda u: u != "")).alias("pos", "url"))
    none = F.lit(None).cast("string")
    return each.select("id", (F.col("pos") + 1).alias("row"), "url", none.alias("title"), none.alias("platform"))


def read_imports(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of sound imports (id, row, url, title, platform), and id, fault of the others."""
    told = told_apart(imports)
    sound = told.filter("fault IS NULL")
    rows = _json_rows(sound).unionByName(_csv_rows(sound)).unionByName(_url_rows(sound))
    many = rows.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_ROWS).select("id", F.lit(TOO_MANY).alias("fault"))
    return rows.join(many.select("id"), "id", "left_anti"), told.filter("fault IS NOT NULL").select("id", "fault").unionByName(many)


def _reason(url: Column, platform: Column, told: Column, connected: Column) -> Column:
    """Why a row brings no question; null if it does."""
    scheme = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit(""))
    plain = (scheme == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & ~F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")).rlike(r":\d+$")
    return (
        F.when(url.isNull(), EXPECTED).when(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), INVALID).when(~plain, INSECURE).when(platform.isNull() | F.coalesce(told != platform, F.lit(False)), UNSUPPORTED)
        .when(platform == LEFT_OUT, NOT_DONE).when(~connected, NOT_CONNECTED)
    )


def previewed(imports: DataFrame, accounts: DataFrame, solved: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of sound imports: id, row, state (record, duplicate, unresolved), key, platform, title, url, difficulty, reason; and the imports' faults (id, fault).

    imports: id, text; accounts: platform, of those connected; solved: key, of questions already done; catalog: key, title, difficulty. Of rows with one key the first of an import stays; dates that an import claims are
    never taken over.
    """
    rows, faults = read_imports(imports)
    url = F.trim("url")
    own = rows.select("id", "row", url.alias("given"), "title", F.col("platform").alias("told"), urls.import_platform(url).alias("platform"), urls.import_url(url).alias("url"))
    own = own.join(F.broadcast(accounts.select("platform", F.lit(True).alias("connected")).distinct()), "platform", "left")  # no more accounts than there are platforms
    own = own.withColumn("reason", _reason(F.col("given"), F.col("platform"), F.col("told"), F.coalesce("connected", F.lit(False))))
    good = own.filter("reason IS NULL").withColumn("key", urls.problem_key(F.col("platform"), F.col("url"))).withColumn("title", urls.import_title(F.col("given"), F.col("title")))
    place = F.row_number().over(Window.partitionBy("id", "key").orderBy("row"))
    done = solved.select("key", F.lit(True).alias("done")).distinct()
    best = catalog.groupBy("key").agg(F.min(F.struct("title", "difficulty")).alias("known"))
    marked = good.withColumn("place", place).join(done, "key", "left").join(best, "key", "left")
    state = F.when((F.col("place") > 1) | F.coalesce("done", F.lit(False)), "duplicate").otherwise("record")
    found = marked.select("id", "row", state.alias("state"), "key", "platform", F.coalesce("known.title", "title").alias("title"), "url", F.col("known.difficulty").alias("difficulty"), F.lit(None).cast("string").alias("reason"))
    none = F.lit(None).cast("string")
    bad = own.filter("reason IS NOT NULL").select("id", "row", F.lit("unresolved").alias("state"), none.alias("key"), none.alias("platform"), none.alias("title"), none.alias("url"), none.alias("difficulty"), "reason")
    return found.unionByName(bad), faults
