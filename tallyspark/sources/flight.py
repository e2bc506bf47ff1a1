"""Profiles that a page carries in its script chunks: JSON texts cut into pieces anywhere, searched for fields at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.nested import at, found, kind

# How a chunk is handed over, where a profile's own address stands, and where profiles are.
CHUNK = r"self\.__next_f\.push\((\[[\s\S]*?\])\)</script>"
CANONICAL = r'(?i)<link\b[^>]*rel="canonical"[^>]*href="([^"]+)"'
PROFILE = "https://takeuforward.org/profile/"
PLATFORM = "TUF"


def flight_lines(pages: DataFrame) -> DataFrame:
    """id, line, node: the JSON lines of each page (id, html) as variants. Chunks that are no [1, text] pairs and lines that are no JSON are passed over."""
    parts = F.transform(F.regexp_extract_all("html", F.lit(CHUNK), F.lit(1)), lambda c: F.try_parse_json(c))
    own = F.filter(parts, lambda c: F.coalesce((F.try_variant_get(c, "$[0]", "long") == 1) & (kind(at(c, "$[1]")) == "STRING"), F.lit(False)))
    text = F.array_join(F.transform(own, lambda c: F.try_variant_get(c, "$[1]", "string")), "")
    lines = pages.select("id", F.posexplode(F.split(text, "\n")).alias("line", "text")).filter(F.instr("text", ":") > 0)
    return lines.select("id", "line", F.try_parse_json(F.expr("substring(text, instr(text, ':') + 1)")).alias("node")).filter("node IS NOT NULL")


def _last(hits: DataFrame, value) -> DataFrame:
    """id, value of the last hit of each page: fields may be told several times, and the last one counts."""
    return hits.select(F.col("k.id").alias("id"), F.struct("k.line", "place").alias("order"), value.alias("value")).groupBy("id").agg(F.max_by("value", "order").alias("value"))


def flight_profiles(pages: DataFrame) -> DataFrame:
    """id, total, levels, topics (arrays of label, solved), heatmap (JSON text, null without one), fault. pages: id, handle, html.

    A page of another handle and one without sound totals have a fault and no figures.
    """
    lines = flight_lines(pages).join(pages.select("id", "handle"), "id").select(F.struct("id", "line", "handle").alias("k"), "node")
    own = F.coalesce(F.try_variant_get("node", "$.username", "string") == F.col("k.handle"), F.lit(False))
    progress = f"$.dsaProgress.byPlatform.{PLATFORM}"
    hits = found(lines, "k", "node", kind(at(F.col("node"), progress)).isin("OBJECT") | (own & kind(at(F.col("node"), "$.initialHeatmap")).isin("OBJECT", "ARRAY")))
    totals = _last(hits.filter(F.coalesce(kind(at(F.col("node"), progress)) == "OBJECT", F.lit(False))), at(F.col("node"), progress))
    maps = _last(hits.filter(own & F.coalesce(kind(at(F.col("node"), "$.initialHeatmap")).isin("OBJECT", "ARRAY"), F.lit(False))), F.to_json(at(F.col("node"), "$.initialHeatmap")))
    all_ = pages.select("id", "handle", F.regexp_extract("html", CANONICAL, 1).alias("place")).join(totals, "id", "left").join(maps.withColumnRenamed("value", "heatmap"), "id", "left")
    solved = F.try_variant_get("value", "$.solved", "double")
    mine = F.coalesce(F.col("place") == F.concat(F.lit(PROFILE), F.replace(F.url_encode("handle"), F.lit("+"), F.lit("%20"))), F.lit(False))
    sound = F.coalesce((F.try_variant_get("value", "$.platform", "string") == PLATFORM) & (solved >= 0) & ~kind(at(F.col("value"), "$.solved")).isin("STRING", "BOOLEAN"), F.lit(False))
    fault = F.when(~mine, "another profile").when(~sound, "no totals")
    rows = lambda path: F.when(fault.isNull(), F.coalesce(F.try_variant_get("value", path, "array<struct<label:string,solved:bigint>>"), F.array().cast("array<struct<label:string,solved:bigint>>")))
    return all_.select("id", F.when(fault.isNull(), solved.cast("long")).alias("total"), rows("$.categories").alias("levels"), rows("$.topics").alias("topics"), F.when(fault.isNull(), F.col("heatmap")).alias("heatmap"), fault.alias("fault"))
