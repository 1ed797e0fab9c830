"""Structural units of a text: headings, images, lists, quotes, paragraphs and fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dialect import java
from ..functions.text import matches, trimmed, unescape_prose
from .lines import mark_fences, split_lines

ELEMENTS = "array<struct<text:string,src:string>>"


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit_no, type, level, text, src, lines) for every unit, numbered from 0 in order.

    Neighbouring lines that are neither blank nor fenced form a group; images leave it as units of their own, and what
    stands between them are units of the group's type. All windows go by the document, so the lines are dealt once.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    x = mark_fences(split_lines(docs, key, text), [key])
    x = x.withColumn("blank", ~F.col("in_fence") & (trimmed(F.col("line")) == ""))
    cut = F.coalesce(F.lag(F.col("blank") | F.col("in_fence")).over(w), F.lit(True))
    x = x.withColumn("starts", F.col("opens") | (~F.col("in_fence") & ~F.col("blank") & cut))
    x = split_elements(x.withColumn("gid", F.sum(F.col("starts").cast("int")).over(w)).where(~F.col("blank")), key)
    order = Window.partitionBy(key).orderBy("line_no", "part")
    x = x.withColumn("island", F.sum(F.col("e.src").isNotNull().cast("int")).over(order)).withColumn("is_image", F.col("e.src").isNotNull())
    units = units_of_islands(x, key)
    units = units.withColumn("unit_no", F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1)
    return units.select(key, "unit_no", "type", "level", "text", "src", "lines")


def split_elements(lines: DataFrame, key: str) -> DataFrame:
    """(key, gid, line_no, type, part, e struct<text,src>): lines (key, gid, line_no, line, in_fence) with their group's type, images apart from the text
    around them. Groups of another format's fences go."""
    g = Window.partitionBy(key, "gid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = lines.withColumn("first_line", F.first("line").over(g)).withColumn("n", F.count("*").over(g))
    x = x.where(~(F.col("in_fence") & matches(F.col("first_line"), P.FENCE_HTML)))
    kind = (
        F.when(F.col("in_fence"), "fence")
        .when((F.col("n") == 1) & matches(F.col("line"), P.HEADING), "heading")
        .when(matches(F.col("first_line"), P.LIST), "list")
        .when(matches(F.col("first_line"), P.QUOTE), "quote")
        .otherwise("para")
    )
    image = java(P.IMAGE)
    found = F.regexp_extract_all("line", F.lit(image), F.lit(1))
    parts = F.arrays_zip(F.split("line", image, -1).alias("text"), found.alias("src"))
    nothing = F.lit(None).cast("string")
    split = F.flatten(F.transform(parts, lambda p: F.array(F.struct(p["text"].alias("text"), nothing.alias("src")), F.struct(nothing.alias("text"), p["src"].alias("src")))))
    kept = F.filter(split, lambda e: e["src"].isNotNull() | (trimmed(e["text"]) != ""))
    whole = F.array(F.struct(F.col("line").alias("text"), nothing.alias("src")))
    x = x.withColumn("type", kind)
    x = x.withColumn("elements", F.when(F.col("type").isin("fence", "heading") | ~matches(F.col("line"), P.IMAGE), whole).otherwise(kept).cast(ELEMENTS))
    return x.select(key, "gid", "line_no", "type", F.posexplode("elements").alias("part", "e"))


def units_of_islands(elements: DataFrame, key: str) -> DataFrame:
    """(key, at, type, level, text, src, lines): a unit for each (gid, island, is_image), `at` its place."""
    units = elements.groupBy(key, "gid", "island", "is_image").agg(
        F.min(F.struct("line_no", "part")).alias("at"),
        F.first("type").alias("type"),
        F.first("e.src").alias("src"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part", F.col("e.text").alias("text")))), lambda p: p["text"]).alias("lines"),
    )
    heading, first = F.col("type") == "heading", F.get("lines", F.lit(0))
    return units.select(
        key,
        "at",
        F.when(F.col("is_image"), "image").otherwise(F.col("type")).alias("type"),
        F.when(heading, F.length(F.regexp_extract(first, java(P.HEADING), 1))).alias("level"),
        F.when(heading, trimmed(unescape_prose(F.regexp_extract(first, java(P.HEADING), 2)))).alias("text"),
        "src",
        F.when(~heading & ~F.col("is_image"), F.col("lines")).alias("lines"),
    )
