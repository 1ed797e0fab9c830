"""Rendering: units with their kinds become the text of a module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dialect import java
from ..functions.text import NBSP, image_marker, matches, module_file, replaced, report_line, right_trimmed, strip_whole_line_bold, trimmed, unescape_all, unescape_prose
from .language import detect_language

STATS = ("code", "images", "headings", "lists", "paras", "quotes")


def code_lines(type_: Column, lines: Column) -> Column:
    """A unit's lines as they go into a fence. A quote loses its marks, and its blank lines if a third or more are blank."""
    plain = F.transform(lines, lambda x: replaced(x, P.QUOTE, ""))
    filled = F.filter(plain, lambda x: trimmed(x) != "")
    blanks = F.size(plain) - F.size(filled)
    quoted = F.when((blanks > 0) & (blanks * 3 >= F.size(plain)), filled).otherwise(plain)
    return F.transform(F.when(type_ == "quote", quoted).otherwise(lines), lambda x: right_trimmed(F.translate(strip_whole_line_bold(unescape_all(x)), NBSP, " ")))


def join_dangling(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows (keys, order, line) with a line joined to the one before where that ends in a lone `=`.

    A joined line that is only `=` passes on what it was joined to, so the last line that isn't one decides.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    lone = F.col("line") == "="
    open_before = F.last(F.when(~lone, matches(F.col("line"), P.DANGLING)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = lines.withColumn("joins", F.coalesce(open_before, F.lit(False)) & (trimmed(F.col("line")) != ""))
    x = x.withColumn("row", F.sum((~F.col("joins")).cast("int")).over(w)).withColumn("at", F.row_number().over(w))
    parts = F.array_sort(F.collect_list(F.struct("at", "line")))
    texts = F.transform(parts, lambda p, i: F.when(i == 0, F.when(F.size(parts) > 1, right_trimmed(p["line"])).otherwise(p["line"])).otherwise(trimmed(p["line"])))
    return x.groupBy(*keys, "row").agg(F.array_join(texts, " ").alias("line")).withColumnRenamed("row", order[-1])


def code_segments(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units of kind code with `run` (neighbours of that kind) and `segment`: a new JSON root starts one once the brackets are closed."""
    w = Window.partitionBy(*keys).orderBy("unit_no")
    is_code = F.col("kind") == "code"
    x = units.withColumn("run", F.sum((is_code & F.coalesce(F.lag("kind").over(w) != "code", F.lit(True))).cast("int")).over(w)).where(is_code)
    x = x.withColumn("code_lines", code_lines(F.col("type"), F.col("lines")))
    joined = F.array_join("code_lines", "\n")
    count = lambda chars: F.length(joined) - F.length(F.translate(joined, chars, ""))
    r = Window.partitionBy(*keys, "run").orderBy("unit_no")
    upto = r.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("balance", F.sum(count("{[") - count("}]")).over(upto))
    # The depth never falls below zero: what the running balance has under its least value so far.
    x = x.withColumn("depth", F.col("balance") - F.least(F.lit(0), F.min("balance").over(upto)))
    x = x.withColumn("root", matches(trimmed(F.coalesce(F.get("code_lines", F.lit(0)), F.lit(""))), r"^[{[]"))
    cut = F.col("root") & F.first("root").over(upto) & (F.lag("depth").over(r) == 0)
    return x.withColumn("segment", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(r))


def code_blocks(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_no of the segment's first unit, piece, code, language): the fences of a module, in order."""
    seg = code_segments(units, keys)
    # A segment goes by the number of its first unit from here on.
    seg = seg.withColumn("first_unit", F.min("unit_no").over(Window.partitionBy(*keys, "run", "segment")))
    group = [*keys, "module_title", "first_unit"]
    lines = seg.select(*group, "unit_no", F.posexplode("code_lines").alias("pos", "line"))
    merged = join_dangling(lines, group, ["unit_no", "pos"])
    # A closing html tag ends a document: what follows in the segment is another one.
    before = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = merged.withColumn("piece", F.coalesce(F.sum(matches(F.col("line"), P.DOCUMENT_END, "i").cast("int")).over(before), F.lit(0)))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda p: p["line"])
    x = x.groupBy(*group, "piece").agg(F.array_join(rows, "\n").alias("code"))
    last = F.max("piece").over(Window.partitionBy(*group))
    x = x.withColumn("code", F.when(F.col("piece") == 0, F.regexp_replace("code", r"^\n+", "")).otherwise(F.col("code")))
    x = x.withColumn("code", F.when(F.col("piece") == last, F.regexp_replace("code", r"\n+\z", "")).otherwise(F.col("code")))
    x = x.where(trimmed(F.col("code")) != "")
    return x.select(*keys, F.col("first_unit").alias("unit_no"), "piece", "code", detect_language(F.col("code"), F.col("module_title")).alias("language"))


def text_chunks(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_no, piece, counted, chunk) of every unit that isn't code."""
    prose = F.array_join(F.transform("lines", lambda x: right_trimmed(unescape_prose(x))), "\n")
    body = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(6))), F.lit(" "), F.col("text")))
        .when(F.col("type") == "image", image_marker(F.col("src")))
        .when(F.col("type") == "fence", F.array_join("lines", "\n"))
        .otherwise(prose)
    )
    counted = F.when(F.col("type") == "heading", "headings").when(F.col("type") == "image", "images").when(F.col("type") == "list", "lists").when(F.col("type") == "quote", "quotes").when(F.col("type") == "para", "paras")
    return units.where("kind <> 'code'").select(*keys, "unit_no", F.lit(0).alias("piece"), counted.alias("counted"), F.concat(body, F.lit("\n")).alias("chunk"))


def render_modules(modules: DataFrame, units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, module_no, title, file, text, images, stats, report): one row per module, empty ones too."""
    keys = [key, "module_no"]
    fences = code_blocks(units, keys).select(*keys, "unit_no", "piece", F.lit("code").alias("counted"), F.concat(F.lit("```"), "language", F.lit("\n"), "code", F.lit("\n```\n")).alias("chunk"))
    chunks = fences.unionByName(text_chunks(units, keys))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "piece", "chunk"))), lambda c: c["chunk"]), "\n")
    counts = [F.sum(F.when(F.col("counted") == s, 1).otherwise(0)).cast("int").alias(s) for s in STATS]
    out = chunks.groupBy(*keys).agg(joined.alias("body"), *counts)
    x = modules.select(*keys, "title").join(out, keys, "left")
    text = F.concat(right_trimmed(F.regexp_replace(F.coalesce("body", F.lit("")), r"\n{3,}", "\n\n")), F.lit("\n"))
    stats = F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in STATS])
    x = x.select(*keys, "title", module_file(F.col("module_no"), F.col("title")).alias("file"), text.alias("text"), stats.alias("stats"))
    images = F.regexp_extract_all("text", F.lit(java(P.RENDERED_IMAGE)), F.lit(1))
    return x.select(*keys, "title", "file", F.concat(F.lit("# "), "title", F.lit("\n\n"), "text").alias("text"), images.alias("images"), "stats", report_line(F.col("module_no"), F.col("file"), F.col("stats")).alias("report"))


def manifest(rendered: DataFrame, generated: Column, key: str = "doc_id") -> DataFrame:
    """(key, generated, modules): one row per document, its modules in order."""
    module = F.struct(F.col("module_no").alias("number"), "title", F.concat(F.lit("modules/"), "file").alias("file"), "images", "stats")
    return rendered.groupBy(key).agg(F.array_sort(F.collect_list(module)).alias("modules")).select(key, generated.alias("generated"), "modules")
