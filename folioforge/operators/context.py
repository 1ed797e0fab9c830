"""Kinds of units: votes of their lines, then their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import is_file_path_label, is_spanish_label, mixed_prose
from ..functions.text import matches, replaced, trimmed, unescape_all, word_count
from .lines import classify_lines


def classify_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `kind`. A paragraph goes by the majority of its lines, a tie is unknown; a quote is code if code has at least as
    many votes as prose, and any; other types are their own kind."""
    others = [c for c in units.columns if c not in keys]
    lines = units.select(*units.columns, F.explode_outer(F.when(F.col("type").isin("para", "quote"), F.col("lines"))).alias("voter"))
    lines = lines.withColumn("voter", F.when(F.col("type") == "quote", replaced(F.col("voter"), P.QUOTE, "")).otherwise(F.col("voter")))
    voted = classify_lines(lines, "voter")
    code, prose = (F.sum(F.when(F.col("line_kind") == k, 1).otherwise(0)).alias(f"votes_{k}") for k in ("code", "prose"))
    got = voted.groupBy(*keys).agg(*[F.first(c).alias(c) for c in others], code, prose)
    c, p = F.col("votes_code"), F.col("votes_prose")
    kind = (
        F.when(F.col("type") == "quote", F.when((c > 0) & (c >= p), "code").otherwise("quote"))
        .when(F.col("type") == "para", F.when(c > p, "code").when(p > c, "prose").otherwise("unknown"))
        .otherwise(F.col("type"))
    )
    return got.withColumn("kind", kind).select(*units.columns, "kind")


def resolve_unknowns(rows: DataFrame, keys: list[str], order: str = "unit_no") -> DataFrame:
    """`kind` without unknowns: code if the nearest known kinds on both sides are code, else prose."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col("kind") != "unknown", F.col("kind"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    settled = F.when((before == "code") & (after == "code"), "code").otherwise("prose")
    return rows.withColumn("kind", F.when(F.col("kind") == "unknown", settled).otherwise(F.col("kind")))


def fuse_split_blocks(units: DataFrame, keys: list[str], order: str = "unit_no") -> DataFrame:
    """`kind` with a short paragraph of prose between two units of code taken as code, unless it reads as a label or sentence."""
    w = Window.partitionBy(*keys).orderBy(order)
    between = (F.col("kind") == "prose") & (F.col("type") == "para") & (F.lag("kind").over(w) == "code") & (F.lead("kind").over(w) == "code")
    x = units.withColumn("between", F.coalesce(between, F.lit(False)))
    return take_split_code(x).select(*units.columns)


def take_split_code(units: DataFrame) -> DataFrame:
    """`kind` with paragraphs `between` code taken as code where they are short and neither a label nor a sentence."""
    x = units.withColumn("joined", F.when(F.col("between"), trimmed(unescape_all(F.array_join("lines", " ")))))
    text, words = F.col("joined"), word_count(F.col("joined"))
    label = is_spanish_label(text) | mixed_prose(text) | is_file_path_label(text)
    sentence = matches(text, P.SENTENCE_END) & (words >= 5)
    fused = F.col("between") & ~label & (words <= 6) & ~sentence
    return x.withColumn("kind", F.when(fused, "code").otherwise(F.col("kind")))


def settle_kinds(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """Units with module_no get their final `kind`; neighbours never reach across modules."""
    keys = [key, "module_no"]
    return fuse_split_blocks(resolve_unknowns(classify_units(units, [*keys, "unit_no"]), keys), keys)
