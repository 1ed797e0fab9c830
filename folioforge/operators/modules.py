"""Modules: the parts of a document that its first-level headings open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import matches


def number_modules(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """The units with `module_seq`, from 1; what stands before the first heading of level 1 goes."""
    opens = (F.col("type") == "heading") & (F.col("level") == 1)
    w = Window.partitionBy(key).orderBy("unit_no")
    x = units.withColumn("opens_module", F.coalesce(opens, F.lit(False)))
    return x.withColumn("module_seq", F.sum(F.col("opens_module").cast("int")).over(w)).where(F.col("module_seq") > 0)


def is_index(title: Column, anchors: Column, units: Column) -> Column:
    """A table of contents, by its title or by how many units link to anchors."""
    return matches(title, P.INDEX_TITLE, "i") | (anchors >= F.greatest(F.lit(3.0), units * 0.6))


def place_units(units: DataFrame, key: str = "doc_id", keep_index: bool = False, only: int | None = None) -> DataFrame:
    """The units with `opens_module`, `module_no`, `module_title` and `n_units`, after a leading index has gone.

    A module's first row is the heading that opens it, so a module without units has that row alone. `only` keeps one
    module and its number. All windows go by the document or a part of it: nothing is dealt again.
    """
    x = number_modules(units, key)
    anchored = ~F.col("opens_module") & F.coalesce(F.exists("lines", lambda line: matches(line, P.ANCHOR_LINK)), F.lit(False))
    module = Window.partitionBy(key, "module_seq")
    x = x.withColumn("module_title", F.max(F.when(F.col("opens_module"), F.col("text"))).over(module))
    x = x.withColumn("n_units", F.sum((~F.col("opens_module")).cast("int")).over(module)).withColumn("anchors", F.sum(anchored.cast("int")).over(module))
    first = (F.col("module_seq") == 1) & is_index(F.col("module_title"), F.col("anchors"), F.col("n_units"))
    x = x.withColumn("dropped", F.lit(False) if keep_index else F.coalesce(first, F.lit(False)))
    x = x.withColumn("module_no", F.col("module_seq") - F.max(F.col("dropped").cast("int")).over(Window.partitionBy(key))).where(~F.col("dropped"))
    if only is not None:
        x = x.where(F.col("module_no") == only)
    return x.select(*units.columns, "opens_module", "module_no", "module_title", "n_units")


def modules_of(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, module_no, title, n_units), empty modules too."""
    return placed.where("opens_module").select(key, "module_no", F.col("module_title").alias("title"), "n_units")


def inner_units(placed: DataFrame) -> DataFrame:
    """The units inside modules, without the headings that open them."""
    return placed.where("not opens_module").drop("opens_module", "n_units")


def list_modules(units: DataFrame, key: str = "doc_id", keep_index: bool = False, only: int | None = None) -> DataFrame:
    """(key, module_no, title, n_units) of a document's modules."""
    return modules_of(place_units(units, key, keep_index, only), key)


def split_modules(units: DataFrame, key: str = "doc_id", keep_index: bool = False, only: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(modules, units with module_no and module_title)."""
    placed = place_units(units, key, keep_index, only)
    return modules_of(placed, key), inner_units(placed)
