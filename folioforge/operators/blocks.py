"""Blocks: the text of a module becomes typed blocks, as rows with their parents.

A list's tree is kept as `parent_no`; `to_json` nests nothing. One row is one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dialect import java
from ..functions.text import matches, safe_language, trimmed
from .inline import code_runs, inline_runs, plain_runs
from .lines import mark_fences, split_lines

LISTS = ("bulleted_list_item", "numbered_list_item")


def effective_depth(rows: DataFrame, keys: list[str], order: str, depth: str = "depth") -> DataFrame:
    """Adds `level` and `parent` (an `order` value or null) to list items: no item is deeper than one below the item before it.

    level = least(i, i + least(depth[k] - k for k up to i)), a running minimum. The parent is the latest earlier item one
    level up: every item asks at the level above its own, among the items of that level.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w) - 1
    x = rows.withColumn("item", i)
    least = F.min(F.col(depth) - F.col("item")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("level", F.least(F.col("item"), F.col("item") + least))
    asks = F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("asks")), F.struct((F.col("level") - 1).alias("at"), F.lit(True).alias("asks")))
    y = x.withColumn("look", F.explode(asks))
    v = Window.partitionBy(*keys, F.col("look.at")).orderBy(order, F.col("look.asks")).rowsBetween(Window.unboundedPreceding, -1)
    y = y.withColumn("parent", F.last(F.when(~F.col("look.asks"), F.col(order)), ignorenulls=True).over(v)).where("look.asks")
    return y.select(*rows.columns, "level", "parent")


def block_rows(modules: DataFrame, keys: list[str], text: str = "text", image_mode: str = "callout") -> DataFrame:
    """(keys, block_no, type, content, language, token, depth, parent_no) from module texts; content is still unparsed."""
    named = modules.select(F.struct(*keys).alias("k"), F.col(text).alias("text"))
    x = mark_fences(split_lines(named, "k", "text", "\n"), ["k"])
    w = Window.partitionBy("k").orderBy("line_no")
    line = F.col("line")
    x = x.where(~((F.col("line_no") == 0) & line.startswith("# ") & matches(line, P.BLOCK_HEADING)))
    kind = (
        F.when(F.col("in_fence"), "code")
        .when(trimmed(line) == "", "blank")
        .when(matches(line, P.BLOCK_IMAGE), "image")
        .when(matches(line, P.BLOCK_HEADING), "heading")
        .when(matches(line, P.BLOCK_BULLET), LISTS[0])
        .when(matches(line, P.BLOCK_NUMBER), LISTS[1])
        .otherwise("paragraph")
    )
    # Blank lines part nothing once they are gone: a list goes on over them if a list line follows.
    x = x.withColumn("kind", kind).where("kind <> 'blank'")
    x = x.withColumn("starts", F.when(F.col("kind") == "code", F.col("opens")).otherwise(True))
    x = x.withColumn("block_no", F.sum(F.col("starts").cast("int")).over(w) - 1)
    x = x.withColumn("run", F.sum(F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True)).cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    b = x.groupBy("k", "block_no").agg(F.first("kind").alias("kind"), F.first("run").alias("run"), body.alias("rows"))
    first = F.col("rows")[0]["line"]
    inner = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    closed = (F.size("rows") > 1) & matches(F.element_at("rows", -1)["line"], P.FENCE_BARE)
    code = F.array_join(F.transform(F.when(closed, F.slice("rows", 2, F.greatest(F.size("rows") - 2, F.lit(0)))).otherwise(inner), lambda r: r["line"]), "\n")
    mark = F.concat(F.lit("![]("), F.regexp_extract(first, java(P.BLOCK_IMAGE), 1), F.lit(")"))
    is_list = F.col("kind").isin(*LISTS)
    item = lambda group: F.when(F.col("kind") == LISTS[0], F.regexp_extract(first, java(P.BLOCK_BULLET), group)).otherwise(F.regexp_extract(first, java(P.BLOCK_NUMBER), group))
    b = b.select(
        "k",
        "block_no",
        "run",
        F.when(F.col("kind") == "heading", F.concat(F.lit("heading_"), F.length(F.regexp_extract(first, java(P.BLOCK_HEADING), 1)).cast("string")))
        .when(F.col("kind") == "image", "callout" if image_mode == "callout" else "paragraph")
        .otherwise(F.col("kind"))
        .alias("type"),
        F.when(F.col("kind") == "heading", F.regexp_extract(first, java(P.BLOCK_HEADING), 2)).when(F.col("kind") == "image", mark).when(F.col("kind") == "code", code).when(is_list, item(2)).otherwise(trimmed(first)).alias("content"),
        F.when(F.col("kind") == "code", safe_language(F.substring(first, 4, 1 << 30))).alias("language"),
        F.when(F.col("kind") == "image", F.regexp_extract(first, java(P.BLOCK_IMAGE), 1)).alias("token"),
        F.when(is_list, F.floor(F.length(item(1)) / 4).cast("int")).alias("depth"),
    )
    # A run is all list items or none; what the windows say of the others is put aside.
    x = effective_depth(b.withColumn("item_depth", F.coalesce("depth", F.lit(0))), ["k", "run"], "block_no", "item_depth")
    item_only = lambda c: F.when(F.col("depth").isNotNull(), F.col(c))
    return x.select("k.*", "block_no", "type", "content", "language", "token", F.coalesce(item_only("level"), F.lit(0)).alias("depth"), item_only("parent").alias("parent_no"))


def with_runs(rows: DataFrame) -> DataFrame:
    """The rows with `rich_text` in place of their content."""
    content = F.col("content")
    runs = F.when(F.col("type") == "code", plain_runs(content)).when(F.col("token").isNotNull(), code_runs(content)).otherwise(inline_runs(content))
    icon = F.when(F.col("type") == "callout", F.lit(P.ICON)).alias("icon")
    color = F.when(F.col("type") == "callout", F.lit(P.ICON_COLOR)).alias("color")
    return rows.select(*[c for c in rows.columns if c != "content"], runs.alias("rich_text"), icon, color)


def to_blocks(modules: DataFrame, keys: list[str], text: str = "text", image_mode: str = "callout") -> DataFrame:
    """Typed blocks with formatted runs from module texts."""
    return with_runs(block_rows(modules, keys, text, image_mode))


def image_refs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref_no, token): image tokens in order, repeated ones kept."""
    w = Window.partitionBy(*keys).orderBy("block_no")
    return blocks.where("token is not null").select(*keys, (F.row_number().over(w) - 1).alias("ref_no"), "token")


def batches(blocks: DataFrame, keys: list[str], size: int = P.MAX_BLOCKS) -> DataFrame:
    """Adds `batch_no`: top-level blocks go by `size` in order, children with their parent.

    Where there is a column `n_blocks`, a top-level row stands for so many blocks one after the other, of which the token is the first's;
    `batch_no` is then the batch of the first, and `last_batch` is added for the last's. So blocks needn't be rows to be counted.
    """
    w = Window.partitionBy(*keys).orderBy("block_no")
    is_top = F.col("parent_no").isNull()
    if "n_blocks" not in blocks.columns:
        return blocks.withColumn("batch_no", F.floor((F.sum(is_top.cast("int")).over(w) - 1) / F.lit(size)).cast("int"))
    x = blocks.withColumn("upto", F.sum(F.when(is_top, F.col("n_blocks").cast("long")).otherwise(0)).over(w))
    first = F.col("upto") - F.when(is_top, F.col("n_blocks")).otherwise(1)
    return x.withColumns({"batch_no": F.floor(first / F.lit(size)).cast("int"), "last_batch": F.floor((F.col("upto") - 1) / F.lit(size)).cast("int")}).drop("upto")


def rich_text_json(runs: Column) -> Column:
    """Runs as the remote service takes them; absent keys are left out."""
    marks = lambda r: F.struct(r["bold"].alias("bold"), r["italic"].alias("italic"), r["code"].alias("code"))
    one = lambda r: F.struct(
        F.lit("text").alias("type"),
        F.struct(r["content"].alias("content"), F.when(r["url"].isNotNull(), F.struct(r["url"].alias("url"))).alias("link")).alias("text"),
        F.when(F.coalesce(r["bold"], r["italic"], r["code"]).isNotNull(), marks(r)).alias("annotations"),
    )
    return F.to_json(F.transform(runs, one))
