"""Nested blocks: a module's blocks, rows with parents, become one JSON object for each top-level block.

A list's tree in document order is its own traversal from the top, so no level has to wait for another: each row writes what opens
its object, and what closes it and the objects above it that end here, which the level of the row after it tells. The pieces of a
top-level block, one after the other, are its JSON, whatever the depth. One window over a module and one grouping, dealt alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from .blocks import LISTS, batches, rich_text_json


def json_string(c: Column) -> Column:
    """A text as a JSON string; null as null."""
    listed = F.to_json(F.array(c))
    return F.when(c.isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))


def _opening(columns: list[str]) -> Column:
    """A block's object up to the end of its own properties."""
    rich = F.concat(F.lit('"rich_text":'), F.coalesce(rich_text_json(F.col("rich_text")), F.lit("[]")))
    icon = F.lit(f'"icon":{{"type":"emoji","emoji":"{P.ICON}"}},"color":"{P.ICON_COLOR}",')
    body = F.when(F.col("type").startswith("heading_"), F.concat(rich, F.lit(',"is_toggleable":false'))).when(F.col("type") == "code", F.concat(F.lit('"language":'), json_string(F.coalesce("language", F.lit(P.PLAIN_TEXT))), F.lit(","), rich))
    body = body.when(F.col("type") == "callout", F.concat(icon, rich))
    if "file_upload_id" in columns:
        body = body.when(F.col("type") == "image", F.concat(F.lit('"type":"file_upload","file_upload":{"id":'), json_string(F.col("file_upload_id")), F.lit('},"caption":[]')))
    return F.concat(F.lit('{"object":"block","type":"'), F.col("type"), F.lit('","'), F.col("type"), F.lit('":{'), body.otherwise(rich))


def nest_blocks(blocks: DataFrame, keys: list[str], markers: bool = False) -> DataFrame:
    """(keys, block_no, json) for every top-level block, its children inside it.

    `blocks`: keys, block_no, type, language, token, depth (0 at the top, at most one more than the row before), rich_text and, once images are
    resolved, file_upload_id. `markers` leaves the token of an unresolved image in its block. Null formatting reads as none.
    """
    w = Window.partitionBy(*keys).orderBy("block_no")
    level, following, before = F.col("depth"), F.coalesce(F.lead("depth").over(w), F.lit(0)), F.lag("depth").over(w)
    x = blocks.withColumn("following", following).withColumn("elder", (level > 0) & (before >= level)).withColumn("root_no", F.last(F.when(level == 0, F.col("block_no")), ignorenulls=True).over(w))
    opening = F.concat(F.when(F.col("elder"), ",").otherwise(""), _opening(blocks.columns))
    marker = F.when((F.col("type") == "paragraph") & F.col("token").isNotNull(), F.concat(F.lit(',"_marker":'), json_string(F.col("token")))) if markers else F.lit(None).cast("string")
    own = F.concat(F.lit("}"), F.coalesce(marker, F.lit("")), F.lit("}"))
    above = F.expr("repeat(']}}', cast(greatest(depth - following, 0) as int))")
    piece = F.concat(opening, F.when(F.col("following") > level, ',"children":[').otherwise(F.concat(own, above)))
    pieces = x.select(*keys, "root_no", "block_no", piece.alias("piece")).groupBy(*keys, "root_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "piece"))).alias("pieces"))
    return pieces.select(*keys, F.col("root_no").alias("block_no"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("json"))


def nested_lists(items: DataFrame, keys: list[str], order: str = "block_no", text: str = "text") -> DataFrame:
    """(keys, block_no, json) for lists given as rows (keys, `order`, level, text): bulleted items without formatting."""
    run = F.struct(F.col(text).alias("content"), *[F.lit(None).cast("boolean").alias(m) for m in ("bold", "italic", "code")], F.lit(None).cast("string").alias("url"))
    none = F.lit(None).cast("string")
    rows = items.select(*keys, F.col(order).alias("block_no"), F.lit(LISTS[0]).alias("type"), none.alias("language"), none.alias("token"), F.col("level").alias("depth"), F.array(run).alias("rich_text"))
    return nest_blocks(rows, keys)


def batch_bodies(nested: DataFrame, keys: list[str], size: int = P.MAX_BLOCKS) -> DataFrame:
    """(keys, batch_no, n_blocks, children): the JSON array of each batch of top-level blocks, in order."""
    x = batches(nested.withColumn("parent_no", F.lit(None).cast("long")), keys, size)
    own = x.groupBy(*keys, "batch_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "json"))).alias("rows"))
    return own.select(*keys, "batch_no", F.size("rows").cast("long").alias("n_blocks"), F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]")).alias("children"))
