"""Media by content: each distinct file is stored once under its SHA-256, and image references resolve to it.

Rows: a file with null content isn't stored, and counts as missing; a name that a document has twice goes by the smaller hash; references with
a null token go; repeated references stay, and are told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash
from .versions import exists

MEDIA = "hash string, size long, content binary"


def media_hashes(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, hash, size) of files (keys, name, content)."""
    return files.where("content is not null").select(*keys, "name", content_hash(F.col("content")).alias("hash"), F.length("content").cast("long").alias("size"))


def store_media(files: DataFrame, path: str) -> DataFrame:
    """Adds the contents of `files` (content, ...) that the store at `path` hasn't, each once, and returns the store."""
    spark = files.sparkSession
    x = files.where("content is not null").select(content_hash(F.col("content")).alias("hash"), F.length("content").cast("long").alias("size"), "content")
    if exists(spark, path):
        x = x.join(spark.read.schema(MEDIA).parquet(path).select("hash"), "hash", "left_anti")
    x.dropDuplicates(["hash"]).write.mode("append").option("compression", "none").parquet(path)
    # Two runs at once may add a content twice, alike; it is read as a set.
    return spark.read.schema(MEDIA).parquet(path).dropDuplicates(["hash"])


def resolve_media(refs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref_no, token, hash, size, status, first_ref): what each reference (keys, ref_no, token) stands for.

    status: stored; repeated, if an earlier reference of the document has the same content, which `first_ref` names; or missing.
    """
    known = media_hashes(files, keys).groupBy(*keys, F.col("name").alias("token")).agg(F.min(F.struct("hash", "size")).alias("m"))
    x = refs.where("token is not null").join(known, [*keys, "token"], "left").select(*keys, "ref_no", "token", "m.hash", "m.size")
    first = F.min("ref_no").over(Window.partitionBy(*keys, "hash"))
    x = x.withColumn("first_ref", F.when(F.col("hash").isNotNull(), first))
    status = F.when(F.col("hash").isNull(), "missing").when(F.col("first_ref") < F.col("ref_no"), "repeated").otherwise("stored")
    return x.select(*keys, "ref_no", "token", "hash", "size", status.alias("status"), "first_ref")
