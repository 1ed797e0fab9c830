"""Structuring with a cache: a document whose text was structured before, by these rules, isn't structured again.

The cache goes by content. A text's address is the SHA-256 of the rules' version and its bytes; `path`/modules holds the modules of each
address with the run that made them, `path`/manifest one row for each address and run, added once a run's modules are whole. Documents
that share a text are structured once. Unchanged documents cost a look-up; a changed one has another address, and what is under its
old one stays for documents that still have it, or until `sweep`. Rows that a cut-off run left have no manifest row, and don't count.

Rows: a null text has no module and no address; repeated and null ids are documents like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged
from ..sources.versions import exists, remove
from .jobs import structure

#: Counts up when the rules of structuring change, which makes every cached text new.
VERSION = 1
MANIFEST = "address string, run string"
MODULES = "address string, run string, module_no long, title string, file string, text string, images array<string>, stats struct<code:int,images:int,headings:int,lists:int,paras:int,quotes:int>, report string"


def addressed(docs: DataFrame, key: str = "doc_id", version: int = VERSION) -> DataFrame:
    """(key, text, address); null texts go."""
    return docs.where("text is not null").select(key, "text", F.sha2(F.concat(F.lit(f"{version}:"), F.col("text")).cast("binary"), 256).alias("address"))


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)


def _committed(spark: SparkSession, path: str) -> DataFrame:
    """(address, run): of two runs that made the same address at once, one counts."""
    return _read(spark, path, "manifest", MANIFEST).groupBy("address").agg(F.min("run").alias("run"))


def new_texts(docs: DataFrame, path: str, key: str = "doc_id", version: int = VERSION) -> DataFrame:
    """(address, text): each text that the cache hasn't, once. Texts of known addresses don't move."""
    known = _committed(docs.sparkSession, path).select("address")
    return addressed(docs, key, version).select("address", "text").join(known, "address", "left_anti").dropDuplicates(["address"])


def structure_increment(docs: DataFrame, path: str, key: str = "doc_id", version: int = VERSION) -> DataFrame:
    """Structures what the cache at `path` hasn't, adds it there, and returns the modules of `docs`: (key, module_no, title, file, text,
    images, stats, report), as `structure` does."""
    spark, run = docs.sparkSession, uuid.uuid4().hex
    todo, _ = staged(new_texts(docs, path, key, version), "new-texts")
    if not todo.isEmpty():
        columns = [c.split()[0] for c in MODULES.split(", ")[:7]] + ["stats", "report"]
        structure(todo, "address").withColumn("run", F.lit(run)).select(*columns).write.mode("append").option("compression", "zstd").parquet(f"{path}/modules")
        todo.select("address", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/manifest")
    return cached_modules(docs, path, key, version)


def cached_modules(docs: DataFrame, path: str, key: str = "doc_id", version: int = VERSION) -> DataFrame:
    """The modules that the cache has for `docs`, by their addresses."""
    spark = docs.sparkSession
    made = _read(spark, path, "modules", MODULES).join(_committed(spark, path), ["address", "run"]).drop("run")
    return addressed(docs, key, version).select(key, "address").join(made, "address").drop("address")


def sweep(docs: DataFrame, path: str, key: str = "doc_id", version: int = VERSION) -> None:
    """Keeps only what `docs` need. One run at a time; a run that is cut off here leaves an empty or a smaller cache, so more is structured again."""
    spark = docs.sparkSession
    needed = addressed(docs, key, version).select("address").distinct()
    keep = _committed(spark, path).join(needed, "address", "left_semi")
    manifest, _ = staged(keep, "kept-manifest")
    modules, _ = staged(_read(spark, path, "modules", MODULES).join(manifest, ["address", "run"], "left_semi"), "kept-modules")
    remove(spark, f"{path}/manifest")
    remove(spark, f"{path}/modules")
    modules.write.parquet(f"{path}/modules")
    manifest.write.parquet(f"{path}/manifest")
