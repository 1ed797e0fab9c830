"""Readers. Schemas are declared, so nothing is inferred; what may be missing reads as an empty table."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, content_hash, course_folder, course_slug, file_stem

STATS = "struct<code:int,images:int,headings:int,lists:int,paras:int,quotes:int>"
MANIFEST = f"source string, generated timestamp, modules array<struct<number:int,title:string,file:string,images:array<string>,stats:{STATS}>>"
STATE = "parent_id string, module_no int, page_id string, done boolean"
REGISTRY = "slug string, page_id string, docx_file_name string, docx_hash string, created_at timestamp, last_synced_at timestamp"
STATE_JSON = "map<string,struct<modules:map<string,struct<pageId:string,done:boolean>>>>"
REGISTRY_JSON = "map<string,struct<pageId:string,docxFileName:string,docxHash:string,createdAt:timestamp,lastSyncedAt:timestamp>>"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, name, size, hash): files with the SHA-256 of their bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"), content_hash(F.col("content")).alias("hash"))


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size): the content column is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", base_name(F.col("path")).alias("name"), F.col("length").alias("size"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, slug, folder, stem, text) of converted documents."""
    p = F.col("path")
    return read_markdown(spark, path).select("path", course_slug(p).alias("slug"), course_folder(p).alias("folder"), file_stem(p).alias("stem"), "text")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(source, generated, modules) of manifest files."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def manifest_modules(manifests: DataFrame) -> DataFrame:
    """(source, module_no, title, file, images, stats): a row per module."""
    m = manifests.select("source", F.explode("modules").alias("m"))
    return m.select("source", F.col("m.number").alias("module_no"), "m.title", "m.file", "m.images", "m.stats")


def _json_map(spark: SparkSession, path: str, schema: str, multiline: bool) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=multiline).select(F.explode(F.from_json("value", schema)).alias("key", "entry"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_state(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(parent_id, module_no, page_id, done) of a state; empty if there is none. `multiline`: one JSON text over many lines."""
    x = _json_map(spark, path, STATE_JSON, multiline)
    if x is None:
        return spark.createDataFrame([], STATE)
    x = x.select(F.col("key").alias("parent_id"), F.explode("entry.modules").alias("no", "m"))
    return x.select("parent_id", F.col("no").cast("int").alias("module_no"), F.col("m.pageId").alias("page_id"), F.col("m.done").alias("done"))


def read_registry(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """The course registry; empty if there is none."""
    x = _json_map(spark, path, REGISTRY_JSON, multiline)
    if x is None:
        return spark.createDataFrame([], REGISTRY)
    e = F.col("entry")
    return x.select(F.col("key").alias("slug"), e["pageId"].alias("page_id"), e["docxFileName"].alias("docx_file_name"), e["docxHash"].alias("docx_hash"), e["createdAt"].alias("created_at"), e["lastSyncedAt"].alias("last_synced_at"))


def read_settings(text: str) -> dict[str, str]:
    """KEY=VALUE lines; one pair of quotes goes, and what the environment sets wins."""
    import re

    found: dict[str, str] = {}
    for line in re.split(r"\r?\n", text):
        key, sign, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if sign and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
            if value[:1] in ("'", '"'):
                value = value[1:]
            if value[-1:] in ("'", '"'):
                value = value[:-1]
            found.setdefault(key, value)
    return {k: os.environ.get(k, v) for k, v in found.items()}


#: More than this a converter's output isn't taken.
MOST_OUTPUT = 512 * 1024 * 1024


def command_converter(command: list[str]):
    """A converter for `convert_documents` that runs a program: the document on its input, markdown on its output. Nothing is written to disk."""

    def convert(content: bytes) -> str:
        import subprocess

        return subprocess.run(command, input=content, capture_output=True, check=True).stdout.decode("utf-8")

    return convert


def convert_documents(files: DataFrame, convert, most: int = MOST_OUTPUT) -> DataFrame:
    """(path, text, problem, error) of binary documents (path, content), by a function from bytes to markdown run on the executors.

    The converter is external to this library. A document that it fails on has no text but a problem: `no converter` if its program isn't
    there, `status N` if it ended so, `too long` if its text has more than `most` bytes, else `failed`; `error` says what it said.
    Null content has the problem `no content`.
    """
    import pandas as pd

    def one(content: bytes | None) -> tuple[str | None, str | None, str | None]:
        import subprocess

        if content is None:
            return None, "no content", None
        try:
            text = convert(bytes(content))
        except FileNotFoundError as e:
            return None, "no converter", str(e)
        except subprocess.CalledProcessError as e:
            return None, f"status {e.returncode}", (e.stderr or b"").decode("utf-8", "replace")
        except Exception as e:  # noqa: BLE001  any converter, any failure: it goes into the row
            return None, "failed", f"{type(e).__name__}: {e}"
        size = len(text.encode("utf-8", "surrogatepass"))
        return (text, None, None) if size <= most else (None, "too long", f"{size} bytes")

    def run(parts):
        for p in parts:
            yield pd.DataFrame([(path, *one(content)) for path, content in zip(p["path"], p["content"])], columns=["path", "text", "problem", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, problem string, error string")
