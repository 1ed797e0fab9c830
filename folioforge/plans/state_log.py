"""The state of pushes as a log of transitions: a page was made, then its module is done. Nothing is overwritten.

A transition (parent_id, module_no, version, page_id or null, done) is appended when it has happened. The state is what the highest
version says: `done` of the last one, `page_id` of the last one that names a page. Replaying a transition twice changes nothing, so a
run that was cut off after any write is resumed from the log. The log has generations: compaction folds all before a new generation
into a snapshot and commits it as a version; until that marker is there, the old snapshot and the old generations are still read.
Of two transitions with one version the one that says done counts, then the greater page_id. A null version comes before all others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import children, current_version, drop_versions, publish, read_version, remove

TRANSITIONS = "parent_id string, module_no int, version long, page_id string, done boolean"
KEYS = ["parent_id", "module_no"]


def _last(transitions: DataFrame) -> DataFrame:
    """(parent_id, module_no, last, paged): the last transition of a module and the last that names a page, whole. Combined before the
    shuffle, whatever the length of the log."""
    order = F.struct(F.coalesce("version", F.lit(-(1 << 62))), F.coalesce("done", F.lit(False)), F.coalesce("page_id", F.lit("")))
    row = F.struct("version", "page_id", "done")
    paged = F.max_by(row, F.when(F.col("page_id").isNotNull(), order))
    return transitions.groupBy(*KEYS).agg(F.max_by(row, order).alias("last"), paged.alias("paged"))


def replay(transitions: DataFrame) -> DataFrame:
    """(parent_id, module_no, page_id, done): one row a module, as readers.read_state."""
    return _last(transitions).select(*KEYS, F.col("paged.page_id").alias("page_id"), F.coalesce("last.done", F.lit(False)).alias("done"))


def fold(transitions: DataFrame) -> DataFrame:
    """The transitions that the state rests on, at most two a module, with their own versions: what comes late still finds its place."""
    kept = F.filter(F.array_distinct(F.array("last", "paged")), lambda t: t.isNotNull())
    return _last(transitions).select(*KEYS, F.explode(kept).alias("t")).select(*KEYS, "t.version", "t.page_id", "t.done")


def append_transitions(transitions: DataFrame, path: str) -> None:
    """Adds to the current generation. A failed write leaves no file that counts; one that is run again adds equal rows."""
    generation = current_version(transitions.sparkSession, path) or 0
    transitions.select(*(c.split()[0] for c in TRANSITIONS.split(", "))).write.mode("append").option("compression", "zstd").parquet(f"{path}/log/generation={generation}/{uuid.uuid4().hex}")


def read_transitions(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot and everything logged since."""
    current = current_version(spark, path) or 0
    found = read_version(spark, path, "state", TRANSITIONS)
    for folder in children(spark, f"{path}/log"):
        if folder.startswith("generation=") and int(folder.split("=")[1]) >= current:
            parts = [f"{path}/log/{folder}/{p}" for p in children(spark, f"{path}/log/{folder}")]
            if parts:
                found = found.unionByName(spark.read.schema(TRANSITIONS).parquet(*parts))
    return found


def read_log_state(spark: SparkSession, path: str) -> DataFrame:
    return replay(read_transitions(spark, path))


def compact(spark: SparkSession, path: str) -> int:
    """Folds the log into a snapshot and drops what it replaces; the snapshot's number. One writer at a time: what is appended between the
    fold's reading and its marker would go with the old generation."""
    version = publish({"state": fold(read_transitions(spark, path))}, path)
    drop_versions(spark, path)
    for folder in children(spark, f"{path}/log"):
        if int(folder.split("=")[1]) < version:
            remove(spark, f"{path}/log/{folder}")
    return version
