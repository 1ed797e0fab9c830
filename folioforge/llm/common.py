"""What the operators share: table access, shared-folder tables, sentences, word hashes and connected components."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder, staged

#: Rows in an Arrow batch. Documents may be long, so a batch is kept far below Spark's default.
BATCH_ROWS = 1000

M64 = (1 << 64) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows, and so the bytes, that a Python worker holds at once. The setting is the session's and the last one counts
    for all plans, so it bears on memory only: no result depends on where batches are cut."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def snapshot(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder; for narrow tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a compressed table to the shared folder and reads it again; for wide tables that are read more than once."""
    return staged(df, name)[0]


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int | None:
    """Spark's own estimate of the bytes a plan reads, None where it has none; for the number of buckets only, never for results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def bucket_count(df: DataFrame, bytes_per_bucket: int = 8 << 20) -> int:
    """Buckets that grow with the input, so that the memory of one bucket doesn't. Spark plans a million tasks at most well, so
    from 8 TB on buckets grow instead: at 100 TB one holds what 100 MB of input gives."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, -(-(plan_bytes(df) or 0) // bytes_per_bucket)))


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[str]:
    """A text column as Python strings; null reads as empty."""
    return [t or "" for t in column.to_pylist()]


def batches(schema: pa.Schema):
    """Turns a generator of column lists into record batches of this schema."""

    def wrap(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return wrap


# ---- sentences -------------------------------------------------------------------------------------

#: A sentence ends after a run of . ! ? before white space, at a line end, or before a capitalised word that follows a
#: lower-case one (text pasted into the middle of a sentence starts so).
SENTENCE_END = re.compile(r"(?<=[.!?])[ \t]+|\n+|(?<=[^\W\dA-Z_])[ \t]+(?=[^\W\d_a-zß-ÿ])")


def sentence_spans(text: str, ends: re.Pattern = SENTENCE_END) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without the white space between them."""
    out, at = [], 0
    for m in ends.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


# ---- hashes ----------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & M64], dtype=np.uint64))[0])


class HashTable(dict):
    """Word -> 64-bit hash, each distinct word hashed once while it stays in the table."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


# ---- tables of a worker process --------------------------------------------------------------------

_tables_of: dict[str, list] = {}


def own_tables(operator: str, *tables) -> None:
    """Called where a task starts. A worker process is used again by later operators and stages: what earlier ones keep in it
    (anything with `clear`) goes before this one fills its own tables. Tables are named by functions of their module, since a
    nested function takes copies of the globals it names along."""
    others = [t for name, held in _tables_of.items() if name != operator for t in held]
    for t in others:
        t.clear()
    for name in [n for n in _tables_of if n != operator]:
        del _tables_of[name]
    if others:
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
    if tables:
        _tables_of[operator] = list(tables)


# ---- connected components --------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long); component is the smallest node reachable.

    Each round every class hooks onto its smallest neighbour and pointers are doubled until they end at roots; the edges are
    then rewritten to roots and those inside a class go, so a round at least halves the classes and a path of n nodes
    takes log n doublings. Hooking is a minimum by key, which is combined before the shuffle, so a hub with
    a third of all edges is no hot task. In the joins on pointers a hub's nodes have one key: the rows are two numbers, both
    sides are checkpointed scans, and AQE splits such a partition once it is large. Only a row count comes to the driver.
    """
    e = snapshot(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        p = snapshot(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")))
        while True:
            doubled = p.alias("x").join(p.alias("y"), F.col("x.p") == F.col("y.u"))
            p = snapshot(doubled.select(F.col("x.u").alias("u"), F.col("y.p").alias("p"), (F.col("x.p") != F.col("y.p")).alias("moved")))
            if p.where("moved").isEmpty():
                break
        if labels is None:
            labels = p.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = snapshot(labels.join(p, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component")))
        e = e.join(p.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(p.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        e = snapshot(e.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
