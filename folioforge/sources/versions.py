"""Folders that change as a whole: a version's tables are written beside the others, and a marker makes it the current one.

`path`/v=N/name holds a table of version N; it counts once `path`/_committed/N is there, and the highest such N is current. A run that is
cut off leaves a version without a marker, which nobody reads and the next clean-up drops. Readers keep what they opened until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def current_version(spark: SparkSession, path: str) -> int | None:
    return max((int(n) for n in children(spark, f"{path}/_committed") if n.isdigit()), default=None)


def publish(tables: dict[str, DataFrame], path: str) -> int:
    """Writes the tables as the next version and makes it current; its number. A version that was cut off is written anew."""
    spark = next(iter(tables.values())).sparkSession
    version = (current_version(spark, path) or 0) + 1
    for name, table in tables.items():
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/v={version}/{name}")
    fs, marker = _fs(spark, f"{path}/_committed/{version}")
    # Fails if another run has committed the same version meanwhile.
    fs.create(marker, False).close()
    return version


def read_version(spark: SparkSession, path: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    """A table of the current (or the given) version; empty if there is none."""
    version = current_version(spark, path) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={version}/{name}")


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Drops all but the last `keep` committed versions, and versions that were never committed."""
    done = sorted(int(n) for n in children(spark, f"{path}/_committed") if n.isdigit())
    kept = set(done[len(done) - keep :])
    for n in done:
        if n not in kept:
            remove(spark, f"{path}/_committed/{n}")
    for folder in children(spark, path):
        if folder.startswith("v=") and int(folder[2:]) not in kept:
            remove(spark, f"{path}/{folder}")
