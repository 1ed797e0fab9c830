"""Mixing sources to target weights, with DataFrame functions only.

Each source has a target in words: its share by weight of the whole budget, but at most `most_epochs` times its own size; what is
cut off there is shared again by weight until no target is above its limit. A target is met by complete epochs of the
source first (each document once an epoch), and what remains by a weighted sample without replacement (Efraimidis and
Spirakis): each document gets an exponential key divided by its quality weight, and documents are taken in order of key until the
remaining words are used up. The document at the edge is taken in part, so a source's words are its target rounded down.

No source is sorted as a whole. Keys fall into buckets of about 2,000 rows by their distribution function, the buckets'
sizes are summed, and only the bucket at the edge is sorted and summed row by row. So a source with a third of all rows is no
hot task: its rows stay where they are, but for those of one bucket.

Rows: a null text has size 0 and takes 0; a null source is a source, the last; null and repeated doc_ids are documents like
any other (rows alike in id and text share a key; the edge may part them, which rows it is doesn't show); extra columns are dropped; an
empty table gives an empty one. A doc_id without a quality, or with a null one, has the middle weight; of several the mean counts.
Texts are read once and whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, write_table

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 13
#: Weights of documents of quality 0, of unknown quality, and of quality 1.
QUALITY_WEIGHTS = (1.0, 2.0, 4.0)
BUCKET_ROWS = 2_000
#: A table of sources up to this many rows and letters is sent to all executors; a larger one is joined in parts.
SENT_SOURCES, SENT_LETTERS, PARTS = 100_000, 4_000_000, 64


def words_in(text: Column) -> Column:
    """How many stretches without white space (space, tab to carriage return) a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponential_key(seed: int, doc_id: Column, text: Column, weight: Column) -> Column:
    """-ln(u) / weight, with u from the first 52 bits of a digest of seed, id and text."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def quality_weights(labels: DataFrame, weights: tuple[float, float, float] = QUALITY_WEIGHTS) -> DataFrame:
    """(labelled, w): the weight of each doc_id of `labels` (doc_id, quality 0 to 1)."""
    low, _, high = weights
    x = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.avg("quality").alias("q"))
    return x.select("labelled", (F.lit(low) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q"))) * (high - low)).alias("w"))


def source_order(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`sources` (source, ...) with `weight`: the weights in turn, by code point of the source, null last.

    Sources are numbered in ranges, each by itself; only the ranges' counts meet in one task.
    """
    parts = bucket_count(sources)
    key = F.col("source").asc_nulls_last()
    x = write_table(sources.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()), "source-ranges")
    counts = x.groupBy("part").agg(F.count("*").alias("n"))
    firsts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    number = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return x.join(firsts, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int")).cast("long")).drop("part", "first")


def share_out(sources: DataFrame, percent: int = 100, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """`sources` (source, source_size, weight, ...) with `target`: `percent` of all sizes shared by weight, at most `most_epochs` sizes each.

    A round asks how many words and how much weight are left for the sources below their limit, two numbers. Limited sources stay
    so, since the share only grows.
    """
    limit = F.col("source_size") * most_epochs
    x = write_table(sources.withColumn("limited", F.lit(False)), "mix-sources")
    total = (x.agg(F.sum("source_size")).first()[0] or 0) * percent // 100
    at = None
    while True:
        # A source is above its limit if weight * left > limit * open, in whole numbers.
        limited = F.lit(False) if at is None else F.col("weight") * F.lit(at[0]).cast("decimal(38,0)") > limit * F.lit(at[1]).cast("decimal(38,0)")
        found = x.agg(F.sum(F.when(limited, limit).otherwise(0)), F.sum(F.when(limited, 0).otherwise(F.col("weight")))).first()
        now = (total - (found[0] or 0), found[1] or 0)
        if now == at or now[1] == 0:
            break
        at = now
    if at is None or now[1] == 0:  # no source, or the budget is more than all limits
        return x.withColumn("target", limit.cast("double")).drop("limited")
    target = (F.col("weight") * at[0]).cast("double") / float(at[1])
    return x.withColumn("target", F.when(limited, limit.cast("double")).otherwise(target)).drop("limited")


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` with the columns that `sources` has for their source: sent to all executors while small, joined in parts of a source else."""
    n, letters = sources.agg(F.count("*"), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    s = sources.withColumnRenamed("source", "source_")
    same = F.col("source").eqNullSafe(F.col("source_"))
    if n <= SENT_SOURCES and letters <= SENT_LETTERS:
        return rows.join(F.broadcast(s), same).drop("source_")
    s = s.withColumn("part_", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(PARTS)).cast("int")).join(s, same & (F.col("part") == F.col("part_"))).drop("source_", "part", "part_")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, percent: int = 100, most_epochs: int = MOST_EPOCHS, seed: int = SEED, quality: tuple[float, float, float] = QUALITY_WEIGHTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of every row of `docs` (doc_id, source, text)."""
    lightest = min(quality)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(F.col("text")).alias("size"), exponential_key(seed, F.col("doc_id"), F.col("text"), F.lit(1.0)).alias("key"))
    if labels is not None:
        x = x.join(quality_weights(labels, quality), F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
    else:
        x = x.withColumn("w", F.lit(None).cast("double"))
    rows = write_table(x.withColumn("key", F.col("key") / F.coalesce("w", F.lit(quality[1]))).drop("w"), "mix-rows")

    per_source = write_table(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sizes")
    sources = share_out(source_order(per_source, weights), percent, most_epochs)
    sources = sources.withColumn("epochs", F.expr("if(source_size > 0, cast(floor(target) as long) div source_size, 0L)"))
    sources = write_table(sources.withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-targets")

    # 1 - exp(-key * lightest) is between 0 and 1 and no denser than heaviest / lightest anywhere.
    buckets = F.ceil(F.col("n_rows") / bucket_rows)
    bucketed = with_sources(rows, sources).withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key") * lightest))))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).join(sources.select(F.col("source").alias("source_"), F.col("rest").alias("rest_")), F.col("source").eqNullSafe(F.col("source_")))
    # The edge is the first bucket that the rest doesn't reach past. A source always has one, since the rest is less than its size.
    edges = sums.where(F.col("upto") > F.col("rest_")).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("edge"))
    sources = sources.join(edges.select(F.col("source").alias("source_"), "edge"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    edged = with_sources(rows, write_table(sources, "mix-edges"))
    edged = edged.withColumn("bucket", F.floor(buckets * (1 - F.exp(-F.col("key") * lightest))))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    below = F.coalesce(F.col("bucket") < F.col("edge.bucket"), F.lit(False))
    columns = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    whole = edged.where(~at_edge).withColumn("more", F.when(below, F.col("size")).otherwise(0))
    in_order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("edge.before") - (F.sum("size").over(in_order) - F.col("size"))
    parted = edged.where(at_edge).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    both = whole.select(*columns, "more").unionByName(parted.select(*columns, "more"))
    return both.select(*columns, (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken"))
