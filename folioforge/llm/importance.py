"""Importance resampling towards a target distribution.

Features (runs of one to `longest` words) are hashed into buckets; a bucket's gain is the log ratio of its smoothed shares in the target
and in the documents, in thousandths. Gains are one array, and a document's weight is the sum of its features' entries there. Gumbel
noise by doc_id makes the highest scores a draw without replacement in proportion to exp(weight).

Scores are integers, so ranks need no sort of the documents: counts by score, summed from the top over blocks of 4,096
scores and then inside a block, say how many documents stand above each score. The cutoff is the last score that any drawn
document has. Only documents from the cutoff on are numbered, by doc_id within a score, and offset by what stands above.

Rows: a null text has no words; null doc_ids read as empty for the noise and come last in ties; repeated rows count and are
drawn each; extra columns are dropped; an empty table, or an empty target, works as any other (gains then rest on the smoothing).
Texts are read whole, in pieces. Bucket counts and gains hold `buckets` numbers, whatever the input. Blocks hold at most
4,096 counts each; a text's words span some blocks a thousand words, so blocks with counts grow with the longest texts, not with the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_tables, small_batches, write_table

BUCKETS, LEAST_WORDS, SEED, PERCENT, LONGEST = 10_000, 20, 2024, 10, 1
BLOCK = 1 << 12
#: Bytes of a text that are parted into words at once.
PIECE = 1 << 20
TABLE_WORDS, TABLE_WORD_BYTES = 200_000, 64

#: Words are 0-9, a-z and everything beyond ASCII, after A-Z became a-z; all else parts them.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class BucketTable(dict):
    """Word -> its bucket, kept for short words until the table is full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % self.buckets
        if len(word) <= TABLE_WORD_BYTES:
            if len(self) >= TABLE_WORDS:
                self.clear()
            self[word] = found
        return found


_tables: dict[int, BucketTable] = {}


def _table(buckets: int) -> BucketTable:
    """One table for all tasks of a worker process."""
    own_tables("importance", _tables)
    if buckets not in _tables:
        _tables[buckets] = BucketTable(buckets)
    return _tables[buckets]


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; no word is cut."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def feature_buckets(text: bytes, table: BucketTable, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of one to `longest` words that end in it) of each piece of a text."""
    carried: list[bytes] = []
    for words in word_pieces(text):
        found = [np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))]
        if longest > 1:
            row = carried + words
            for n in range(2, longest + 1):
                ends = range(max(len(carried), n - 1), len(row))
                found.append(np.fromiter((zlib.crc32(b" ".join(row[e - n + 1 : e + 1])) % table.buckets for e in ends), dtype=np.int64))
            carried = row[len(row) - min(len(row), longest - 1) :]
        yield len(words), np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) over all rows of `texts` (text): summed in each task, then by bucket."""
    small_batches(texts.sparkSession, 500)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _table(buckets), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            held, n = [np.zeros(0, dtype=np.int64)], 0
            for text in b.column(0):
                for _, found in feature_buckets(text.as_py() or b"", table, longest):
                    held.append(found)
                    n += len(found)
                    if n > PIECE:
                        total += np.bincount(np.concatenate(held), minlength=buckets)
                        held, n = held[:1], 0
            total += np.bincount(np.concatenate(held), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """The gain of each bucket, in order: `buckets` numbers come to the driver."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, buckets, longest).withColumnRenamed("n", "s"), bucket_counts(target, buckets, longest).withColumnRenamed("n", "t")
    x = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    rows = x.select("bucket", "s", "t").collect()
    all_s, all_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    counts = spark.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in rows], "bucket int, s long, t long")
    ratio = (F.col("t") + 1).cast("double") * float(all_s + buckets) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    gains = counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(gains, key=lambda r: r["bucket"])]


def weigh_documents(docs: DataFrame, gains: list[int], longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    small_batches(docs.sparkSession, 500)
    gain, schema = np.array(gains, dtype=np.int64), pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(len(gain))
        for b in batches:
            out = []
            for text in b.column(1):
                n_words = n_features = weight = 0
                for n, found in feature_buckets(text.as_py() or b"", table, longest):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gain[found].sum())
                out.append((n_words, n_features, weight))
            columns = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(columns[:, i]) for i in range(3))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel_milli(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def rank_offsets(scores: DataFrame, draw: int) -> DataFrame:
    """(score, above) for each score of `scores` (score) that a drawn row has: the number of rows with a higher one."""
    counts = write_table(scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK)), "score-counts")
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy(F.desc("block"))) - F.col("n")).alias("before")).where(F.col("before") < draw)
    inside = Window.partitionBy("block").orderBy(F.desc("score"))
    placed = counts.join(blocks, "block").select("score", (F.col("before") + F.sum("n").over(inside) - F.col("n")).alias("above"))
    return placed.where(F.col("above") < draw)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`; rank is null for what isn't drawn.

    Of the N rows with `least_words` words, floor(percent * N / 100) are drawn, ties to the smaller doc_id. The driver gets N
    and the cutoff score.
    """
    weighed = weigh_documents(docs, bucket_gains(docs.select("text"), target.select("text"), buckets, longest), longest)
    scored = write_table(weighed.withColumn("score", F.col("weight") + gumbel_milli(F.col("doc_id"), seed)), "importance-scores")
    may = F.col("n_words") >= least_words
    draw = percent * scored.where(may).count() // 100
    offsets = write_table(rank_offsets(scored.where(may).select("score"), draw), "score-offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    above = may & (F.col("score") >= cutoff)
    rank = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features"))
    drawn = scored.where(above).join(offsets, "score").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    return drawn.select(*columns, "rank").unionByName(scored.where(~above).select(*columns, F.lit(None).cast("long").alias("rank")))
