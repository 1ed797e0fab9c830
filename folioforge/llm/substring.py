"""Substring deduplication by sliding sentence spans.

A span is a run of consecutive sentences, at least `least_sentences` of them with `least_words` words or more. Every span that
stands anywhere in the table before (by doc_id and place) is repeated, and its sentences are removed, with the white space
after them. By default a span is two sentences and twelve words. `CLAUSES` is the finer rule: sentences end at commas, semicolons and
colons too, and one alone may be a span; a passage that was pasted into the middle of a sentence then loses little at its edges.

Of all runs only the least ones need to be hashed: from each sentence the shortest run that is a span, and
the shortest such run that ends at each sentence. A repeated longer run consists of least runs, each repeated where it is,
and the forward and backward ones cover it to both ends, so the same sentences go (tests hold this against all runs).

Runs travel packed by hash bucket, fourteen bytes a run. Of a run that a batch holds several times only the first goes to
its hash's bucket; the others are repeats whatever comes, so they bypass it, and a passage in a third of all documents
makes no hot bucket. A removal names its hash, and a document removes a run only if that hash stands at that place.

Rows: null and empty texts have no sentence and stay as they are; a text of any length is read whole, rows with a null doc_id count as the last document; rows that share a
doc_id count as one document for who is first; repeated rows keep or lose the same; other columns are kept; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import SENTENCE_END, batches, bucket_count, fresh_name, own_tables, sentence_spans, small_batches, texts_of

LAST_ID = (1 << 63) - 1

#: As in `common.SENTENCE_END`, and after , ; and :
_CLAUSE_END = re.compile(r"(?<=[.!?,;:])[ \t]+|\n+|(?<=[^\W\dA-Z_])[ \t]+(?=[^\W\d_a-zß-ÿ])")


@dataclass(frozen=True)
class Spans:
    """What counts as a span."""

    least_words: int = 12
    least_sentences: int = 2
    ends: re.Pattern = SENTENCE_END


SENTENCES = Spans()
CLAUSES = Spans(least_sentences=1, ends=_CLAUSE_END)


def runs_of(text: str, rule: Spans = SENTENCES) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """(sentence spans, first sentence, last sentence, 64-bit hash) of a text's runs."""
    import xxhash

    spans = sentence_spans(text, rule.ends)
    sentences = [text[a:b] for a, b in spans]
    n = len(sentences)
    words = np.fromiter((s.count(" ") + 1 for s in sentences), dtype=np.int64, count=n)
    before = np.r_[0, np.cumsum(words)]
    if n < rule.least_sentences or before[-1] < rule.least_words:
        none = np.zeros(0, dtype=np.int64)
        return spans, none, none, none.astype(np.uint64)
    # Forward: the least j with enough words and sentences from i on. Backward: the greatest i for each j.
    i, more = np.arange(n), rule.least_sentences - 1
    j = np.maximum(np.searchsorted(before, before[:-1] + rule.least_words) - 1, i + more)
    forward = np.c_[i[j < n], j[j < n]]
    back = np.minimum(np.searchsorted(before, before[1:] - rule.least_words, side="right") - 1, i - more)
    backward = np.c_[back[back >= 0], i[back >= 0]]
    both = np.unique(np.r_[forward, backward], axis=0)
    h = np.fromiter((xxhash.xxh3_64_intdigest("\n".join(sentences[a : b + 1])) for a, b in both.tolist()), dtype=np.uint64, count=len(both))
    return spans, both[:, 0], both[:, 1], h


def pack(ids: np.ndarray, texts: list[str], buckets: int, rule: Spans) -> list | None:
    """The columns of `packed_runs` for these documents, or None without a run."""
    hashes, owners, firsts = [], [], []
    for k, t in enumerate(texts):
        _, first, _, h = runs_of(t, rule)
        hashes.append(h)
        owners.append(np.full(len(h), k, dtype=np.uint32))
        firsts.append(first.astype(np.uint32))
    h, o, f = np.concatenate(hashes), np.concatenate(owners), np.concatenate(firsts)
    if not len(h):
        return None
    order = np.lexsort((f, ids[o], h))
    h, o, f = h[order], o[order], f[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    group = np.repeat(start, np.diff(np.r_[start, len(h)]))
    # Equal places (a repeated row) are no repeats of each other: they stand or fall with the first.
    again = (ids[o] != ids[o[group]]) | (f != f[group])
    bucket = np.where(again, ids[o].view(np.uint64) % np.uint64(buckets), h % np.uint64(buckets)).astype(np.int32)
    keep = again.copy()
    keep[start] = True
    order = np.lexsort((bucket[keep], again[keep]))
    h, o, f, bucket, again = (x[keep][order] for x in (h, o, f, bucket, again))
    cuts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (again[1:] != again[:-1])])
    rows: list[list] = [[], [], [], []]
    for i, j in zip(cuts, np.r_[cuts[1:], len(h)]):
        used, owner = np.unique(o[i:j], return_inverse=True)
        for column, x in zip(rows, (h[i:j], owner.astype(np.uint32), f[i:j], ids[used])):
            column.append(x.tobytes())
    return [bucket[cuts], pa.array(again[cuts]), *rows]


def packed_runs(docs: DataFrame, buckets: int, rule: Spans) -> DataFrame:
    """(bucket, repeated, hashes, owners, firsts, ids): the runs of a batch by bucket; owners are places in ids, firsts the first
    sentences. `repeated` rows hold runs that the batch has before; their bucket only spreads them."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("repeated", pa.bool_()), ("hashes", pa.binary()), ("owners", pa.binary()), ("firsts", pa.binary()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("substring")
        wrap = batches(schema)
        for b in parts:
            ids = np.array([LAST_ID if d is None else d for d in b.column(0).to_pylist()], dtype=np.int64)
            if len(ids) and (columns := pack(ids, texts_of(b.column(1)), buckets, rule)):
                yield wrap(columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "bucket int, repeated boolean, hashes binary, owners binary, firsts binary, ids binary")


def repeats(packed: DataFrame, buckets: int) -> DataFrame:
    """(id long, first long, hash long) of every run that is not the first with its hash."""
    small_batches(packed.sparkSession, 100)
    schema = pa.schema([("id", pa.int64()), ("first", pa.int64()), ("hash", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        hs, ds, fs = [], [], []
        for b in parts:
            for again, hashes, owners, firsts, ids in zip(b.column(1).to_pylist(), *(b.column(i) for i in range(2, 6))):
                h = np.frombuffer(hashes.as_buffer(), dtype=np.uint64)
                d = np.frombuffer(ids.as_buffer(), dtype=np.int64)[np.frombuffer(owners.as_buffer(), dtype=np.uint32)]
                f = np.frombuffer(firsts.as_buffer(), dtype=np.uint32)
                if again:
                    yield wrap([d, f.astype(np.int64), h.view(np.int64)])
                else:
                    hs.append(h)
                    ds.append(d)
                    fs.append(f)
        if not hs:
            return
        h, d, f = np.concatenate(hs), np.concatenate(ds), np.concatenate(fs)
        hs.clear(), ds.clear(), fs.clear()
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(s), dtype=bool)
        same = s[1:] == s[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        h, d, f = h[order], d[order], f[order]
        order = np.lexsort((f, d, h))
        h, d, f = h[order], d[order], f[order]
        if not len(h):
            return
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        group = np.repeat(starts, np.diff(np.r_[starts, len(h)]))
        later = np.flatnonzero((d != d[group]) | (f != f[group]))
        for i in range(0, len(later), 20_000):
            k = later[i : i + 20_000]
            yield wrap([d[k], f[k].astype(np.int64), h[k].view(np.int64)])

    return packed.repartition(buckets, "bucket").mapInArrow(run, "id long, first long, hash long")


def removed_spans(text: str, marks: set[tuple[int, int]], rule: Spans) -> list[tuple[int, int]]:
    """(start, end) of the stretches of a text to remove; marks: (first sentence, signed hash) of runs."""
    if not marks:
        return []
    spans, first, last, h = runs_of(text, rule)
    gone = np.zeros(len(spans) + 1, dtype=np.int64)
    for a, b, x in zip(first.tolist(), last.tolist(), h.view(np.int64).tolist()):
        if (a, x) in marks:
            gone[a] += 1
            gone[b + 1] -= 1
    covered = np.flatnonzero(np.cumsum(gone)[:-1] > 0)
    out = []
    for part in np.split(covered, np.flatnonzero(np.diff(covered) > 1) + 1):
        if len(part):
            i, j = int(part[0]), int(part[-1])
            end = spans[j + 1][0] if j + 1 < len(spans) else len(text)
            out.append((spans[i][0], end))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def dedup_substrings(docs: DataFrame, rule: Spans = SENTENCES) -> DataFrame:
    """The rows of `docs` with their text cleaned, all columns kept, and `removed_spans` array<struct<start,end>> of the text before."""
    spark = docs.sparkSession
    buckets = bucket_count(docs)
    found = repeats(packed_runs(docs, buckets, rule), buckets)
    # Both steps combine by key before they shuffle; a document has at most two runs a sentence.
    mark_id, marks_name = fresh_name(docs, "mark_id"), fresh_name(docs, "marks")
    marks = found.groupBy(F.col("id").alias(mark_id)).agg(F.collect_set(F.struct("first", "hash")).alias(marks_name))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST_ID))
    joined = docs.join(marks, key == F.col(mark_id), "left").drop(mark_id)
    small_batches(spark)
    at, n = docs.columns.index("text"), len(docs.columns)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    out_schema = StructType([*docs.schema.fields, StructField(fresh_name(docs, "removed_spans"), ArrayType(span))])
    span_pa = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts, gone = b.column(at).to_pylist(), []
            for i, m in enumerate(b.column(n)):
                spans = []
                if m.is_valid and texts[i]:
                    spans = removed_spans(texts[i], {(x["first"], x["hash"]) for x in m.as_py()}, rule)
                    texts[i] = without(texts[i], spans)
                gone.append([{"start": x, "end": y} for x, y in spans])
            columns = [*b.columns[:n], pa.array(gone, span_pa)]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:n], out_schema.names[-1]])

    return joined.mapInArrow(run, out_schema)
