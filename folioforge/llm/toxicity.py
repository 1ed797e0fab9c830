"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words and their first letters;
a document's is the noisy-or of its sentences', 1 - product(1 - p). The weights are trained from document labels alone,
so the sentences that carry a label are found on the way, and scoring names them.

The bias is fixed and very low: a sentence without evidence is clean, and thousands of clean sentences stay clean. Only
words that the training sample has in several documents get a weight, and an L1 penalty drives most weights to zero, so
the model is a small table.

Training takes a bounded sample of the labelled rows (`sample_positive`, `sample_negative`: at most so many of either
label, by hash of doc_id); rows that are weighted back to the labels' own shares. Its texts are taken apart on the
executors; what comes to the driver is the vocabulary and, for each document, the vocabulary's features by sentence, of at
most `SAMPLE_SENTENCES` sentences. The same tables give the same model. Scoring covers every document whole.

Rows: a null or empty text has no sentence and scores 0; rows with a null doc_id are scored, never learnt from; labels
that are null are skipped, and a document with several labels is toxic if one says so; of several texts with one doc_id
the least is learnt from; copies of a text are learnt once; repeated rows are scored alike; extra columns are dropped by
`score_documents` and kept by `flag_documents`. An empty table gives an empty one. Without labels of both kinds every
score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_name, own_tables, sentence_spans, small_batches, texts_of, write_table

BIAS = -9.0
THRESHOLD = 0.3
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2000, 3000
#: Of a sampled document with more sentences that have a feature, so many are learnt from, evenly spread. Scoring takes all.
SAMPLE_SENTENCES = 5000
LEAST_DOCUMENTS = 3
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 300_000


def features(word: str) -> list[str]:
    """A word, and its first letters marked as such."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def held_out_column(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 by 4; such rows are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    weights: dict[str, float]
    bias: float = BIAS


def training_sample(docs: DataFrame, labels: DataFrame, positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE) -> tuple[DataFrame | None, tuple[float, float]]:
    """((text, y) table or None, weight of a clean and of a toxic document). Ids are chosen among the labels first; only the
    chosen documents' texts move."""
    usable = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out_column(F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in usable.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None, (1.0, 1.0)
    parts = [usable.where(F.col("toxic") > 0 if y else F.col("toxic") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, positive), (0, negative))]
    # At most sample_positive + sample_negative rows of two numbers: that bound is what makes the broadcast safe.
    chosen = parts[0].select("doc_id", F.lit(1).alias("y")).unionByName(parts[1].select("doc_id", F.lit(0).alias("y")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = write_table(rows.groupBy("text").agg(F.max("y").alias("y"), F.count("*").alias("n"), F.sum("y").alias("n1")), "toxicity-sample")
    found = sample.agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).first()
    n1 = found["n1"] or 0
    return sample.select("text", "y"), (totals[0] / max(1, (found["n"] or 0) - n1), totals[1] / max(1, n1))


def vocabulary_of(sample: DataFrame) -> dict[str, int]:
    """Feature -> its number, for the features that toxic documents have clearly more often: only such can raise a score."""
    shares = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    small_batches(sample.sparkSession, 500)
    schema = pa.schema([("feature", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                counts[y].update({f for w in set(_WORD.findall(t.lower())) for f in features(w)})
            names = list(counts[0] | counts[1])
            yield wrap([names, [counts[0][f] for f in names], [counts[1][f] for f in names]])

    x = sample.select("text", "y").mapInArrow(run, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    often = F.col("n1") / F.lit(float(max(1, shares.get(1, 0)))) > 4 * (F.col("n0") + 0.5) / F.lit(float(max(1, shares.get(0, 0))))
    names = sorted(r["feature"] for r in x.where((F.col("n1") >= LEAST_DOCUMENTS) & often).select("feature").collect())
    return {f: i for i, f in enumerate(names)}


@dataclass
class Bags:
    """Documents as bags of sentences: feature `col[i]` stands in sentence `sen[i]`, sentence s in document `doc[s]`; `plain` counts
    each document's sentences without a feature, `y` are the labels and `weight` sums to 1."""

    col: np.ndarray
    sen: np.ndarray
    doc: np.ndarray
    plain: np.ndarray
    y: np.ndarray
    weight: np.ndarray


def bags_of(sample: DataFrame, vocabulary: dict[str, int], weights: tuple[float, float]) -> Bags:
    small_batches(sample.sparkSession, 500)
    shared = sample.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the sample
    schema = pa.schema([("order", pa.int64()), ("y", pa.int64()), ("plain", pa.int64()), ("sizes", pa.list_(pa.int32())), ("columns", pa.list_(pa.int32()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap, known = batches(schema), shared.value
        for b in parts:
            rows: list[list] = [[], [], []]
            for t in texts_of(b.column(2)):
                plain, sizes, columns = 0, [], []
                for x, y in sentence_spans(t):
                    found = {known[f] for w in set(_WORD.findall(t[x:y].lower())) for f in features(w) if f in known}
                    if found:
                        sizes.append(len(found))
                        columns += sorted(found)
                    else:
                        plain += 1
                if len(sizes) > SAMPLE_SENTENCES:
                    ends = np.cumsum(sizes)
                    some = np.linspace(0, len(sizes) - 1, SAMPLE_SENTENCES).astype(np.int64)
                    columns = np.concatenate([columns[ends[i] - sizes[i] : ends[i]] for i in some]).tolist()
                    sizes = [sizes[i] for i in some]
                for column, value in zip(rows, (plain, sizes, columns)):
                    column.append(value)
            yield wrap([*b.columns[:2], *rows])

    got = sample.select(F.xxhash64("text"), F.col("y").cast("long"), "text").mapInArrow(run, "order long, y long, plain long, sizes array<int>, columns array<int>").orderBy("order").toArrow()
    y = got.column("y").to_numpy().astype(float)
    sizes = [np.array(x, dtype=np.int64) for x in got.column("sizes").to_pylist()]
    col = np.concatenate([np.array(x, dtype=np.int64) for x in got.column("columns").to_pylist()])
    per_sentence = np.concatenate(sizes)
    weight = np.where(y > 0, weights[1], weights[0])
    return Bags(col, np.repeat(np.arange(len(per_sentence)), per_sentence), np.repeat(np.arange(len(sizes)), [len(x) for x in sizes]), got.column("plain").to_numpy(), y, weight / weight.sum())


def loss(w: np.ndarray, bags: Bags) -> tuple[float, np.ndarray]:
    """(negative log likelihood of the labels under noisy-or, its gradient)."""
    p0 = 1 / (1 + math.exp(-BIAS))
    z = BIAS + np.bincount(bags.sen, weights=w[bags.col], minlength=len(bags.doc))
    p = 1 / (1 + np.exp(-z))
    log_q = np.bincount(bags.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags.y)) + bags.plain * math.log1p(-p0)
    score = np.clip(-np.expm1(log_q), 1e-9, 1 - 1e-9)
    value = -float(bags.weight @ np.where(bags.y > 0, np.log(score), np.log1p(-score)))
    # By a sentence's z: p for clean documents, -(1 - score) / score * p for toxic ones.
    slope = bags.weight * np.where(bags.y > 0, -(1 - score) / score, 1.0)
    return value, np.bincount(bags.col, weights=(slope[bags.doc] * p)[bags.sen], minlength=len(w))


def fit(bags: Bags, n_features: int, epochs: int = 150, rate: float = 0.15, l1: float = 2e-4) -> np.ndarray:
    """Weights that maximise the likelihood of the labels, by full-batch Adam with a proximal L1 step."""
    w, m, v = np.full(n_features, 0.5), np.zeros(n_features), np.zeros(n_features)
    for step in range(1, epochs + 1):
        _, grad = loss(w, bags)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w = w - move * m / (1 - 0.9**step)
        w = np.clip(np.sign(w) * np.maximum(0, np.abs(w) - move * l1 * 0.01), 0.0, 14.0)
    return w


class Scorer:
    """A model with a memo of word weights."""

    def __init__(self, model: Model):
        self.w, self.bias, self.memo = model.weights, model.bias, {}
        self.p0 = 1 / (1 + math.exp(-model.bias))

    def weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            got = self.memo[word] = sum(self.w.get(f, 0.0) for f in features(word))
        return got

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of its offending sentences."""
        if not self.w:
            return 0.0, []
        memo, lower, spans = self.memo, text.lower(), None
        if len(lower) != len(text):  # a character whose lower case is longer: keep positions right
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        hits = []
        for m in _WORD.finditer(lower):
            word = m[0]
            got = memo.get(word)
            if got is None:
                got = self.weight(word)
            if got:
                hits.append((m.start(), word))
        if not hits:
            return 0.0, []
        spans = sentence_spans(text)
        log_q, found, i = 0.0, [], 0
        for a, b in spans:
            words = set()
            while i < len(hits) and hits[i][0] < b:
                words.add(hits[i][1])
                i += 1
            if not words:
                continue
            z = self.bias + sum(self.w.get(f, 0.0) for f in {f for x in words for f in features(x)})
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            log_q += math.log1p(-min(p, 1 - 1e-12))
            if p >= THRESHOLD:
                found.append((a, b, p))
        return min(1.0, max(0.0, -math.expm1(log_q))), found


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double, sentences array<struct<start,end,score>>): sentences at or above the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's vocabulary
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.list_(struct))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("toxicity")
        wrap, scorer = batches(schema), Scorer(shared.value)
        for b in parts:
            scored = [scorer.score(t) for t in texts_of(b.column(1))]
            yield wrap([b.column(0), [s for s, _ in scored], [[{"start": a, "end": e, "score": p} for a, e, p in x] for _, x in scored]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def flag_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns kept, with a last boolean column `toxic_flag` (with _ behind it if that is taken)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at, name = docs.columns.index("text"), fresh_name(docs, "toxic_flag")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tables("toxicity")
        scorer = Scorer(shared.value)
        for b in parts:
            flags = pa.array([scorer.score(t)[0] >= threshold for t in texts_of(b.column(at))], pa.bool_())
            yield b.append_column(name, flags)

    from pyspark.sql.types import BooleanType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, BooleanType()))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample, weights = training_sample(docs, labels)
    vocabulary = vocabulary_of(sample) if sample is not None else {}
    if not vocabulary:
        return Model({})
    w = fit(bags_of(sample, vocabulary, weights), len(vocabulary))
    return Model({f: round(float(w[i]), 4) for f, i in vocabulary.items() if w[i] > 0.05})
