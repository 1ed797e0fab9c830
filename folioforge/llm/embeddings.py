"""Vector operators: near-duplicates by Euclidean p-stable hashing, and exact top-k by the threshold algorithm.

Near-duplicates. Normalised vectors are projected on random Gaussian directions and cut into cells of width `WIDTH`; a
table's code is the cells of some directions, and vectors that share a code in any table are compared by exact cosine in
double precision. Unit vectors of cosine c are sqrt(2 - 2c) apart, so the chance to share a code is known: `plan` takes as
many directions a code as keep the strangers in a bucket few, so more for a larger table, and as many tables as
`recall_bound` needs to stay above 0.99 at the threshold. Comparisons so grow with n^1.23, not with its square.

Equal vectors of a label are one entry with a count, so copies never meet. Codes travel alone first; only entries whose
code another has fetch their vectors. A code's entries are cut into blocks by hash and each pair of blocks is a task's
work; a pair counts in the first table whose code it shares. What leaves a task are link counts and enough links to
connect what is connected in it, not all pairs.

Top-k. Every component x becomes floor(64 x). Candidates are cut into blocks; a block holds one sorted list per dimension,
built once, and the queries stream past it. A query walks its lists from their best ends, scores each row when a list
first shows it, and stops when the sum of the scores at the lists' present depth cannot reach the kth score (Fagin's
threshold algorithm). The best of all blocks are merged. How far a walk goes depends on the vectors: where few dimensions
carry a query's score it ends early, where all weigh alike the lists show nearly every row before the bound falls.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part (near-duplicates: a component
of their own; top-k: neither query nor candidate, a zero vector does take part there). Vectors of other lengths never
meet. A null id takes no part; repeated ids are rows of their own in the counts. Extra columns are dropped. Equal scores
rank by the smaller id. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, bucket_count, components, mix, mix_int, small_batches, snapshot

COSINE = 0.93
WIDTH, SEED, RECALL, STRANGERS = 2.4, 20240607, 0.99, 16
BLOCK = 512
SCALE, TOP, QUERY_EVERY = 64, 20, 20
CANDIDATE_BLOCK, LEAST_BLOCK = 8192, 1024


def same_cell(cosine: float, width: float = WIDTH) -> float:
    """The chance that two unit vectors of this cosine fall into one cell of a random direction."""
    r = width / math.sqrt(max(1e-18, 2 - 2 * cosine))
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def recall_bound(cosine: float, tables: int, projections: int) -> float:
    """The chance that two unit vectors of this cosine share a code in some table."""
    return 1 - (1 - same_cell(cosine) ** projections) ** tables


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(tables, projections) for n vectors: a bucket holds about STRANGERS unrelated vectors, and links are met with RECALL."""
    projections = min(48, max(6, math.ceil(math.log(max(1.0, n / STRANGERS)) / -math.log(same_cell(0.0)))))
    return math.ceil(math.log(1 - RECALL) / math.log1p(-(same_cell(cosine) ** projections))), projections


def directions(dim: int, tables: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, WIDTH, tables * projections)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors in double precision."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None
        if v.is_valid and len(v) and v.values.null_count == 0:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                x = None
        out.append(x)
    return out


def unit_rows(raw: list[bytes]) -> np.ndarray:
    """The normalised vectors, in double precision, of `raw` columns of one length."""
    size = len(raw[0])
    x = np.frombuffer(b"".join(r[1:] for r in raw), dtype=np.float32 if raw[0][:1] == b"f" else np.float64).reshape(len(raw), -1).astype(np.float64)
    assert all(len(r) == size for r in raw)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, raw binary): usable vectors, f or d and then their components."""
    small_batches(vectors.sparkSession, 2000)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("raw", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            rows: list[list] = [[], [], []]
            short = pa.types.is_float32(b.column(2).type.value_type)
            for vec, label, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _vectors(b.column(2))):
                if vec is None or label is None or x is None or not x.any():
                    continue
                for column, value in zip(rows, (vec, label, b"f" + x.astype(np.float32).tobytes() if short else b"d" + x.tobytes())):
                    column.append(value)
            yield wrap(rows)

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, raw binary")


def coded(entries: DataFrame, tables: int, projections: int) -> DataFrame:
    """`entries` (rep, key, copies, label, raw) with `codes` binary: a 32-bit code for each table."""
    small_batches(entries.sparkSession, 2000)
    schema = pa.schema([("rep", pa.int64()), ("key", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("raw", pa.binary()), ("codes", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap, made = batches(schema), {}
        salt = np.array([mix_int(t + 1) | 1 for t in range(projections)], dtype=np.uint64)
        for b in parts:
            raw = b.column(4).to_pylist()
            codes: list[bytes] = [b""] * len(raw)
            for size in {(x[:1], len(x)) for x in raw}:
                which = [i for i, x in enumerate(raw) if (x[:1], len(x)) == size]
                unit = unit_rows([raw[i] for i in which])
                if unit.shape[1] not in made:
                    made[unit.shape[1]] = directions(unit.shape[1], tables, projections)
                a, shift = made[unit.shape[1]]
                cells = np.floor((unit @ a + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(which), tables, projections)
                found = mix((cells * salt).sum(axis=2, dtype=np.uint64) + np.uint64(size[1])).astype(np.uint32)
                for i, c in zip(which, found):
                    codes[i] = c.tobytes()
            yield wrap([*b.columns, codes])

    return entries.select("rep", "key", "copies", "label", "raw").mapInArrow(run, "rep long, key long, copies long, label long, raw binary, codes binary")


def compared(entries: DataFrame, cosine: float, tables: int) -> DataFrame:
    """(a, key, b, n) rows: entry (a, key) has n linked vectors that it met here, and b (or null) is one to connect it to.

    `entries`: rep, key, copies, label, raw, codes. An id may be repeated with other vectors: rep and key name an entry.
    """
    small_batches(entries.sparkSession, 2000)
    schema = pa.schema([("rep", pa.int64()), ("key", pa.int64()), ("label", pa.int64()), ("t", pa.int32()), ("code", pa.int32())])

    def by_table(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            if not b.num_rows:
                continue
            codes = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.int32).reshape(-1, tables)
            for t in range(tables):
                yield wrap([*b.columns[:3], np.full(len(codes), t, dtype=np.int32), codes[:, t]])

    held = entries.select("rep", "key", "label", "codes").mapInArrow(by_table, "rep long, key long, label long, t int, code int")
    counts = held.groupBy("label", "t", "code").agg(F.count("*").alias("members")).where("members > 1").select(F.col("label").alias("l"), F.col("t").alias("tt"), F.col("code").alias("c"), F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks"))
    met = held.join(counts, (F.col("label") == F.col("l")) & (F.col("t") == F.col("tt")) & (F.col("code") == F.col("c"))).select("rep", "key", "t", "code", "blocks")
    met = met.join(entries, ["rep", "key"])
    placed = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = placed.select("label", "t", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "key", "copies", "raw", "codes")

    order = ["label", "t", "code", "i", "j"]
    dealt = spread.repartition(bucket_count(entries), *order).sortWithinPartitions(*order)
    out = pa.schema([("a", pa.int64()), ("key", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap, rest = batches(out), None
        for b in parts:
            rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            if not rows.num_rows:
                continue
            starts = group_starts(rows, order)
            rest = rows.slice(int(starts[-1]))  # the last group may go on in the next batch
            if starts[-1]:
                yield wrap(links_within(rows.slice(0, int(starts[-1])), starts[:-1], cosine, tables))
        if rest is not None:
            yield wrap(links_within(rest, np.zeros(1, dtype=np.int64), cosine, tables))

    return dealt.mapInArrow(run, "a long, key long, b long, n long")


def group_starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where groups of equal values in these columns begin, in sorted rows."""
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = False
    for c in columns:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


#: Groups of at most so many rows are compared together, by distance of rows; larger ones one by one, as matrices.
SMALL_GROUP = 12


def links_within(rows: pa.Table, starts: np.ndarray, cosine: float, tables: int) -> list[np.ndarray]:
    """The columns of `compared` for whole groups: link counts, and links that connect what is connected in a group."""
    n_rows = rows.num_rows
    rep, key, copies, block, t, i, j = (rows.column(c).to_numpy() for c in ("rep", "key", "copies", "block", "t", "i", "j"))
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.int32).reshape(n_rows, tables)
    raw = rows.column("raw").to_pylist()
    length = np.array([len(x) if x[:1] == b"d" else -len(x) for x in raw])
    sizes = np.diff(np.r_[starts, n_rows])
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    a, n, linked = [], [], []

    def fresh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs that share no code in an earlier table."""
        return ~((codes[x] == codes[y]) & (np.arange(tables) < t[x][:, None])).any(axis=1)

    for size in np.unique(length):
        here = np.flatnonzero(length == size)
        unit = unit_rows([raw[k] for k in here])
        few = small[here]
        for apart in range(1, min(SMALL_GROUP, len(here))):
            x, y = np.arange(len(here) - apart), np.arange(apart, len(here))
            gx, gy = here[:-apart], here[apart:]
            ok = few[x] & (group[gx] == group[gy]) & ((i[gx] == j[gx]) | (block[gx] != block[gy]))
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            x, y = here[x[near]], here[y[near]]
            keep = fresh(x, y)
            x, y = x[keep], y[keep]
            a += [x, y]
            n += [copies[y], copies[x]]
            linked.append((x, y))
        for g in np.unique(group[here[~few]]):
            some = np.flatnonzero(group[here] == g)
            at, u = here[some], unit[some]
            crossed = i[at[0]] != j[at[0]]
            left, right = (np.flatnonzero(block[at] == i[at[0]]), np.flatnonzero(block[at] == j[at[0]])) if crossed else (np.arange(len(at)), np.arange(len(at)))
            near = u[left] @ u[right].T >= cosine
            for earlier in range(int(t[at[0]])):
                near &= codes[at[left], earlier][:, None] != codes[at[right], earlier][None, :]
            if not crossed:
                np.fill_diagonal(near, False)
            a += [at[left], at[right]] if crossed else [at[left]]
            n += [near @ copies[at[right]], copies[at[left]] @ near] if crossed else [near @ copies[at[right]]]
            # Each vector is tied to the first vector that links met here lead to; that connects all they connect.
            label = np.arange(len(at))
            while near.any():
                least = label.copy()
                least[left] = np.minimum(least[left], np.where(near, label[right][None, :], len(at)).min(axis=1))
                least[right] = np.minimum(least[right], np.where(near, label[left][:, None], len(at)).min(axis=0))
                least = least[least]
                if (least == label).all():
                    break
                label = least
            tied = np.flatnonzero(label != np.arange(len(at)))
            linked.append((at[tied], at[label[tied]]))
    one = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    counted, n = one(a), one(n)
    counted, n = counted[n > 0], n[n > 0]
    x, y = one([p for p, _ in linked]), one([q for _, q in linked])
    nothing = pa.nulls(len(counted), pa.int64())
    b = pa.concat_arrays([nothing, pa.array(rep[y].astype(np.int64))])
    return [np.r_[rep[counted], rep[x]], np.r_[key[counted], key[x]], b, np.r_[n, np.zeros(len(x), dtype=np.int64)].astype(np.int64)]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors`."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    usable = snapshot(usable_rows(vectors))
    equal = snapshot(usable.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("key", F.xxhash64("label", "raw")))
    tables, projections = plan(equal.count(), cosine)
    found = snapshot(compared(snapshot(coded(equal, tables, projections)), cosine, tables))
    links = found.groupBy(F.col("a").alias("rep"), "key").agg(F.sum("n").alias("links"))
    named = usable.join(equal.select(F.col("label").alias("l"), F.col("raw").alias("r"), "rep", "key", "copies"), (F.col("label") == F.col("l")) & (F.col("raw") == F.col("r"))).select("vec_id", "rep", "key", "copies")
    named = snapshot(named.join(links, ["rep", "key"], "left").select("vec_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    edges = found.where("b is not null").select("a", "b").unionByName(named.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges)
    per_id = named.groupBy("vec_id").agg(F.sum("links").alias("links"))
    out = vectors.select("vec_id").join(per_id.withColumnRenamed("vec_id", "v"), F.col("vec_id") == F.col("v"), "left").join(labels, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


# ---- exact top-k -----------------------------------------------------------------------------------


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim int, v binary): usable vectors as floor(scale * x), doubles that hold integers."""
    small_batches(vectors.sparkSession, 2000)
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for b in parts:
            rows = [(i, len(x), np.floor(scale * x).tobytes()) for i, x in zip(b.column(0).to_pylist(), _vectors(b.column(1))) if i is not None and x is not None]
            yield wrap([list(c) for c in zip(*rows)] if rows else [[], [], []])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dim int, v binary")


class SortedLists:
    """A block of candidates with one list per dimension, from the greatest component to the smallest.

    A list is kept as `edges` (its components in order) and `rank` (each row's place in it).
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        #: By dimension the rows from the greatest component to the smallest, and those components.
        self.lists = np.ascontiguousarray(np.argsort(-self.x, axis=0, kind="stable").T.astype(np.int32))
        self.edges = np.take_along_axis(np.ascontiguousarray(self.x.T), self.lists, axis=1)
        # Products of doubles are exact below 2^53, of floats below 2^24; larger components are multiplied as Python integers.
        self.most = float(np.abs(self.x).max(initial=0))
        self.small = self.x.astype(np.float32) if self.most < 2**24 else None
        self.scored = self.touched = self.stops = 0

    def _scores(self, rows: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
        self.scored += len(rows)
        many = 4 * len(rows) > len(self.ids)  # then the product of all rows costs less than taking them apart
        if reach < 2**24 and self.small is not None:
            q = q.astype(np.float32)
            return ((self.small @ q)[rows] if many else self.small[rows] @ q).astype(np.float64)
        if reach < 2**53:
            return (self.x @ q)[rows] if many else self.x[rows] @ q
        ints = [int(c) for c in q]
        return np.array([sum(int(c) * d for c, d in zip(self.x[r], ints)) for r in rows], dtype=object)

    def top(self, query_id: int, q: np.ndarray, k: int, first_depth: int = 64) -> list[tuple[int, int]]:
        """(score, id) of the k best other rows: greatest score, then smallest id.

        The lists of the dimensions that the query weighs are walked from the end that its sign asks for. A row is scored when the
        first list shows it. No row that is still unseen has a component beyond any list's edge, the last entry read or the first one of
        a list not read yet; that bounds its score. A step doubles the depth, from `first_depth`, of those lists where an entry lowers the bound
        most (at least a quarter as much as in the best one); nothing below these depths is read. Once half of the rows are scored, the
        rest are scored in one product, which then costs less than reading on.
        """
        n, dims = len(self.ids), np.flatnonzero(q)
        w, flip = q[dims], q[dims] < 0
        reach = float(np.abs(q).max(initial=0)) * self.most * max(1, len(q))
        exact = reach < 2**53
        unseen, at = np.ones(n, dtype=bool), np.zeros(len(dims), dtype=np.int64)

        def edge(depth: np.ndarray) -> np.ndarray:
            return self.edges[dims, np.where(flip, n - depth, depth - 1)]

        best_rows, best_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=float if exact else object)
        seen, now = 0, edge(np.ones_like(at)) if n else w
        while seen < n:
            if 2 * seen >= n or not len(dims):  # a zero query weighs nothing, and all rows score alike
                rows = np.flatnonzero(unseen)
            else:
                to = np.minimum(n, np.maximum(first_depth, 2 * at))
                then, ahead = edge(to), np.maximum(to - at, 1)
                gain = w * (now - then) / ahead
                chosen = np.flatnonzero((to > at) & (gain >= gain.max() / 4))
                cells = np.concatenate([self.lists[dims[i], n - to[i] : n - at[i]] if flip[i] else self.lists[dims[i], at[i] : to[i]] for i in chosen])
                at[chosen], now[chosen] = to[chosen], then[chosen]
                self.touched += len(cells)
                if len(cells) < n >> 3:
                    rows = np.unique(cells[unseen[cells]])
                else:
                    shown = np.zeros(n, dtype=bool)
                    shown[cells] = True
                    rows = np.flatnonzero(shown & unseen)
            unseen[rows] = False
            seen += len(rows)
            rows = rows[self.ids[rows] != query_id]
            if len(rows):
                scores = self._scores(rows, q, reach)
                if exact:  # only what reaches the kth score so far, and the kth of these, can matter
                    least = best_scores[-1] if len(best_scores) == k else -np.inf
                    if len(rows) > 4 * k:
                        least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                    rows, scores = rows[scores >= least], scores[scores >= least]
                best_rows, best_scores = np.r_[best_rows, rows], np.r_[best_scores, scores]
                order = np.lexsort((best_rows, -best_scores))[:k] if exact else np.array(sorted(range(len(best_rows)), key=lambda i: (-best_scores[i], best_rows[i]))[:k], dtype=np.int64)
                best_rows, best_scores = best_rows[order], best_scores[order]
            if seen < n and len(best_rows) == k:
                # Rows are in order of id, so an unseen row that ties could still win: only a lower bound stops the walk.
                bound = float(now @ w) if exact else sum(int(c) * int(d) for c, d in zip(now, w))
                if bound < best_scores[-1]:
                    self.stops += 1
                    break
        return [(int(s), int(self.ids[r])) for s, r in zip(best_scores, best_rows)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of `vectors` for each row of `queries`.

    A candidate moves once, to its block; each query moves once to each block and streams past the lists there, so a task
    holds one block of candidates and one batch of queries, whatever the tables' size.
    """
    spark = vectors.sparkSession
    everything, asked = snapshot(quantised(vectors, scale)), snapshot(quantised(queries, scale))
    n = everything.count()
    # Small tables are cut finer, so that all cores have a block.
    blocks = max(1, -(-n // candidate_block), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    small_batches(spark, 2000)
    candidates = everything.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "v")
    askers = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        now, ids, raw, lists = None, [], [], None
        for b in parts:
            out: list[list[int]] = [[], [], []]
            for dim, block, asks, vec, v in zip(*(c.to_pylist() for c in b.columns)):
                if (dim, block) != now:
                    now, ids, raw, lists = (dim, block), [], [], None
                if not asks:
                    ids.append(vec)
                    raw.append(v)
                elif ids:
                    if lists is None:
                        lists = SortedLists(np.array(ids, dtype=np.int64), np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(ids), -1))
                        raw = []
                    for score, i in lists.top(vec, np.frombuffer(v, dtype=np.float64), k):
                        for column, value in zip(out, (vec, i, score)):
                            column.append(value)
            yield wrap(out)

    # Blocks are dealt by hash: with more partitions than blocks few of them share one.
    dealt = candidates.unionByName(askers).repartition(4 * blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    met = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    # Spark keeps the first k of a query in each task before it shuffles them.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
