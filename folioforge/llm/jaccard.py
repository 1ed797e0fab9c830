"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the hashes of its distinct five-word shingles. Two sets link when 100 |A and B| >= 80 |A or B|,
that is when their symmetric difference is at most (|A| + |B|) / 9.

Sizes fall into bands. For a band the hash universe is cut into segments, each with an allowance of 0 (the segments must
be equal) or 1 (they may differ by one token: the index then also holds the segment without each of its tokens). If the
allowances plus one add up to more than the greatest difference of the band, every linked pair agrees in a segment. How
many segments of either kind a band gets is chosen by cost. Segments without tokens say nothing; a document that has too
many of them to be sure also enters a prefix index, which has no such case, so no link is lost.

What agrees becomes groups, not pairs. A group's smallest document is compared with the others, linked sets are joined to
components, and only groups that still hold several components are compared further, across components, in blocks of
bounded size. A parity sketch (each token flips one bit, so the bits that differ never exceed the true difference) drops
pairs that cannot link; the rest are verified on the 64-bit hashes of all their shingles, made again from their texts.

Copies of a set meet first by (set, salt) and then by set, and a leader's pairs are dealt in parts, so neither a set nor a
leader that very many documents share is one task's work.

Rows: null and empty texts have an empty set and link with nothing; rows with a null doc_id get a null component and link
with nothing; repeated rows are one node, and rows that share a doc_id are linked by it; extra columns are dropped; an empty
table gives an empty one. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, staged
from .common import HashTable, M64, batches, bucket_count, components, mix, mix_int, own_tables, release_shuffles, small_batches, snapshot, texts_of, write_table

WORDS = 5
LAST_SIZE = 1 << 31
BLOCK = 512
SALTS, LEADER_PAIRS = 64, 256
_INDEX_BITS = np.uint64(20)
_INDEX_MASK = np.uint64((1 << 20) - 1)
_FACTORS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WORDS)]


# ---- sets ------------------------------------------------------------------------------------------


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both are ASCII only for bytes
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hash, words), dtype=np.uint64, count=n)
    if n < WORDS:
        x = np.uint64(mix_int(n))
        for k in range(n):
            x = mix((x + h[k : k + 1]) * np.uint64(_FACTORS[k]))[0]
        return np.array([x], dtype=np.uint64)
    x = h[: n - WORDS + 1] * np.uint64(_FACTORS[0])
    for k in range(1, WORDS):
        x = x + h[k : n - WORDS + 1 + k] * np.uint64(_FACTORS[k])
    return np.unique(mix(x))


class _Words(HashTable):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_table = _Words()
_word_hash = _table.__getitem__


def own_words() -> None:
    own_tables("jaccard", _table)


def set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sketch(s: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits; as many bits as the power of two at or above the set's size."""
    width = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) brought down to `words` words."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def may_link(na: int, nb: int, sa: bytes, sb: bytes) -> bool:
    if 10 * min(na, nb) < 8 * max(na, nb):
        return False
    a, b = np.frombuffer(sa, dtype=np.uint64), np.frombuffer(sb, dtype=np.uint64)
    w = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, w) ^ folded(b, w)).sum()) <= (na + nb) // 9


# ---- bands and allocation --------------------------------------------------------------------------


@functools.cache
def band_edges() -> tuple[list[int], list[int]]:
    """First and last sizes of the bands. Sets below 4 link only with equal ones and need no band."""
    lows, highs, low = [], [], 4
    while low < LAST_SIZE:
        high = max(low, int(low * 1.5) - 1)
        lows.append(low)
        highs.append(high)
        low = high + 1
    return lows, highs


def bands_of(n: int) -> list[int]:
    """A set's own band, and those in which a larger partner may be."""
    lows, _ = band_edges()
    if n < 4:
        return []
    return list(range(bisect_right(lows, n) - 1, bisect_right(lows, n * 5 // 4)))


@functools.cache
def allocation(band: int) -> tuple[int, int]:
    """(segments with allowance 0, segments with allowance 1) of least expected cost: index rows, candidates of short
    segments, and the prefix rows of sets that would have too many empty segments."""
    lows, highs = band_edges()
    low, high = lows[band], highs[band]
    most = 2 * high // 9
    sizes = [0.8 * low * (high / (0.8 * low)) ** (k / 4) for k in range(5)]
    best = (math.inf, 0, 0)
    for slack in range(0, most + 4, max(1, most // 16)):
        whole = most + 1 + slack
        for ones in range(0, whole // 2 + 1, max(1, whole // 24)):
            zeros, cost = whole - 2 * ones, 0.0
            for size in sizes:
                own = int((size + min(high, 1.25 * size)) / 9)
                load = size / (zeros + ones)
                p0, p1 = math.exp(-load), math.exp(-load) * (1 + load)
                mean, var = zeros * p0 + 2 * ones * p1, zeros * p0 * (1 - p0) + 4 * ones * p1 * (1 - p1)
                unsafe = 0.5 * math.erfc((slack + most - own + 0.5 - mean) / math.sqrt(2 * var + 1e-9))
                # Index rows, half a candidate for a segment of one token, and the prefix rows if the set is unsafe.
                cost += zeros * (1 - p0) + ones * (1 + load) + 0.5 * zeros * load * p0 + unsafe * 4 * (0.2 * size + 1)
            best = min(best, (cost, zeros, ones))
    return best[1], best[2]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all index rows of these sets."""
    by_band: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for b in bands_of(len(s)):
            by_band.setdefault(b, []).append(i)
    all_sigs, all_owners = [], []
    highs = band_edges()[1]
    for band, members in by_band.items():
        sigs, owners = [], []
        zeros, ones = allocation(band)
        m, seed = zeros + ones, np.uint64(mix_int(band + 1))
        sizes = np.array([len(sets[i]) for i in members])
        token = np.concatenate([sets[i] for i in members])
        of = np.repeat(np.arange(len(members)), sizes)
        place = of * m + (mix(token ^ seed) % np.uint64(m)).astype(np.int64)
        value = mix(token + seed)
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sums, counts = np.add.reduceat(value, starts), np.diff(np.r_[starts, len(place)])
        cell = place[starts]
        who, segment = cell // m, cell % m
        salt = mix(segment.astype(np.uint64) + np.uint64(3 * int(seed) & M64))
        sigs.append(mix(sums ^ salt))
        owners.append(who)
        soft = segment < ones  # the first segments have allowance 1
        drop = np.repeat(soft & (counts >= 2), counts)
        if drop.any():
            sigs.append(mix((np.repeat(sums, counts)[drop] - value[drop]) ^ np.repeat(salt, counts)[drop]))
            owners.append(np.repeat(who, counts)[drop])
        useful = np.bincount(who, weights=np.where(soft, 2 * (counts >= 2), 1), minlength=len(members))
        greatest = (sizes + np.minimum(highs[band], sizes * 5 // 4)) // 9
        for k in np.flatnonzero(useful < greatest + 1):
            s = sets[members[k]]
            prefix = s[: len(s) - -(-8 * len(s) // 10) + 1]
            sigs.append(mix(prefix ^ np.uint64(mix_int(band + (1 << 40)))))
            owners.append(np.full(len(prefix), k))
        all_sigs += sigs
        all_owners.append(np.array(members, dtype=np.int32)[np.concatenate(owners)])
    if not all_sigs:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    return np.concatenate(all_sigs), np.concatenate(all_owners)


# ---- stages ----------------------------------------------------------------------------------------


def described(docs: DataFrame, buckets: int) -> DataFrame:
    """Two kinds of rows from one pass over the texts. (doc_id, n, set_key binary, sketch binary) of every row, and the index rows
    (bucket int, rows binary, ids binary), packed by bucket, 44 bits of signature and 20 of place in `ids` each; n is null in those.

    Copies of a set within a batch are one entry of the index; they are linked by their set key.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary()), ("bucket", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words()
        wrap = batches(schema)
        for b in parts:
            sets = [shingle_set(t) for t in texts_of(b.column(1))]
            keys = [set_key(s) for s in sets]
            none = [None] * len(sets)
            yield wrap([b.column(0), [len(s) for s in sets], keys, [sketch(s) for s in sets], none, none, none])
            first: dict[bytes, int] = {}
            for i, (d, s) in enumerate(zip(b.column(0).to_pylist(), sets)):
                if d is not None and len(s) >= 4:
                    first.setdefault(keys[i], i)
            bucket, rows, ids = index_rows(b.column(0).take(pa.array(first.values(), pa.int64())).to_numpy(), [sets[i] for i in first.values()], buckets)
            none = [None] * len(bucket)
            yield wrap([none, none, none, none, bucket, rows, ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, set_key binary, sketch binary, bucket int, rows binary, ids binary")


def index_rows(all_ids: np.ndarray, sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """The columns bucket, rows and ids of `described` for these sets."""
    sig, owner = signatures(sets)
    bucket = (sig % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, packed = bucket[order], ((sig >> _INDEX_BITS << _INDEX_BITS) | owner.astype(np.uint64))[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows, names = [], []
    for i, j in zip(cuts, np.r_[cuts[1:], len(bucket)]):
        part = packed[i:j]
        used, place = np.unique(part & _INDEX_MASK, return_inverse=True)
        rows.append(((part & ~_INDEX_MASK) | place.astype(np.uint64)).tobytes())
        names.append(all_ids[used.astype(np.int64)].tobytes())
    return bucket[cuts].astype(np.int32), rows, names


_OTHER_NAME = np.uint64(mix_int(1 << 50))


def grouped(index: DataFrame, buckets: int) -> DataFrame:
    """(fp binary, doc_id long): the members of each group of at least two documents that share a signature.

    A group is named by a fingerprint of its members in 128 bits, so the same members met in many segments are one group.
    """
    small_batches(index.sparkSession, 100)
    schema = pa.schema([("fp", pa.binary()), ("doc_id", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        sig, doc = [], []
        for b in parts:
            for rows, ids in zip(b.column(1), b.column(2)):
                x = np.frombuffer(rows.as_buffer(), dtype=np.uint64)
                sig.append(x >> _INDEX_BITS)
                doc.append(np.frombuffer(ids.as_buffer(), dtype=np.int64)[(x & _INDEX_MASK).astype(np.int64)])
        if not sig:
            return
        s, d = np.concatenate(sig), np.concatenate(doc)
        sig.clear(), doc.clear()
        order = np.argsort(s, kind="stable")
        s, d = s[order], d[order]
        del order
        twice = np.zeros(len(s), dtype=bool)
        same = s[1:] == s[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        s, d = s[twice], d[twice]
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        if len(s):
            new = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
            s, d = s[new], d[new]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            sizes = np.diff(np.r_[starts, len(s)])
            one = mix(d.view(np.uint64))
            name = np.stack([mix(np.add.reduceat(one, starts)) ^ sizes.astype(np.uint64), mix(np.add.reduceat(mix(one ^ _OTHER_NAME), starts))], axis=1)
            order = np.lexsort((name[:, 1], name[:, 0]))
            fresh = np.r_[True, (name[order[1:]] != name[order[:-1]]).any(axis=1)]
            first = np.sort(order[fresh])
            first = first[sizes[first] >= 2]
            fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(name), [None, pa.py_buffer(np.ascontiguousarray(name))]).cast(pa.binary())
            for i in range(0, len(first), 5000):
                some = first[i : i + 5000]
                n = sizes[some]
                at = np.repeat(starts[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                yield wrap([fp.take(pa.array(np.repeat(some, n))), d[at]])

    return index.repartition(buckets, "bucket").mapInArrow(run, "fp binary, doc_id long").dropDuplicates(["fp", "doc_id"])


def sketch_filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` that their sizes and sketches don't rule out."""
    side = lambda x: nodes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    small_batches(pairs.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrap = batches(schema)
        for x in parts:
            a, b, na, sa, nb, sb = (c.to_pylist() for c in x.columns)
            keep = [i for i in range(len(a)) if may_link(na[i], nb[i], sa[i], sb[i])]
            yield wrap([[a[i] for i in keep], [b[i] for i in keep]])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` whose texts link, compared exactly."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = write_table(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi"), "jaccard-texts")
    release_shuffles(docs.sparkSession)
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words()
        wrap = batches(schema)
        memo = functools.lru_cache(maxsize=256)(shingle_set)
        for x in parts:
            keep_a, keep_b = [], []
            for a, b, ta, tb in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), texts_of(x.column(2)), texts_of(x.column(3))):
                p, q = memo(ta), memo(tb)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if len(p) and len(q) and 100 * both >= 80 * (len(p) + len(q) - both):
                    keep_a.append(a)
                    keep_b.append(b)
            yield wrap([keep_a, keep_b])

    # A leader with many pairs goes in parts, with its text in each of them.
    hot = snapshot(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(LEADER_PAIRS)).cast("int").alias("parts")).where("parts > 1"))
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    leaders = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(hot, "a", "left")
    leaders = leaders.select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    wide = dealt.join(leaders, ["a", "part"]).join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return snapshot(wide.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct())


def pairs_across(members: DataFrame) -> DataFrame:
    """(a, b) of each group's members (fp, rep, n, sketch, component) of different components that may link.

    A group is cut into blocks by hash of the member, and each pair of blocks is one task's work, so a group of any size
    is spread; what comes out has passed the size and sketch bounds.
    """
    counts = members.groupBy("fp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = members.join(counts, "fp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = placed.select("fp", "rep", "n", "sketch", "component", "block", other)
    spread = spread.select("fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "sketch", "component")

    def compare(key, table):  # Spark reads the kind of function from annotations, and these are texts here
        t = table.to_pydict()
        rep, n, comp, block = (np.array(t[c], dtype=np.int64) for c in ("rep", "n", "component", "block"))
        i, j = key[1].as_py(), key[2].as_py()
        sk = [np.frombuffer(x, dtype=np.uint64) for x in t["sketch"]]
        width = np.array([len(x) for x in sk])
        out_a, out_b = [], []
        for w in np.unique(width):
            near = np.flatnonzero((width == w) | (width == 2 * w))
            stack = np.stack([folded(sk[k], w) for k in near])
            for x in np.flatnonzero(width == w):
                ok = (comp[near] != comp[x]) & (10 * np.minimum(n[near], n[x]) >= 8 * np.maximum(n[near], n[x]))
                ok &= (width[near] > w) | (rep[near] > rep[x])
                if i != j:
                    ok &= block[near] != block[x]
                k = np.flatnonzero(ok)
                if len(k):
                    apart = np.bitwise_count(stack[k] ^ folded(sk[x], w)).sum(axis=1)
                    for y in near[k[apart <= (n[near[k]] + n[x]) // 9]]:
                        out_a.append(min(rep[x], rep[y]))
                        out_b.append(max(rep[x], rep[y]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return spread.groupBy("fp", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`; see the module's docstring."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    buckets = bucket_count(docs)
    table, path = staged(described(docs, buckets), "jaccard-index")
    info = write_table(table.where("n is not null").select("doc_id", "n", "set_key", "sketch"), "jaccard-sets")
    index = table.where("n is null").select("bucket", "rows", "ids")
    known = info.where("doc_id is not null and n > 0")
    salted = known.select("doc_id", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    firsts = snapshot(salted.groupBy("set_key", "salt").agg(F.min("doc_id").alias("first")))
    reps = snapshot(firsts.groupBy("set_key").agg(F.min("first").alias("rep"), F.count("*").alias("salts")))
    near = salted.join(firsts, ["set_key", "salt"]).where("doc_id <> first").select("doc_id", F.col("first").alias("to"))
    far = firsts.join(reps.where("salts > 1"), "set_key").select(F.col("first").alias("doc_id"), "set_key", F.col("rep").alias("to"))
    nodes = snapshot(reps.join(known.select(F.col("doc_id").alias("rep"), F.col("set_key").alias("k"), "n", "sketch"), "rep").where("set_key = k").select("rep", "n", "sketch").dropDuplicates(["rep"]))
    # A document points to the first copy with its salt, that one to the first copy of all.
    copies = snapshot(near.unionByName(far.select("doc_id", "to")).where("doc_id <> to").select(F.col("doc_id").alias("a"), F.col("to").alias("b")).distinct())

    groups = snapshot(grouped(index, buckets))
    drop_staged(docs.sparkSession, path)
    release_shuffles(docs.sparkSession)
    step = copies.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("rep"))
    for _ in range(2):  # two steps lead to the first copy of all
        groups = groups.join(step, "doc_id", "left").select("fp", F.coalesce("rep", "doc_id").alias("doc_id"))
    groups = groups.withColumnRenamed("doc_id", "rep").distinct()
    leaders = groups.groupBy("fp").agg(F.min("rep").alias("a"))
    stars = groups.join(leaders, "fp").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    links = verified(snapshot(sketch_filtered(stars, nodes)), docs)

    labels = components(links)
    placed = groups.join(labels, F.col("rep") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("fp").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("fp")
    members = snapshot(placed.join(mixed, "fp", "left_semi"))
    across = snapshot(pairs_across(members.join(nodes, "rep").select("fp", "rep", "n", "sketch", "component")).join(stars.select("a", "b"), ["a", "b"], "left_anti"))
    if not across.isEmpty():
        links = snapshot(links.unionByName(verified(across, docs)).distinct())
    everything = components(links.unionByName(copies))
    release_shuffles(docs.sparkSession)
    return info.select("doc_id", "n").join(everything, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
