"""Periodic runs, importance resampling and source mixing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioforge.llm import importance, mixing, periods, queries

SHA = lambda b: hashlib.sha256(b).hexdigest()


# ---- periodic runs ---------------------------------------------------------------------------------


def plain_runs(w, power, least):
    """Every period, one after the other."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, power * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_words(rnd, letters):
    w = []
    for _ in range(rnd.randint(0, 12)):
        block = [rnd.randrange(letters) for _ in range(rnd.randint(1, 6))]
        if w and rnd.random() < 0.3:
            block = w[rnd.randrange(len(w)) :][: rnd.randint(1, 40)]
        w += block * rnd.randint(1, 7)
    return w


def test_every_run_is_found():
    rnd = random.Random(7)
    for _ in range(4000):
        w, power, least = plain_words(rnd, rnd.choice([1, 2, 3, 6])), rnd.choice([2, 3, 4, 4, 5]), rnd.choice([2, 6, 6, 9])
        runs = periods.word_runs(w, power, least)
        assert runs == plain_runs(w, power, least), (w, power, least)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert periods.collapse(w, runs) == [x for i, x in enumerate(w) if i not in gone]


def test_factors_are_the_longest_earlier_stretches():
    rnd = random.Random(8)
    for _ in range(300):
        x = [rnd.randrange(3) for _ in range(rnd.randint(0, 60))]
        factors = periods.factorise(x)
        ends = [f[0] for f in factors[1:]] + [len(x)]
        for (b, earlier), end in zip(factors, ends):
            longest = max((next((k for k in range(len(x) - b) if x[j + k] != x[b + k]), len(x) - b) for j in range(b)), default=0)
            assert end - b == max(longest, 1) and (earlier < 0) == (longest == 0)
            assert earlier < 0 or (earlier < b and x[earlier : earlier + end - b] == x[b:end])


def test_long_runs_take_linear_time():
    rnd = random.Random(9)
    w = [rnd.randrange(20_000) for _ in range(30_000)] * 5
    assert periods.word_runs(["a"] * 300_000) == [(0, 300_000, 1)] and periods.word_runs(w) == [(0, 150_000, 30_000)]


def test_periodic_runs_odd_rows(spark):
    texts = ["", None, "  \t\n", "a " * 6, "a\x85b " * 5, "a b " * 3 + "a", "é ü\n" * 4 + "é", "x" * 100_000, "w1 w2 w3 " * 50_000, "a\xa0a " * 6, "A a " * 3]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "b " * 7, "c", 1), (3, "a " * 6, "c", 1)], "doc_id long, text string, runs string, start long")
    got = {r["doc_id"]: r for r in periods.periodic_runs(df).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        if len(w) < 10_000:
            assert [tuple(r) for r in got[i]["runs"]] == plain_runs(w, 4, 6) and got[i]["n_words"] == len(w), t
    assert [tuple(r) for r in got[8]["runs"]] == [(0, 150_000, 3)] and got[8]["collapsed"] == "w1 w2 w3" and got[3]["collapsed"] == "a" and got[1]["collapsed"] == ""
    rows = periods.run_digests(periods.periodic_runs(df))
    by_id = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(texts) + 2 and by_id[0]["start"] is None and by_id[0]["runs_sha256"] == by_id[0]["collapsed_sha256"] == SHA(b"")
    assert (by_id[None]["length"], by_id[None]["exponent_milli"]) == (7, 7000) and by_id[8]["runs_sha256"] == SHA(b"0,150000,3\n")
    assert periods.run_digests(periods.periodic_runs(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(df, power=1)


def test_longest_run_breaks_ties(spark):
    runs = [[(5, 8, 2), (0, 8, 1), (0, 8, 2)], [(9, 7, 1), (1, 9, 2)], []]
    df = spark.createDataFrame([(i, [dict(zip(("start", "length", "period"), r)) for r in x]) for i, x in enumerate(runs)], f"i int, runs {periods.RUNS}")
    got = [r["b"] for r in df.select("i", periods.longest_run(F.col("runs")).alias("b")).orderBy("i").collect()]
    assert [tuple(b) if b else None for b in got] == [(0, 8, 1), (1, 9, 2), None]


def plain_periodic(doc_id, text):
    words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 4, 6)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], SHA("".join("%d,%d,%d\n" % r for r in runs).encode()), SHA(kept.encode()))


def test_periodic_query(spark, tmp_path):
    rnd = random.Random(10)
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:150] + list(range(100))
    texts = {i: " ".join(rnd.choice(["uno", "dos", "tres", "　x", "q"] + [str(j) for j in range(k)]) for _ in range(rnd.choice([0, 1, 5, 40, 300]))) for k, i in enumerate(ids)}
    texts[ids[0]], texts[ids[1]] = None, " \n "
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {i: plain_periodic(i, t) for i, t in texts.items()} and sum(r[0] > 0 for r in got.values()) > 20


# ---- importance resampling -------------------------------------------------------------------------


def plain_resample(docs, target, percent, least, seed, buckets, longest):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    features = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    words = [fold(t) for _, t in docs]
    held = [features(w) for w in words]
    s, t = Counter(x for f in held for x in f), Counter(x for x_ in target for x in features(fold(x_)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for (doc_id, _), w, f in zip(docs, words, held):
        weight, h = sum(gain[b] for b in f), int(SHA(f"{seed}:{'' if doc_id is None else doc_id}".encode())[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize(("percent", "longest", "buckets"), [(10, 1, 10_000), (35, 3, 50), (100, 2, 7), (0, 1, 10)])
def test_resampling(spark, percent, longest, buckets):
    rnd = random.Random(percent)
    vocabulary = ["Apfel", "birne", "ÄÖ", "x1", "le", "ciel", "Zebra9", "　", "été"] + [f"w{i}" for i in range(40)]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 3, 19, 20, 21, 60]))) for i in range(300)] + [(None, text(30)), (7, docs7 := text(25)), (7, docs7), (500, None), (501, ""), (502, text(6000))]
    target = [text(10) for _ in range(30)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, bucket string")
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest, buckets=buckets)
    assert sorted((tuple(r) for r in got.collect()), key=KEY) == sorted(plain_resample(docs, target, percent, 20, 2024, buckets, longest), key=KEY)


def test_resampling_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance.resample(none, one).count() == 0
    assert [tuple(r)[1] for r in importance.resample(one, none, percent=100).collect()] == [30] and importance.resample(one, none, percent=100).first()["rank"] == 1


def test_pieces_and_offsets(spark):
    text = ("Wort eins zwei, DREI-vier " * 50).encode()
    table = importance.BucketTable(97)
    whole = [x for _, found in importance.feature_buckets(text, table, 3) for x in found.tolist()]
    size, importance.PIECE = importance.PIECE, 16
    try:
        importance.word_pieces.__defaults__ = (16,)
        parted = [x for _, found in importance.feature_buckets(text, table, 3) for x in found.tolist()]
    finally:
        importance.PIECE = size
        importance.word_pieces.__defaults__ = (size,)
    assert Counter(whole) == Counter(parted)
    rnd = random.Random(3)
    scores = [rnd.choice([-5, 7, 65_536, -65_537, 10**9, rnd.randrange(-300_000, 300_000)]) for _ in range(2000)]
    offsets = {r["score"]: r["above"] for r in importance.rank_offsets(spark.createDataFrame([(x,) for x in scores], "score long"), 700).collect()}
    assert offsets == {x: n for x in set(scores) if (n := sum(y > x for y in scores)) < 700}


# ---- mixing ----------------------------------------------------------------------------------------


def plain_targets(sizes, weights, most):
    """Rounds of sharing what is above a limit, by hand; sizes by source in order."""
    total, target = sum(sizes), [0.0] * len(sizes)
    full = set()
    while True:
        left, open_ = total - sum(most * sizes[i] for i in full), sum(weights[i % len(weights)] for i in range(len(sizes)) if i not in full)
        target = [most * s if i in full else left * weights[i % len(weights)] / open_ for i, s in enumerate(sizes)]
        more = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i]}
        if not more:
            return target
        full |= more


def mixed(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, source string, text string, size int, bucket string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400, 3)] + [(1, None, 0), (None, 1, 0), (2, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    return mixing.mix_sources(df, labels, **options)


def test_mix(spark):
    rnd = random.Random(4)
    text = lambda: None if rnd.random() < 0.05 else " \x85\n".join("w" for _ in range(rnd.choice([0, 1, 5, 30, 200])))
    names = ["src1", "src10", "src2", "ä", "\U0001f600", "", None, "tiny", "hot"]
    rows = [(i, "hot" if i % 3 == 0 else rnd.choice(names[:-2]), text()) for i in range(900)] + [(1000, "tiny", "a b"), (1001, "void", None), (None, "hot", "q w e"), (3, "hot", "r"), (3, "hot", "r")]
    got = mixed(spark, rows, bucket_rows=20).collect()
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, s, t in rows if s == name) for name in sources]
    want = dict(zip(sources, plain_targets(sizes, (1, 2, 3), 3)))
    assert len(got) == len(rows)
    for name, size in zip(sources, sizes):
        own = [r for r in got if r["source"] == name]
        assert {r["source_size"] for r in own} == {size} and all(abs(r["target"] - want[name]) < 1e-6 for r in own)
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 1e-9)
        parted = [r for r in own if r["size"] and r["taken"] % r["size"]]
        assert len(parted) <= 1 and all(r["epochs"] * r["size"] <= r["taken"] <= min(3, r["epochs"] + 1) * r["size"] for r in own)
    assert want["tiny"] == 6 and sum(want.values()) == pytest.approx(sum(sizes))
    # neither the buckets nor the order of rows bear on the result
    again = mixed(spark, rows[::-1], bucket_rows=20_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality_bears_on_the_sample(spark):
    rows = [(i, "a" if i < 6000 else "b", "w") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12_000)], "doc_id long, quality int")
    taken = {r["q"]: r["n"] for r in mixing.mix_sources(df, labels, weights=(1, 3)).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("q")).agg(F.sum("taken").alias("n")).collect()}
    assert taken[0] + taken[1] == 3000 and taken[1] > 2 * taken[0]


def test_many_sources_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, f"s{i % 7}" if i % 5 else None, "w " * (i % 11)) for i in range(400)]
    sent = sorted(map(str, mixed(spark, rows).collect()))
    monkeypatch.setattr(mixing, "SENT_SOURCES", 3)
    assert sorted(map(str, mixed(spark, rows).collect())) == sent


def test_mix_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert [r["taken"] for r in mixed(spark, [(1, "a", None), (2, None, " ")]).collect()] == [0, 0]
