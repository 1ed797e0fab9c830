"""Jaccard join, embedding near-duplicates, top-k, components and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import embeddings, jaccard
from folioforge.llm.common import components

pytest.importorskip("xxhash")


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(200, 201 + i) for i in range(50)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)]
    df = spark.createDataFrame([*links, (5, 5), (None, 7), (2, 1), (0, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == classes(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).count() == 0


# ---- n-gram Jaccard --------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def near_texts(rnd):
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(4))
    texts = ["", None, "One two", "one TWO", "one\ttwo\nthree", "a b c d e", "A b c d e", "É b c d e", "é b c d e", "\xa0x y"]
    for size in (6, 9, 12, 20, 45, 80, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rnd.randint(0, max(1, size // 40))):
                    k = rnd.randrange(len(copy))
                    op = rnd.random()
                    if op < 0.5:
                        copy[k] = word()
                    elif op < 0.75:
                        copy[k:k] = [word()] * rnd.randint(1, 3)
                    else:
                        del copy[k : k + rnd.randint(1, 3)]
                if rnd.random() < 0.3:
                    copy += [word() for _ in range(rnd.randint(0, size // 4))]
                texts.append(" ".join(copy))
    return texts + texts[12:18]


def test_signatures_miss_no_linked_pair():
    rng = np.random.default_rng(0)
    checked = 0
    for _ in range(1500):
        n = int(np.exp(rng.uniform(np.log(4), np.log(500))))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone, most = int(rng.integers(0, n // 5 + 1)), 0
        while 100 * (n - gone) >= 80 * (n + most + 1):
            most += 1
        b = np.unique(np.r_[rng.permutation(a)[: n - gone], rng.integers(0, 2**63, most, dtype=np.uint64)])
        if 100 * (n - gone) < 80 * (n + most) or len(b) < 4 or np.array_equal(a, b):
            continue
        checked += 1
        assert set(jaccard.signatures([a])[0].tolist()) & set(jaccard.signatures([b])[0].tolist()), (n, gone, most)
        assert jaccard.may_link(len(a), len(b), jaccard.sketch(a), jaccard.sketch(b))
    assert checked > 1000


def test_one_deletion_segments_miss_no_linked_pair(monkeypatch):
    """The allowance of 1 gives the same guarantee where the cost model would choose it."""

    def halves(band):
        most = 2 * jaccard.band_edges()[1][band] // 9
        return most % 3, (most - most % 3) // 2 + 1

    monkeypatch.setattr(jaccard, "allocation", halves)
    test_signatures_miss_no_linked_pair()


def test_jaccard(spark):
    texts = near_texts(random.Random(2))
    df = spark.createDataFrame([(i, t, 0, b"") for i, t in enumerate(texts)], "doc_id long, text string, n int, sketch binary").repartition(5)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(df).collect()}
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = classes(range(len(texts)), links)
    assert len(links) > 200
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_jaccard_of_many_copies_in_parts(spark, monkeypatch):
    """One set in many documents and a leader with many pairs, dealt in small parts."""
    monkeypatch.setattr(jaccard, "SALTS", 5)
    monkeypatch.setattr(jaccard, "LEADER_PAIRS", 3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 40 + [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(30)] + ["x y z u v w"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: 0 for i in range(70)} | {70: 70}


def test_jaccard_compares_across_components_in_blocks(spark, monkeypatch):
    """Chains whose ends don't link, all in common groups, with blocks of two."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    texts, now = [], list(base)
    for i in range(14):
        texts.append(" ".join(now))
        now = list(now)
        now[i * 8 + 3] = f"new{i}"
    rnd.shuffle(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == classes(range(len(texts)), links)


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (3, "q"), (3, "r"), (4, "r")]
    got = sorted((tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 1, 3), (3, 1, 3), (4, 1, 3)], key=str)
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- vectors ---------------------------------------------------------------------------------------


def vector_rows(n=400, dim=16):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        x = rng.standard_normal(dim)
        if i % 3 == 0 and rows:
            x = np.array(rows[rng.integers(0, len(rows))][1]) + rng.standard_normal(dim) * 0.12
        if i % 20 == 1:
            x = np.array(rows[0][1]) if rows else x
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 2)))
    odd = [None, [], [0.0] * dim, [None] * dim, [float("nan")] * dim, [float("inf")] * dim]
    return rows + [(n + i, v, 0) for i, v in enumerate(odd)] + [(n + 10, rows[0][1], None)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_plan_keeps_recall_and_grows_slowly():
    made = [embeddings.plan(n) for n in (0, 1, 400, 50_000, 10**6, 10**9)]
    assert all(embeddings.recall_bound(embeddings.COSINE, *x) >= embeddings.RECALL for x in made)
    assert made == sorted(made) and made[-1][0] < 1000
    # Strangers in a bucket: cosine 0, the mean over the projections.
    assert all(n * embeddings.same_cell(0.0) ** p <= embeddings.STRANGERS for n, p in ((50_000, made[3][1]), (10**6, made[4][1])))


def test_near_vectors(spark):
    rows = vector_rows()
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", raw string")).collect()}
    ok = [(i, np.array(v, dtype=float), c) for i, v, c in rows if c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i, x, c in ok for j, y, d in ok if j < i and c == d and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(rows) and len(links) > 100
    assert all(got[i]["n_links"] <= k for i, k in n.items()) and found >= 0.97 * 2 * len(links)
    want = classes([i for i, _, _ in rows], links)
    assert sum(got[i]["component_id"] == c for i, c in want.items()) >= 0.97 * len(rows)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_vectors_in_blocks(spark, monkeypatch):
    whole = {r["vec_id"]: tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(vector_rows(), SCHEMA)).collect()}
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    assert {r["vec_id"]: tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(vector_rows(), SCHEMA)).collect()} == whole


def test_small_and_large_groups_find_the_same_links(monkeypatch):
    """Groups compared by distance of rows, and as matrices: the same counts, and the same vectors connected."""
    import pyarrow as pa

    rng = np.random.default_rng(10)
    base = rng.standard_normal((9, 8))
    x = (base[rng.integers(0, 9, 60)] + 0.15 * rng.standard_normal((60, 8))).astype(np.float32)
    group = np.sort(rng.integers(0, 9, 60))
    crossed, block = group % 2, rng.integers(0, 2, 60)
    block = np.where(crossed == 1, block, 0)
    order = np.zeros(60, dtype=np.int64)
    codes = rng.integers(0, 3, (60, 4)).astype(np.int32)
    columns = {"label": order, "t": group % 4, "code": group, "i": order, "j": crossed, "block": block, "rep": np.arange(60), "key": order, "copies": rng.integers(1, 4, 60)}
    rows = pa.table({**{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "raw": [b"f" + v.tobytes() for v in x], "codes": [c.tobytes() for c in codes]})
    starts = embeddings.group_starts(rows, ["label", "t", "code", "i", "j"])
    seen = []
    for small in (12, 0):
        monkeypatch.setattr(embeddings, "SMALL_GROUP", small)
        a, _, b, n = embeddings.links_within(rows, starts, 0.93, 4)
        b = b.to_pylist()
        counts = {}
        for p, q, k in zip(a.tolist(), b, n.tolist()):
            counts[p] = counts.get(p, 0) + k
        seen.append(({p: k for p, k in counts.items() if k}, classes(range(60), [(p, q) for p, q in zip(a.tolist(), b) if q is not None])))
    assert seen[0] == seen[1] and len(seen[0][0]) > 20


@pytest.mark.parametrize("block", [8192, 50])
def test_top_k(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in embeddings.top_k(df, df.where("vec_id % 20 = 0"), 20, 64, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.floor(64 * np.array(v, dtype=float))) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    for q, x in ok:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:20]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got


@pytest.mark.parametrize("spread", [[1.0] * 3, [2.0**-i for i in range(16)]])
def test_bound_ends_walks(spread):
    """Vectors whose scores few dimensions carry: the bound ends the walks, and the results are those of a full scan."""
    rng = np.random.default_rng(7)
    x, ids = np.floor(64 * rng.standard_normal((8000, len(spread))) * np.array(spread)), rng.permutation(8000)
    lists = embeddings.SortedLists(ids, x)
    for i in range(0, 8000, 500):
        want = sorted((-int(x[i] @ y), int(j)) for j, y in zip(ids, x) if j != ids[i])[:20]
        assert lists.top(int(ids[i]), x[i], 20) == [(-s, j) for s, j in want]
    assert lists.stops >= 12 and lists.scored < 0.6 * 16 * 8000


def test_walk_reads_only_what_it_shows():
    """The rows scored, and the list entries read, are those down to the depth where the walk stopped."""
    rng = np.random.default_rng(8)
    x = np.floor(64 * rng.standard_normal((3000, 2)))
    lists = embeddings.SortedLists(np.arange(3000), x)
    q = np.array([100.0, -1.0])
    assert lists.top(-1, q, 5)[0][0] == int((x @ q).max())
    assert lists.stops == 1 and lists.touched in {64 << i for i in range(6)} and lists.scored <= lists.touched
    one = embeddings.SortedLists(np.arange(3000), x)
    one.top(-1, np.array([100.0, 0.0]), 5)
    assert one.touched == 64  # a dimension that the query doesn't weigh is not walked


def test_bound_saves_time():
    """Where the bound stops walks, they take less time than a scan of all rows that sorts what it found, and read few entries."""
    import time

    rng = np.random.default_rng(9)
    x = np.floor(4096 * rng.standard_normal((60_000, 8)) * 0.3 ** np.arange(8))
    lists, queries = embeddings.SortedLists(np.arange(60_000), x), x[:100]
    start = time.perf_counter()
    got = [lists.top(-1, q, 20) for q in queries]
    walked, start = time.perf_counter() - start, time.perf_counter()
    want = []
    for q in queries:
        s = x @ q
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        want.append([(int(s[i]), int(i)) for i in best])
    scanned = time.perf_counter() - start
    assert got == want
    assert lists.stops >= 90 and lists.touched < 0.05 * 100 * x.size and walked < scanned / 2


def test_vector_tables_may_be_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddings.top_k(none, none).count() == 0 and embeddings.near_duplicates(none).count() == 0


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (4, [-1.0, 0.0], 0)]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)}


def test_top_k_small_and_large(spark):
    rows = [(0, [1e20, -3e18], 0), (1, [5e19, 1.0], 0), (20, [0.0, 0.0], 0), (21, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").where("vec_id > 1")
    got = sorted(tuple(r) for r in embeddings.top_k(df, df.where("vec_id % 20 = 0")).collect())
    assert got == []
    df = spark.createDataFrame([(0, [2.0**40, 1.0], 0), (1, [2.0**40 + 1 / 64, -1.0], 0), (2, [2.0**40, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    lists = embeddings.SortedLists(np.array([1, 2]), np.floor(64 * np.array([[2.0**40 + 1 / 64, -1.0], [2.0**40, 2.0]])))
    q = np.floor(64 * np.array([2.0**40, 1.0]))
    assert lists.top(0, q, 1) == [((64 * 2**40) * (64 * 2**40 + 1) - 64 * 64, 1)]


# ---- pipeline --------------------------------------------------------------------------------------


def test_near_copies_keep_other_texts_of_an_id(spark):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "q"), (3, "r"), (3, "r"), (5, None), (5, None), (None, "z"), (None, "z")]
    got = sorted((tuple(r) for r in pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (3, "q"), (3, "r"), (5, None), (None, "z"), (None, "z")], key=str)


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + ". "
    clean = ["".join(sentence() for _ in range(8)) for _ in range(60)]
    toxic = ["".join([*(sentence() for _ in range(4)), f"You {rnd.choice(['scumlo', 'nitwit'])} thing. ", *(sentence() for _ in range(3))]) for _ in range(30)]
    near = [c.replace(c.split()[10], "changed") for c in clean[:5]]
    passage = "".join(sentence() for _ in range(5))
    shared = [sentence() * 1 + passage + "".join(sentence() for _ in range(9)) for _ in range(3)]
    private = ["Write to someone@mail.example now. " + "".join(sentence() for _ in range(6))]
    texts = clean + toxic + near + clean[:2] + shared + private
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(len(clean) <= i < len(clean) + len(toxic))) for i in range(len(clean) + len(toxic))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert sorted(out.columns) == sorted(d.columns) and dict(out.dtypes) == dict(d.dtypes)
        out.write.parquet(str(tmp_path / name))
        d = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r["text"] for r in d.collect()})
    assert set(kept[0]) == set(range(len(texts))) - set(range(60, 90))
    assert set(kept[1]) == set(kept[0]) - set(range(90, 97))
    assert passage.strip() in kept[2][97] and passage.strip() not in kept[2][98] and all(kept[2][i] == clean[i] for i in range(60))
    assert "[EMAIL]" in kept[3][100] and "@" not in kept[3][100]
    packed = pipeline.run(spark, str(tmp_path)).groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    assert all(r["n"] == 4096 for r in packed[:-1]) and packed[-1]["n"] <= 4096
