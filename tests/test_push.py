"""Nested blocks, the order of a push's requests, and the time uploads wait, against plain walks."""

import json
import random

import pytest

from folioforge.functions import patterns as P
from folioforge.operators import blocks, nesting
from folioforge.plans import push

KEYS = ["parent_id", "module_no"]


def as_json(spark, *texts, **options):
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "parent_id string, module_no int, text string")
    found = {}
    for r in nesting.nest_blocks(blocks.to_blocks(df, KEYS, **options), KEYS, markers=options.get("image_mode") == "marker").orderBy("module_no", "block_no").collect():
        found.setdefault(r["module_no"], []).append(json.loads(r["json"]))
    return [found.get(i, []) for i in range(len(texts))]


def item(text, *children, kind="bulleted_list_item"):
    own = {"rich_text": [{"type": "text", "text": {"content": text}}]} | ({"children": list(children)} if children else {})
    return {"object": "block", "type": kind, kind: own}


def test_nested_lists(spark):
    number = lambda *a: item(*a, kind="numbered_list_item")
    got = as_json(spark, "- padre 1\n    - hijo 1.1\n    - hijo 1.2\n- padre 2", "1.  padre 1\n    1.  hijo 1.1\n    2.  hijo 1.2\n2.  padre 2", "- a\n            - b\n    - c\n        - d\n1. e\n    - f", "")
    assert got[0] == [item("padre 1", item("hijo 1.1"), item("hijo 1.2")), item("padre 2")]
    assert got[1] == [number("padre 1", number("hijo 1.1"), number("hijo 1.2")), number("padre 2")]
    assert got[2] == [item("a", item("b"), item("c", item("d"))), number("e"), item("f")]
    assert got[3] == []


def test_objects_of_every_type(spark):
    text = '# T\n\n## Dos **n**\n![](image1.png)\n```js\nlet a = "x";\n```\ntexto "q" \\* [a](https://b.c)'
    callout, marker = as_json(spark, text), as_json(spark, text, image_mode="marker")
    assert callout[0][0] == {"object": "block", "type": "heading_2", "heading_2": {"rich_text": [{"type": "text", "text": {"content": "Dos "}}, {"type": "text", "text": {"content": "n"}, "annotations": {"bold": True}}], "is_toggleable": False}}
    run = {"type": "text", "text": {"content": "![](image1.png)"}, "annotations": {"code": True}}
    assert callout[0][1] == {"object": "block", "type": "callout", "callout": {"icon": {"type": "emoji", "emoji": P.ICON}, "color": P.ICON_COLOR, "rich_text": [run]}}
    assert marker[0][1] == {"object": "block", "type": "paragraph", "paragraph": {"rich_text": [run]}, "_marker": "image1.png"}
    assert callout[0][2]["code"]["rich_text"] == [{"type": "text", "text": {"content": 'let a = "x";'}}] and list(callout[0][2]["code"]) == ["language", "rich_text"]
    assert callout[0][3]["paragraph"]["rich_text"][-1] == {"type": "text", "text": {"content": "a", "link": {"url": "https://b.c"}}}


def test_blocks_are_written_nested(spark, tmp_path):
    from folioforge.sources import sinks

    df = spark.createDataFrame([("p", 1, "- a\n    - b\nc")], "parent_id string, module_no int, text string")
    sinks.write_blocks(blocks.to_blocks(df, KEYS), KEYS, str(tmp_path / "b"))
    got = spark.read.json(str(tmp_path / "b")).orderBy("block_no").collect()
    assert json.loads(got[0]["json"]) == item("a", item("b")) and len(got) == 2


def test_deep_trees(spark):
    """Any depth, against a stack."""
    rnd = random.Random(3)
    for deep in (4, 60):
        depths = [rnd.randint(0, deep) for _ in range(300)]
        df = spark.createDataFrame([("p", i, d, f't"{i}') for i, d in enumerate(depths)], "parent_id string, no long, depth long, text string")
        got = [json.loads(r["json"]) for r in nesting.nested_lists(blocks.effective_depth(df, ["parent_id"], "no"), ["parent_id"], "no").orderBy("block_no").collect()]
        roots, stack = [], []
        for i, d in enumerate(depths):
            del stack[d:]
            own = item(f't"{i}')
            if stack:
                stack[-1]["bulleted_list_item"].setdefault("children", []).append(own)
            else:
                roots.append(own)
            stack.append(own)
        assert got == roots


def test_batches_of_bodies(spark):
    df = spark.createDataFrame([("p", i, 1 if i % 3 == 1 else 0) for i in range(10)], "parent_id string, no long, level long").selectExpr("*", "cast(no as string) as text")
    got = nesting.batch_bodies(nesting.nested_lists(df, ["parent_id"], "no"), ["parent_id"], 3).orderBy("batch_no").collect()
    assert [(r["batch_no"], r["n_blocks"]) for r in got] == [(0, 3), (1, 3), (2, 1)]
    assert [b["bulleted_list_item"]["rich_text"][0]["text"]["content"] for r in got for b in json.loads(r["children"])] == ["0", "2", "3", "5", "6", "8", "9"]


# ---- the sequence ----------------------------------------------------------------------------------


def tables(spark, seed=1):
    """Modules with 0 to 320 blocks, every 40th an image or so; some files are missing, one module has one that is too large."""
    rnd = random.Random(seed)
    acts, rows, files = [], [], []
    for p in "abc":
        for m in range(1, 9):
            action = rnd.choice(["skip", "redo", "create"])
            acts.append((p, m, f"old-{m}" if action != "create" else None, action))
            for i in range(rnd.choice([0, 1, 99, 100, 101, 320])):
                token = f"image{rnd.randint(1, 6)}.png" if rnd.random() < 0.03 else None
                rows.append((p, m, i, None if i % 7 else None, token))
            files += [(p, m, f"image{k}.png", 30 << 20 if (p, m, k) == ("b", 3, 2) else 1) for k in (1, 2, 3, 5)]
    acts[acts.index(next(a for a in acts if a[:2] == ("b", 3)))] = ("b", 3, None, "create")
    rows.append(("b", 3, 1000, None, "image2.png"))
    make = spark.createDataFrame
    return (make(acts, "parent_id string, module_no int, page_id string, action string"), make(rows, "parent_id string, module_no int, block_no int, parent_no int, token string"), make(files, "parent_id string, module_no int, name string, size long"), acts, rows, files)


def walked(acts, rows, files):
    """Module by module, as the requests would be sent."""
    size = {(p, m, n): s for p, m, n, s in files}
    run, out = 0, []
    for p in "abc":
        at = 0
        for _, m, page, action in sorted(a for a in acts if a[0] == p):
            own = sorted(r for r in rows if r[:2] == (p, m))
            tokens = [r[4] for r in own if r[4]]
            if action == "skip" or any(size.get((p, m, t), 0) > P.MAX_UPLOAD for t in tokens):
                continue
            steps = [("GET", f"/blocks/{p}/children"), ("PATCH", f"/pages/{page}")] if action == "redo" else []
            for t in tokens:
                if (p, m, t) in size:
                    steps += [("POST", "/file_uploads"), ("POST", "/file_uploads/{upload}/send")]
            steps += [("POST", "/pages")] + [("PATCH", "/blocks/{page}/children")] * (max(1, -(-len(own) // 100)) - 1)
            for k, s in enumerate(steps):
                out.append((p, m, k, at, run, *s))
                at, run = at + 1, run + 1
    return out


def test_push_sequence(spark):
    a, b, f, acts, rows, files = tables(spark)
    images = push.image_steps(b, f)
    got = push.push_sequence(a, b, images)
    have = [tuple(r) for r in got.orderBy("run_seq").select("parent_id", "module_no", "seq", "parent_seq", "run_seq", "method", "endpoint").collect()]
    assert have == walked(acts, rows, files)
    counts = push.module_counts(a, b, images)
    assert [(r["parent_id"], r["module_no"]) for r in counts.where("problem is not null").collect()] == [("b", 3)]
    per = {(r["parent_id"], r["module_no"]): r for r in counts.collect()}
    for key, r in per.items():  # two requests an image, one for a batch, two for an old page
        assert r["n_requests"] == (0 if r["problem"] else 2 * r["n_uploads"] + r["n_batches"] + (2 if r["action"] == "redo" else 0)), key
    assert push.push_sequence(a, b, images, dry_run=True).count() == 0
    assert push.push_sequence(a.limit(0), b, images).count() == 0
    at = spark.createDataFrame([("a", m, "after_block", "x") for m in range(1, 9)], "parent_id string, module_no int, position string, after_id string")
    placed = push.push_sequence(a, b, images, at).where("position is not null")
    assert {r["kind"] for r in placed.collect()} == {"page"} and {r["parent_id"] for r in placed.collect()} == {"a"}


@pytest.mark.parametrize("seconds", [2, 5, 12, 3600])
def test_attach_windows(spark, seconds):
    _, b, f, _, _, _ = tables(spark, 2)
    images = push.image_steps(b, f)
    counts = blocks.batches(b, KEYS).groupBy(*KEYS).agg({"batch_no": "max"}).selectExpr(*KEYS, "`max(batch_no)` + 1 as n_batches")
    got = push.attach_windows(images, counts, attach_seconds=seconds).collect()
    up = [r for r in images.collect() if r["status"] == "upload"]
    assert len(got) == len(up) > 20
    for key in {(r["parent_id"], r["module_no"]) for r in got}:
        own = sorted((r for r in got if (r["parent_id"], r["module_no"]) == key), key=lambda r: r["ref_no"])
        n = next(r["n_batches"] for r in counts.collect() if (r["parent_id"], r["module_no"]) == key)
        flat = [("s", r["ref_no"], k) for r in own for k in (0, 1)] + [("b", k) for k in range(n)]
        group_of = {r["batch_no"]: r["group_no"] for r in own}
        assert all(x <= y for x, y in zip([r["group_no"] for r in own], [r["group_no"] for r in own][1:]))
        fits = seconds * 1000 // P.MIN_INTERVAL_MS
        for r in own:
            assert r["wait_ms"] == 340 * (flat.index(("b", r["batch_no"])) - flat.index(("s", r["ref_no"], 1))) and r["late"] == (r["wait_ms"] > 1000 * seconds)
            dearest = max(1 + 2 * sum(x["batch_no"] == k for x in own) for k in group_of)
            if dearest < fits:
                assert not r["grouped_late"]
            assert r["grouped_wait_ms"] <= r["wait_ms"]


# ---- rows that stand for many blocks ---------------------------------------------------------------


def test_rows_that_stand_for_many_blocks(spark):
    """The same requests and waits, whether the blocks of a run are rows or a number."""
    rnd = random.Random(4)
    runs = [(p, m, k, None if rnd.random() < 0.8 or k == 0 else k - 1, f"image{rnd.randint(1, 30)}" if rnd.random() < 0.4 else None, rnd.choice([1, 2, 40, 99, 100, 101, 260])) for p in "ab" for m in (1, 2, 3) for k in range(25)]
    rows = [(p, m, 1000 * k + i, parent, token if i == 0 else None) for p, m, k, parent, token, n in runs for i in range(n if parent is None else 1)]
    make, own = spark.createDataFrame, "parent_id string, module_no int, block_no int, parent_no int, token string"
    short, long = make(runs, own + ", n_blocks int"), make(rows, own)
    acts = make([(p, m, "x", "redo") for p in "ab" for m in (1, 2, 3)], "parent_id string, module_no int, page_id string, action string")
    names = [f"image{k}" for k in range(1, 25)]
    shared = make([(n, 1) for n in names], "name string, size long")
    each = make([(p, m, n, 1) for p in "ab" for m in (1, 2, 3) for n in names], "parent_id string, module_no int, name string, size long")
    a, b = push.image_steps(short, shared), push.image_steps(long, each)
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows_of(a) == rows_of(b) and a.where("status = 'missing'").count()
    assert rows_of(push.push_sequence(acts, short, a)) == rows_of(push.push_sequence(acts, long, b))
    counts = blocks.batches(long, KEYS).groupBy(*KEYS).agg({"batch_no": "max"}).selectExpr(*KEYS, "`max(batch_no)` + 1 as n_batches")
    for seconds in (2, 8, 20, 90):
        assert rows_of(push.attach_windows(a, attach_seconds=seconds)) == rows_of(push.attach_windows(b, counts, attach_seconds=seconds))


@pytest.mark.parametrize("seconds", [2, 3, 5, 8, 12])
def test_groups_over_batches_without_images(spark, seconds):
    """A group may start with batches that take no image in; its waits count from there. Against a walk over all batches."""
    rnd = random.Random(seconds)
    images = [("p", m, k, f"t{k}", b, "upload") for m in (1, 2, 3, 4) for k, b in enumerate(sorted(rnd.choices(range(60), k=14)))]
    got = push.attach_windows(spark.createDataFrame(images, "parent_id string, module_no int, ref_no int, token string, batch_no int, status string"), attach_seconds=seconds).collect()
    assert len(got) == len(images)
    fits = seconds * 1000 // P.MIN_INTERVAL_MS
    for m in (1, 2, 3, 4):
        own = [x for x in images if x[1] == m]
        per = [sum(x[4] == b for x in own) for b in range(60)]
        room, spent, groups = max(1, fits - (2 * max(per) + 1)), 0, {}
        for b in range(60):
            spent += 1 + 2 * per[b]
            groups.setdefault((spent - 1) // room, []).append(b)
        sent = []
        for g in groups.values():
            sent += [("s", x[2], k) for x in own if x[4] in g for k in (0, 1)] + [("b", b) for b in g]
        group_of = {b: g for g, bs in groups.items() for b in bs}
        for r in (r for r in got if r["module_no"] == m):
            assert r["group_no"] == group_of[r["batch_no"]] and r["grouped_wait_ms"] == 340 * (sent.index(("b", r["batch_no"])) - sent.index(("s", r["ref_no"], 1)))
