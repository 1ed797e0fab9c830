"""Upload plans, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from folioforge.plans import sync
from folioforge.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_actions(spark):
    mods = spark.createDataFrame([("p", i) for i in range(1, 5)], "parent_id string, module_no int")
    state = spark.createDataFrame([("p", 1, "a", True), ("p", 2, "b", False), ("q", 3, "c", True)], readers.STATE)
    assert [r["action"] for r in sync.push_actions(mods, state).orderBy("module_no").collect()] == ["skip", "redo", "create", "create"]
    assert [r["action"] for r in sync.push_actions(mods, state, force=True).orderBy("module_no").collect()] == ["redo", "redo", "create", "create"]
    assert [r["module_no"] for r in sync.pending(mods, state).orderBy("module_no").collect()] == [2, 3, 4]


def test_positions(spark):
    state = spark.createDataFrame([("p", 1, "a", True), ("p", 2, "b", True), ("p", 3, "c", True), ("p", 5, "e", False)], readers.STATE)
    children = spark.createDataFrame([("p", 0, "a"), ("p", 1, "z"), ("p", 2, "c")], "parent_id string, position int, block_id string")
    got = sync.page_positions(state.select("parent_id", "module_no", "page_id"), children, state)
    assert rows(got, "module_no") == [("p", 1, "page_start", None), ("p", 2, "after_block", "a"), ("p", 3, "after_block", "z"), ("p", 5, "after_block", "c")]


def test_registry(spark, tmp_path):
    old = spark.createDataFrame([("s", "1", "f", "h", "t0", "t0"), ("u", "2", "g", "h", "t0", "t0")], "slug string, page_id string, docx_file_name string, docx_hash string, created_at string, last_synced_at string")
    new = spark.createDataFrame([("s", "1", "f", "h2"), ("u", "2", "other", "h2"), ("v", "3", "x", "h3")], "slug string, page_id string, docx_file_name string, docx_hash string")
    merged, clashes = sync.upsert_courses(old, new, F.lit("t1"))
    assert rows(merged, "slug") == [("s", "1", "f", "h2", "t0", "t1"), ("u", "2", "g", "h", "t0", "t0"), ("v", "3", "x", "h3", "t1", "t1")]
    assert rows(clashes, "slug") == [("u", "g", "other")]
    dated = merged.withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).withColumn("last_synced_at", F.lit("2024-01-02").cast("timestamp"))
    sinks.write_json_texts(sinks.registry_json(dated), str(tmp_path / "r"))
    assert rows(readers.read_registry(spark, str(tmp_path / "r")), "slug") == rows(dated, "slug")


def test_state_round_trip(spark, tmp_path):
    assert readers.read_state(spark, str(tmp_path / "none")).count() == 0
    state = spark.createDataFrame([("p", 1, "a", True), ("p", 2, "b", False)], readers.STATE)
    done = spark.createDataFrame([("p", 2, "b2", True)], readers.STATE)
    new = sync.commit_state(state, done)
    sinks.write_json_texts(sinks.state_json(new), str(tmp_path / "s"))
    (tmp_path / "pretty.json").write_text('{\n "p": {"modules": {\n "4": {"pageId": "d", "done": true}}}\n}')
    assert rows(readers.read_state(spark, str(tmp_path / "pretty.json"), multiline=True), "module_no") == [("p", 4, "d", True)]
    assert rows(readers.read_state(spark, str(tmp_path / "s")), "module_no") == [("p", 1, "a", True), ("p", 2, "b2", True)]


def test_requests_and_batches(spark, tmp_path):
    b = spark.createDataFrame([("p", 1, i, None) for i in range(250)], "parent_id string, module_no int, block_no int, parent_no int")
    assert rows(sync.request_counts(b, ["parent_id", "module_no"]), "module_no")[0][2:5] == (250, 3, 2)
    acts = spark.createDataFrame([("p", 1, "old", "redo"), ("p", 2, None, "create"), ("p", 3, "x", "skip")], "parent_id string, module_no int, page_id string, action string")
    got = sync.push_requests(acts, b)
    assert rows(got.select("module_no", "seq", "method", "endpoint"), "module_no", "seq") == [(1, 0, "PATCH", "/pages/old"), (1, 1, "POST", "/pages"), (1, 2, "PATCH", "/blocks/{page}/children"), (1, 3, "PATCH", "/blocks/{page}/children"), (2, 1, "POST", "/pages")]
    assert sync.push_requests(acts, b, dry_run=True).count() == 0
    spark.dataSource.register(sinks.RequestLog)
    got.write.format("request_log").option("path", str(tmp_path / "log")).mode("append").save()
    assert spark.read.schema(got.schema).json(str(tmp_path / "log") + "/part-*.jsonl").count() == 5
    with pytest.raises(Exception, match="mounted folder"):
        got.write.format("request_log").option("path", "hdfs://store/log").mode("append").save()


def test_images(spark):
    b = spark.createDataFrame([(1, 0, "paragraph", "i1"), (1, 1, "paragraph", "i2"), (1, 2, "paragraph", None)], "doc_id int, block_no int, type string, token string")
    u = spark.createDataFrame([(1, "i1", "id1"), (1, "i2", None)], "doc_id int, token string, file_upload_id string")
    assert [r["type"] for r in sync.resolve_images(b, u, ["doc_id"]).orderBy("block_no").collect()] == ["image", "paragraph", "paragraph"]
    files = spark.createDataFrame([(1, "i1", "/m/i1", 5), (1, "i2", "/m/i2", 30 << 20)], "doc_id int, name string, path string, size long")
    refs = spark.createDataFrame([(1, "i1"), (1, "i2"), (1, "i3"), (1, "i1")], "doc_id int, token string")
    assert [r["status"] for r in sync.upload_plan(refs, files, ["doc_id"]).orderBy("token").collect()] == ["upload", "too_large", "missing"]


def test_retries(spark):
    r = spark.createDataFrame([(1, 0, 429, 3), (1, 1, 200, None), (1, 2, 500, None)] + [(2, i, 500, None) for i in range(6)] + [(3, 0, 404, None)], "call int, attempt int, status int, retry_after int")
    got = rows(sync.retry_schedule(r, ["call"]).select("call", "attempt", "wait_seconds", "outcome"), "call", "attempt")
    assert got == [(1, 0, 3.0, "retry"), (1, 1, 0.0, "done")] + [(2, i, 2.0**i, "retry") for i in range(5)] + [(2, 5, 0.0, "failed"), (3, 0, 0.0, "failed")]


def test_courses_and_runs(spark):
    c = spark.createDataFrame([("s", "T", "A", "P", None, 3, "f/x.docx", "2024-01-01", "pg")], "slug string, title string, area string, platform string, status string, modules int, source string, synced string, page_id string")
    body = sync.course_payload(c, "db").first()["body"]
    assert '"Estado":{"select":{"name":"Terminado"}}' in body and '"Módulos":{"number":3}' in body and "Notas" not in body
    assert sync.course_update(c).first()["endpoint"] == "/pages/pg"
    mods = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, module_no int")
    runs = spark.createDataFrame([(1, 1, None, True), (2, 1, 9, False), (3, 1, 2, True), (4, 7, None, False)], "run_id int, doc_id int, module_no int, force boolean")
    assert [r["run_id"] for r in sync.sync_problems(runs, mods).orderBy("run_id").collect()] == [1, 2, 4]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\n\nb", encoding="utf-8")
    assert readers.read_markdown(spark, str(tmp_path / "a")).first()["text"] == "# T\n\nb"
    got = readers.read_files(spark, str(tmp_path / "a")).first()
    assert got["name"] == "x.md" and got["size"] == 6 and len(got["hash"]) == 64
    assert readers.read_settings('A="1"\n#x\nB_2 = \'y\'\nbad line') == {"A": "1", "B_2": "y"}
    files = spark.createDataFrame([("p", bytearray(b"hi")), ("q", bytearray(b"\xff"))], "path string, content binary")
    got = readers.convert_documents(files, lambda b: b.decode()).orderBy("path").collect()
    assert got[0]["text"] == "hi" and got[1]["text"] is None and "Unicode" in got[1]["error"]


def test_all_events_reach_the_retry_schedule(spark, tmp_path, monkeypatch):
    """All events are in series of six, which end by the operator's own rule, not by a filter before it."""
    from folioforge import queries

    rows = [(u, 8 * i + u) for u in (0, 1, 3) for i in range(9)]
    spark.createDataFrame(rows, "user_id long, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    given, plain = [], sync.retry_schedule
    monkeypatch.setattr(sync, "retry_schedule", lambda e, keys: (given.append(e.count()), plain(e, keys))[1])
    got = sorted(tuple(r) for r in queries.k_retries(spark, str(tmp_path)).collect())
    assert given == [27]
    assert got == [(0, "exhausted", 1, 3.0), (0, "retry", 5 + 3, 8 * 3.0), (1, "failed", 1, 0.0), (1, "retry", 5 + 3, 31.0 + 7.0), (3, "done", 2, 0.0)]
