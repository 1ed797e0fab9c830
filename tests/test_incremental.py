"""Caches, versions, the state log, media and the resumable stream."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from folioforge.plans import state_log, sync
from folioforge.sources import media, readers, sinks, versions
from folioforge.streaming import incremental, jobs

KEYS = ["parent_id", "module_no"]


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect()) if not order else [tuple(r) for r in df.orderBy(*order).collect()]


def docs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "doc_id long, text string")


MD = "# Uno\n\nhola\n\nconst x = 1;\n"


def test_only_new_texts_are_structured(spark, tmp_path, monkeypatch):
    path, counted, plain = str(tmp_path / "cache"), [], incremental.structure
    monkeypatch.setattr(incremental, "structure", lambda d, key: (counted.append(d.count()), plain(d, key))[1])
    first = docs(spark, (1, MD), (2, MD + "fin\n"), (3, MD), (4, None), (5, ""))
    columns = ["doc_id", "module_no", "title", "file", "text", "report"]
    assert rows(incremental.structure_increment(first, path).select(columns)) == rows(plain(first).select(columns))
    assert counted == [3]  # copies once, the null text never
    incremental.structure_increment(first, path)
    assert counted == [3]
    second = docs(spark, (1, MD), (2, MD + "otro fin\n"), (9, MD + "\n# Dos\n"))
    assert rows(incremental.structure_increment(second, path).select(columns)) == rows(plain(second).select(columns))
    assert counted == [3, 2]
    incremental.sweep(second, path)
    assert rows(incremental.cached_modules(second, path).select(columns)) == rows(plain(second).select(columns))
    assert incremental.cached_modules(first, path).select("doc_id").distinct().count() == 2  # documents 1 and 3
    assert incremental.structure_increment(second, path, version=2).count() == 4 and counted == [3, 2, 3]
    assert incremental.structure_increment(first.limit(0), path).count() == 0


def test_a_cut_off_run_counts_for_nothing(spark, tmp_path):
    path, d = str(tmp_path / "cache"), docs(spark, (1, MD))
    incremental.structure_increment(d, path)
    shutil.rmtree(tmp_path / "cache" / "manifest")  # as if it had ended between its two writes
    assert incremental.cached_modules(d, path).count() == 0
    assert incremental.structure_increment(d, path).count() == 1


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.current_version(spark, path) is None and versions.read_version(spark, path, "t", "id long").count() == 0
    assert versions.publish({"t": spark.range(3)}, path) == 1
    spark.range(9).write.parquet(f"{path}/v=2/t")  # cut off before its marker
    assert versions.read_version(spark, path, "t", "id long").count() == 3
    assert versions.publish({"t": spark.range(5)}, path) == 2
    spark.range(1).write.parquet(f"{path}/v=7/t")
    versions.drop_versions(spark, path)
    assert versions.read_version(spark, path, "t", "id long").count() == 5 and versions.children(spark, path) == ["_committed", "v=2"]


def test_a_run_is_published_whole(spark, tmp_path):
    rendered = jobs.structure(docs(spark, (1, MD + "\n# Dos\n\n![](./media/image1.png)\n"), (2, MD)))
    assert sinks.publish_run(rendered, F.lit("2024-01-01"), str(tmp_path / "out")) == 1
    got = {n: spark.read.parquet(str(tmp_path / "out" / "v=1" / n)) for n in ("modules", "manifests", "reports")}
    manifest = {r["doc_id"]: r["modules"] for r in got["manifests"].collect()}
    assert [(m["number"], m["file"], m["images"]) for m in manifest[1]] == [(1, "modules/01-uno.md", []), (2, "modules/02-dos.md", ["image1.png"])]
    assert {r["doc_id"]: r["value"].count("\n") for r in got["reports"].collect()} == {1: 2, 2: 1} and got["modules"].count() == 3


def plain_state(log):
    state = {}
    for p, m, v, page, done in sorted(log, key=lambda t: (t[2], t[4], t[3] or "")):
        old = state.get((p, m), (None, False))
        state[p, m] = (page if page is not None else old[0], done)
    return sorted((p, m, *s) for (p, m), s in state.items())


def test_log_state(spark, tmp_path):
    """Any order of transitions, with compaction anywhere between them, gives the state of their versions."""
    rnd = random.Random(1)
    log = [(rnd.choice("pq"), rnd.randint(1, 5), v, f"page-{v}" if rnd.random() < 0.6 else None, rnd.random() < 0.4) for v in range(60)]
    rnd.shuffle(log)
    path = str(tmp_path / "log")
    assert state_log.read_log_state(spark, path).count() == 0
    for at in range(0, 60, 15):
        state_log.append_transitions(spark.createDataFrame(log[at : at + 15], state_log.TRANSITIONS), path)
        state_log.append_transitions(spark.createDataFrame(log[:3], state_log.TRANSITIONS), path)  # a repeated write changes nothing
        if at in (15, 30):
            assert state_log.compact(spark, path) == (1 if at == 15 else 2)
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted((tuple(r) for r in state_log.read_log_state(spark, path).collect()), key=key) == sorted(plain_state(log[: at + 15]), key=key)
    assert versions.children(spark, f"{path}/log") == ["generation=2"]


def test_a_push_resumes_after_any_write(spark, tmp_path):
    """The state after each of a push's writes says what is left to do."""
    mods = spark.createDataFrame([("p", 1), ("p", 2)], "parent_id string, module_no int")
    writes = [("p", 1, 0, "a", False), ("p", 1, 1, None, True), ("p", 2, 2, "b", False), ("p", 2, 3, None, True)]
    expected = [["create", "create"], ["redo", "create"], ["skip", "create"], ["skip", "redo"], ["skip", "skip"]]
    for cut in range(5):
        path = str(tmp_path / str(cut))
        for w in writes[:cut]:
            state_log.append_transitions(spark.createDataFrame([w], state_log.TRANSITIONS), path)
        if cut == 3:  # cut off inside a compaction: the snapshot is written, its marker isn't
            state_log.fold(state_log.read_transitions(spark, path)).limit(1).write.parquet(f"{path}/v=1/state")
        state = state_log.read_log_state(spark, path)
        assert [r["action"] for r in sync.push_actions(mods, state).orderBy("module_no").collect()] == expected[cut]


def test_media(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.png", b"x"), (1, "b.png", b"x"), (1, "c.png", b"y"), (2, "a.png", b"x"), (2, "z.png", None)], "doc_id int, name string, content binary")
    path = str(tmp_path / "media")
    assert media.store_media(files, path).count() == 2 and media.store_media(files, path).count() == 2
    assert media.store_media(files.limit(0), path).count() == 2
    refs = spark.createDataFrame([(1, 0, "a.png"), (1, 1, "b.png"), (1, 2, "c.png"), (1, 3, "a.png"), (1, 4, "q.png"), (2, 0, "z.png"), (2, 1, "a.png"), (2, 2, None)], "doc_id int, ref_no int, token string")
    got = media.resolve_media(refs, files, ["doc_id"]).orderBy("doc_id", "ref_no").collect()
    assert [(r["status"], r["first_ref"]) for r in got] == [("stored", 0), ("repeated", 0), ("stored", 2), ("repeated", 0), ("missing", None), ("missing", None), ("stored", 1)]


def test_stream_of_pushes_resumes(spark, tmp_path):
    """Batches that are run again, with all or half of what they wrote still there, plan the same requests."""
    source, schema = tmp_path / "in", "doc_id long, parent_id string, text string"
    files = spark.createDataFrame([("p", 1, "image1.png", 5)], "parent_id string, module_no int, name string, size long")
    batches = [[(1, "p", "# Uno\n\n![](./media/image1.png)\n\nhola\n")], [(1, "p", "# Uno\n\nhola\n\n# Dos\n\n" + "linea\n\n" * 120), (2, "q", MD)], [(2, "q", MD)]]

    def run(out, upto):
        for i in range(upto):
            spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("overwrite").parquet(str(source / str(i)))
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
            jobs.push_stream(stream, str(out), str(out) + "-checkpoint", files).awaitTermination()
        columns = ["parent_id", "module_no", "seq", "kind", "method", "endpoint", "batch_no", "token"]
        return {i: rows(spark.read.parquet(f"{out}/requests/batch={i}").select(columns), "parent_id", "module_no", "seq") for i in range(upto)}

    plain = run(tmp_path / "plain", 3)
    assert [(r[3], r[7]) for r in plain[0]] == [("reserve", "image1.png"), ("send", "image1.png"), ("page", None)]
    assert [(r[0], r[1], r[3]) for r in plain[1]] == [("p", 2, "page"), ("p", 2, "append"), ("q", 1, "page")] and plain[2] == []
    shutil.rmtree(source)
    run(tmp_path / "cut", 2)
    # The last batch was written but not noted as done; the stream runs it again.
    (tmp_path / "cut-checkpoint" / "commits" / "1").unlink()
    crc = tmp_path / "cut-checkpoint" / "commits" / ".1.crc"
    crc.unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "cut" / "requests" / "batch=1")
    spark.createDataFrame(batches[2], schema).coalesce(1).write.parquet(str(source / "2"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    jobs.push_stream(stream, str(tmp_path / "cut"), str(tmp_path / "cut-checkpoint"), files).awaitTermination()
    columns = ["parent_id", "module_no", "seq", "kind", "method", "endpoint", "batch_no", "token"]
    for i in range(3):
        assert rows(spark.read.parquet(f"{tmp_path}/cut/requests/batch={i}").select(columns), "parent_id", "module_no", "seq") == plain[i]


def test_registry_takes_the_last_entry(spark):
    none = spark.createDataFrame([], "slug string, page_id string, docx_file_name string, docx_hash string, created_at string, last_synced_at string")
    new = spark.createDataFrame([("s", "1", "f", "h9", 1), ("s", "1", "f", "h2", 2), ("t", "2", "g", "h", 1)], "slug string, page_id string, docx_file_name string, docx_hash string, no int")
    merged, clashes = sync.upsert_courses(none, new, F.lit("t1"), order="no")
    assert [(r["slug"], r["docx_hash"]) for r in merged.orderBy("slug").collect()] == [("s", "h2"), ("t", "h")] and clashes.count() == 0
    with pytest.raises(Exception):  # noqa: B017  the column must exist
        sync.upsert_courses(none, new, F.lit("t1"), order="nope")
    assert readers.STATE.startswith("parent_id")


def test_converters(spark):
    files = spark.createDataFrame([("a", b"# hola"), ("b", None), ("c", b"x" * 9)], "path string, content binary")
    told = lambda convert, most=8: [(r["path"], r["text"], r["problem"]) for r in readers.convert_documents(files, convert, most).orderBy("path").collect()]
    assert told(readers.command_converter(["cat"])) == [("a", "# hola", None), ("b", None, "no content"), ("c", None, "too long")]
    assert [p for _, _, p in told(readers.command_converter(["no-such-program-here"]))] == ["no converter", "no content", "no converter"]
    assert [p for _, _, p in told(readers.command_converter(["sh", "-c", "echo bad >&2; exit 3"]))] == ["status 3", "no content", "status 3"]
    assert [p for _, _, p in told(lambda content: 1 / 0)] == ["failed", "no content", "failed"]
    said = readers.convert_documents(files, readers.command_converter(["sh", "-c", "echo bad >&2; exit 3"])).where("path = 'a'").first()
    assert said["error"] == "bad\n"
