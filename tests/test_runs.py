"""Runs, uploads, listings, staged tables, and that every registered query can be written."""

import pytest
from pyspark.sql import functions as F

from folioforge.plans import course
from folioforge.sources import staging

SF = "/root/testdata/sf0.001"


def test_plan_sync(spark):
    modules = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "doc_id long, module_no int")
    state = spark.createDataFrame([("p", 1, "page-1", True), ("p", 2, "page-2", False)], "parent_id string, module_no int, page_id string, done boolean")
    runs = [(1, 1, "p", None, False, False), (2, 1, "p", None, True, False), (3, 1, "p", 1, True, False), (4, 1, "p", 9, False, False), (5, 8, "p", None, False, False), (6, 1, "p", 1, False, True), (7, 1, "p", None, False, True), (8, 1, "p", 1, True, True)]
    got = course.plan_sync(spark.createDataFrame(runs, "run_id int, doc_id long, parent_id string, module_no int, force boolean, dry_run boolean"), modules, state).orderBy("run_id", "module_no").collect()
    assert [(r["run_id"], r["module_no"], r["action"], r["problem"]) for r in got] == [
        (1, 1, "skip", None), (1, 2, "redo", None), (1, 3, "create", None), (2, None, None, "force needs a module"), (3, 1, "redo", None),
        (4, None, None, "no such module; 1 to 3"), (5, None, None, "no such document"), (6, 1, "skip", None),
        (7, 1, "skip", None), (7, 2, "dry_run", None), (7, 3, "dry_run", None), (8, 1, "dry_run", None),
    ]


def test_plan_courses(spark):
    rows = [("a", "f", "Web", "Libre", None), ("b", "f", None, "Libre", "x"), ("c", "f", "Web", "", None), ("d", "g", None, None, None), ("e", "f", None, None, None)]
    courses = spark.createDataFrame(rows, "slug string, docx_file_name string, area string, platform string, status string")
    registry = spark.createDataFrame([("d", "f"), ("e", "f")], "slug string, docx_file_name string")
    got = course.plan_courses(courses, registry, F.lit("db")).orderBy("slug").collect()
    assert [(r["action"], r["status"], r["problem"]) for r in got] == [("create", "Terminado", None), (None, "x", "area missing"), (None, "Terminado", "platform missing"), (None, "Terminado", "slug taken by another file"), ("update", "Terminado", None)]
    assert course.plan_courses(courses, registry, F.lit(None).cast("string")).where("problem = 'database missing'").count() == 1


def test_uploads_listings_and_titles(spark):
    plan = spark.createDataFrame([(1, "image1.png", "media/image1.png", "image/png", "upload"), (1, "image2.png", None, "image/png", "missing")], "doc_id int, token string, path string, content_type string, status string")
    got = course.upload_requests(plan, ["doc_id"]).orderBy("seq").collect()
    assert [(r["token"], r["endpoint"], r["attach_seconds"]) for r in got] == [("image1.png", "/file_uploads", None), ("image1.png", "/file_uploads/{upload}/send", 3600)]
    listing = spark.createDataFrame([("p", [("b",), ("a",)]), ("q", [])], "parent_id string, results array<struct<id:string>>")
    assert [tuple(r) for r in course.children_of(listing).collect()] == [("p", 0, "b"), ("p", 1, "a")]
    pages = [("ab-cd", [("x", "number", []), ("y", "title", [("Ho",), ("la",)]), ("z", "title", [("no",)])]), ("e", [])]
    titles = course.parent_titles(spark.createDataFrame(pages, "id string, properties array<struct<name:string,type:string,title:array<struct<plain_text:string>>>>"))
    assert [tuple(r) for r in titles.collect()] == [("abcd", "Ho"), ("e", "(sin título)")]


def test_staged_tables(spark):
    df, path = staging.staged(spark.range(10), "ten")
    assert df.count() == 10
    staging.drop_staged(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
    assert staging.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(10).repartition(64)
    assert staging.spread(many) is many


def test_structuring_queries_can_be_written(spark, tmp_path):
    """No query has two columns of one name, or a type that Parquet doesn't take."""
    from folioforge.queries import QUERIES

    for name, query in QUERIES.items():
        columns = [c.lower() for c in query(spark, SF).columns]
        assert len(set(columns)) == len(columns), name
    QUERIES["r_modules"](spark, SF).write.parquet(str(tmp_path / "r_modules"))
    assert spark.read.parquet(str(tmp_path / "r_modules")).count() > 0


def walk_options(tokens):
    """Token by token, as a loop with an index reads them."""
    from folioforge.plans.options import SWITCHES, VALUES

    out, rest, i = {c: None for c in VALUES.values()} | {c: False for c in SWITCHES.values()}, [], 0
    while i < len(tokens):
        if tokens[i] in SWITCHES:
            out[SWITCHES[tokens[i]]] = True
        elif tokens[i] in VALUES:
            i += 1
            out[VALUES[tokens[i - 1]]] = tokens[i] if i < len(tokens) else None
        else:
            rest.append(tokens[i])
        i += 1
    return out | {"docx_path": rest[0] if rest else None, "module": rest[1] if len(rest) > 1 else None, "problem": None if rest and rest[0] else "usage"}


def test_options(spark):
    import random

    from folioforge.plans import options

    rnd = random.Random(3)
    lines = [[rnd.choice(["--dry-run", "--force", "--area", "--area", "--titulo", "--estado", "--plataforma", "a.docx", "3", ""]) for _ in range(rnd.randint(1, 9))] for _ in range(300)]
    lines += [["--area", "--area", "--force", "x"], ["x", "--titulo"], ["--titulo", "a", "x", "--titulo"]]
    df = spark.createDataFrame([(i, k, t) for i, line in enumerate(lines) for k, t in enumerate(line)], "run_id int, pos int, token string")
    got = {r["run_id"]: r.asDict() for r in options.parse_options(df).collect()}
    for i, line in enumerate(lines):
        assert got[i] == walk_options(line) | {"run_id": i}, line
    two = options.parse_options(df, positionals=("docx_path", "parent_id", "module"), needed=2, values={})
    assert "area" not in two.columns and two.where("parent_id is null and problem is null").count() == 0
    assert options.parse_options(df.limit(0)).count() == 0
    line = ["a.md", "--modulo", "3", "--odd", "--parent", "--force", "--media", "m"]
    push = options.parse_options(spark.createDataFrame([(1, k, t) for k, t in enumerate(line)], "run_id int, pos int, token string"), positionals=("path",), values=options.PUSH_VALUES)
    assert push.first().asDict() == {"run_id": 1, "path": "a.md", "module": "3", "media": "m", "parent_id": "--force", "dry_run": False, "force": False, "problem": None}


def test_titles_of_part_numbers_over_five_digits(spark, tmp_path):
    """A number is matched whole, though the stem shows five digits of it."""
    from folioforge import queries

    rows = [(7, "big ring", "B#1", 3), (10000, "hot bolt", "B#2", 4), (100003, "red nut", "B#3", 5), (100004, None, "B#4", 1), (100006, "old pin", "B#5", 2)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.k_titles(spark, str(tmp_path)).orderBy("module_no").collect()
    assert [tuple(r) for r in got] == [
        ("00007-big-ring", 7, "Big ring"), ("10000-hot-bolt", 10000, "Módulo B#2"), ("10000-red-nut", 100003, "Red nut"),
        ("10000-modulo", 100004, "Modulo"), ("10000-old-pin", 100006, "Módulo B#5"),
    ]
