"""Runs: which courses and modules a run pushes, what stops it before it starts, and what it uploads. Plans only; nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import course_title, plain_id
from .sync import push_actions, sync_problems

#: An upload that no page takes in within this time is gone.
ATTACH_SECONDS = 3600


def plan_sync(runs: DataFrame, modules: DataFrame, state: DataFrame) -> DataFrame:
    """(run_id, parent_id, doc_id, module_no, action, problem): what each run (run_id, doc_id, parent_id, module_no or null, force,
    dry_run) does with its document's modules, in order of module_no; a run that may not start has one row with its problem.

    A run without a module takes all; `force` makes a finished module again and needs a module. A finished module is skipped on a dry run
    too; the others are only told.
    """
    problems = sync_problems(runs, modules)
    good = runs.join(problems.select("run_id"), "run_id", "left_anti")
    wanted = good.select("run_id", "doc_id", "parent_id", "force", "dry_run", F.col("module_no").alias("only")).join(modules.select("doc_id", "module_no"), "doc_id")
    wanted = wanted.where(F.col("only").isNull() | (F.col("only") == F.col("module_no")))
    planned = push_actions(wanted, state)
    finished = (F.col("action") == "skip") & ~F.col("force")
    action = F.when(finished, "skip").when(F.col("dry_run"), "dry_run").when(F.col("action") == "skip", "redo").otherwise(F.col("action"))
    done = planned.select("run_id", "parent_id", "doc_id", F.col("module_no").cast("long").alias("module_no"), action.alias("action"), F.lit(None).cast("string").alias("problem"))
    stopped = runs.join(problems, "run_id").select("run_id", "parent_id", "doc_id", F.lit(None).cast("long").alias("module_no"), F.lit(None).cast("string").alias("action"), "problem")
    return done.unionByName(stopped)


def plan_courses(courses: DataFrame, registry: DataFrame, database_id: Column) -> DataFrame:
    """(slug, action, status, problem) of courses (slug, docx_file_name, area, platform, status): a registered one is updated after its
    push; a new one is created, and saved in the registry, before it. A new one needs area, platform and a database.

    A slug that another file has is refused before the push. Without that the push would run and its last step fail."""
    known = registry.select("slug", F.col("docx_file_name").alias("registered"))
    x = courses.join(known, "slug", "left")
    new = F.col("registered").isNull()
    problem = (
        F.when(~new & (F.col("registered") != F.col("docx_file_name")), "slug taken by another file")
        .when(new & (F.coalesce("area", F.lit("")) == ""), "area missing")
        .when(new & (F.coalesce("platform", F.lit("")) == ""), "platform missing")
        .when(new & (F.coalesce(database_id, F.lit("")) == ""), "database missing")
    )
    action = F.when(problem.isNull(), F.when(new, "create").otherwise("update"))
    return x.select("slug", action.alias("action"), F.coalesce("status", F.lit(P.DEFAULT_STATUS)).alias("status"), problem.alias("problem"))


def course_steps(courses: DataFrame, registry: DataFrame, database_id: Column) -> DataFrame:
    """(slug, step_no, step, title, status): what a run does for each course (slug, path, docx_file_name, area, platform, status, title,
    dry_run), in order; courses with a problem have no step.

    A new course is created, saved in the registry, pushed and updated; a registered one is pushed, saved and updated. A dry run pushes a
    registered course dry and shows a new one; neither is created, saved or updated. A step is taken only if the one before it went well.
    The title is the given one, or made from the file's name, or its folder's where that says nothing.
    """
    planned = plan_courses(courses, registry, database_id).where("problem is null")
    x = courses.select("slug", course_title(F.col("path"), F.col("title")).alias("title"), F.coalesce("dry_run", F.lit(False)).alias("dry")).join(planned, "slug")
    names = lambda *steps: F.array(*map(F.lit, steps))
    new = F.col("action") == "create"
    steps = F.when(new & F.col("dry"), names("show")).when(F.col("dry"), names("push dry")).when(new, names("create", "save", "push", "update")).otherwise(names("push", "save", "update"))
    return x.select("slug", F.posexplode(steps).alias("step_no", "step"), "title", "status")


def upload_requests(plan: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, seq, method, endpoint, content_type, attach_seconds): the two requests of each image that is uploaded: one
    reserves the upload, one sends the bytes; the block that takes it in has to follow within attach_seconds."""
    steps = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("/file_uploads").alias("endpoint"), F.lit(None).cast("int").alias("attach")),
        F.struct(F.lit(1).alias("seq"), F.lit("/file_uploads/{upload}/send").alias("endpoint"), F.lit(ATTACH_SECONDS).alias("attach")),
    )
    x = plan.where("status = 'upload'").withColumn("s", F.explode(steps))
    return x.select(*keys, "token", "s.seq", F.lit("POST").alias("method"), "s.endpoint", "content_type", F.col("s.attach").alias("attach_seconds"))


def children_of(listings: DataFrame) -> DataFrame:
    """(parent_id, position, block_id) from listings (parent_id, results array<struct<id>>): one page each, ids in order."""
    return listings.select("parent_id", F.posexplode("results").alias("position", "r")).select("parent_id", "position", F.col("r.id").alias("block_id"))


def parent_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title) of pages (id, properties array<struct<name,type,title array<struct<plain_text>>>>): the first part of the first property of
    type title, or a fixed text without one."""
    first = F.get(F.filter("properties", lambda p: p["type"] == "title"), F.lit(0))
    return pages.select(plain_id(F.col("id")).alias("page_id"), F.coalesce(F.get(first["title"], F.lit(0))["plain_text"], F.lit(P.NO_TITLE)).alias("title"))
