"""Upload planning: which modules to push, where their pages go, and the requests in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import mime_type, number_from_file, title_from_file
from ..operators.blocks import batches


def push_actions(modules: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Modules (parent_id, module_no, ...) with page_id, done and action: skip, redo (a page is there) or create."""
    s = state.select("parent_id", "module_no", "page_id", "done")
    x = modules.join(s, ["parent_id", "module_no"], "left")
    done = F.coalesce(F.col("done"), F.lit(False))
    action = F.when(done & F.lit(not force), "skip").when(F.coalesce(F.col("page_id"), F.lit("")) != "", "redo").otherwise("create")
    return x.withColumn("action", action)


def pending(modules: DataFrame, state: DataFrame) -> DataFrame:
    """Modules that no finished push covers; an anti join, so finished ones cost nothing later."""
    return modules.join(state.where("done").select("parent_id", "module_no"), ["parent_id", "module_no"], "left_anti")


def page_positions(redone: DataFrame, children: DataFrame, state: DataFrame) -> DataFrame:
    """(parent_id, module_no, position, after_id) for modules whose page is made again.

    After the old page's predecessor; at the start if it was first. If it is gone, after the page of the nearest lower
    module that is still there; else at the start. `children`: parent_id, position, block_id.
    """
    w = Window.partitionBy("parent_id").orderBy("position")
    first = children.groupBy("parent_id", "block_id").agg(F.min("position").alias("position"))
    ordered = children.withColumn("before_id", F.lag("block_id").over(w)).join(first, ["parent_id", "block_id", "position"])
    here = redone.join(ordered.select("parent_id", F.col("block_id").alias("page_id"), F.col("position").alias("child_at"), "before_id"), ["parent_id", "page_id"], "left")
    alive = state.where("module_no >= 1 and page_id <> ''").join(children.select("parent_id", F.col("block_id").alias("page_id")).distinct(), ["parent_id", "page_id"], "left_semi")
    # An as-of lookup: the pages that are there and the modules that ask go by module number in one window.
    marks = alive.select("parent_id", "module_no", F.col("page_id").alias("live"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("long").alias("child_at"), F.lit(None).cast("string").alias("before_id"))
    asks = here.select("parent_id", "module_no", F.lit(None).cast("string").alias("live"), F.lit(1).alias("asks"), "page_id", F.col("child_at").cast("long").alias("child_at"), "before_id")
    lower = Window.partitionBy("parent_id").orderBy("module_no").rangeBetween(Window.unboundedPreceding, -1)
    x = marks.unionByName(asks).withColumn("nearest", F.last("live", ignorenulls=True).over(lower)).where("asks = 1")
    after = F.when(F.col("child_at").isNotNull(), F.col("before_id")).otherwise(F.col("nearest"))
    return x.select("parent_id", "module_no", F.when(after.isNull(), "page_start").otherwise("after_block").alias("position"), after.alias("after_id"))


def resolve_images(blocks: DataFrame, uploads: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of marker mode with uploaded images in place of their markers; a marker without an upload stays text.

    `uploads`: keys, token, file_upload_id. Whether it is broadcast is left to Spark's size limit.
    """
    u = uploads.where("file_upload_id is not null").select(*keys, "token", "file_upload_id").dropDuplicates([*keys, "token"])
    x = blocks.join(u, [*keys, "token"], "left")
    uploaded = F.col("file_upload_id").isNotNull()
    x = x.withColumn("type", F.when(uploaded, "image").otherwise(F.col("type")))
    if "rich_text" in blocks.columns:
        x = x.withColumn("rich_text", F.when(~uploaded, F.col("rich_text")))
    return x.select(*[c for c in blocks.columns], "file_upload_id")


def upload_plan(images: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, path, content_type, status) for each distinct image: upload, missing or too_large."""
    x = images.select(*keys, "token").distinct().join(files.select(*keys, F.col("name").alias("token"), "path", "size"), [*keys, "token"], "left")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("size") > P.MAX_UPLOAD, "too_large").otherwise("upload")
    return x.select(*keys, "token", "path", mime_type(F.col("token")).alias("content_type"), status.alias("status"))


def request_counts(blocks: DataFrame, keys: list[str], size: int = P.MAX_BLOCKS) -> DataFrame:
    """(keys, n_top, n_batches, n_appends, least_seconds): one request makes the page, the others append."""
    b = batches(blocks, keys, size).groupBy(*keys).agg(F.sum(F.col("parent_no").isNull().cast("int")).alias("n_top"), (F.max("batch_no") + 1).alias("n_batches"))
    return b.select(*keys, "n_top", "n_batches", (F.col("n_batches") - 1).alias("n_appends"), (F.col("n_batches") * F.lit(P.MIN_INTERVAL_MS) / 1000.0).alias("least_seconds"))


def push_requests(actions: DataFrame, blocks: DataFrame, positions: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """(parent_id, module_no, seq, method, endpoint, batch_no): the requests of every module that isn't skipped, in order."""
    keys = ["parent_id", "module_no"]
    todo = actions.where("action <> 'skip'")
    if dry_run:
        todo = todo.where(F.lit(False))
    trash = todo.where("action = 'redo'").select(*keys, F.lit(0).alias("seq"), F.lit("PATCH").alias("method"), F.concat(F.lit("/pages/"), "page_id").alias("endpoint"), F.lit(None).cast("int").alias("batch_no"))
    n = batches(blocks, keys).groupBy(*keys).agg((F.max("batch_no") + 1).alias("n"))
    pages = todo.join(n, keys, "left").select(*keys, F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)))).alias("batch_no"))
    make = pages.select(*keys, (F.col("batch_no") + 1).alias("seq"), F.when(F.col("batch_no") == 0, "POST").otherwise("PATCH").alias("method"), F.when(F.col("batch_no") == 0, "/pages").otherwise("/blocks/{page}/children").alias("endpoint"), "batch_no")
    return trash.unionByName(make)


def retry_schedule(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `wait_seconds` and `outcome` to responses (keys, attempt from 0, status, retry_after).

    429 waits as told (1 s if not told) and uses an attempt; 5xx waits 1, 2, 4, 8, 16 s, and the sixth fails; other
    statuses end at once.
    """
    attempt, status = F.col("attempt"), F.col("status")
    wait = F.when(status == 429, F.coalesce(F.col("retry_after").cast("double"), F.lit(1.0))).when((status >= 500) & (attempt < P.MAX_RETRIES), F.pow(F.lit(2.0), attempt)).otherwise(F.lit(0.0))
    outcome = (
        F.when(status == 429, F.when(attempt < P.MAX_RETRIES, "retry").otherwise("exhausted"))
        .when((status >= 500) & (attempt < P.MAX_RETRIES), "retry")
        .when((status >= 200) & (status < 300), "done")
        .otherwise("failed")
    )
    w = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    x = responses.withColumn("wait_seconds", wait).withColumn("outcome", outcome)
    ended = F.coalesce(F.max((F.col("outcome") != "retry").cast("int")).over(w), F.lit(0)) == 1
    return x.withColumn("ended", ended).where(~F.col("ended")).drop("ended")


def upsert_courses(registry: DataFrame, entries: DataFrame, now: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new registry, collisions): entries by slug update or join the registry and keep created_at; a slug whose file name
    differs is a collision and changes nothing. Columns: slug, page_id, docx_file_name, docx_hash, created_at, last_synced_at.

    Of entries with one slug the last by `order` counts, or without it the greatest by file name, hash and page. Slugs are unique in a registry.
    """
    rank = F.struct(*([order] if order else []), "docx_file_name", "docx_hash", "page_id")
    entries = entries.groupBy("slug").agg(F.max_by(F.struct("page_id", "docx_file_name", "docx_hash"), rank).alias("e")).select("slug", "e.*")
    old = registry.select("slug", *[F.col(c).alias(f"old_{c}") for c in registry.columns if c != "slug"])
    x = entries.join(old, "slug", "full_outer")
    clash = F.coalesce((F.col("old_docx_file_name") != F.col("docx_file_name")), F.lit(False))
    fresh = F.col("page_id").isNotNull() & ~clash
    pick = lambda c: F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    merged = x.select("slug", pick("page_id"), pick("docx_file_name"), pick("docx_hash"), F.when(fresh, F.coalesce("old_created_at", now)).otherwise(F.col("old_created_at")).alias("created_at"), F.when(fresh, now).otherwise(F.col("old_last_synced_at")).alias("last_synced_at"))
    collisions = x.where(clash).select("slug", F.col("old_docx_file_name").alias("registered"), F.col("docx_file_name").alias("offered"))
    return merged, collisions


def commit_state(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The state with pushed modules (parent_id, module_no, page_id, done) in place of their old rows."""
    kept = state.join(outcomes.select("parent_id", "module_no"), ["parent_id", "module_no"], "left_anti")
    return kept.select("parent_id", "module_no", "page_id", "done").unionByName(outcomes.select("parent_id", "module_no", "page_id", "done"))


def course_payload(courses: DataFrame, database_id: str) -> DataFrame:
    """(slug, method, endpoint, body): the request that makes a course's row. Columns: slug, title, area, platform, status, modules, source, synced."""
    text = lambda c: F.array(F.struct(F.lit("text").alias("type"), F.struct(F.col(c).alias("content")).alias("text")))
    choice = lambda c: F.struct(F.struct(c.alias("name")).alias("select"))
    values = (
        F.struct(text("title").alias("title")),
        choice(F.col("area")),
        choice(F.col("platform")),
        choice(F.coalesce("status", F.lit(P.DEFAULT_STATUS))),
        F.struct(F.col("modules").alias("number")),
        F.struct(text("source").alias("rich_text")),
        F.struct(F.struct(F.col("synced").alias("start")).alias("date")),
    )
    properties = F.struct(*[v.alias(n) for v, n in zip(values, P.COURSE_PROPERTIES)])
    body = F.to_json(F.struct(F.struct(F.lit(database_id).alias("database_id")).alias("parent"), properties.alias("properties")))
    return courses.select("slug", F.lit("POST").alias("method"), F.lit("/pages").alias("endpoint"), body.alias("body"))


def course_update(courses: DataFrame) -> DataFrame:
    """(slug, method, endpoint, body): the request that notes a sync; two properties change."""
    properties = F.struct(F.struct(F.col("modules").alias("number")).alias(P.COURSE_PROPERTIES[4]), F.struct(F.struct(F.col("synced").alias("start")).alias("date")).alias(P.COURSE_PROPERTIES[6]))
    return courses.select("slug", F.lit("PATCH").alias("method"), F.concat(F.lit("/pages/"), "page_id").alias("endpoint"), F.to_json(F.struct(properties.alias("properties"))).alias("body"))


def module_titles(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(stem, module_no, title): the manifest's title for a file's number, or one made from the file's name."""
    x = files.select("stem", number_from_file(F.col("stem")).alias("module_no"), title_from_file(F.col("stem")).alias("from_file"))
    return x.join(modules.select("module_no", "title"), "module_no", "left").select("stem", "module_no", F.coalesce("title", "from_file").alias("title"))


def sync_problems(runs: DataFrame, modules: DataFrame) -> DataFrame:
    """(run_id, problem): runs that may not start. `runs`: run_id, doc_id, module_no, force."""
    n = modules.groupBy("doc_id").agg(F.max("module_no").alias("most"))
    hit = modules.select("doc_id", "module_no", F.lit(True).alias("hit")).distinct()
    x = runs.join(n, "doc_id", "left").join(hit, ["doc_id", "module_no"], "left")
    problem = (
        F.when(F.col("force") & F.col("module_no").isNull(), "force needs a module")
        .when(F.col("most").isNull(), "no such document")
        .when(F.col("module_no").isNotNull() & F.col("hit").isNull(), F.concat(F.lit("no such module; 1 to "), F.col("most").cast("string")))
    )
    return x.select("run_id", problem.alias("problem")).where("problem is not null")
