"""Sinks. What a run writes as a whole goes to a new version of its folder, so a run that is cut off changes nothing. Single files of
JSON or text are overwritten by a rerun; that deletes first, so a table that is being read goes to another path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.nesting import nest_blocks
from ..operators.render import manifest
from .versions import publish


def reports(rendered: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, value): one text per document, its report lines in order of module, each with its line end."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("module_no", "report"))), lambda r: F.concat(r["report"], F.lit("\n")))
    return rendered.groupBy(key).agg(F.array_join(lines, "").alias("value"))


def publish_run(rendered: DataFrame, generated: Column, path: str, key: str = "doc_id") -> int:
    """Modules, manifests and reports of one run as the next version of `path`: all three become current at once. The version's number."""
    return publish({"modules": rendered, "manifests": manifest(rendered, generated, key), "reports": reports(rendered, key)}, path)


def state_json(state: DataFrame) -> DataFrame:
    """(value): the state as one JSON text per parent, in the layout `read_state` takes."""
    modules = F.map_from_entries(F.collect_list(F.struct(F.col("module_no").cast("string"), F.struct(F.col("page_id").alias("pageId"), "done"))))
    by_parent = state.groupBy("parent_id").agg(F.struct(modules.alias("modules")).alias("entry"))
    return by_parent.select(F.to_json(F.map_from_arrays(F.array("parent_id"), F.array("entry"))).alias("value"))


def registry_json(registry: DataFrame) -> DataFrame:
    """(value): the registry as one JSON text per course."""
    entry = F.struct(F.col("page_id").alias("pageId"), F.col("docx_file_name").alias("docxFileName"), F.col("docx_hash").alias("docxHash"), F.col("created_at").alias("createdAt"), F.col("last_synced_at").alias("lastSyncedAt"))
    return registry.select(F.to_json(F.map_from_arrays(F.array("slug"), F.array(entry))).alias("value"))


def write_json_texts(values: DataFrame, path: str) -> None:
    values.select("value").write.mode("overwrite").text(path)


def write_blocks(blocks: DataFrame, keys: list[str], path: str) -> None:
    """One JSON line for each top-level block, its children inside it, with its keys and number."""
    nest_blocks(blocks, keys).write.mode("overwrite").json(path)


class RequestLog(DataSource):
    """A batch sink for request plans: each task writes its rows to a file in a shared folder, and a commit names them.

    Options: path, a folder that the driver and all executors have mounted. Nothing is sent; a sender reads the committed files in order at the rate the service allows.
    """

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return "parent_id string, module_no int, seq int, method string, endpoint string, batch_no int"

    def writer(self, schema, overwrite: bool):
        path = self.options["path"].removeprefix("file://")
        if "://" in path:
            raise ValueError(f"the request log takes a mounted folder, not {path}; write other stores with the requests' own DataFrame")
        return _RequestLogWriter(path)


class _RequestLogWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        import json
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.jsonl"
        with open(os.path.join(self.path, name), "w", encoding="utf-8") as f:
            for r in rows:
                f.write(json.dumps(r.asDict(), ensure_ascii=False) + "\n")
        return _Part(name)

    def commit(self, messages) -> None:
        import json
        import os

        with open(os.path.join(self.path, "_committed.json"), "w", encoding="utf-8") as f:
            json.dump(sorted(m.name for m in messages if m), f)

    def abort(self, messages) -> None:
        import os

        for m in messages:
            if m:
                os.remove(os.path.join(self.path, m.name))


class _Part(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name
