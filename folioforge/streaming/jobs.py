"""Documents that arrive as a stream are structured by micro-batch with the batch operators.

A document is structured on its own, so a micro-batch needs no state beyond which documents were done; writes go by
batch id, so a batch that is run again overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segments
from ..operators.blocks import to_blocks
from ..operators.context import settle_kinds
from ..operators.modules import inner_units, modules_of, place_units
from ..operators.render import render_modules
from ..operators.units import tokenize
from ..plans.push import KEYS, image_steps, module_counts, push_sequence
from ..plans.state_log import TRANSITIONS, replay
from ..plans.sync import push_actions
from ..sources.staging import staged
from ..sources.versions import children


def settled_units(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents to units with their modules and final kinds, the headings that open modules included."""
    return settle_kinds(place_units(tokenize(docs, key), key), key)


def structure(docs: DataFrame, key: str = "doc_id", block_size: int | None = None) -> DataFrame:
    """Documents to rendered modules. The settled units are staged: rendering reads them several times, the documents once.

    With `block_size` documents are taken in blocks of so many lines, then units, for documents that are longer than a task.
    """
    settled = settled_units(docs, key) if block_size is None else segments.settled_units(docs, key, block_size)
    units, _ = staged(settled, "settled-units")
    return render_modules(modules_of(units, key), inner_units(units), key)


def push_stream(docs: DataFrame, path: str, checkpoint: str, files: DataFrame, key: str = "doc_id", parent: str = "parent_id"):
    """Starts the query that structures arriving documents (key, parent, text) and plans the pushes of their modules.

    `path`/requests/batch=N holds a batch's requests in order, `path`/log/batch=N what they do to the state. A batch sees the state
    of the batches before it, so one that is run again, whatever it had written, plans the same requests; a module that arrives again is
    skipped once it is done. A batch's modules are planned to their end, and their pages go by the batch's number until they are
    made. `files`: parent_id, module_no, name, size.
    """

    def plan(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rendered, _ = staged(structure(batch, key), "stream-modules")
        parents = batch.select(key, F.col(parent).cast("string").alias("parent_id")).distinct()
        modules = rendered.join(parents, key).select("parent_id", F.col("module_no").cast("int").alias("module_no"), "text")
        before = [f"{path}/log/{n}" for n in children(spark, f"{path}/log") if n.startswith("batch=") and int(n[6:]) < batch_id]
        log = spark.read.schema(TRANSITIONS).parquet(*before) if before else spark.createDataFrame([], TRANSITIONS)
        actions, _ = staged(push_actions(modules.select(*KEYS).distinct(), replay(log)), "stream-actions")
        blocks = to_blocks(modules.join(actions.where("action <> 'skip'"), KEYS, "left_semi"), KEYS, image_mode="marker")
        blocks, _ = staged(blocks.select(*KEYS, "block_no", "parent_no", "token"), "stream-blocks")
        images = image_steps(blocks, files)
        push_sequence(actions, blocks, images).write.mode("overwrite").parquet(f"{path}/requests/batch={batch_id}")
        pushed = module_counts(actions, blocks, images).where("problem is null")
        page = F.concat_ws("-", F.lit("page"), "parent_id", F.col("module_no").cast("string"), F.lit(str(batch_id)))
        steps = F.explode(F.array(F.struct(F.lit(2 * batch_id).alias("version"), page.alias("page_id"), F.lit(False).alias("done")), F.struct(F.lit(2 * batch_id + 1).alias("version"), F.lit(None).cast("string").alias("page_id"), F.lit(True).alias("done"))))
        steps = pushed.select(*KEYS, steps.alias("s")).select(*KEYS, F.col("s.version").cast("long").alias("version"), "s.page_id", "s.done")
        steps.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    return docs.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def structure_stream(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id"):
    """Starts the query that writes the modules of arriving documents to `path`/batch=N."""

    def write(batch: DataFrame, batch_id: int) -> None:
        structure(batch, key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
