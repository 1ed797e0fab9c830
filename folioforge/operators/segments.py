"""Structuring of documents that are longer than a task: the steps of lines, units, modules and kinds, block by block.

A document's lines (later its units) fall into blocks of `size`. What a block does to a state that comes in from before it is small: a
fence is open or not, a count goes on, a kind is the nearest known one. So each step takes three moves: blocks are worked out side by side
for every state that may come in, the blocks' summaries (one row each) are scanned in order, and the states go back to the blocks. The
only windows over a whole document run over its summaries. Results equal those of `lines`, `units`, `modules` and `context`.

Within a block everything is one partition by (document, block). A unit's lines are one row, as everywhere, so a unit must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import matches, trimmed
from ..sources.staging import staged
from .context import classify_units, take_split_code
from .lines import split_lines
from .modules import is_index
from .units import split_elements, units_of_islands

SIZE = 1000


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---- fences and groups of lines --------------------------------------------------------------------


def _line_states(lines: DataFrame, key: str, size: int) -> DataFrame:
    """The lines with their block and, for both fence states 0 and 1 that may come in, in_0, in_1, open_0, open_1, blank_0, blank_1 and the
    groups started so far in the block, groups_0, groups_1; a block's first line counts there only if it opens a fence."""
    x = lines.withColumn("block", F.floor(F.col("line_no") / size).cast("long"))
    w = Window.partitionBy(key, "block").orderBy("line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(matches(F.col("line"), P.FENCE_BARE), "B").when(F.col("line").startswith("```"), "O").otherwise("N")
    x = x.withColumn("fence_kind", kind).withColumn("bare", F.sum((F.col("fence_kind") == "B").cast("int")).over(upto))
    x = x.withColumn("named_at", F.last(F.when(F.col("fence_kind") == "O", F.col("bare")), ignorenulls=True).over(upto))
    x = x.withColumn("bare_before", F.col("bare") - (F.col("fence_kind") == "B").cast("int")).withColumn("named_before", F.last("named_at", ignorenulls=True).over(before))
    fence, empty = F.col("fence_kind") != "N", trimmed(F.col("line")) == ""
    for s in (0, 1):
        inside = F.when(F.col("named_before").isNotNull(), (F.col("bare_before") - F.col("named_before")) % 2 == 0).otherwise((F.col("bare_before") + s) % 2 == 1)
        x = x.withColumn(f"open_{s}", ~inside & fence).withColumn(f"in_{s}", inside | fence)
        x = x.withColumn(f"blank_{s}", ~F.col(f"in_{s}") & empty)
        cut = F.lag(F.col(f"blank_{s}") | F.col(f"in_{s}")).over(w)
        starts = F.col(f"open_{s}") | (~F.col(f"in_{s}") & ~F.col(f"blank_{s}") & _flag(cut))
        x = x.withColumn(f"starts_{s}", starts).withColumn(f"groups_{s}", F.sum(F.col(f"starts_{s}").cast("long")).over(upto))
    return x.drop("fence_kind", "bare_before", "named_before", "starts_0", "starts_1")


def _line_summaries(states: DataFrame, key: str) -> DataFrame:
    """(key, block, state, extra, groups_before): what comes into each block: the fence state, whether its first line starts a group, and the
    groups before."""
    pick = lambda c: F.struct(*[F.col(f"{c}_{s}").alias(f"s{s}") for s in (0, 1)])
    can = F.struct(*[(~F.col(f"in_{s}") & ~F.col(f"blank_{s}")).alias(f"s{s}") for s in (0, 1)])
    gap = F.struct(*[(F.col(f"in_{s}") | F.col(f"blank_{s}")).alias(f"s{s}") for s in (0, 1)])
    x = states.groupBy(key, "block").agg(F.max_by(F.struct("bare", "named_at", gap.alias("gap"), pick("groups").alias("groups")), "line_no").alias("last"), F.min_by(can, "line_no").alias("can"))
    w = Window.partitionBy(key).orderBy("block")
    toggles = F.col("last.bare") - F.coalesce("last.named_at", F.lit(0))
    x = x.withColumn("toggled", F.sum(toggles).over(w)).withColumn("from_named", F.last(F.when(F.col("last.named_at").isNotNull(), F.col("toggled") - toggles), ignorenulls=True).over(w))
    after = F.when(F.col("from_named").isNotNull(), (1 + F.col("toggled") - F.col("from_named")) % 2).otherwise(F.col("toggled") % 2)
    x = x.withColumn("after", after).withColumn("state", F.coalesce(F.lag("after").over(w), F.lit(0)).cast("int"))
    chosen = lambda c: F.when(F.col("state") == 1, F.col(f"{c}.s1")).otherwise(F.col(f"{c}.s0"))
    x = x.withColumn("gap", chosen("last.gap")).withColumn("extra", (chosen("can") & F.coalesce(F.lag("gap").over(w), F.lit(True))).cast("long"))
    total = chosen("last.groups") + F.col("extra")
    return x.withColumn("total", total).withColumn("groups_before", F.sum("total").over(w) - F.col("total")).select(key, "block", "state", "extra", "groups_before")


def _placed_lines(lines: DataFrame, key: str, size: int) -> DataFrame:
    """(key, line_no, line, in_fence, opens, blank, gid): every line as `units.tokenize` sees it."""
    states, _ = staged(_line_states(lines, key, size), "line-states")
    x = states.join(_line_summaries(states, key), [key, "block"])
    chosen = lambda c: F.when(F.col("state") == 1, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    return x.select(key, "line_no", "line", chosen("in").alias("in_fence"), chosen("open").alias("opens"), chosen("blank").alias("blank"), (F.col("groups_before") + F.col("extra") + chosen("groups")).alias("gid"))


def mark_fences(lines: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """`lines` (key, line_no from 0, line) with `in_fence` and `opens`, as lines.mark_fences."""
    return _placed_lines(lines, key, size).select(*lines.columns, "in_fence", "opens")


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, unit_no, type, level, text, src, lines), as units.tokenize."""
    x = split_elements(_placed_lines(split_lines(docs, key, text), key, size).where(~F.col("blank")), key)
    # Images part a group, so counting them inside the group is enough.
    order = Window.partitionBy(key, "gid").orderBy("line_no", "part")
    x = x.withColumn("island", F.sum(F.col("e.src").isNotNull().cast("int")).over(order)).withColumn("is_image", F.col("e.src").isNotNull())
    found, _ = staged(units_of_islands(x, key).withColumn("block", F.floor(F.col("at.line_no") / size).cast("long")), "unit-islands")
    counts = found.groupBy(key, "block").agg(F.count("*").alias("n"))
    counts = counts.select(key, "block", (F.sum("n").over(Window.partitionBy(key).orderBy("block")) - F.col("n")).alias("first"))
    number = F.col("first") + F.row_number().over(Window.partitionBy(key, "block").orderBy("at")) - 1
    return found.join(counts, [key, "block"]).select(key, number.cast("int").alias("unit_no"), "type", "level", "text", "src", "lines")


# ---- modules ---------------------------------------------------------------------------------------


def place_units(units: DataFrame, key: str = "doc_id", size: int = SIZE, keep_index: bool = False) -> DataFrame:
    """The units inside modules with `module_no` and `module_title`, and the headings that open them, as modules.place_units."""
    opens = _flag((F.col("type") == "heading") & (F.col("level") == 1))
    x = units.withColumn("block", F.floor(F.col("unit_no") / size).cast("long")).withColumn("opens_module", opens)
    x = x.withColumn("opened", F.sum(F.col("opens_module").cast("int")).over(Window.partitionBy(key, "block").orderBy("unit_no")))
    x, _ = staged(x, "units-in-blocks")
    inner = ~F.col("opens_module")
    anchored = inner & _flag(F.exists("lines", lambda line: matches(line, P.ANCHOR_LINK)))
    parts = x.groupBy(key, "block", "opened").agg(F.max(F.when(~inner, F.col("text"))).alias("title"), F.sum(inner.cast("int")).alias("n"), F.sum(anchored.cast("int")).alias("anchors"))
    # The part of a block after its last opening heading has the block's count; parts go on from block to block.
    w = Window.partitionBy(key).orderBy("block", "opened")
    last_of_block = F.max("opened").over(Window.partitionBy(key, "block"))
    parts = parts.withColumn("adds", F.when(F.col("opened") == last_of_block, F.col("opened")).otherwise(0))
    parts = parts.withColumn("seq", F.sum("adds").over(w) - F.col("adds") + F.col("opened")).where("seq > 0")
    module = Window.partitionBy(key, "seq")
    parts = parts.withColumn("module_title", F.max("title").over(module)).withColumn("n_units", F.sum("n").over(module)).withColumn("all_anchors", F.sum("anchors").over(module))
    first = (F.col("seq") == 1) & is_index(F.col("module_title"), F.col("all_anchors"), F.col("n_units"))
    parts = parts.withColumn("dropped", F.lit(False) if keep_index else _flag(first))
    parts = parts.withColumn("module_no", F.col("seq") - F.max(F.col("dropped").cast("int")).over(Window.partitionBy(key))).where(~F.col("dropped"))
    return x.join(parts.select(key, "block", "opened", "module_no", "module_title", "n_units"), [key, "block", "opened"]).select(*units.columns, "opens_module", "module_no", "module_title", "n_units")


# ---- kinds -----------------------------------------------------------------------------------------


def settle_kinds(units: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Units with module_no get their final `kind`, as context.settle_kinds."""
    keys = [key, "module_no"]
    block = [*keys, "block"]
    w = Window.partitionBy(*block).orderBy("unit_no")
    known = F.when(F.col("kind") != "unknown", F.col("kind"))
    x = classify_units(units, [*keys, "unit_no"]).withColumn("block", F.floor(F.col("unit_no") / size).cast("long"))
    x = x.withColumn("known_before", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("known_after", F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    x, _ = staged(x, "unit-kinds")

    sums = x.groupBy(*block).agg(F.min_by(F.struct("kind", "known_after"), "unit_no").alias("head"), F.max_by(F.struct("kind", "known_before"), "unit_no").alias("tail"))
    head_known = F.coalesce(F.when(F.col("head.kind") != "unknown", F.col("head.kind")), F.col("head.known_after"))
    tail_known = F.coalesce(F.when(F.col("tail.kind") != "unknown", F.col("tail.kind")), F.col("tail.known_before"))
    s = Window.partitionBy(*keys).orderBy("block")
    sums = sums.withColumn("from_before", F.last(tail_known, ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1))).withColumn("from_after", F.first(head_known, ignorenulls=True).over(s.rowsBetween(1, Window.unboundedFollowing)))
    settled = lambda kind, before, after: F.when(kind != "unknown", kind).when((before == "code") & (after == "code"), "code").otherwise("prose")
    first = settled(F.col("head.kind"), F.col("from_before"), F.coalesce("head.known_after", "from_after"))
    last = settled(F.col("tail.kind"), F.coalesce("tail.known_before", "from_before"), F.col("from_after"))
    sums = sums.withColumn("first", first).withColumn("last", last)
    sums = sums.select(*block, "from_before", "from_after", F.lag("last").over(s).alias("kind_before"), F.lead("first").over(s).alias("kind_after"))

    x = x.join(sums, block)
    x = x.withColumn("kind", settled(F.col("kind"), F.coalesce("known_before", "from_before"), F.coalesce("known_after", "from_after")))
    left, right = F.coalesce(F.lag("kind").over(w), F.col("kind_before")), F.coalesce(F.lead("kind").over(w), F.col("kind_after"))
    x = x.withColumn("between", _flag((F.col("kind") == "prose") & (F.col("type") == "para") & (left == "code") & (right == "code")))
    return take_split_code(x).select(*units.columns, "kind")


def settled_units(docs: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Documents to units with their modules and final kinds, the headings that open modules included."""
    return settle_kinds(place_units(tokenize(docs, key, size=size), key, size), key, size)
