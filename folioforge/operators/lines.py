"""Lines: splitting, fences and the classification of a line as code or prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.dialect import java
from ..functions.predicates import cannot_be_label, code_score, is_file_path_label, label_text, looks_like_call, named, reads_as_label, reads_as_prose
from ..functions.text import has_nbsp_indent, is_autolink_line, matches, nbsp_ratio, prose_skeleton, strip_line_comment, trimmed, unescape_all, words_up_to


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", newline: str = r"\r?\n") -> DataFrame:
    """(key, line_no, line): every line of every text, empty ones too. A null text has no line."""
    return docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), newline, -1)).alias("line_no", "line"))


def mark_fences(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `in_fence` and `opens` (this line starts a fence) to lines ordered by line_no.

    A bare fence line ends an open fence and starts one otherwise; a fence line with a name starts one, or is content.
    After a line, one is inside iff the number of bare lines since the last named one (that one included as a start), or
    since the beginning, is even after a named one, odd without: two running values, no loop.
    """
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare, fence = matches(F.col("line"), P.FENCE_BARE), F.col("line").startswith("```")
    kind = F.when(bare, "B").when(fence, "O").otherwise("N")
    x = lines.withColumn("fence_kind", kind).withColumn("bare_count", F.sum((F.col("fence_kind") == "B").cast("int")).over(upto))
    x = x.withColumn("last_named", F.last(F.when(F.col("fence_kind") == "O", F.col("bare_count")), ignorenulls=True).over(upto))
    inside = F.when(F.col("last_named").isNotNull(), (F.col("bare_count") - F.col("last_named")) % 2 == 0).otherwise(F.col("bare_count") % 2 == 1)
    x = x.withColumn("inside_after", inside).withColumn("inside_before", F.coalesce(F.lag("inside_after").over(w), F.lit(False)))
    return x.select(*lines.columns, (F.col("inside_before") | (F.col("fence_kind") != "N")).alias("in_fence"), (~F.col("inside_before") & (F.col("fence_kind") != "N")).alias("opens"))


def line_features(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds what several rules look at, each worked out once: t, tt (t trimmed), words (13 if there are more; no rule asks beyond 12), body, ends_code, comment_tail."""
    x = lines.withColumn("t", unescape_all(F.col(line)))
    x = x.withColumn("tt", trimmed(F.col("t"))).withColumn("words", words_up_to(F.col("t"), 13)).withColumn("body", trimmed(strip_line_comment(F.col("t"))))
    x = x.withColumn("ends_code", matches(F.col("body"), P.CODE_END))
    return x.withColumn("comment_tail", (F.length("body") > 0) & (F.length("body") < F.length("tt")))


def classify_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `line_kind`: 'code', 'prose' or 'unknown'; the first rule that applies decides. A null line is unknown.

    Rules go in steps, and what a later step looks at (the label's text, the skeleton, the score) is worked out once and
    only for lines that no earlier step has decided. The last steps before the score all say prose, so the cheap ones go first.
    """
    x = line_features(lines.withColumn("raw_line", F.coalesce(F.col(line), F.lit(""))), "raw_line")
    raw, t, tt, words, ends_code, tail = (F.col(c) for c in ("raw_line", "t", "tt", "words", "ends_code", "comment_tail"))
    inner = trimmed(F.regexp_extract(tt, java(P.BOLD_LINE), 1))
    bold_code = named(inner, "hard_syntax") | named(inner, "keyword_start") | matches(inner, P.ARROW) | matches(inner, P.STATEMENT_END) | looks_like_call(inner)
    code, prose, open_ = F.lit("code"), F.lit("prose"), F.col("decided").isNull()
    decided = (
        F.when(tt == "", F.lit("unknown"))
        .when(is_autolink_line(raw) | matches(tt, P.BARE_URL), prose)
        .when(matches(raw, P.ANCHOR_LINK) | matches(raw, P.ONLY_LINKS), prose)
        .when(matches(t, P.COMMENT_START) | has_nbsp_indent(raw) | (nbsp_ratio(raw) >= 0.5), code)
        .when(matches(t, P.HTML_TAG_START) | matches(t, P.DOCTYPE_START, "i"), code)
        .when(matches(tt, P.ONLY_CLOSERS) | matches(tt, P.LONE_OPENER), code)
        .when(matches(tt, P.BOLD_LINE), F.when(bold_code, code).otherwise(prose))
        .when((words >= 7) & ~ends_code & named(t, "connectors") & ~named(t, "hard_syntax"), prose)
        .when((words >= 6) & ~ends_code & matches(tt, P.SENTENCE_COLON_END) & named(t, "accented"), prose)
        .when(is_file_path_label(t), prose)
    )
    x = x.withColumn("decided", decided)
    x = x.withColumn("label", F.when(open_ & ~cannot_be_label(t), label_text(t)))
    x = x.withColumn("decided", F.when(open_ & reads_as_label(F.col("label")), prose).otherwise(F.col("decided")))
    x = x.withColumn("skeleton", F.when(open_, prose_skeleton(t)))
    x = x.withColumn("decided", F.when(open_ & reads_as_prose(F.col("skeleton")), prose).otherwise(F.col("decided")))
    x = x.withColumn("score", F.when(open_, code_score(t, tt, ends_code, words, tail)))
    scored = F.when((F.col("score") >= 4) | ((F.col("score") >= 3) & (words <= 8)), code).otherwise(F.lit("unknown"))
    return x.select(*lines.columns, F.coalesce("decided", scored).alias("line_kind"))
