"""Structuring in blocks equals structuring in one, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import context, lines, modules, segments, units
from folioforge.operators.prefix import running_before
from folioforge.streaming.jobs import settled_units, structure

PIECES = ["a", "", "```", "```js", "``` ", "```{=html}", "- item", "> cita", "# M {#m}", "# Contenido", "## Paso", "[a](#a)", "const x = 1;", "Esto es lo que hay que hacer", "x ![](./media/i.png){w=1} y", "![](m/j.png)", "valor", "};", "  "]


def long_texts(seed, n=60):
    rnd = random.Random(seed)
    return ["\n".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 70))) for _ in range(n)] + ["", None, "\n" * 40, "```\n" * 41, "```js\n" + "# M\n\n" * 30, "valor\n\n" * 60, "# M\n\nconst x = 1;\n\n" + "valor\n\n" * 60 + "const x = 1;"]


def docs(spark, seed):
    return spark.createDataFrame(list(enumerate(long_texts(seed))), "doc_id long, text string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("size", [1, 3, 8, 1000])
def test_fences_and_units(spark, size):
    d = docs(spark, size)
    split = lines.split_lines(d)
    assert rows(segments.mark_fences(split, "doc_id", size), "doc_id", "line_no") == rows(lines.mark_fences(split, ["doc_id"]), "doc_id", "line_no")
    assert rows(segments.tokenize(d, size=size), "doc_id", "unit_no") == rows(units.tokenize(d), "doc_id", "unit_no")


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_modules_and_kinds(spark, size):
    d = docs(spark, 100 + size)
    columns = ["doc_id", "unit_no", "type", "level", "text", "src", "lines", "opens_module", "module_no", "module_title", "n_units", "kind"]
    want = settled_units(d).select(columns)
    assert rows(segments.settled_units(d, size=size).select(columns), "doc_id", "unit_no") == rows(want, "doc_id", "unit_no")
    tokens = units.tokenize(d)
    kept = modules.place_units(tokens, keep_index=True)
    assert rows(segments.place_units(tokens, size=size, keep_index=True).select(kept.columns), "doc_id", "unit_no") == rows(kept, "doc_id", "unit_no")


def test_rendering_in_blocks(spark):
    d = docs(spark, 9)
    assert rows(structure(d, block_size=5), "doc_id", "module_no") == rows(structure(d), "doc_id", "module_no")


def test_empty_and_null_kinds(spark):
    none = docs(spark, 0).limit(0)
    assert segments.settled_units(none).count() == 0 and segments.mark_fences(lines.split_lines(none), "doc_id").count() == 0


def test_no_window_over_a_document(spark):
    """Every window partition over lines or units names the block, group or unit; only summaries go by document alone."""
    d = docs(spark, 5)
    states = segments._line_states(lines.split_lines(d), "doc_id", 8)
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("block#" in line for line in windows)


def test_running_totals(spark):
    rnd = random.Random(6)
    given = [(rnd.choice("abc"), i, rnd.randint(0, 9)) for i in range(500)]
    got = rows(running_before(spark.createDataFrame(given, "p string, i int, n int"), ["p", "i"], "n"), "p", "i")
    want, total = [], 0
    for p, i, n in sorted(given):
        want.append((p, i, n, total))
        total += n
    assert got == want
    assert running_before(spark.createDataFrame([], "p string, n int"), ["p"], "n").count() == 0
