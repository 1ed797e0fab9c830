"""Tokenizer, classification, modules, rendering and blocks."""

import random

import plain_inline
import pytest
from pyspark.sql import functions as F

from folioforge.operators import blocks, context, inline, language, lines, modules, render, units
from folioforge.streaming.jobs import structure, structure_stream

CODE = ["const x = 1;", "}", "**element.onclick = function(){}**", 'x = [10, "hello"]; // Error', "\xa0\xa0return x;", "<div>", "// el comentario", "npm install x"]
PROSE = ["https://example.com/x", "**Object.create**", "Otra solución", "Assets/plugins/Ads/Ads.json", "Esto es lo que hay que hacer cuando todo falla", "[a](#b)"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_line_kinds(spark):
    rows = [(i, t) for i, t in enumerate([*CODE, *PROSE, "", None])]
    got = lines.classify_lines(spark.createDataFrame(rows, "i int, line string")).orderBy("i").collect()
    assert [r["line_kind"] for r in got] == ["code"] * len(CODE) + ["prose"] * len(PROSE) + ["unknown"] * 2


def walk_fences(text):
    out, inside = [], False
    for line in text:
        bare, fence = line.rstrip() == "```", line.startswith("```")
        if inside:
            out.append((True, False))
            inside = not bare
        else:
            out.append((fence, fence))
            inside = fence
    return out


def test_fences(spark):
    rnd = random.Random(1)
    texts = [[rnd.choice(["a", "```", "```js", "", "``` "]) for _ in range(rnd.randint(1, 12))] for _ in range(300)]
    got = lines.mark_fences(lines.split_lines(docs(spark, *["\n".join(t) for t in texts])), ["doc_id"]).orderBy("doc_id", "line_no").collect()
    assert [(r["in_fence"], r["opens"]) for r in got] == [x for t in texts for x in walk_fences(t)]


def test_tokenize(spark):
    text = "# T {#x}\r\n\n- a\n- b\n\n> q\n\n```{=html}\n<!-- -->\n```\nx ![](./media/i.png){w=1} y\nz\n\n## H\nmore\n```js\nlet a\n\nlet b"
    got = units.tokenize(docs(spark, text, None, "")).orderBy("unit_no").collect()
    assert [(r["type"], r["level"], r["text"], r["src"], r["lines"]) for r in got] == [
        ("heading", 1, "T", None, None),
        ("list", None, None, None, ["- a", "- b"]),
        ("quote", None, None, None, ["> q"]),
        ("para", None, None, None, ["x "]),
        ("image", None, None, "./media/i.png", None),
        ("para", None, None, None, [" y", "z"]),
        ("para", None, None, None, ["## H", "more"]),
        ("fence", None, None, None, ["```js", "let a", "", "let b"]),
    ]
    assert [r["unit_no"] for r in got] == list(range(8))


def test_modules(spark):
    text = "lost\n\n# Contenidos\n\nx\n\n# A\n\n# B\n\ny"
    found, inner = modules.split_modules(units.tokenize(docs(spark, text)))
    assert [(r["module_no"], r["title"], r["n_units"]) for r in found.orderBy("module_no").collect()] == [(1, "A", 0), (2, "B", 1)]
    assert [(r["module_no"], r["lines"]) for r in inner.collect()] == [(2, ["y"])]
    links = "# Hola\n\n[a](#a)\n\n[b](#b)\n\n[c](#c)\n\n# B"
    assert [r["title"] for r in modules.list_modules(units.tokenize(docs(spark, links))).collect()] == ["B"]
    assert [r["module_no"] for r in modules.list_modules(units.tokenize(docs(spark, links)), keep_index=True, only=2).collect()] == [2]


def settle(kinds):
    known = lambda it: next((k for k in it if k != "unknown"), None)
    return [("code" if known(kinds[i::-1]) == known(kinds[i:]) == "code" else "prose") if k == "unknown" else k for i, k in enumerate(kinds)]


def test_unknowns(spark):
    rnd = random.Random(2)
    seqs = [[rnd.choice(["code", "unknown", "unknown", "prose", "list"]) for _ in range(rnd.randint(1, 9))] for _ in range(200)]
    df = spark.createDataFrame([(i, j, k) for i, s in enumerate(seqs) for j, k in enumerate(s)], "s int, unit_no int, kind string")
    got = context.resolve_unknowns(df, ["s"]).orderBy("s", "unit_no").collect()
    assert [r["kind"] for r in got] == [k for s in seqs for k in settle(s)]


def test_unit_kinds(spark):
    text = "# M\n\nconst x = 1;\nOtra solución\n\n> const x = 1;\n> const y = 2;\n\n> cita\n\nconst a = {\n\nvalor\n\n};"
    _, inner = modules.split_modules(units.tokenize(docs(spark, text)))
    got = context.classify_units(inner, ["doc_id", "module_no", "unit_no"]).orderBy("unit_no").collect()
    assert [r["kind"] for r in got] == ["unknown", "code", "quote", "code", "unknown", "code"]
    got = context.settle_kinds(inner).orderBy("unit_no").collect()
    assert [r["kind"] for r in got] == ["prose", "code", "quote", "code", "code", "code"]


@pytest.mark.parametrize(
    "code, title, expected",
    [
        ("<!DOCTYPE html>\n<p>", "", "html"),
        ("npm install\ncd x", "", "bash"),
        ('{\n"a": 1\n}', "", "json"),
        (".a {\ncolor: red;\nwidth: 1px;", "", "css"),
        ("let a: number = 1", "", "typescript"),
        ("interface A {", "", "typescript"),
        ("a.paused ? this.play() : this.pause()", "", "javascript"),
        ("const a = 1", "TypeScript", "typescript"),
    ],
)
def test_language(spark, code, title, expected):
    row = spark.createDataFrame([(code, title)], "code string, title string")
    assert row.select(language.detect_language(F.col("code"), F.col("title"))).first()[0] == expected


def joined(rows):
    """The rule in words: a line goes to the end of the one before if that ends in a lone =."""
    import re

    out = []
    for r in rows:
        if out and r.strip() and re.search(r"[^=!<>+\-*/%&|^]=\s*\Z", out[-1]):
            out[-1] = out[-1].rstrip() + " " + r.strip()
        else:
            out.append(r)
    return out


def test_join_dangling(spark):
    rnd = random.Random(5)
    seqs = [[rnd.choice(["a =", "=", "", " =", "b", "  c ==", "x = "]).rstrip() for _ in range(rnd.randint(1, 7))] for _ in range(300)]
    df = spark.createDataFrame([(i, 0, j, x) for i, s in enumerate(seqs) for j, x in enumerate(s)], "id int, u int, pos int, line string")
    got = {}
    for r in render.join_dangling(df, ["id"], ["u", "pos"]).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["line"])
    assert [got[i] for i in range(len(seqs))] == [joined(s) for s in seqs]


def test_render(spark):
    text = '# Uno\n\nconst url =\n\n"x";\n\n{"a": 1}\n\n{"b": 2}\n\ntexto **a **b en la página de hoy\n\n\n\n![](./media/image1.png)\n\n# Vacío'
    got = structure(docs(spark, text)).orderBy("module_no").collect()
    assert got[0]["file"] == "01-uno.md" and got[1]["text"] == "# Vacío\n\n\n"
    assert '```javascript\nconst url = "x";\n{"a": 1}\n{"b": 2}\n```' in got[0]["text"]
    assert got[0]["text"].endswith("texto **a** b en la página de hoy\n\n![](image1.png)\n")
    assert got[0]["images"] == ["image1.png"] and got[0]["stats"].asDict() == {"code": 1, "images": 1, "headings": 0, "lists": 0, "paras": 1, "quotes": 0}


def test_json_roots_and_document_end(spark):
    text = '# M\n\n{"a": [1,\n\n2]}\n\n{"b": 2}\n\n## H\n\n<html>\n</html>\nlet a = 1;'
    body = structure(docs(spark, text)).first()["text"]
    assert body.count("```json") == 2 and "```html\n<html>\n</html>\n```\n\n```javascript\nlet a = 1;\n```" in body


def tree(depths):
    """The rule in words: an item hangs on the nearest open item above its depth."""
    stack, out = [], []
    for i, d in enumerate(depths):
        del stack[d:]
        out.append((len(stack), stack[-1] if stack else None))
        stack.append(i)
    return out


def test_list_depths(spark):
    rnd = random.Random(7)
    seqs = [[rnd.randint(0, 4) for _ in range(rnd.randint(1, 9))] for _ in range(300)] + [[0, 3, 2]]
    df = spark.createDataFrame([(i, j, d) for i, s in enumerate(seqs) for j, d in enumerate(s)], "id int, no int, depth int")
    got = blocks.effective_depth(df, ["id"], "no").orderBy("id", "no").collect()
    assert [(r["level"], r["parent"]) for r in got] == [x for s in seqs for x in tree(s)]


def test_blocks(spark):
    text = "# T\n## A\n\n- a\n    - b\n\n- c\n1. d\n- e\n```js\nx\n\ny\n```\n![](image1.png)\n#### n\n```cobol\nopen"
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, module_no int, text string")
    got = blocks.block_rows(df, ["doc_id", "module_no"]).orderBy("block_no").collect()
    assert [(r["type"], r["content"], r["depth"], r["parent_no"]) for r in got] == [
        ("heading_2", "A", 0, None),
        ("bulleted_list_item", "a", 0, None),
        ("bulleted_list_item", "b", 1, 1),
        ("bulleted_list_item", "c", 0, None),
        ("numbered_list_item", "d", 0, None),
        ("bulleted_list_item", "e", 0, None),
        ("code", "x\n\ny", 0, None),
        ("callout", "![](image1.png)", 0, None),
        ("paragraph", "#### n", 0, None),
        ("code", "open", 0, None),
    ]
    assert [r["language"] for r in got if r["type"] == "code"] == ["plain text", "plain text"]
    marker = blocks.to_blocks(df, ["doc_id", "module_no"], image_mode="marker").where("token is not null").first()
    assert marker["type"] == "paragraph" and marker["rich_text"][0]["code"]


def test_inline():
    short = lambda t: [(r["content"], r["url"], *(k for k in ("bold", "italic", "code") if r[k])) for r in plain_inline.parse_inline(t)]
    assert short("**muy *importante* hoy**") == [("muy ", None, "bold"), ("importante", None, "bold", "italic"), (" hoy", None, "bold")]
    assert short("ve [a](https://x) o https://y, `c*d*`") == [("ve ", None), ("a", "https://x"), (" o ", None), ("https://y,", "https://y,"), (" ", None), ("c*d*", None, "code")]
    assert short(r"\*x\* **a") == [("*x* **a", None)] and short("") == []
    assert [len(x) for x in plain_inline.cuts("a" * 2000)] == [2000]
    assert [len(x) for x in plain_inline.cuts("a" * 1990 + " " + "b" * 50)] == [1990, 51]
    assert [len(x) for x in plain_inline.cuts("a" * 2100)] == [2000, 100]
    assert "".join(plain_inline.cuts("😀" * 1500)) == "😀" * 1500 and len(plain_inline.cuts("😀" * 1500)) == 2


def test_inline_expressions(spark):
    """The expressions in the JVM against the scanner, over texts made of marks."""
    rnd = random.Random(11)
    parts = ["*", "**", "***", "`", "[", "]", "](https://x.y/z)", "[a](b)", "https://e.fg/h", "http", "ftp://q", "\\", "\\*", "a", "bc d", " ", "\n", "\x00", "\x01", "😀", "é", "<", ")", "**b**", "*i*", "`c`", "\u2003", "h", "f"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", "a" * 2000, "a" * 2001, "a" * 1990 + " " + "b" * 50, "😀" * 1500, "a" + "😀" * 1500, "\uffff" + "😀" * 1500, "x " * 3000, ("y" * 900 + "\n") * 9, "**" + "z" * 4100 + "** *" + "w " * 1500 + "*", "h" * 30_000, "\\a" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r for r in df.select("i", inline.inline_runs(F.col("t")).alias("r"), inline.plain_runs(F.col("t")).alias("p"), inline.code_runs(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert [r.asDict() for r in got[i]["r"]] == plain_inline.parse_inline(t or ""), t
        assert [r.asDict() for r in got[i]["p"]] == plain_inline.split_runs([plain_inline.run(t or "")])
        assert [r.asDict() for r in got[i]["c"]] == [plain_inline.run(t or "", code=True)]
    plan = df.select(inline.inline_runs(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    docs(spark, "# A\n\nconst x = 1;", "# B").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    structure_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]
