"""Scalars and predicates against plain statements of their rules, on hand-written and random lines."""

import random
import re

from pyspark.sql import functions as F

from folioforge.functions import dialect, patterns as P
from folioforge.functions import predicates as pr
from folioforge.functions import text as tx

SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def column(spark, rows, **columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row int, s string")
    got = df.select("row", *[c.alias(n) for n, c in columns.items()]).orderBy("row").collect()
    return {n: [r[n] for r in got] for n in columns}


def test_unescape(spark):
    s = [r"\<script\>", r"Espera\...", "**Diferencia **entre", "<https://a.b/c> y <mailto:a@b>", r"\*ver\*", None, "", "a\xa0b"]
    got = column(spark, s, bare=tx.unescape_all(F.col("s")), prose=tx.unescape_prose(F.col("s")), auto=tx.is_autolink_line(F.col("s")))
    assert got["bare"] == ["<script>", "Espera…", "**Diferencia **entre", "https://a.b/c y a@b", "*ver*", None, "", "a\xa0b"]
    assert got["prose"] == ["<script>", "Espera…", "**Diferencia** entre", "https://a.b/c y a@b", r"\*ver\*", None, "", "a b"]
    assert got["auto"] == [False, False, False, True, False, None, False, False]


def test_word_boundary_is_ascii(spark):
    s = ["el está aquí", "señal", "año", "ESTÁ", "según el"]
    got = column(spark, s, a=tx.matches(F.col("s"), r"\bestá\b"), b=tx.matches(F.col("s"), r"\bal\b"), c=tx.matches(F.col("s"), r"\bo\b"), d=tx.matches(F.col("s"), "está", "i"))
    assert got["a"] == [False] * 5
    assert got["b"] == [False, True, False, False, False]
    assert got["c"] == [False, False, True, False, False]
    assert got["d"] == [True, False, False, True, False]


def test_space_covers_every_code_point(spark):
    got = column(spark, [f"a{c}b{c}" for c in SPACE], n=tx.word_count(F.col("s")), t=tx.trimmed(F.col("s")))
    assert got["n"] == [2] * len(SPACE)
    assert got["t"] == [f"a{c}b" for c in SPACE]


def test_end_is_the_true_end(spark):
    assert column(spark, ["a;\n", "a;"], e=tx.matches(F.col("s"), "a;$"))["e"] == [False, True]
    assert dialect.re2("a$").endswith(r"\z")


def comment_free(t):
    """The rule in words: a quote opens a string that the same quote closes unless a backslash stands before it."""
    quote, before = "", ""
    for i, c in enumerate(t):
        if quote:
            quote = "" if c == quote and before != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif t.startswith("//", i) and before != ":":
            return t[:i]
        before = c
    return t


def test_line_comment(spark):
    rnd = random.Random(3)
    s = ['x = [10, "hello"]; // Error', "go('http://a//b') // c", "http://x", "a ://// b", '"\\"//" // y']
    s += ["".join(rnd.choice("ab\"'`\\/: ") for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    assert column(spark, s, c=tx.strip_line_comment(F.col("s")))["c"] == [comment_free(x) for x in s]


def test_measures(spark):
    s = ["**x**", " **a b** ", "\xa0 return", "a b\xa0c", "f(x) y `z` 'w' a.b el"]
    got = column(spark, s, u=tx.strip_whole_line_bold(F.col("s")), i=tx.has_nbsp_indent(F.col("s")), r=tx.nbsp_ratio(F.col("s")), p=tx.prose_residue(F.col("s")))
    assert got["u"][:2] == ["x", " a b "]
    assert got["i"] == [False, False, True, False, False]
    assert got["r"] == [0.0, 0.0, 0.5, 0.5, 0.0]
    assert got["p"][4] == "y el"


def test_names(spark):
    s = ["Módulo Introducción", "a" * 80, "¡¡¡???!!!", "ñandú Ærø"]
    assert column(spark, s, x=tx.slugify(F.col("s")))["x"] == ["modulo-introduccion", "a" * 50, "modulo", "nandu-r"]
    paths = ["/c/JS desde cero/Clases.docx", "/c/x/mi_curso--final.docx", "solo.docx"]
    got = column(spark, paths, t=tx.course_title(F.col("s"), F.lit(None).cast("string")), f=tx.course_folder(F.col("s")), g=tx.course_slug(F.col("s")))
    assert got["t"] == ["JS Desde Cero", "Mi Curso Final", "Solo"]
    assert got["f"] == ["JS desde cero", "x", ""]
    assert got["g"][1] == "x-mi-curso-final"
    assert column(spark, ["07-hola-mundo", "120-x"], n=tx.number_from_file(F.col("s")), t=tx.title_from_file(F.col("s"))) == {"n": [7, 120], "t": ["Hola mundo", "X"]}
    assert column(spark, ["x"], f=tx.module_file(F.lit(123), F.lit("É")))["f"] == ["123-e.md"]
    assert column(spark, ["./media/A.PNG", "b.jpeg", "c"], m=tx.mime_type(F.col("s")), k=tx.image_marker(F.col("s")))["m"] == ["image/png", "image/jpeg", P.DEFAULT_MIME]
    assert column(spark, [" JavaScript ", "", "cobol", None], x=tx.safe_language(F.col("s")))["x"] == ["javascript", "plain text", "plain text", "plain text"]


def test_predicates(spark):
    got = column(spark, ["SRP", "Abstract Syntax Tree", "1,3", "", "'video'"], g=pr.is_gloss(F.col("s")))
    assert got["g"] == [True, True, False, False, False]
    got = column(spark, ["Nota", "Otra solución", "Creamos el archivo sw.js", "const x = 1", "Si en nuestro código tenemos:"], g=pr.is_spanish_label(F.col("s")))
    assert got["g"] == [False, True, True, False, True]
    got = column(spark, ["package.json", "Assets/plugins/Ads/Ads.json", "https://a/b", "import x from './a.json'"], g=pr.is_file_path_label(F.col("s")))
    assert got["g"] == [True, True, False, False]
    got = column(spark, ["f()", "f('x')", "AST (Abstract Syntax Tree)", "f(3)", "f(a.b)", "none"], g=pr.looks_like_call(F.col("s")))
    assert got["g"] == [True, True, False, True, True, False]
    assert column(spark, ["**Diferencia **entre element.onclick = function(){} y el element.addEventListener(x)"], g=pr.mixed_prose(F.col("s")))["g"] == [True]


def test_translation_keeps_classes():
    assert re.fullmatch(dialect.java("[a-z[]").replace(r"\[", "["), "q")
    assert dialect.java(r"[\s\S]").endswith(r"\S]")
