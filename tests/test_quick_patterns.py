"""Quick spellings against the plain ones: word lists by letters, two words that differ, white space, hints."""

import random
import time

from pyspark.sql import functions as F

from folioforge.functions import patterns as P
from folioforge.functions import predicates as pr
from folioforge.functions import text as tx
from folioforge.functions.dialect import java
from folioforge.operators import lines

PIECES = [
    "la", "LA", "el", "está", "estáx", "ESTÁN", "más", "ſi", "ſobre", "también", "y", "que", "x.y", "console.log", "require(", "a/b.json", "sw.js", "foo.cſs", "Nota", "**", "=>", "`q`", "'s'", '"',
    "(a)", "f(x)", "f (y) ;", "9ab.c", "a9b(c)", "{", "}", ";", ":", ".", "\\*", "\\...", "<https://a.b>", "<b>", "<mailto:x@y>", "// c", " ", " ", "﻿", "\t", "¿", "3", "-", "a_b", "$x.y", "localStorage.",
    "exports.", "x.prototype.y", "=", "1.5", "ı", "İ", " ", "é", "this.b", "import", "la.", "fin:", "Dos.",
]


def plain_prose(c):
    residue = c
    for pattern in P.RESIDUE:
        residue = F.regexp_replace(residue, java(pattern), " ")
    found = F.array_distinct(F.transform(F.regexp_extract_all(residue, F.lit(java(P.SPANISH_FUNCTION_WORD, "i")), F.lit(0)), F.lower))
    return (F.regexp_count(residue, F.lit(java(r"\S+"))) >= 3) & (F.size(found) >= 2)


def plain_trim(c):
    return F.regexp_replace(F.regexp_replace(c, java(r"^\s+"), ""), java(r"\s+$"), "")


def plain_label(c):
    t = plain_trim(F.regexp_replace(F.regexp_replace(plain_trim(tx.strip_whole_line_bold(c)), java(P.FILE_TOKEN, "i"), " "), java(r"\s+"), " "))
    words = F.regexp_count(t, F.lit(java(r"\S+")))
    return tx.matches(t, P.PURE_TEXT) & (words >= 2) & ~tx.matches(t, P.KEYWORD_START) & ~tx.matches(t, P.SHELL_START) & (((words >= 4) & tx.matches(t, r"[.:]$")) | tx.matches(t, P.SPANISH_WORD, "i"))


def test_quick_spellings_say_what_plain_ones_say(spark):
    rnd = random.Random(11)
    rows = [("".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.choice([1, 2, 3, 5, 9, 16]))),) for _ in range(6000)]
    c = F.col("s")
    pairs = {
        "prose": (pr.mixed_prose(c), plain_prose(c)),
        "label": (pr.is_spanish_label(c), plain_label(c)),
        "no label": (pr.cannot_be_label(c) & plain_label(c), F.lit(False)),
        "trim": (tx.trimmed(c), plain_trim(c)),
        "words": (tx.words_up_to(c, 13), F.least(tx.word_count(c), F.lit(13))),
        **{n: (pr.named(c, n), tx.matches(c, *p)) for n, p in pr.NAMED.items()},
    }
    got = spark.createDataFrame(rows, "s string").select("s", *[x.alias(f"{n} {i}") for n, xs in pairs.items() for i, x in enumerate(xs)]).collect()
    for n in pairs:
        assert not [r["s"] for r in got if r[f"{n} 0"] != r[f"{n} 1"]], n
    assert 1000 < sum(r["prose 0"] for r in got) < 5000 and 20 < sum(r["label 0"] for r in got)


def test_long_lines_are_classified_in_good_time(spark):
    """Two lines of 120,000 letters: a name without a call, which takes a step for each pair of letters if it is looked for at every one, and prose without a function word."""
    rows = [("(" + "a" * 120_000,), ("thern anble (onded) " * 6_000,)]
    began = time.time()
    got = lines.classify_lines(spark.createDataFrame(rows, "line string")).collect()
    assert [r["line_kind"] for r in got] == ["code", "unknown"] and time.time() - began < 30
