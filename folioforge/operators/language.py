"""The language of a block of code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import matches, trimmed


def detect_language(code: Column, title: Column) -> Column:
    """html, bash, json, css, typescript or javascript; the first rule that applies decides."""
    lines = F.filter(F.transform(F.split(code, "\n", -1), trimmed), lambda x: x != "")
    body = F.array_join(lines, "\n")
    n = F.greatest(F.size(lines), F.lit(1))
    share = lambda pattern: F.size(F.filter(lines, lambda x: matches(x, pattern))) / n
    shell = matches(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), P.LANG_SHELL_FIRST) & F.forall(lines, lambda x: matches(x, P.LANG_SHELL_LINE))
    json = matches(body, r"^[{[]") & matches(body, P.LANG_JSON_KEY) & ~matches(body, P.LANG_JSON_NOT)
    typed = matches(body, P.LANG_TS_RETURN, "m")
    for pattern in P.LANG_TS_STRONG:
        typed = typed | matches(body, pattern)
    return (
        F.when(matches(body, P.LANG_DOCTYPE, "i") | (share(P.LANG_TAG_LINE) >= 0.6), "html")
        .when(shell, "bash")
        .when(json, "json")
        .when((share(P.LANG_CSS_LINE) >= 0.7) & ~matches(body, P.LANG_CSS_NOT), "css")
        .when(typed | matches(title, "typescript", "i"), "typescript")
        .otherwise("javascript")
    )
