"""Inline formatting: a text becomes runs with links and annotations, by expressions in the JVM.

One pattern takes a text apart into marks and the plain stretches between them, in the order that decides at one place: escape, code,
link, bare address, bold, italic, plain. The bodies of bold and italic marks are taken apart again. That ends by itself: a bold mark ends
at the first `**`, so its body has none, and an italic body has no `*` at all; so bold, italic in bold, and no further.

Neighbouring plain stretches, escapes among them, are one run: pieces are put together with a separator around each mark and parted there.
Lengths are UTF-16 units, as the limit on a run is: a mark behind each character beyond the first plane makes it count twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import MAX_TEXT

RUNS = "array<struct<content:string,url:string,bold:boolean,italic:boolean,code:boolean>>"

_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_CODE, _LINK, _ADDRESS = r"`[^`]*`", rf"\[[^\]]*\]\([^){_SPACE}]+\)", rf"(?:https?|ftp)://[^{_SPACE}<>()]+"
#: The last two take what no mark can start with at once, and any other character by itself.
_PIECES = rf"(?s)\\.|{_CODE}|{_LINK}|{_ADDRESS}|\*\*.*?\*\*|\*[^*\n]+\*|[^\\`\[*hf]+|."
#: The separator, its escape, and the characters that stand for an escaped escape and separator.
_CUT, _ESCAPE = "\x00", "\x01"


def _run(content: Column, url: Column | None = None, bold: bool = False, italic: bool = False, code: bool = False) -> Column:
    flag = lambda on: F.lit(True if on else None).cast("boolean")
    nothing = F.lit(None).cast("string")
    return F.struct(content.alias("content"), (nothing if url is None else url).alias("url"), flag(bold).alias("bold"), flag(italic).alias("italic"), flag(code).alias("code"))


def _said(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(_ESCAPE + "b"), F.lit(_CUT)), F.lit(_ESCAPE + "a"), F.lit(_ESCAPE))


def _inner(x: Column, width: int) -> Column:
    """Without `width` characters at both ends."""
    return x.substr(F.lit(width + 1), F.length(x) - 2 * width)


def _level(text: Column, bold: bool, italic: bool) -> Column:
    """The runs of an escaped text inside these marks."""
    is_mark = lambda t: (F.length(t) > 1) & F.substring(t, 1, 1).isin("`", "[", "*", "h", "f")
    piece = lambda t: F.when(is_mark(t), F.concat(F.lit(_CUT), t, F.lit(_CUT))).when((F.length(t) == 2) & t.startswith("\\"), F.substring(t, 2, 1)).otherwise(t)
    joined = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), piece), "")
    none = F.array().cast(RUNS)
    own = lambda *a, **k: F.array(_run(*a, bold=bold, italic=italic, **k)).cast(RUNS)

    def runs(x: Column, i: Column) -> Column:
        label, target = F.regexp_extract(x, r"(?s)^\[([^\]]*)\]", 1), F.regexp_extract(x, r"(?s)\]\(([^)]+)\)\z", 1)
        out = F.when(i % 2 == 0, F.when(x == "", none).otherwise(own(_said(x))))
        out = out.when(x.startswith("`"), own(_said(_inner(x, 1)), code=True))
        out = out.when(x.startswith("["), own(_said(F.when(label == "", target).otherwise(label)), _said(target)))
        if not bold and not italic:
            out = out.when(x.startswith("**"), _level(_inner(x, 2), True, False))
        if not italic:
            out = out.when(x.startswith("*"), _level(_inner(x, 1), bold, True))
        return out.otherwise(own(_said(x), _said(x)))

    return F.flatten(F.transform(F.split(joined, _CUT, -1), runs))


def pieces(content: Column, most: int = MAX_TEXT) -> Column:
    """A text in pieces of at most `most` units, cut at the last space or line end unless that is in the first half. Half a pair, which a
    hard cut may leave, becomes the replacement character."""
    twin = F.when(F.contains(content, F.lit("\uffff")), F.lit("\ufffe")).otherwise(F.lit("\uffff"))
    units = F.regexp_replace(content, F.lit(r"([\x{10000}-\x{10FFFF}])"), F.concat(F.lit("$1"), twin))
    none = F.array().cast("array<string>")

    def step(state: Column, _: Column) -> Column:
        rest, out = state["rest"], state["out"]
        head = F.reverse(F.substring(rest, 1, most + 1))
        back = F.least(*[F.coalesce(F.nullif(F.instr(head, c), F.lit(0)), F.lit(most + 2)) for c in (" ", "\n")])
        cut = F.when(most + 1 - back < most / 2, F.lit(most)).otherwise(most + 1 - back)
        long = F.length(rest) > most
        return F.struct(F.when(long, rest.substr(cut + 1, F.length(rest))).otherwise(rest).alias("rest"), F.when(long, F.concat(out, F.array(rest.substr(F.lit(1), cut)))).otherwise(out).alias("out"))

    # Every cut takes half of `most` at least.
    turns = F.sequence(F.lit(0), F.floor(F.length(units) / (most // 2)).cast("int"))
    done = F.aggregate(turns, F.struct(units.alias("rest"), none.alias("out")), step)
    parts = F.when((F.length(done["rest"]) > 0) | (F.size(done["out"]) == 0), F.concat(done["out"], F.array(done["rest"]))).otherwise(done["out"])
    whole = lambda p: F.replace(F.regexp_replace(F.regexp_replace(p, F.concat(F.lit("^"), twin), F.lit("\ufffd")), r"[\x{10000}-\x{10FFFF}]\z", "\ufffd"), twin)
    # A text of half as many characters fits whatever they are.
    return F.when(F.length(content) <= most // 2, F.array(content)).otherwise(F.transform(parts, whole))


def cut_runs(runs: Column, most: int = MAX_TEXT) -> Column:
    """The runs with long ones in pieces."""
    parted = lambda r: F.transform(pieces(r["content"], most), lambda c: r.withField("content", c))
    return F.when(F.exists(runs, lambda r: F.length(r["content"]) > most // 2), F.flatten(F.transform(runs, parted))).otherwise(runs).cast(RUNS)


def inline_runs(text: Column) -> Column:
    """Runs of a text column; null and empty texts have none."""
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_ESCAPE), F.lit(_ESCAPE + "a")), F.lit(_CUT), F.lit(_ESCAPE + "b"))
    return cut_runs(_level(escaped, False, False))


def plain_runs(text: Column) -> Column:
    """A text as one run, cut where it is too long; nothing in it is formatting."""
    return cut_runs(F.array(_run(F.coalesce(text, F.lit("")))).cast(RUNS))


def code_runs(text: Column) -> Column:
    """A text as one run of code."""
    return F.array(_run(F.coalesce(text, F.lit("")), code=True)).cast(RUNS)
