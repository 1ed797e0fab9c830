"""Regular expressions, written once and spelled for each engine.

Patterns are kept in the ECMAScript spelling that their meaning comes from. Spark runs them in Java's dialect and DuckDB
in RE2's, which differ in word boundaries, white space, line ends and case folding:

* `\\b` looks at ASCII word characters only, in Java too after translation;
* `\\s` covers 25 code points, among them the no-break space and U+FEFF;
* `$` is the end of the text and nothing else, unless the pattern is multi-line;
* `.` stops at the four line terminators;
* ignoring case folds accents as well.
"""

from __future__ import annotations

#: White space beyond what Java and RE2 call `\s`: U+000B, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF.
_EXTRA = ("000b", "00a0", "1680", "2000-200a", "2028", "2029", "202f", "205f", "3000", "feff")


def _points(prefix: str, suffix: str) -> str:
    return "".join("-".join(f"{prefix}{p}{suffix}" for p in x.split("-")) for x in _EXTRA)


#: Java asks the parts of a class one after the other, so a character below U+00A0 is told apart from all of them at once.
JAVA_SPACE, RE2_SPACE = r"\s[[^\x00-\x{9f}]&&[" + _points(r"\x{", "}") + "]]", r"\s" + _points(r"\x{", "}")
#: The same characters as a text.
SPACES = " \t\n\f\r" + "".join(chr(x) for r in _EXTRA for x in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1))
_WORD = "A-Za-z0-9_"
_JAVA_BOUNDARY = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
#: The same where case counts; under (?i) a class has more letters than `\\w`.
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NOT_LINE_END = r"[^\n\r\x{2028}\x{2029}]"


def _translate(pattern: str, space: str, boundary: str, end: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            d = pattern[i + 1]
            i += 2
            if d == "s":
                out.append(space if in_class else f"[{space}]")
            elif d == "S":
                # In a class it only stands beside \\s, and the two cover everything in any engine.
                out.append(r"\S" if in_class else f"[^{space}]")
            elif d == "b" and not in_class:
                out.append(boundary)
            elif d == "u":
                out.append(r"\x{" + pattern[i : i + 4] + "}")
                i += 4
            elif d in "/\"'`":
                out.append(d)
            else:
                out.append("\\" + d)
            continue
        i += 1
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c in "[&":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            in_class = True
            if pattern.startswith("^", i):
                c, i = "[^", i + 1
            out.append(c)
        elif c == "$":
            out.append(end)
        elif c == ".":
            out.append(_NOT_LINE_END)
        else:
            out.append(c)
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """The pattern for Spark. Flags: i ignores case, m lets `$` match at line ends."""
    end = r"(?=[\n\r\x{2028}\x{2029}]|\z)" if "m" in flags else r"\z"
    return ("(?iu)" if "i" in flags else "") + _translate(pattern, JAVA_SPACE, _JAVA_BOUNDARY, end)


#: What each letter matches if case is ignored, beyond its two forms.
_ALSO = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
#: Texts with one of these may hold words that only the plain spelling finds: a long s may start a word, and these letters fold otherwise than they match.
ODD_LETTERS = "\u017f\u0130\u0131"


def _branches(words: list[str]) -> str:
    """The words and the boundary after each, as a tree by letters; alternatives stay in order."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in [*word, ""]:
            at = at.setdefault(c, {})

    def spelled(at: dict) -> str:
        parts = [f"[{c}{c.upper()}{_ALSO.get(c, '')}]" + spelled(x) if c else _BOUNDARY for c, x in at.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return spelled(tree)


def java_words(pattern: str, two: bool = False) -> str:
    """A pattern `\\b(one|two|...)\\b` of lower-case words that start with ASCII letters, for Spark: whether a text without ODD_LETTERS, after a space, has one in
    any case, or with `two` has two that differ. A word is looked for only where one may start, and by its letters."""
    words = pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|")
    heads = "".join(sorted({w[0] + w[0].upper() for w in words}))
    start, tree = rf"\W(?=[{heads}])", _branches(words)
    if not two:
        return start + tree
    return rf"\A(?>(?s:.*?){start}({tree}))(?s:.*?)(?=[{heads}])(?<!\w)(?!(?iu:\1){_BOUNDARY}){tree}"


def re2(pattern: str, flags: str = "") -> str:
    """The pattern for DuckDB."""
    end = r"(?m:$)" if "m" in flags else r"\z"
    return ("(?i)" if "i" in flags else "") + _translate(pattern, RE2_SPACE, r"\b", end)


def sql(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"
