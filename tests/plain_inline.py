"""The inline scanner as plain Python: recursive, one text at a time. What the library's expressions are held against."""

import re

from folioforge.functions.patterns import MAX_TEXT

_SPACE = "\\t\\n\\x0b\\x0c\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: In the order that decides at one place: escape, code, link, bare address, bold, italic.
_TOKEN = re.compile(
    rf"\\(?P<escaped>.)|`(?P<code>[^`]*)`|\[(?P<label>[^\]]*)\]\((?P<target>[^){_SPACE}]+)\)"
    rf"|(?P<address>(?:https?|ftp)://[^{_SPACE}<>()]+)|\*\*(?P<bold>.*?)\*\*|\*(?P<italic>[^*\n]+)\*",
    re.S,
)


def run(content: str, url: str | None = None, **marks: bool) -> dict:
    return {"content": content, "url": url, "bold": None, "italic": None, "code": None} | marks


def parse_inline(text: str) -> list[dict]:
    out: list[dict] = []
    plain: list[str] = []
    at = 0

    def flush() -> None:
        if content := "".join(plain):
            out.append(run(content))
        plain.clear()

    for m in _TOKEN.finditer(text):
        plain.append(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup
        if kind == "escaped":
            plain.append(m["escaped"])
            continue
        flush()
        if kind == "code":
            out.append(run(m["code"], code=True))
        elif kind == "target":
            out.append(run(m["label"] or m["target"], m["target"]))
        elif kind == "address":
            out.append(run(m["address"], m["address"]))
        else:
            out.extend(inner | {kind: True} for inner in parse_inline(m[kind]))
    plain.append(text[at:])
    flush()
    return split_runs(out)


def _units(text: str) -> str:
    """One character for each UTF-16 unit."""
    if not text or max(text) < "\U00010000":
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(int.from_bytes(raw[i : i + 2], "little")) for i in range(0, len(raw), 2))


def _text(units: str) -> str:
    """Back to code points; half a pair, which a hard cut may leave, becomes the replacement character."""
    return b"".join(ord(c).to_bytes(2, "little") for c in units).decode("utf-16-le", "replace") if any("\ud800" <= c <= "\udfff" for c in units) else units


def cuts(content: str, most: int = MAX_TEXT) -> list[str]:
    """Pieces of at most `most` units, cut at the last space or line end unless that is in the first half."""
    rest, out = _units(content), []
    while len(rest) > most:
        cut = max(rest.rfind(" ", 0, most + 1), rest.rfind("\n", 0, most + 1))
        if cut < most / 2:
            cut = most
        out.append(_text(rest[:cut]))
        rest = rest[cut:]
    if rest or not out:
        out.append(_text(rest))
    return out


def split_runs(runs: list[dict], most: int = MAX_TEXT) -> list[dict]:
    return [r | {"content": piece} for r in runs for piece in cuts(r["content"], most)]
