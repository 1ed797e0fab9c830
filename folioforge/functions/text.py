"""Scalar functions over text columns. All stay in the JVM; a null gives a null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import ODD_LETTERS, SPACES, java, java_words

NBSP = "\u00a0"


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(java(pattern, flags))


def replaced(c: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(c, java(pattern, flags), by)


def trimmed(c: Column) -> Column:
    """Without white space at either end, the no-break space included."""
    return F.btrim(c, F.lit(SPACES))


def right_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def has_word(c: Column, pattern: str) -> Column:
    """Whether one of the words of `\\b(one|two|...)\\b` is there, in any case."""
    return F.when(has_odd_letter(c), matches(c, pattern, "i")).otherwise(F.concat(F.lit(" "), c).rlike(java_words(pattern)))


def has_odd_letter(c: Column) -> Column:
    odd = c.contains(ODD_LETTERS[0])
    for x in ODD_LETTERS[1:]:
        odd = odd | c.contains(x)
    return odd


def strip_autolinks(c: Column) -> Column:
    return replaced(replaced(c, P.WEB_AUTOLINK, "$1"), P.MAIL_AUTOLINK, "$1")


def unescape_all(c: Column) -> Column:
    plain = replaced(replaced(strip_autolinks(c), P.ESCAPED_ELLIPSIS, "…"), P.ESCAPED_ANY, "$1")
    return F.when(c.contains("<") | c.contains("\\"), plain).otherwise(c)


def unescape_prose(c: Column) -> Column:
    c = replaced(replaced(strip_autolinks(c), P.ESCAPED_ELLIPSIS, "…"), P.ESCAPED_PUNCTUATION, "$1")
    c = replaced(replaced(c, P.BOLD_SPACE_END, "**$1**$2"), P.BOLD_SPACE_START, "$1**$2**")
    return F.translate(c, NBSP, " ")


def is_autolink_line(c: Column) -> Column:
    return matches(c, P.AUTOLINK_LINE)


def word_count(c: Column) -> Column:
    """Runs of anything but white space: the text's length less what single replacements leave."""
    return F.when(c.isNull(), None).otherwise(F.regexp_count(c, F.lit(java(r"\S+"))))


def words_up_to(c: Column, most: int) -> Column:
    """The number of words, or `most` if there are more; reads no further than that."""
    return F.regexp_count(F.regexp_extract(c, java(rf"^\s*+(?:\S++\s*+){{0,{most}}}"), 0), F.lit(java(r"\S+")))


def has_words(c: Column, least: int) -> Column:
    return matches(c, rf"^\s*+(?:\S++\s++){{{least - 1}}}\S")


def strip_whole_line_bold(c: Column) -> Column:
    return replaced(c, P.WHOLE_LINE_BOLD, "$1$2$3")


def has_nbsp_indent(c: Column) -> Column:
    return matches(c, P.NBSP_INDENT) & matches(c, P.NBSP_START)


def nbsp_ratio(c: Column) -> Column:
    """No-break spaces among all spaces; 0 without one."""
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    hard, soft = count(NBSP), count(" ")
    return F.when(~c.contains(NBSP), F.lit(0.0)).otherwise(hard / (hard + soft))


#: What stands before a trailing comment: plain characters, closed strings (a quote after a backslash doesn't close), and
#: slashes that start no comment. Possessive, so that a line is read once; an open string ends the match.
_STRING = "|".join(rf"{q}(?:[^{q}]++|(?<=\\){q})*+{q}" for q in "\"'`")
_BEFORE_COMMENT = rf"^((?:[^\"'`/]++|{_STRING}|/(?!/)|(?<=:)/)*+)//"


def strip_line_comment(c: Column) -> Column:
    """Without a `//` comment that stands outside strings and not after a colon."""
    return F.when(c.contains("//") & c.rlike(_BEFORE_COMMENT), F.regexp_extract(c, _BEFORE_COMMENT, 1)).otherwise(c)


#: Names and calls are looked for once a word, not at each of its letters, and without going back; for Java only.
_NAME = r"(?<![A-Za-z_$])[A-Za-z_$][\w$]*+"
_ONCE = {P.RESIDUE[2]: _NAME + r"(?:\.[A-Za-z_$][\w$]*+)+", P.RESIDUE[3]: _NAME + r"\s*+\([^()]*+\)"}


def prose_skeleton(c: Column) -> Column:
    """The words that are left without syntax, white space as it falls. What would be taken out can't be there without the hint."""
    rest = with_calls = c
    for pattern in P.RESIDUE[:-2]:
        with_calls = replaced(with_calls, _ONCE.get(pattern, pattern), " ")
        if pattern != P.RESIDUE[3]:
            rest = replaced(rest, _ONCE.get(pattern, pattern), " ")
    return replaced(F.when(c.contains("("), with_calls).when(matches(c, P.RESIDUE_HINT), rest).otherwise(c), P.RESIDUE[-2], " ")


def prose_residue(c: Column) -> Column:
    return trimmed(replaced(prose_skeleton(c), P.RESIDUE[-1], " "))


#: Lower-case letters whose canonical decomposition is an ASCII letter and marks, and that letter; from the Unicode tables.
_FOLDS = {c: d[0] for c in map(chr, range(0xC0, 0x2C00)) if (d := unicodedata.normalize("NFD", c))[0].isascii() and d[0].islower() and d[1:] and all("\u0300" <= m <= "\u036f" for m in d[1:])}
_FROM, _TO = "".join(_FOLDS), "".join(_FOLDS.values())
_MARKS = "".join(chr(x) for x in range(0x300, 0x370))


def folded(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.translate(F.lower(c), _FROM, _TO), _MARKS, "")


def slugify(c: Column) -> Column:
    dashed = F.regexp_replace(folded(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, r"^-+|-+\z", ""), 1, 50), F.lit("")), F.when(c.isNotNull(), F.lit(P.DEFAULT_SLUG)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"/+\z", ""), "/", -1), -1)


def file_stem(path: Column) -> Column:
    """The name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)\z", 1))


def image_marker(src: Column) -> Column:
    return F.concat(F.lit("![]("), base_name(src), F.lit(")"))


def safe_language(c: Column) -> Column:
    name = F.lower(trimmed(F.coalesce(c, F.lit(""))))
    return F.when(name.isin(list(P.SAFE_LANGUAGES)), name).otherwise(F.lit(P.PLAIN_TEXT))


def prettify_title(name: Column) -> Column:
    words = F.filter(F.split(trimmed(F.regexp_replace(name, "[-_]+", " ")), " ", -1), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def is_generic_name(name: Column) -> Column:
    return folded(name).isin(list(P.GENERIC_NAMES))


def course_folder(path: Column) -> Column:
    return F.coalesce(F.get(F.split(path, "/", -1), F.size(F.split(path, "/", -1)) - 2), F.lit(""))


def course_slug(path: Column) -> Column:
    return slugify(F.concat_ws("-", course_folder(path), file_stem(path)))


def course_title(path: Column, given: Column) -> Column:
    stem = file_stem(path)
    return F.coalesce(given, prettify_title(F.when(is_generic_name(stem), course_folder(path)).otherwise(stem)))


def padded(number: Column, width: int, fill: str = " ") -> Column:
    """Padded on the left; a longer number stays whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def right_padded(c: Column, width: int) -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def module_file(number: Column, title: Column) -> Column:
    return F.concat(padded(number, 2, "0"), F.lit("-"), slugify(title), F.lit(".md"))


def report_line(number: Column, file: Column, stats: Column) -> Column:
    return F.concat(
        padded(number, 2), F.lit("  "), right_padded(file, 42), F.lit(" código="), padded(stats["code"], 3), F.lit("  imgs="), padded(stats["images"], 3),
        F.lit("  H2="), padded(stats["headings"], 2), F.lit("  párr="), padded(stats["paras"], 3), F.lit("  listas="), padded(stats["lists"], 3),
    )


def number_from_file(stem: Column) -> Column:
    return F.regexp_extract(stem, r"^(\d+)-(.+)\z", 1).cast("int")


def title_from_file(stem: Column) -> Column:
    words = F.replace(F.regexp_extract(stem, r"^(\d+)-(.+)\z", 2), F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(P.DEFAULT_MIME))


def plain_id(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))
