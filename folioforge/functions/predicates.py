"""Predicates and scores that tell a line of code from a line of prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .dialect import java, java_words
from .text import has_odd_letter, has_word, has_words, matches, prose_skeleton, replaced, strip_whole_line_bold, trimmed

#: The named line predicates: pattern and flags.
NAMED = {
    "keyword_start": (P.KEYWORD_START, ""),
    "shell_start": (P.SHELL_START, ""),
    "api_tokens": (P.API_TOKENS, ""),
    "connectors": (P.CONNECTORS, "i"),
    "hard_syntax": (P.HARD_SYNTAX, ""),
    "accented": (P.ACCENTED, ""),
    "pure_text": (P.PURE_TEXT, ""),
    "spanish_word": (P.SPANISH_WORD, "i"),
    "file_path_label": (P.FILE_PATH_LABEL, "i"),
}


#: What a line must have for a named predicate to hold, looked for first.
HINTS = {"api_tokens": P.API_TOKENS_HINT, "hard_syntax": P.HARD_SYNTAX_HINT}


def named(c: Column, name: str) -> Column:
    if name == "connectors":
        return has_word(c, P.CONNECTORS)
    holds = matches(c, *NAMED[name])
    return matches(c, HINTS[name]) & holds if name in HINTS else holds


def without_file_tokens(c: Column) -> Column:
    return F.when(matches(c, P.FILE_TOKEN_HINT), replaced(c, P.FILE_TOKEN, " ", "i")).otherwise(c)


def function_words(c: Column) -> Column:
    """All Spanish function words, in order."""
    return F.regexp_extract_all(c, F.lit(java(P.SPANISH_FUNCTION_WORD, "i")), F.lit(0))


def two_function_words(c: Column) -> Column:
    """Whether two function words differ, looked for no further than the second."""
    counted = F.size(F.array_distinct(F.transform(function_words(c), F.lower))) >= 2
    return F.when(has_odd_letter(c), counted).otherwise(F.concat(F.lit(" "), c).rlike(java_words(P.SPANISH_FUNCTION_WORD, two=True)))


def reads_as_prose(skeleton: Column) -> Column:
    return has_words(skeleton, 3) & two_function_words(skeleton)


def mixed_prose(c: Column) -> Column:
    """Prose that quotes code: without its syntax a skeleton of function words is left."""
    return reads_as_prose(prose_skeleton(c))


def is_file_path_label(c: Column) -> Column:
    t = trimmed(strip_whole_line_bold(c))
    return ~matches(t, r"\s") & ~matches(t, P.URL_SCHEME, "i") & named(t, "file_path_label")


def label_text(c: Column) -> Column:
    """What a label is judged by: without bold marks and file names, white space evened."""
    return trimmed(replaced(without_file_tokens(trimmed(strip_whole_line_bold(c))), r"\s+", " "))


def cannot_be_label(c: Column) -> Column:
    """Lines that are no labels whatever else they hold; seen before a label's text is worked out."""
    return matches(c, P.NO_LABEL)


def reads_as_label(t: Column) -> Column:
    plain = named(t, "pure_text") & has_words(t, 2) & ~named(t, "keyword_start") & ~named(t, "shell_start")
    return plain & ((has_words(t, 4) & matches(t, r"[.:]$")) | named(t, "spanish_word"))


def is_spanish_label(c: Column) -> Column:
    return reads_as_label(label_text(c))


def looks_like_call(c: Column) -> Column:
    argument = trimmed(F.regexp_extract(c, java(P.FIRST_CALL), 1))
    return matches(c, P.FIRST_CALL) & ((argument == "") | matches(argument, P.CALL_ARGUMENT) | matches(argument, P.DOTTED_NAME) | matches(argument, P.NUMBER))


def is_gloss(c: Column) -> Column:
    a = trimmed(c)
    return (a != "") & ~matches(a, P.NOT_A_GLOSS) & matches(a, P.GLOSS)


def code_score(t: Column, trimmed_t: Column, ends_code: Column, words: Column, comment_tail: Column) -> Column:
    has_call = matches(trimmed_t, P.CALL_END)
    call_at_end = F.when(has_call, F.regexp_extract(trimmed_t, java(P.CALL_AT_END), 1))
    weights = (
        (named(t, "keyword_start"), 3),
        (named(t, "shell_start"), 3),
        (named(t, "api_tokens"), 3),
        (matches(t, P.ARROW), 3),
        (ends_code, 2),
        (comment_tail, 3),
        (matches(trimmed_t, P.KEY_VALUE) & (words <= 12), 2),
        (matches(t, P.METHOD_START), 2),
        (has_call & matches(trimmed_t, P.CALL_AT_END) & (words <= 10) & ~is_gloss(call_at_end), 2),
        (matches(t, P.OPERATORS_HINT) & matches(t, P.OPERATORS), 1),
        (matches(t, P.MEMBER_HINT) & matches(t, P.MEMBER), 1),
        (matches(t, P.BRACKET), 1),
        (~named(t, "accented"), 1),
        (words <= 4, 1),
    )
    score = F.lit(0)
    for test, weight in weights:
        score = score + F.when(test, weight).otherwise(0)
    return score
