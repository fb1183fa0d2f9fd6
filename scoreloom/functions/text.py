"""Column expressions on text. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom import constants as K
from scoreloom.functions import sqltext as sql


def _members(runs) -> str:
    return "".join(chr(point) for first, last in runs for point in range(first, last + 1))


def _char_class(runs) -> str:
    return "[" + "".join(f"\\u{first:04X}-\\u{last:04X}" for first, last in runs) + "]"


# Java tests the ranges of a class one after another. Both classes are therefore
# intersected with a range or two that settle most characters at the first test:
# nothing below the Arabic blocks is Arabic, and no printable Latin, Greek,
# Cyrillic, Hebrew or Arabic character is white space.
WHITESPACE = _members(K.WHITESPACE_RUNS)
WHITESPACE_CLASS = "[[^!-\\u0084\\u00A1-\\u167F]&&" + _char_class(K.WHITESPACE_RUNS) + "]"
ARABIC_CLASS = "[[\\u0600-\\uFEFF]&&" + _char_class(K.ARABIC_BLOCKS) + "]"

# beyond this many words one pass of an alternation beats a pass per word
_LARGE_LIST = 64


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` alone drops U+0020 only)."""
    return F.trim(text, F.lit(WHITESPACE))


def normalize_digits(text: Column) -> Column:
    """ASCII digits to Arabic-Indic ones; null becomes the empty string."""
    text = text_or_empty(text)
    # most texts have no digit, and looking for one is cheaper than translating
    return F.when(text.rlike("[0-9]"), F.translate(text, K.ASCII_DIGITS, K.ARABIC_DIGITS)).otherwise(text)


def contains_any(body: str, words: Sequence[str]) -> str:
    """SQL test: does the text hold any of the words as a plain substring?

    A word that holds another word of the list adds nothing and is left out.
    """
    words = [w for i, w in enumerate(words) if not any(o in w and (o != w or j < i) for j, o in enumerate(words))]
    if len(words) <= _LARGE_LIST:
        found = sql.contains_any(body, words)
    else:
        quoted = "|".join("\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E" for word in words)
        found = f"{body} RLIKE {sql.text(quoted)}"
    if words and all(not word.isascii() for word in words):
        # pure ASCII text cannot hold any of them
        return f"(octet_length({body}) <> length({body}) AND {found})"
    return found


def words_of(text: Column) -> Column:
    """Split on runs of white space, no empty pieces."""
    return F.array_remove(F.split(text_or_empty(text), WHITESPACE_CLASS + "+"), "")


def tag_start(text: Column, opening: str) -> Column:
    """Position of the first opening tag, 0 if there is none."""
    return F.position(F.lit(opening), text)


def tag_end(text: Column, start: Column, opening: str, closing: str) -> Column:
    """Position of the first closing tag behind the opening one, 0 if there is none."""
    behind = start + F.lit(len(opening))
    return F.when(start > 0, F.position(F.lit(closing), text, behind)).otherwise(F.lit(0))


def tag_body(text: Column, start: Column, end: Column, opening: str) -> Column:
    """Text between the tags; null unless the pair is complete."""
    first = start + F.lit(len(opening))
    return F.when(end > 0, F.substr(text, first, end - first))
