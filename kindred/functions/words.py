"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is not kept of a text, what is a number, and whitespace that is not a space.
# The classes are spelled out because \w and \s of the JVM know ASCII only, and
# would turn "élan" into "lan".
PUNCTUATION = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NUMBER = r"^\p{N}+$"
INNER_SPACE = r"[\t\x0B-\r\x1C-\x1F\x{85}\p{Z}&&[^ ]]"


def strip_punctuation(text: Column) -> Column:
    """Remove everything but letters, numbers, underscore and whitespace, in any script."""
    return F.regexp_replace(text, PUNCTUATION, "")


def strip_digits(text: Column) -> Column:
    """Remove decimal digits inside a text."""
    return F.regexp_replace(text, r"\p{Nd}", "")


def trim_tokens(text: Column) -> Column:
    """Drop whitespace other than a space next to a space or an end: every token is then trimmed.

    Done on the text, once, rather than on each token; most texts hold no such whitespace at all.
    """
    edge = f"{INNER_SPACE}+(?![^ ])|(?<![^ ]){INNER_SPACE}+"
    return F.when(text.rlike(INNER_SPACE), F.regexp_replace(text, edge, "")).otherwise(text)


def split_words(text: Column) -> Column:
    """Array of trimmed, lower-case tokens: a newline counts as a space, each single space splits."""
    return F.split(F.lower(trim_tokens(F.replace(text, F.lit("\n"), F.lit(" ")))), " ")


def is_number(word: Column) -> Column:
    """Whether a word is all numerals; what starts with a letter from a to z is not matched against the pattern."""
    return ~((word >= "a") & (word < "{")) & word.rlike(NUMBER)
