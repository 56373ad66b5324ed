"""Whitespace stripping and label normalisation as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() and str.split() remove.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RANGES = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same class; the wide ranges before && let most letters fail at once.
WHITESPACE_CLASS = r"[\x09-\x20\x{85}-\x{3000}&&[" + WHITESPACE_RANGES + "]]"

# Characters that may wrap an answer, and phrases that may lead it in.
WRAPPERS = " \t\"'`.,:;!?()[]{}<>"
LEAD_INS = [
    "the disease is",
    "the disease appears to be",
    "the disease appears as",
    "the disease is:",
    "disease:",
    "answer:",
    "prediction:",
    "predicted disease:",
    "the answer is",
]

LEAD_IN_PATTERN = (
    "^(?i:(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in LEAD_INS) + ")"
    + WHITESPACE_CLASS + "*)+"
)
# Hyphen, slashes, underscore and whitespace part words; what is neither part of a
# word nor between words is dropped.
WORD = r"0-9A-Za-z\p{L}\p{N}"
DROPPED = "[^" + WORD + r"\-/\\_" + WHITESPACE_RANGES + "]"
NOT_WORD = "[^" + WORD + "]+"
FIRST_LINE = "^" + WHITESPACE_CLASS + r"*([^\r\n]*)"


def strip(text: Column) -> Column:
    """Python's ``str.strip()``; Spark's ``trim`` knows the blank only."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_line(text: Column) -> Column:
    """The first non-empty line, stripped. CR counts as a line end.

    The pattern stops at the end of that line, however long the text is.
    """
    return F.rtrim(F.regexp_extract(text, FIRST_LINE, 1), F.lit(WHITESPACE))


def normalise_label(text: Column) -> Column:
    """Bring a label or a free-text answer into the form in which they are compared.

    First non-empty line, without wrapping punctuation and lead-in phrases, words
    joined by single underscores, other punctuation dropped, lower case. Null
    gives the empty string.
    """
    answer = F.btrim(first_line(F.coalesce(text, F.lit(""))), F.lit(WRAPPERS))
    answer = F.regexp_replace(answer, LEAD_IN_PATTERN, "")
    words = F.regexp_replace(F.regexp_replace(answer, DROPPED, ""), NOT_WORD, "_")
    return F.lower(F.btrim(words, F.lit("_")))


def clean_label(label: Column) -> Column:
    """A label as it enters the vocabulary: stripped, blank becomes null."""
    stripped = strip(label.cast("string"))
    return F.when(stripped != "", stripped)
