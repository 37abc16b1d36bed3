"""Text-cleaning column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation and letters with no one-letter base form, and their ASCII forms.
ASCII_FORMS = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th",
    "…": "...", "©": "(C)", "®": "(R)", "«": "<<", "»": ">>",
}
ASCII_CHARS = {
    "\u00d8": "O", "\u00f8": "o", "\u00d0": "D", "\u00f0": "d", "\u0110": "D", "\u0111": "d",
    "\u0141": "L", "\u0142": "l", "\u0131": "i",
    "\u2018": "'", "\u2019": "'", "\u201a": ",", "\u201c": '"', "\u201d": '"', "\u201e": '"',
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-",
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}


def _accented_letters() -> dict[str, str]:
    """Accented Latin letters whose canonical decomposition starts with an ASCII letter."""
    table = {}
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            table[chr(code)] = base
    return table


def strip_boilerplate(col: Column, patterns: Sequence[str]) -> Column:
    """Replace the first match of each pattern by one space."""
    for pattern in patterns:
        col = F.array_join(F.split(col, pattern, 2), " ")
    return col


def drop_soft_hyphens(col: Column) -> Column:
    return F.translate(col, "\u00ad", "")


def join_line_hyphens(col: Column) -> Column:
    """Join words hyphenated over a line break, letters on both sides."""
    return F.regexp_replace(col, r"(?U)-(?<=\p{L}-)\s*\r?\n\s*(?=\p{L})", "")


def join_gap_hyphens(col: Column) -> Column:
    """Join words hyphenated before two or more blanks, letters on both sides."""
    return F.regexp_replace(col, r"(?U)-(?<=\p{L}-)\s{2,}(?=\p{L})", "")


def flatten_newlines(col: Column) -> Column:
    return F.regexp_replace(col, r"[\r\n]+", " ")


def squish(col: Column) -> Column:
    """Collapse runs of (Unicode) white space and trim."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def pad_parentheses(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("("), F.lit(" ( ")), F.lit(")"), F.lit(" ) "))


def _fold(col: Column) -> Column:
    single = {**_accented_letters(), **ASCII_CHARS}
    col = F.translate(col, "".join(single), "".join(single.values()))
    for mark, form in ASCII_FORMS.items():
        col = F.replace(col, F.lit(mark), F.lit(form))
    return F.regexp_replace(col, r"[^\x00-\x7F]", "")


def fold_to_ascii(col: Column) -> Column:
    """Accented Latin letters and typographic marks to ASCII; drop what has no ASCII form.

    A text with as many bytes as characters is ASCII already and is not touched.
    """
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(_fold(col))


def clean_text(col: Column, patterns: Sequence[str] = ()) -> Column:
    """The whole cleaning chain as one expression.

    Squishing also flattens line breaks, and after it only plain blanks are left to collapse.
    """
    col = strip_boilerplate(col, patterns)
    col = squish(join_gap_hyphens(join_line_hyphens(drop_soft_hyphens(col))))
    col = fold_to_ascii(pad_parentheses(col))
    return F.trim(F.regexp_replace(col, " {2,}", " "))


def truncate(col: Column, max_chars: int) -> Column:
    return F.substring(col, 1, max_chars)


def char_count(col: Column) -> Column:
    return F.length(col)


def word_count(col: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(col, F.lit(r"\S+"))


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def norm_rater(col: Column) -> Column:
    return F.upper(F.regexp_replace(blank_if_null(col), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def spaces_for_hyphens(col: Column) -> Column:
    return F.translate(col, "-", " ")


def highlight(text: Column, phrase: Column) -> Column:
    """Wrap every case-insensitive literal occurrence of ``phrase`` in ``<mark>``."""
    literal = F.concat(F.lit(r"(?iu)\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    marked = F.regexp_replace(text, literal, F.lit("<mark>$0</mark>"))
    return F.when(phrase.isNull() | (phrase == ""), text).otherwise(marked)


def word_array(col: Column) -> Column:
    """Lower-case alphanumeric words in order, as an array."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda word: word != "")
