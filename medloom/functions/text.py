"""String functions as Column -> Column; all of them keep null as null unless they say otherwise.

White space and word characters follow Python's Unicode rules (no-break spaces are white space, accented letters are word
characters) through explicit classes, because the defaults of Java's regular expressions are ASCII only.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and masks that results depend on.
SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
ZERO_WIDTH = r"[\x{200b}-\x{200d}\x{feff}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(\+?\d{1,3}[\s-]?)?(\(?\d{2,4}\)?[\s-]?){2,4}\d{2,4}\b"
NUMBER = r"\b\d+\b"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Accented Latin letters and what is left without the accent.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) == 2)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim knows blanks only)."""
    return F.trim(c, F.lit(_SPACES))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def text_or_empty(c: Column) -> Column:
    """Any value as text; null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def stripped_or_null(c: Column) -> Column:
    """Without white space at the ends; blank as null."""
    return F.nullif(strip(c), F.lit(""))


def drop_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, ZERO_WIDTH, "")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def nfc(c: Column) -> Column:
    """Unicode normal form C. Only texts with a character beyond ASCII go through Python."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfc(c)).otherwise(c)


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents (also loose combining accents), without leaving the JVM."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def change_case(c: Column, mode: str = "lower") -> Column:
    if mode not in ("lower", "upper", "none"):
        raise ValueError(f"unknown case mode: {mode}")
    return {"lower": F.lower, "upper": F.upper, "none": lambda x: x}[mode](c)


def normalise(c: Column, case: str = "lower", accents: bool = True, spaces: bool = True) -> Column:
    """Zero-width characters, accents, case and white space, in that order."""
    c = drop_zero_width(c)
    c = c if accents else strip_accents(c)
    c = change_case(c, case)
    return collapse_spaces(c) if spaces else c


def clean_document(c: Column, keep_newlines: bool = False) -> Column:
    """Control characters as blanks; then white space collapsed, or line ends unified and at most one empty line kept."""
    c = F.regexp_replace(c, CONTROL, " ")
    if not keep_newlines:
        return collapse_spaces(c)
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t\f\x0b]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def single_line(c: Column) -> Column:
    """Lines joined by blanks."""
    return strip(F.regexp_replace(strip(c), LINE_END, " "))


def tokens(c: Column) -> Column:
    """Split at white space; no empty tokens."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda x: x != "")


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(rf"({WORD}+)"), F.lit(1))


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){NUMBER}", "<NUM>")


def mask_emails(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){EMAIL}", "<EMAIL>")


def mask_phones(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){PHONE}", "<PHONE>")


def preprocess(c: Column, lower: bool = True, numbers: bool = False, emails: bool = False, phones: bool = False) -> Column:
    """White space, case and masks in that order; blank or null as null, for the caller to skip and count."""
    steps = [collapse_spaces, *([F.lower] if lower else []), *([mask_numbers] if numbers else []), *([mask_emails] if emails else []), *([mask_phones] if phones else [])]
    return F.nullif(reduce(lambda x, step: step(x), steps, c), F.lit(""))


def fixed_field(line: Column, start: int, end: int) -> Column:
    """Characters start..end (from 0, end excluded) without white space at the ends; '' beyond a short line."""
    return strip(F.substring(line, start + 1, end - start))


def document_type(c: Column) -> Column:
    """A tag in its canonical spelling."""
    return F.translate(F.lower(strip(c)), " _", "--")


def file_tags(name: Column) -> Column:
    """Types of '#type#type_name.txt', in order, once each: what stands before the first underscore, split at '#'."""
    head = F.split(name, "_", 2)[0]
    return F.array_distinct(F.transform(F.filter(F.split(head, "#"), lambda x: strip(x) != ""), document_type))


def file_base(name: Column) -> Column:
    """The name of '#type#type_name.txt' without tags; a name without underscore keeps what follows the leading '#'."""
    parts = F.split(name, "_", 2)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(F.ltrim(name, F.lit("#")))


def context(text: Column, start: Column, end: Column, window: int = 60) -> Column:
    """Characters around a span with white space collapsed; '' for a negative span."""
    first = F.greatest(start - window, F.lit(0))
    last = F.least(F.length(text), end + window)
    return F.when((start < 0) | (end < 0), "").otherwise(collapse_spaces(F.substr(text, first + 1, last - first)))
