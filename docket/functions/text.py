"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, with the four separators that Java leaves out.
BLANK = r"[\s\x1c-\x1f]"
#: What does not print, line feed and tab excepted; marks that OCR leaves on lines of their own.
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]"
STRAY_LINE = "(?md)^[^a-zA-Z0-9ऀ-ॿ]{1,2}$"
#: Cells that stand for a missing value, compared in lower case after trimming.
MISSING = ("", "n/a", "na", "none", "null", "-", "--", "nil", "not available", "not applicable", "unknown")
#: Cells that a reader takes for missing as they stand, before trimming.
READ_AS_NULL = ("", "NA", "N/A", "NaN", "null", "None", "-", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN")
READ_AS_NULL += ("-nan", "1.#IND", "1.#QNAN", "<NA>", "NULL", "n/a", "nan")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, f"(?U){BLANK}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty; the last as it is."""
    return F.coalesce(*(blank_to_null(c) for c in columns[:-1]), columns[-1])


def clean_cell(c: Column) -> Column:
    tidy = collapse(strip(F.when(~c.isin(*READ_AS_NULL), c)))
    return F.when(~F.lower(tidy).isin(*MISSING), tidy)


def clean_text(c: Column, ocr: bool = False) -> Column:
    """Line ends as line feeds, single spaces, two line feeds at most, printable characters only; for OCR, no stray lines."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]+", " ")
    if ocr:
        c = F.regexp_replace(c, STRAY_LINE, "")
    c = F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), UNPRINTABLE, "")
    return F.regexp_replace(c, r"^[ \n\t]+|[ \n\t]+$", "")
