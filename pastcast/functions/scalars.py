"""Scalar Column expressions. Everything here is a built-in Spark expression
(JVM-side, whole-stage-codegen friendly); there is no Python UDF.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# White space of any script, the non-breaking kinds of workbooks included.
_SPACE = r"[\s\p{Z}\x1C-\x1F\x85]+"


# The same, character by character.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(x: str | Column) -> Column:
    """Text without white space, of any script, at both ends."""
    return F.btrim(_c(x).cast("string"), F.lit(_SPACES))


def norm_name(x: str | Column) -> Column:
    """Trim, collapse inner whitespace, upper-case."""
    return F.upper(F.trim(F.regexp_replace(_c(x), _SPACE, " ")))


# --- fixed values: textual sentinels that mean "no name" ---------------------
MISSING_NAMES = ["", "NAN", "NONE"]
# --- end of fixed values -----------------------------------------------------


def norm_key(x: str | Column) -> Column:
    """Normalised name, with blank and sentinel names as NULL."""
    n = norm_name(x)
    return F.when(n.isin(*MISSING_NAMES), F.lit(None).cast("string")).otherwise(n)


def blank_to_null(x: str | Column) -> Column:
    """Trimmed text, blank -> NULL."""
    return F.nullif(trimmed(x), F.lit(""))


def numeric_cell(x: str | Column) -> Column:
    """``,`` -> ``.``; blank / ``-`` / em-dash -> NULL; first number wins."""
    s = F.replace(_c(x).cast("string"), F.lit(","), F.lit("."))
    return F.nullif(F.regexp_extract(s, r"([-+]?\d*\.?\d+)", 1), F.lit("")).try_cast("double")


def int_cell(x: str | Column) -> Column:
    """B9 int variant: truncates toward zero (BIGINT; out of range -> NULL)."""
    return numeric_cell(x).try_cast("long")


_DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def time_to_seconds(x: str | Column) -> Column:
    """Minutes, ``'``, seconds, with ``''`` or ``.`` before the fraction: ``1'34''37`` and
    ``1'34.37`` -> 94.37, ``1'34`` -> 94, ``34''37`` and ``34.37`` -> 34.37, anything else NULL."""
    s = F.replace(trimmed(_c(x).cast("string")), F.lit("''"), F.lit("."))
    minutes, rest = F.regexp_extract(s, r"^([^']*)'(.*)$", 1), F.regexp_extract(s, r"^([^']*)'(.*)$", 2)
    number = lambda c: F.nullif(F.regexp_extract(trimmed(c), f"({_DECIMAL})", 1), F.lit("")).try_cast("double")
    return F.when(F.instr(s, "'") > 0, number(minutes) * 60 + number(rest)).otherwise(number(s))


def parse_ddmmyy(x: str | Column, pivot: int = 80) -> Column:
    """``dd/mm/yy`` or ``dd/mm/yyyy``; 2-digit years below ``pivot``
    are 2000s, others 1900s; impossible dates (31/02) are NULL."""
    s = trimmed(_c(x).cast("string"))
    yi = F.substring(s, 7, 4).try_cast("int")
    year = (F.when(F.length(s) == 8,
                   F.when(yi < pivot, yi + 2000).otherwise(yi + 1900))
            .otherwise(yi))
    txt = F.format_string("%04d-%s-%s", year, F.substring(s, 4, 2), F.substring(s, 1, 2))
    return F.when(s.rlike(r"^\d{2}/\d{2}/\d{2,4}$"), F.try_to_date(txt, "yyyy-MM-dd"))


def age_at_event(age_doc: Column, doc_year: Column, event_year: Column) -> Column:
    """max(2, age_doc - max(0, doc_year - event_year)); NULL stays NULL."""
    gap = F.greatest(F.lit(0), doc_year - event_year)
    return F.when(age_doc.isNull() | gap.isNull(), F.lit(None).cast("int")).otherwise(
        F.greatest(F.lit(2), age_doc - gap))


def label_from_position(pos: str | Column) -> Column:
    """1 if position in 1..3, 0 otherwise, NULL when there is no position."""
    return _c(pos).between(1, 3).cast("int")


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """C14: clip to [lo, hi] (NULL stays NULL)."""
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))
