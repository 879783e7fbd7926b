"""Text expressions: trimming, blankness and cutting into terms."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a maximal run of letters and digits of any script in the lower-cased text.
TERM = r"[\p{L}\p{Nd}]+"


def _other_numbers() -> str:
    """The number characters that are no decimal digits (fractions, superscripts, Roman numerals), as the inside of a character class."""
    odd = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl")]
    starts = [c for c, before in zip(odd, [-2, *odd], strict=False) if c != before + 1]
    ends = [c for c, after in zip(odd, [*odd[1:], -2], strict=False) if c + 1 != after]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


OTHER_NUMBERS = _other_numbers()
#: The same for Python's re, whose word characters also hold the underscore and the other numbers.
PY_TERM = rf"[^\W_{OTHER_NUMBERS}]+"
#: Runs of letters.
PY_LETTERS = rf"[^\W\d_{OTHER_NUMBERS}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_id(c: Column | str) -> Column:
    """The id without spaces at its ends; null where nothing but white space is left."""
    c = F.trim(_col(c))
    return F.when(~is_blank(c), c)


def is_blank(c: Column | str) -> Column:
    """True for empty or white-space-only values, null for null."""
    return _col(c).rlike(r"^[\s\p{Z}]*$")


def has_text(c: Column | str) -> Column:
    """True where the value is neither null nor blank; never null."""
    return F.coalesce(~is_blank(c), F.lit(False))


def terms(c: Column | str) -> Column:
    """The array of terms of a text, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TERM), F.lit(0))


def ascii_lower(c: Column | str) -> Column:
    """Lower-cases A to Z only; letters beyond ASCII stay as they are."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
