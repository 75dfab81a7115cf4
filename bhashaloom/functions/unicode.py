"""Column expressions for Unicode text that agree with Python's notion of letters and white space.

Java 17 knows Unicode 13. The two Indic letters added later are named by hand, so that a
Kannada or Telugu line counts the same letters in the JVM as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a regular-expression class: what Python's str.isspace accepts.
SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Inside of a class: letters; letters, combining marks and numbers.
LETTER = r"\p{L}\x{0C5D}\x{0CDD}"
ALNUM = r"\p{L}\p{M}\p{N}\x{0C5D}\x{0CDD}"


#: The same characters one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Text without white space at either end; null stays null."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text, never null."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def letters_and_digits(text: Column) -> Column:
    """Lower-case text reduced to letters, combining marks and numbers."""
    return F.regexp_replace(F.lower(text), f"[^{ALNUM}]+", "")


def words(text: Column) -> Column:
    """White-space pieces reduced to letters and digits, lower case, without empty ones. Null gives an empty array."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{ALNUM}{SPACE}]+", "")
    return F.filter(F.split(kept, f"[{SPACE}]+"), lambda w: w != "")


def pieces(text: Column) -> Column:
    """White-space pieces as they stand, without empty ones. Null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
