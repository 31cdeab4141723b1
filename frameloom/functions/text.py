"""Column functions on text: white space, case and key normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property, and the separators U+001C..U+001F
# that Unicode-aware trimming functions also remove.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_blank(text: Column) -> Column:
    """Remove Unicode white space at both ends; null stays null."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def plain(text: Column) -> Column:
    """The plain form of a key: trimmed and in lower case; null stays null."""
    return F.lower(trim_blank(text))


def plain_key(text: Column) -> Column:
    """The plain form of a key, null where nothing is left of it."""
    return F.nullif(plain(text), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case of A..Z only, as ASCII case-insensitive collations fold."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
