"""Column functions on digests, fingerprints and bit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes at either end of a file that its quick fingerprint covers.
EDGE = 65_536


def little_endian(value: Column, width: int = 8) -> Column:
    """A non-negative number as so many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def quick_fingerprint(content: Column) -> Column:
    """SHA-256 over the size, the first 64 KiB and, of larger files, the last 64 KiB."""
    size = F.octet_length(content)
    tail = F.when(size > EDGE, F.substr(content, size - EDGE + 1, F.lit(EDGE))).otherwise(F.to_binary(F.lit(""), F.lit("utf-8")))
    return F.sha2(F.concat(little_endian(size), F.substring(content, 1, EDGE), tail), 256)


def item_hash(source: Column, candidate: Column, content: str, profile: Column, row: Column, column: Column, index: Column) -> Column:
    """The hash that names an export item: its source, candidate, content kind, profile, tile and index."""
    text = F.concat(source, F.coalesce(candidate, F.lit("source")), F.lit(content), F.coalesce(profile, F.lit("full-frame")))
    return F.sha2(F.concat(F.to_binary(text, F.lit("utf-8")), little_endian(row, 4), little_endian(column, 4), little_endian(index, 8)), 256)


def hamming(a: Column, b: Column) -> Column:
    """The number of bits in which two numbers differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hex16(value: Column) -> Column:
    """A number as 16 hexadecimal digits in lower case."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def group_id(keys: Column) -> Column:
    """The id of a group from the sorted array of its members' keys."""
    digest = F.sha2(F.concat(F.lit("similarity-v1"), F.array_join(keys, "")), 256)
    return F.concat(F.lit("sim-"), F.substring(digest, 1, 12))
