"""Near-duplicate records by the similarity of their fingerprints, without pairwise comparison."""

from __future__ import annotations

import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.session import cut, release

#: Bits of a perceptual hash and the largest number of differing bits of a near copy.
BITS, DISTANCE = 63, 8

#: A block value held by more fingerprints than this has its inverted lists split by a second level of elements.
CROWDED = 2000

#: Fingerprints whose retained values one task makes: some 65 entries for each.
PART = 20_000

#: A list of crowded elements is broadcast up to this many rows (8 bytes each), and joined by shuffle beyond.
BROADCAST_ROWS = 500_000

# The element space: bit elements are negative, neighbourhood elements hold (block, value), so that one hash
# function orders all of them.
_BLOCK_SHIFT = 40


def _spark_hash(element: int) -> int:
    """What Spark's xxhash64 gives for a bigint."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", element), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _spans(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of so many blocks of about equal width."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _neighbourhood(h: Column, spans: list[tuple[int, int]]) -> list[Column]:
    """The elements of a fingerprint: of every block its value and the values one bit away."""
    out = []
    for i, (first, width) in enumerate(spans):
        value = F.shiftright(h, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        for flip in [0, *(1 << j for j in range(width))]:
            out.append(value.bitwiseXOR(F.lit(flip).cast("bigint")).bitwiseOR(F.lit(i << _BLOCK_SHIFT).cast("bigint")))
    return out


def _short(element: Column, *more: Column) -> Column:
    """The hash of an element, as 32 bits: equal elements have equal ones, and the few others that do cost a comparison."""
    return F.shiftright(F.xxhash64(element, *more), 32).cast("int")


def _bottom(elements: list[Column], k: int) -> Column:
    """The bottom-k sketch: the k smallest hash values of a set of elements."""
    hashed = F.sort_array(F.array(*[_short(e) for e in elements]))
    return F.slice(hashed, 1, k)


def _retained(bits: int) -> tuple[int, int]:
    """Masks of the positions whose element (position, 0), and (position, 1), is among the ``bits`` lowest-hashed ones.

    There are two elements for each position, so what two fingerprints have of the retained ones is all of their union
    below one hash value: its bottom-k sketch, with k the number of them that either has.
    """
    lowest = sorted(range(2 * bits), key=lambda e: _spark_hash(-1 - e))[:bits]
    return tuple(sum(1 << e // 2 for e in lowest if e % 2 == value) for value in (0, 1))


def _sketched(a: Column, b: Column, bits: int) -> tuple[Column, Column]:
    """How many retained elements both of two fingerprints have, and how many either has."""
    zero, one = (F.lit(m).cast("bigint") for m in _retained(bits))
    both, either = a.bitwiseAND(b), a.bitwiseOR(b)
    count = lambda x, mask: F.bit_count(x.bitwiseAND(mask))
    return count(F.bitwise_not(either), zero) + count(both, one), count(F.bitwise_not(both), zero) + count(either, one)


def similar_fingerprints(
    fingerprints: DataFrame, column: str, bits: int = BITS, distance: int = DISTANCE, crowded: int = CROWDED
) -> DataFrame:
    """All pairs (a < b) of different fingerprints that differ in at most ``distance`` bits, and a pair (a, a) for
    every fingerprint that several rows have.

    Method: bottom-k sketches from one hash function. A fingerprint is the set of its (position, bit) elements, in
    which a distance x is a Jaccard similarity of (bits - x) / (bits + x). For the candidates it is also the set of
    its neighbourhood elements: the value of each of ``distance // 3 + 1`` blocks of bits and all values one bit
    away. Two fingerprints within the distance agree in some block but for two bits, and so share at least two
    neighbourhood elements; of sets of n elements that share t, the bottom n - t + 1 values share at least one.
    With that k the inverted lists of retained values lose no pair. Rows with the same fingerprint meet in every list:
    they are one class, which stands in the lists once. The entries of a list are the fingerprints alone; what meets is
    filtered by the similarity estimated from the sketch of the union (its lowest bit elements; the bound is the least
    value that a pair within the distance can have), and the exact Jaccard similarity verifies.

    Lists of a block value that very many fingerprints share are split, without loss, by the neighbourhood of the
    other bits. The join spills and is split further by adaptive skew handling; only verified pairs are shuffled on.
    Nulls are ignored; an empty table gives an empty result.
    """
    if not 0 <= distance < bits <= 63:
        raise ValueError("distance must be under bits, and bits at most 63")
    spans = _spans(bits, distance // 3 + 1)
    h = F.col("h")
    base = cut(fingerprints.select(F.col(f"`{column}`").cast("bigint").alias("h")).where(h.isNotNull()).groupBy("h").agg(F.count("*").alias("n")))
    spread = base.select("h").repartition(max(1, -(-base.count() // PART)), "h")

    n = sum(width + 1 for _, width in spans)
    k = n - 1
    entries = spread.select("h", F.explode(_bottom(_neighbourhood(h, spans), k)).alias("token"))

    blocks = [
        F.shiftright(h, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).bitwiseOR(F.lit(i << _BLOCK_SHIFT).cast("bigint"))
        for i, (first, width) in enumerate(spans)
    ]
    full = cut(base.select(F.explode(F.array(*blocks)).alias("v")).groupBy("v").count().where(F.col("count") > crowded).select("v"))
    n_full = full.count()
    if n_full:
        widest = max(width for _, width in spans)
        flips = F.array(*[F.lit(f).cast("bigint") for f in [0, *(1 << j for j in range(widest))]])
        hot = (
            full.select(F.shiftright("v", _BLOCK_SHIFT).alias("block"), F.explode(F.transform(flips, lambda f: _short(F.col("v").bitwiseXOR(f)))).alias("token"))
            .distinct()
        )
        if n_full * (widest + 1) <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        second = F.array("token")
        for i, (first, width) in enumerate(spans):
            # The bits outside the block hold all differences in the worst case, and are cut into as many blocks again.
            rest = h.bitwiseAND(F.lit((1 << first) - 1).cast("bigint")).bitwiseOR(F.shiftleft(F.shiftright(h, first + width), first))
            finer = [_short(F.col("token"), e) for e in _neighbourhood(rest, _spans(bits - width, len(spans)))]
            second = F.when(F.col("block") == i, F.array(*finer)).otherwise(second)
        entries = entries.join(hot, "token", "left").select("h", F.explode(second).alias("token"))
    else:
        release(full)

    # The planner can't see how much the entries have grown out of the fingerprints: without the hint it may broadcast them.
    a, b = entries.alias("a"), entries.hint("merge").alias("b")
    differ = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    common, union = _sketched(F.col("a.h"), F.col("b.h"), bits)
    jaccard = (bits - differ) / (bits + differ)
    near = (
        a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.h") < F.col("b.h")) & (common >= union - 2 * distance) & (jaccard >= (bits - distance) / (bits + distance)))
        .select(F.col("a.h").alias("a"), F.col("b.h").alias("b"))
        .distinct()
    )
    return near.unionByName(base.where("n > 1").select(h.alias("a"), h.alias("b")))
