"""Orphan references: rows that point at keys which are missing, removed or arrived later."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a composite reference with nulls is judged, after the MATCH clause of SQL's foreign keys.
SEMANTICS = ("partial", "simple", "full")


def orphan_references(
    references: DataFrame,
    targets: DataFrame,
    removed: DataFrame,
    columns: Sequence[str],
    created: str,
    arrived: str,
    semantics: str = "partial",
) -> DataFrame:
    """Rows of ``references`` whose composite key has no target (in time), with the cause.

    Method: references are grouped by their null mask, and each mask is anti-joined with the targets on its
    non-null columns. ``columns`` name the key in all three frames. Declared match semantics:

    * ``partial``: a reference with nulls matches a target that agrees on the columns it has;
    * ``simple``: a reference with any null is satisfied;
    * ``full``: a reference with some but not all columns null is an orphan (cause ``missing``).

    A reference with all columns null is no case under any of them. Causes: ``late`` (the earliest
    ``arrived`` of the matching targets is after ``created``), ``removed`` (no target, but the key is in
    ``removed``), ``missing`` (neither). A null ``created`` or a target without any ``arrived`` is not late.

    Each mask reduces targets and removals to one row per key first (map-side), so a join never multiplies
    reference rows; a reference key held by very many rows is split by adaptive skew handling, because the
    reference side is the streamed side of a left join. Repeated reference rows come out repeated, with all
    their columns (one named ``cause`` gives way to the result's); columns of ``targets`` and ``removed`` other than those named are ignored. Empty frames
    are fine: without targets every reference is ``removed`` or ``missing``.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    columns = list(columns)
    names = [n for n in references.columns if n.lower() != "cause"]
    parts = []
    for mask in product((True, False), repeat=len(columns)):
        used = [c for c, there in zip(columns, mask, strict=True) if there]
        if not used or (semantics == "simple" and len(used) < len(columns)):
            continue
        of_mask = references.where(
            reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() == F.lit(m) for c, m in zip(columns, mask, strict=True)])
        ).select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(used)], F.col(f"`{created}`").alias("made"))
        if semantics == "full" and len(used) < len(columns):
            parts.append(of_mask.select("row.*", F.lit("missing").alias("cause")))
            continue
        keys = [f"k{i}" for i in range(len(used))]
        there = (
            targets.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, used, strict=True)], F.col(f"`{arrived}`").alias("came"))
            .dropna(subset=keys)
            .groupBy(*keys)
            .agg(F.min("came").alias("came"), F.lit(True).alias("there"))
        )
        gone = (
            removed.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(keys, used, strict=True)])
            .dropna(subset=keys)
            .groupBy(*keys)
            .agg(F.lit(True).alias("gone"))
        )
        orphan = of_mask.join(there, keys, "left").where(F.col("there").isNull() | (F.col("came") > F.col("made")))
        parts.append(
            orphan.join(gone, keys, "left").select(
                "row.*",
                F.when(F.col("there"), "late").when(F.col("gone"), "removed").otherwise("missing").alias("cause"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
