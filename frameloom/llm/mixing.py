"""Mixing sources to target shares by Poisson replication."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.session import ship_package, small_side

#: Cells of the histogram of the hash-seeded uniform numbers, by which the rate of each source is calibrated.
CELLS = 4096

#: A mix plan is configuration that the driver reads; more rows than this are refused.
PLAN_ROWS = 100_000


@dataclass
class Target:
    mix_name: str
    source: str
    target_share: float
    max_repeats: int
    budget: float = 0.0
    available: int = 0

    @property
    def tokens(self) -> float:
        return self.target_share * self.budget

    @property
    def exhausted(self) -> bool:
        return self.tokens >= self.max_repeats * self.available


def _uniform(seed: int, mix: Column, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed, the mix and the key only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), mix, key), 11) * F.lit(2.0**-53)


def poisson_cdf(rate: float, terms: int) -> list[float]:
    """P(X <= j) for j = 0 .. terms - 1 of a Poisson variable."""
    out, total = [], 0.0
    for j in range(terms):
        total += math.exp(-rate + (j * math.log(rate) if rate > 0 else (0.0 if j == 0 else -math.inf)) - math.lgamma(j + 1))
        out.append(min(total, 1.0))
    return out


def calibrated_rate(target: Target, cells: dict[int, int]) -> float:
    """The Poisson rate at which the inverted numbers of a source come to its target tokens.

    A document with number u occurs once for every j < max_repeats with u > P(X <= j), so the tokens of the source
    are the sum over j of the tokens above P(X <= j); that sum grows with the rate, which bisection finds.
    """
    above = [0.0] * (CELLS + 1)
    for c in range(CELLS - 1, -1, -1):
        above[c] = above[c + 1] + cells.get(c, 0)

    def tail(x: float) -> float:
        c = min(int(x * CELLS), CELLS - 1)
        return above[c + 1] + (above[c] - above[c + 1]) * (c + 1 - min(x * CELLS, CELLS))

    low, high = 0.0, 1.0
    got = lambda rate: sum(tail(p) for p in poisson_cdf(rate, target.max_repeats))
    while got(high) < target.tokens and high < 1e6:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if got(middle) < target.tokens else (low, middle)
    return (low + high) / 2


def _read_plan(sizes: DataFrame, plans: DataFrame, targets: DataFrame) -> list[Target]:
    rows = (
        targets.select("mix_name", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"))
        .where("mix_name is not null and source is not null")
        .distinct()
        .groupBy("mix_name", "source")
        .agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats"))
        .limit(PLAN_ROWS + 1)
        .collect()
    )
    ratios = dict(plans.where("mix_name is not null").groupBy("mix_name").agg(F.max("budget_ratio")).limit(PLAN_ROWS + 1).collect())
    if max(len(rows), len(ratios)) > PLAN_ROWS:
        raise ValueError(f"a mix plan of more than {PLAN_ROWS} rows")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    wanted = sizes.sparkSession.createDataFrame([(s,) for s in sorted({r["source"] for r in rows})], "source string")
    available = dict(sizes.join(F.broadcast(wanted), "source").groupBy("source").agg(F.sum("tokens")).collect())
    return [
        Target(r["mix_name"], r["source"], r["share"], max(0, r["repeats"]), (ratios.get(r["mix_name"]) or 0.0) * total, available.get(r["source"]) or 0)
        for r in sorted(rows)
    ]


def mix_sources(sizes: DataFrame, plans: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Choose documents and their repeats so that each source has its share of each mix; and report the shares.

    ``sizes`` has the key, source and tokens of every document; ``plans`` mix_name and budget_ratio (tokens of the
    mix per token of all documents); ``targets`` mix_name, source, target_share and max_repeats.

    Method: Poisson replication. Each document has a uniform number from a hash of seed, mix and key; the number of
    its copies is the inverse of the Poisson distribution at it, cut at ``max_repeats``. The rate of a source starts
    from its target repetition rate (target tokens / tokens it has) and is calibrated for the cut and for the draws:
    one pass gathers a histogram of the numbers by tokens, at most CELLS rows per target, from which a task for each
    target finds the rate. A source that can't reach its target even with all documents ``max_repeats`` times gives all of
    them; what it lacks is reported and not filled up by other sources.

    Result: (chosen, shares). chosen: mix_name, key, source, tokens, repeats (>= 1), one row per chosen document.
    shares: one row per target, also for sources without documents: mix_name, source, target_share, actual_share
    (of the mix's actual tokens), target_tokens, actual_tokens, documents, copies, exhausted. Documents without
    tokens (null and empty texts) or without a source are never chosen, but all tokens count for the budget.
    Repeated target rows count once, of different ones for the same mix and source the shares add up and the
    smaller max_repeats holds. Empty tables give empty results. The same seed gives the same mix, in any order.
    """
    spark = sizes.sparkSession
    ship_package(spark)
    sizes = sizes.select(F.col(key).alias("key"), "source", "tokens")
    plan = _read_plan(sizes, plans, targets)
    pairs = spark.createDataFrame([(t.mix_name, t.source) for t in plan], "mix_name string, source string")
    u = _uniform(seed, F.col("mix_name"), F.col("key"))
    drawn = sizes.where("tokens > 0 and source is not null").join(F.broadcast(pairs), "source").withColumn("u", u)

    wanted = spark.createDataFrame(
        [(t.mix_name, t.source, t.target_share, t.max_repeats, t.budget, t.available) for t in plan if t.available and t.tokens > 0],
        "mix_name string, source string, share double, repeats int, budget double, available bigint",
    )
    cell = F.floor(F.col("u") * CELLS).cast("int").alias("cell")
    cells = drawn.groupBy("mix_name", "source", cell).agg(F.sum("tokens").alias("n")).join(F.broadcast(wanted), ["mix_name", "source"])

    def calibrate(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.iloc[0]
        t = Target(r.mix_name, r.source, float(r.share), int(r.repeats), float(r.budget), int(r.available))
        # All documents of an exhausted source come as often as they may: the limit of ever higher rates.
        steps = [-1.0] * t.max_repeats if t.exhausted else poisson_cdf(calibrated_rate(t, dict(zip(rows.cell, rows.n, strict=True))), t.max_repeats)
        return pd.DataFrame({"mix_name": [t.mix_name], "source": [t.source], "steps": [steps]})

    # Each target's histogram has at most CELLS rows; the fitted steps are as few as the targets.
    inverse = small_side(cells.groupBy("mix_name", "source").applyInPandas(calibrate, "mix_name string, source string, steps array<double>"), PLAN_ROWS)
    chosen = (
        drawn.join(inverse, ["mix_name", "source"])
        .withColumn("repeats", F.size(F.filter("steps", lambda p: F.col("u") > p)))
        .where("repeats > 0")
        .select("mix_name", F.col("key").alias(key), "source", "tokens", "repeats")
    )
    table = spark.createDataFrame(
        [(t.mix_name, t.source, t.target_share, t.tokens, t.exhausted) for t in plan],
        "mix_name string, source string, target_share double, target_tokens double, exhausted boolean",
    )
    got = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("documents"), F.sum("repeats").alias("copies")
    )
    whole = got.groupBy("mix_name").agg(F.sum("actual_tokens").alias("mix_tokens"))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = (
        table.join(got, ["mix_name", "source"], "left")
        .join(whole, "mix_name", "left")
        .select(
            "mix_name", "source", "target_share",
            F.coalesce(F.col("actual_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share"),
            "target_tokens", number("actual_tokens"), number("documents"), number("copies"), "exhausted",
        )
    )
    return chosen, shares


def shuffled_copies(chosen: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """Every copy of every chosen document in one global order per mix, given by ``shuffle_key``.

    The order is a hash of seed, mix, document and copy: a range-partitioned sort shuffles all sources together.
    """
    copies = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return copies.select(
        "mix_name", F.xxhash64(F.lit(seed + 1), "mix_name", key, "copy").alias("shuffle_key"), key, "source", "copy"
    ).orderBy("mix_name", "shuffle_key")
