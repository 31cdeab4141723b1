"""Source mixes: shares, caps, repeatability and missing sources."""

import random

from frameloom.llm.mixing import mix_sources, poisson_cdf, shuffled_copies

SIZES = "doc_id bigint, source string, tokens bigint, mix_name string, u string, steps string"


def sizes(spark, n=4000, shuffle=False):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "small", None]), rng.choice([0, 5, 50, 300]), "x", "y", "z") for i in range(n)]
    if shuffle:
        rng.shuffle(rows)
    return spark.createDataFrame(rows, SIZES)


def plan(spark):
    plans = spark.createDataFrame([("m", 0.3), ("tight", 2.0), ("empty", None)], "mix_name string, budget_ratio double")
    targets = spark.createDataFrame(
        [("m", "big", 0.5, 1), ("m", "mid", 0.3, 6), ("m", "small", 0.2, 6), ("m", "small", 0.2, 6), ("m", "absent", 0.0, 3), ("tight", "small", 1.0, 2), ("empty", "big", 1.0, None)],
        "mix_name string, source string, target_share double, max_repeats int",
    )
    return plans, targets


def test_shares_and_caps(spark):
    chosen, shares = mix_sources(sizes(spark), *plan(spark))
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    assert len(got) == 6
    for source, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got["m", source]["actual_share"] - share) < 0.01
        assert abs(got["m", source]["actual_tokens"] / got["m", source]["target_tokens"] - 1) < 0.02
    assert got["m", "absent"]["actual_tokens"] == 0
    assert got["tight", "small"]["exhausted"] and got["tight", "small"]["actual_tokens"] < got["tight", "small"]["target_tokens"]
    rows = chosen.collect()
    caps = {("m", "big"): 1, ("m", "mid"): 6, ("m", "small"): 6, ("tight", "small"): 2}
    assert all(1 <= r["repeats"] <= caps[r["mix_name"], r["source"]] and r["tokens"] > 0 for r in rows)
    assert {r["repeats"] for r in rows if r["mix_name"] == "tight"} == {2}
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows)
    copies = shuffled_copies(chosen).collect()
    assert len(copies) == sum(r["repeats"] for r in rows)
    assert [(r["mix_name"], r["shuffle_key"]) for r in copies] == sorted((r["mix_name"], r["shuffle_key"]) for r in copies)


def test_the_seed_decides_whatever_the_order(spark):
    a = {tuple(r) for r in mix_sources(sizes(spark), *plan(spark))[0].collect()}
    b = {tuple(r) for r in mix_sources(sizes(spark, shuffle=True).repartition(7), *plan(spark))[0].collect()}
    c = {tuple(r) for r in mix_sources(sizes(spark), *plan(spark), seed=8)[0].collect()}
    assert a == b != c


def test_empty_tables(spark):
    plans, targets = plan(spark)
    chosen, shares = mix_sources(sizes(spark, 0), plans, targets)
    assert chosen.count() == 0 and {r["actual_tokens"] for r in shares.collect()} == {0}
    chosen, shares = mix_sources(sizes(spark, 50), plans.limit(0), targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0


def test_poisson():
    import math

    got = poisson_cdf(2.5, 6)
    want = [sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1)) for k in range(6)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want, strict=True))
    assert poisson_cdf(0.0, 3) == [1.0, 1.0, 1.0]
