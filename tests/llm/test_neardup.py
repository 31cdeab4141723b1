"""Near-duplicate fingerprints against brute force."""

import random

import pytest

from frameloom.llm.neardup import similar_fingerprints

SCHEMA = "h bigint, a string, b string, token bigint, s bigint"


def frame(spark, values):
    return spark.createDataFrame([(v, "x", None, 1, 2) for v in values], SCHEMA)


def brute(values, distance):
    known = [x for x in values if x is not None]
    v = sorted(set(known))
    return {(x, x) for x in v if known.count(x) > 1} | {(x, y) for i, x in enumerate(v) for y in v[i + 1 :] if (x ^ y).bit_count() <= distance}


def clustered(rng, n, width=63):
    out = []
    while len(out) < n:
        centre = rng.getrandbits(width)
        for _ in range(rng.randrange(1, 8)):
            v = centre
            for bit in rng.sample(range(width), rng.randrange(0, 12)):
                v ^= 1 << bit
            out.append(v)
    return out


@pytest.mark.parametrize("distance", [0, 2, 8, 11])
def test_all_pairs_are_found(spark, distance):
    values = [*clustered(random.Random(distance), 900), 0, (1 << 63) - 1, None, None, 0]
    got = [tuple(r) for r in similar_fingerprints(frame(spark, values), "h", distance=distance).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(values, distance)


def test_crowded_blocks_lose_no_pair(spark):
    rng = random.Random(5)
    low = 0b1011 << 3
    values = [v & ~((1 << 21) - 1) | low ^ (1 << rng.randrange(21) if rng.random() < 0.3 else 0) for v in clustered(rng, 500)]
    values += clustered(rng, 200)
    got = {tuple(r) for r in similar_fingerprints(frame(spark, values), "h", crowded=20).collect()}
    assert got == brute(values, 8)


def test_no_fingerprints(spark):
    assert similar_fingerprints(frame(spark, []), "h").count() == 0
    assert similar_fingerprints(frame(spark, [None]), "h").count() == 0
