"""Exact and visual near-duplicates within scopes, their groups and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.config import LARGEST_COMPARISON
from frameloom.functions.hashing import hamming
from frameloom.operators.replay import group_digests
from frameloom.session import cut, release

#: How far two assets may be apart to be compared.
SCOPES = ("source", "source_group", "project")


def exact_edges(assets: DataFrame) -> DataFrame:
    """(a, b, score): every further asset of a digest linked to the first, which keeps a digest's group connected.

    A star instead of all pairs: as many edges as copies, and the first asset comes from a map-side minimum.
    Assets without a digest are never linked.
    """
    known = assets.where("digest is not null and digest <> ''").select("asset_key", "digest").distinct()
    first = known.groupBy("digest").agg(F.min("asset_key").alias("a"))
    return known.join(first, "digest").where("asset_key > a").select("a", F.col("asset_key").alias("b"), F.lit(1.0).alias("score"))


#: A block value that more hashes of a scope share has its lists split by a second level of keys.
CROWDED = 2000


def _spans(bits: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of so many blocks of about equal width."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block_keys(value: Column, spans: list[tuple[int, int]], turned: bool) -> Column:
    """(part, bits) of every block of bits, and with ``turned`` also with each one bit turned."""
    keys = []
    for i, (first, width) in enumerate(spans):
        block = F.shiftright(value, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        for flip in [0, *(1 << j for j in range(width) if turned)]:
            keys.append(F.struct(F.lit(i).alias("part"), block.bitwiseXOR(F.lit(flip).cast("bigint")).alias("bits")))
    return F.array(*keys)


def _second_keys(value: Column, spans: list[tuple[int, int]], bits: int) -> Column:
    """Keys of the bits outside the block that ``key`` is of: these may hold all differences, so they are cut into as many
    blocks again; two hashes within the distance that share the first key share one of these too."""
    out = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("bits")))
    for i, (first, width) in enumerate(spans):
        rest = value.bitwiseAND(F.lit((1 << first) - 1).cast("bigint")).bitwiseOR(F.shiftleft(F.shiftright(value, first + width), first))
        out = F.when(F.col("hot") & (F.col("key.part") == i), _block_keys(rest, _spans(bits - width, len(spans)), True)).otherwise(out)
    return out


def near_pairs(assets: DataFrame, scope: str = "source", window_ms: int = 30_000, distance: int = 8, crowded: int = CROWDED) -> DataFrame:
    """(a, b): pairs of assets in one scope with different digests whose hashes are near.

    ``assets`` has asset_key, source_id, source_group, offset_ms, digest and hash. Two assets of the same source with
    offsets count only if these are at most ``window_ms`` apart. Candidates come from equi-joins on parts of the hash
    that near hashes share without fail. In the scope ``source`` these are distance + 1 bands, one of which is untouched
    by so many differences, with the time bucket: few keys, for small scopes. Otherwise, of distance // 3 + 1 blocks one
    has at most two differences, so its values with at most one bit turned meet: more keys, but each is shared by few.
    Values that more than ``crowded`` hashes of a scope share are split by keys of the other bits, without loss.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    part = {"source": F.col("source_id"), "source_group": F.col("source_group"), "project": F.lit("")}[scope]
    timed = scope == "source"
    spans = _spans(63, min(distance + 1 if timed else distance // 3 + 1, 63))
    rows = assets.where("hash is not null and asset_key is not null").select("asset_key", "source_id", "offset_ms", "digest", "hash", part.alias("part"))
    bucket = F.floor(F.col("offset_ms") / max(window_ms, 1)) if timed else F.lit(None).cast("bigint")
    rows = rows.withColumn("bucket", F.coalesce(bucket, F.lit(-1)))
    left = rows.withColumn("key", F.explode(_block_keys(F.col("hash"), spans, turned=not timed)))
    if not timed:
        values = rows.select("part", F.explode(_block_keys(F.col("hash"), spans, turned=False)).alias("key")).groupBy("part", "key").count()
        full = cut(values.where(F.col("count") > crowded).select("part", "key"))
        if full.limit(1).count():
            widest = max(width for _, width in spans)
            flips = F.array(*[F.lit(f).cast("bigint") for f in [0, *(1 << j for j in range(widest))]])
            near = F.transform(flips, lambda f: F.struct(F.col("key.part").alias("part"), F.col("key.bits").bitwiseXOR(f).alias("bits")))
            hot = full.select("part", F.explode(near).alias("key")).distinct().withColumn("hot", F.lit(True))
            left = left.join(hot, ["part", "key"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
            left = left.withColumn("second", F.explode(_second_keys(F.col("hash"), spans, 63))).drop("hot")
            left = left.withColumn("key", F.struct("key", "second")).drop("second")
        else:
            release(full)
    # An asset is met in its own time bucket, in the next one, and in bucket -1, where those without an offset look.
    ahead = F.when(F.col("bucket") < 0, F.array("bucket")).otherwise(F.array("bucket", F.col("bucket") + 1, F.lit(-1).cast("bigint"))) if timed else F.array("bucket")
    right = left.withColumn("bucket", F.explode(ahead))
    # The planner can't see how much the keys multiply the rows: without the hint it may broadcast them.
    a, b = left.alias("a"), right.hint("merge").alias("b")
    same = (F.col("a.source_id") == F.col("b.source_id")) & (F.abs(F.col("a.offset_ms") - F.col("b.offset_ms")) > window_ms)
    found = a.join(
        b,
        (F.col("a.part") == F.col("b.part")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.asset_key") != F.col("b.asset_key")) & ~F.coalesce(same, F.lit(False))
        & ~F.coalesce(F.col("a.digest") == F.col("b.digest"), F.lit(False)) & (hamming(F.col("a.hash"), F.col("b.hash")) <= distance),
    )
    return found.select(F.least("a.asset_key", "b.asset_key").alias("a"), F.greatest("a.asset_key", "b.asset_key").alias("b")).distinct()


def guard_comparisons(counts: DataFrame, column: str = "n_comparisons", limit: int = LARGEST_COMPARISON) -> int:
    """The number of comparisons that counts per scope add up to; ValueError where that is over the limit.

    For callers who want pairs compared one by one to be refused beforehand; ``near_pairs`` itself has no such limit.
    """
    total = int(counts.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])
    if total > limit:
        raise ValueError(f"{total} comparisons are over the limit of {limit}")
    return total


def ssim_sums(pixels: Column) -> Column:
    """What structural similarity needs of one pixel array: (sum, sum of squares), made once for each."""
    both = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("q"))
    return F.aggregate(pixels, both, lambda t, v: F.struct((t["s"] + v).alias("s"), (t["q"] + v.cast("bigint") * v).alias("q")))


def ssim(a: Column, b: Column, sums_a: Column, sums_b: Column) -> Column:
    """Structural similarity of two pixel arrays of the same size over one window (sample variances), from the sums of
    each; only their products are made for the pair."""
    n = F.size(a).cast("double")
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    products = F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("bigint") * q), F.lit(0).cast("bigint"), lambda s, v: s + v)
    ma, mb = sums_a["s"] / n, sums_b["s"] / n
    var = lambda t, m: (t["q"] - n * m * m) / (n - 1)
    cov = (products - n * ma * mb) / (n - 1)
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (var(sums_a, ma) + var(sums_b, mb) + c2))


def group_members(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Group id, representative and score of every member of a group of two or more.

    ``members`` has asset_key, root, locked, quality and offset_ms; ``edges`` a, b and score. The representative is the
    best by quality, then the earliest (no offset first), then the smallest key, among the locked members if there are
    any. The score of a member is the highest of its edges, that of the representative 1.
    """
    best = F.struct(F.when(F.col("locked"), 0).otherwise(1).alias("o"), (-F.col("quality")).alias("q"), F.coalesce("offset_ms", F.lit(-1)).alias("t"), "asset_key")
    groups = (
        members.groupBy("root").agg(F.count("*").alias("n_members"), F.min(best).alias("best"), (F.count_if("locked") > 1).alias("locked_conflict"))
        .where("n_members > 1").select("root", "n_members", F.col("best.asset_key").alias("chosen"), "locked_conflict")
        .join(group_digests(members, "root", "asset_key").select("root", "group_id"), "root")
    )
    scores = edges.select(F.col("a").alias("asset_key"), "score").unionByName(edges.select(F.col("b").alias("asset_key"), "score")).groupBy("asset_key").agg(F.max("score").alias("score"))
    return (
        members.select("asset_key", "root").join(groups, "root").join(scores, "asset_key", "left")
        .select(
            "asset_key", "group_id", "n_members", "locked_conflict", (F.col("asset_key") == F.col("chosen")).alias("representative"),
            F.when(F.col("asset_key") == F.col("chosen"), 1.0).otherwise(F.col("score")).alias("similarity_score"),
        )
    )


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by an order, all columns kept."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")
