"""Changes of tables as joins: keyed upserts with merge rules, folds of versions, cascading deletes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column, Column], Column]

#: What becomes of a column when a row is there already: (old, new, struct of the new row) -> value.
KEEP_OLD: Rule = lambda old, new, row: old
TAKE_NEW: Rule = lambda old, new, row: new
OLD_FIRST: Rule = lambda old, new, row: F.coalesce(old, new)
NEW_FIRST: Rule = lambda old, new, row: F.coalesce(new, old)
GREATEST: Rule = lambda old, new, row: F.greatest(old, new)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Rule], default: Rule = TAKE_NEW) -> DataFrame:
    """The table after ``new`` is put into ``old``: rows of either side alone stay, the rules merge those of both.

    Both sides have one row per key (see ``fold_versions`` for several) and the same columns; a key with a null
    matches a key with a null in the same place. Added: ``existed``, whether the key was there before. One full outer
    join on the keys; neither side is rewritten or broadcast.
    """
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("o"))
    b = new.select(*[F.col(k).alias(f"n{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("n"))
    on = reduce(lambda x, y: x & y, [F.col(f"k{i}").eqNullSafe(F.col(f"n{i}")) for i in range(len(keys))])
    both = a.join(b, on, "full_outer")
    value = lambda c: (
        F.when(F.col("n").isNull(), F.col("o")[c]).when(F.col("o").isNull(), F.col("n")[c]).otherwise(rules.get(c, default)(F.col("o")[c], F.col("n")[c], F.col("n")))
    )
    key = lambda i, k: F.when(F.col("o").isNull(), F.col(f"n{i}")).otherwise(F.col(f"k{i}")).alias(k)
    return both.select(*[key(i, k) for i, k in enumerate(keys)], *[value(c).alias(c) for c in columns], F.col("o").isNotNull().alias("existed"))


def fold_versions(versions: DataFrame, keys: Sequence[str], order: Sequence[str], first: Sequence[str] = (), last_known: Sequence[str] = ()) -> DataFrame:
    """One row per key out of its versions in order: columns in ``first`` from the oldest version, those in
    ``last_known`` from the newest that has a value, all others from the newest.

    A single aggregation with partial maxima, no window: a key with very many versions costs no sort.
    """
    stamp = F.struct(*order)
    rest = [c for c in versions.columns if c not in keys]
    pick = lambda c: (
        F.min_by(F.struct(c), stamp)[c] if c in first else F.max_by(F.col(c), F.when(F.col(c).isNotNull(), stamp)) if c in last_known else F.max_by(F.struct(c), stamp)[c]
    )
    return versions.groupBy(*keys).agg(*[pick(c).alias(c) for c in rest])


def cascade(tables: Mapping[str, tuple[DataFrame, str]], removed: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete by key in several tables: (what stays of each, how many rows each loses).

    ``tables`` maps a name to a frame and its column that refers to the key. Rows with a null reference stay.
    """
    gone = removed.select(F.col(key).alias("gone_key")).dropna().distinct()
    kept, lost = {}, []
    for name, (df, column) in tables.items():
        kept[name] = df.join(gone, F.col(column) == F.col("gone_key"), "left_anti")
        lost.append(df.select(column).join(gone, F.col(column) == F.col("gone_key"), "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_deleted")))
    return kept, reduce(DataFrame.unionByName, lost)


def event_state(events: DataFrame, entity: str, order: str, action: str) -> DataFrame:
    """The state that a log of review actions leaves: (entity, decision, locked).

    ``keep``, ``exclude`` and ``lock`` decide (a lock keeps), ``restore`` takes the decision back; ``lock`` and
    ``unlock`` set the lock. Each part of the state is that of its last action, so partial maxima suffice where a fold
    would need all events of an entity in order.
    """
    a, at = F.col(action), F.col(order)
    decides = a.isin("keep", "exclude", "restore", "lock")
    value = F.when(a == "exclude", "exclude").when(a.isin("keep", "lock"), "keep")
    decision = F.max_by(F.struct(value.alias("v")), F.when(decides, at))["v"]
    locked = F.max_by(a == "lock", F.when(a.isin("lock", "unlock"), at))
    return events.groupBy(entity).agg(decision.alias("decision"), F.coalesce(locked, F.lit(False)).alias("locked"))


def set_representatives(states: DataFrame, wanted: DataFrame, group: str, key: str) -> DataFrame:
    """Groups with another representative: (key, group, representative, status, locked, changed).

    ``states`` has key, group, representative, status and locked; ``wanted`` one key per group. Only where the wanted
    key belongs to the group does anything change: it is kept, locked members become warnings, all others are
    suggested for exclusion. One semi join finds the wishes that hold; repeated wishes for a group take the greatest.
    """
    one = wanted.groupBy(group).agg(F.max(key).alias("chosen"))
    held = one.join(states.select(F.col(group), F.col(key).alias("chosen")), [group, "chosen"], "left_semi")
    rows = states.join(held, group, "left")
    mine = F.col(key) == F.col("chosen")
    changed = F.col("chosen").isNotNull()
    status = F.when(~changed, F.col("status")).when(mine, "keep").when(F.col("locked"), "warning").otherwise("suggest_exclude")
    return rows.select(key, group, F.when(changed, mine).otherwise(F.col("representative")).alias("representative"), status.alias("status"), "locked", changed.alias("changed"))


def reset_columns(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """All rows with some columns set back; the others stay as they are."""
    return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def update_by_key(old: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of ``old`` with columns from ``changes`` (one row per key) where the key is there; keys only in ``changes`` add nothing."""
    new = changes.select(*keys, F.struct(*columns).alias("_new"))
    rows = old.join(new, list(keys), "left")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    return rows.select(*[pick(c) if c in columns else F.col(c) for c in old.columns])


def delete_by_key(old: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows that stay, which of the wanted keys were there): a wish for a key that isn't there removes nothing."""
    wanted = gone.select(key).dropna().distinct()
    found = wanted.join(old.select(key).distinct().withColumn("removed", F.lit(True)), key, "left")
    return old.join(wanted, key, "left_anti"), found.select(key, F.coalesce("removed", F.lit(False)).alias("removed"))
