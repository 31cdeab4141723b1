"""Folds over ordered rows of a key, where what a row does depends on all before it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import ship_package


def replay(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], list[tuple]], schema: str, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """What a fold says on the way: ``step`` takes the state of a key and the values of its next row, changes the state
    and returns the rows to put out, which come after the keys in ``schema``; ``finish`` returns those at its end.

    The rows of a key are sorted with spilling and stream through one task; what is held is the state alone, never a
    key's rows. Rows with a null key are left out; rows equal in the whole order stand in any order.
    """
    ship_package(rows.sparkSession)
    names = [*keys, *values]
    width = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch[c].tolist() for c in range(len(names))), strict=True):
                key = row[:width]
                if key != current:
                    if finish and current is not None:
                        out += [current + made for made in finish(state)]
                    current, state = key, start()
                out += [key + made for made in step(state, row[width:])]
            yield pd.DataFrame(out, columns=range(len(titles)))
        if finish and current is not None:
            yield pd.DataFrame([current + made for made in finish(state)], columns=range(len(titles)))

    titles = [c.split()[0] for c in schema.split(", ")]
    known = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    ordered = known.repartition(*keys).sortWithinPartitions(*keys, *order).select(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(names)])

    def renamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for made in run(b.set_axis(range(len(names)), axis=1) for b in batches):
            yield made.set_axis(titles, axis=1)

    return ordered.mapInPandas(renamed, schema)


def group_digests(members: DataFrame, group: str, key: str, prefix: str = "similarity-v1") -> DataFrame:
    """(group, group_id, n_members, first_key, last_key): the id of each group is the digest of its members' keys in order.

    Keys stream through a digest, sorted with spilling; no group is gathered. Repeated members count once.
    """

    def start() -> dict:
        return {"digest": hashlib.sha256(prefix.encode()), "n": 0, "first": None, "last": None}

    def step(state: dict, row: tuple) -> list[tuple]:
        if row[0] != state["last"]:
            state["digest"].update(row[0].encode())
            state["n"] += 1
            state["first"] = row[0] if state["first"] is None else state["first"]
            state["last"] = row[0]
        return []

    def finish(state: dict) -> list[tuple]:
        return [("sim-" + state["digest"].hexdigest()[:12], state["n"], state["first"], state["last"])]

    kind = members.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, group_id string, n_members int, first_key string, last_key string"
    return replay(members.where(F.col(key).isNotNull()), [group], [key], [key], start, step, schema, finish)


#: What an action makes of a decision and a lock; an action that isn't here leaves both.
ACTIONS: dict[str, Callable[[str | None, bool], tuple[str | None, bool]]] = {
    "keep": lambda decision, locked: ("keep", locked),
    "exclude": lambda decision, locked: ("exclude", locked),
    "restore": lambda decision, locked: (None, locked),
    "lock": lambda decision, locked: ("keep", True),
    "unlock": lambda decision, locked: (decision, False),
}


def replay_actions(log: DataFrame, project: str, order: str, entity: str, action: str) -> DataFrame:
    """The history of a project's review actions with undo and redo, one row per row of the log that had an effect.

    Every action is recorded with the state of its entity before and after it. ``undo`` puts the entity of the newest
    record that isn't undone back to its state before, ``redo`` that of the last undone one to its state after. A new
    action forgets what could be redone; records undone before it count as standing again, and can be undone once more.
    Undo and redo without a record, and unknown actions, have no effect.

    Result: project, seq (the row's place), record (number of the record it made, undid or redid, from 1), entity,
    action (what the record is), done (``do``, ``undo`` or ``redo``), decision, locked (the entity's state after).
    Held for each project: its records, two small states for each.
    """

    def start() -> dict:
        return {"records": [], "undone": 0, "states": {}}

    def step(state: dict, row: tuple) -> list[tuple]:
        seq, who, what = row
        records, states = state["records"], state["states"]
        if what in ACTIONS:
            before = states.get(who, (None, False))
            states[who] = ACTIONS[what](*before)
            records.append((who, what, before, states[who]))
            state["undone"] = 0
            return [(seq, len(records), who, what, "do", *states[who])]
        if what == "undo" and state["undone"] < len(records):
            number = len(records) - state["undone"]
            state["undone"] += 1
            who, what, states[who], _ = records[number - 1][0], records[number - 1][1], records[number - 1][2], None
            return [(seq, number, who, what, "undo", *states[who])]
        if what == "redo" and state["undone"]:
            number = len(records) - state["undone"] + 1
            state["undone"] -= 1
            who, what = records[number - 1][:2]
            states[who] = records[number - 1][3]
            return [(seq, number, who, what, "redo", *states[who])]
        return []

    kinds = {c: log.schema[c].dataType.simpleString() for c in (project, order, entity)}
    schema = f"{project} {kinds[project]}, seq {kinds[order]}, record bigint, {entity} {kinds[entity]}, action string, done string, decision string, locked boolean"
    return replay(log.where(F.col(entity).isNotNull() & F.col(action).isNotNull()), [project], [order], [order, entity, action], start, step, schema)


def standing_records(history: DataFrame, project: str) -> DataFrame:
    """The records of each project and whether each is undone at the end: undone are those above the last one standing.

    From the history of ``replay_actions``, by maxima alone: records made after the last action's are none, so a record
    is undone if it is after the newest step's, or is that step's and was undone by it.
    """
    last = history.groupBy(project).agg(F.max_by(F.struct("record", "done"), "seq").alias("last"))
    records = history.where("done = 'do'").select(project, "record", F.col("action"), *[c for c in history.columns if c not in (project, "seq", "record", "action", "done", "decision", "locked")])
    undone = (F.col("record") > F.col("last.record")) | ((F.col("record") == F.col("last.record")) & (F.col("last.done") == "undo"))
    return records.join(last, project).select(*records.columns, undone.alias("undone"))


def replay_transitions(log: DataFrame, job: str, order: str, target: str, first: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """Wanted changes of state against a table of allowed ones: (job, seq, from_state, to_state, accepted).

    A change that isn't allowed from the state a job is in is refused and leaves it there.
    """

    def start() -> dict:
        return {"state": first}

    def step(state: dict, row: tuple) -> list[tuple]:
        seq, wanted = row
        before = state["state"]
        fine = (before, wanted) in allowed
        if fine:
            state["state"] = wanted
        return [(seq, before, wanted, fine)]

    kinds = {c: log.schema[c].dataType.simpleString() for c in (job, order)}
    return replay(log, [job], [order], [order, target], start, step, f"{job} {kinds[job]}, seq {kinds[order]}, from_state string, to_state string, accepted boolean")
