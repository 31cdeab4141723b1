"""Changes by key, imports, histories and kernels on small tables with nulls, ties and repeats."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from frameloom.functions.kernels import luma, perceptual_hash, resize
from frameloom.operators import imports, replay, store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_update_and_delete_by_key(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (None, "c", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "gone"), (3, "z", "q")], "id int, v string, extra string")
    assert rows(store.update_by_key(old, new, ["id"], ["v"])) == [(1, "a", None), (2, None, "x"), (None, "c", "y")]
    kept, found = store.delete_by_key(old, spark.createDataFrame([(2,), (9,), (2,), (None,)], "id int"), "id")
    assert rows(kept) == [(1, "a", None), (None, "c", "y")] and rows(found) == [(2, True), (9, False)]
    assert store.delete_by_key(old.limit(0), new, "id")[1].where("removed").count() == 0


def test_representatives_only_of_their_own_group(spark):
    states = spark.createDataFrame([("a", "g", True, "keep", False), ("b", "g", False, "suggest_exclude", True), ("c", "g", False, "warning", False), ("d", "h", True, "keep", False), ("e", None, False, "keep", False)], "k string, g string, representative boolean, status string, locked boolean")
    wanted = spark.createDataFrame([("g", "c"), ("g", "b"), ("h", "a"), (None, "e")], "g string, k string")
    got = {r["k"]: (r["representative"], r["status"], r["changed"]) for r in store.set_representatives(states, wanted, "g", "k").collect()}
    assert got == {"a": (False, "suggest_exclude", True), "b": (False, "warning", True), "c": (True, "keep", True), "d": (True, "keep", False), "e": (False, "keep", False)}


def test_imports(spark):
    known = [("p", "D:\\a\\One.PNG", "image", 5, 1, "f1", True), ("q", "D:\\a\\two.png", "image", 6, 1, "f2", False), ("r", "D:\\a\\r1.mp4", "video", 7, 1, "f3", False), ("s", "D:\\a\\s1.mp4", "video", 7, 1, "f3", False), ("t", None, "image", 8, 1, None, False)]
    scan = [("d:\\A\\one.png", 5, 1, "f1"), ("D:\\A\\ONE.png", 5, 1, "f1"), ("D:\\b\\moved.png", 6, 9, "f2"), ("D:\\c\\again.png", 6, 9, "f2"), ("D:\\b\\x.mp4", 7, 1, "f3"), ("D:\\b\\note.txt", 3, 1, "f4"), ("D:\\b\\empty.png", 0, 1, "f5"), (None, 1, 1, "f"), ("D:\\n.png", 8, 1, None)]
    k = spark.createDataFrame(known, "id string, absolute_path string, kind string, size_bytes int, modified_unix_ms int, quick_fingerprint string, online boolean")
    s = spark.createDataFrame([(*r, "clash") for r in scan], "path string, size_bytes int, modified_unix_ms int, quick_fingerprint string, existing_id string")
    got = {r["path"]: (r["existing_id"], r["action"]) for r in imports.match_imports(s, k).collect()}
    assert got == {
        "D:\\A\\ONE.png": ("p", "unchanged"), "D:\\b\\moved.png": ("q", "updated"), "D:\\c\\again.png": (None, "imported"), "D:\\b\\x.mp4": (None, "imported"),
        "D:\\b\\note.txt": (None, "unsupported"), "D:\\b\\empty.png": (None, "failed"), "D:\\n.png": (None, "imported"),
    }
    status = {r["id"]: (r["new_status"], r["new_error"]) for r in imports.rescan_status(k, s).collect()}
    assert status == {"p": ("online", None), "q": ("offline", "missing"), "r": ("offline", "missing"), "s": ("offline", "missing"), "t": ("offline", "missing")}
    wishes = spark.createDataFrame([("p", "D:\\z.jpg", "f1"), ("p", "D:\\z.mp4", "f1"), ("p", "D:\\z.png", "f9"), ("zz", "D:\\z.png", "f1"), ("t", "D:\\z.png", None)], "id string, new_path string, new_fingerprint string")
    assert [r[2] for r in rows(imports.relink(k, wishes))] == [True, False, False, True, False]


def brute_history(log):
    records, undone, states, out = [], 0, {}, {}
    for seq, who, what in log:
        if what in replay.ACTIONS:
            before = states.get(who, (None, False))
            states[who] = replay.ACTIONS[what](*before)
            records.append((who, before, states[who]))
            undone = 0
        elif what == "undo" and undone < len(records):
            who, before, _ = records[len(records) - 1 - undone]
            undone += 1
            states[who] = before
        elif what == "redo" and undone:
            undone -= 1
            who, _, after = records[len(records) - 1 - undone]
            states[who] = after
    return states, len(records) - undone


def test_histories_with_undo_and_redo(spark):
    rng = random.Random(7)
    ops = ["keep", "exclude", "restore", "lock", "unlock", "undo", "undo", "redo", "nonsense", None]
    log = [(p, i, rng.choice(["x", "y", "z", None]), rng.choice(ops)) for p in range(12) for i in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in log] + [(None, 1, "x", "keep", "c")], "p int, at int, who string, what string, record string")
    history = replay.replay_actions(df, "p", "at", "who", "what").cache()
    last = {(r["p"], r["who"]): (r["s"]["decision"], r["s"]["locked"]) for r in history.groupBy("p", "who").agg(F.max_by(F.struct("decision", "locked"), "seq").alias("s")).collect()}
    standing = {r["p"]: r["n"] for r in replay.standing_records(history, "p").groupBy("p").agg(F.count_if(~F.col("undone")).alias("n")).collect()}
    for p in range(12):
        states, n = brute_history([(i, w, a) for q, i, w, a in log if q == p and w is not None and a is not None])
        assert {w: s for (q, w), s in last.items() if q == p} == states and standing.get(p, 0) == n


def test_undone_records_stand_again_after_a_new_action(spark):
    log = [(1, "a", "keep"), (2, "a", "exclude"), (3, "x", "undo"), (4, "b", "lock"), (5, "x", "undo"), (6, "x", "undo")]
    df = spark.createDataFrame([("p", *r) for r in log], "p string, at int, who string, what string")
    got = [(r["record"], r["who"], r["done"], r["decision"]) for r in replay.replay_actions(df, "p", "at", "who", "what").orderBy("seq").collect()]
    assert got == [(1, "a", "do", "keep"), (2, "a", "do", "exclude"), (2, "a", "undo", "keep"), (3, "b", "do", "keep"), (3, "b", "undo", None), (2, "a", "undo", "keep")]


def test_transitions(spark):
    df = spark.createDataFrame([("j", 1, "b"), ("j", 2, "c"), ("j", 3, "a"), ("j", 4, None), ("k", 1, "c"), (None, 1, "b")], "job string, at int, want string")
    got = rows(replay.replay_transitions(df, "job", "at", "want", "a", {("a", "b"), ("b", "c")}))
    assert got == [("j", 1, "a", "b", True), ("j", 2, "b", "c", True), ("j", 3, "c", "a", False), ("j", 4, "c", None, False), ("k", 1, "a", "c", False)]


def test_perceptual_hash_by_the_sums_it_stands_for():
    rng = np.random.default_rng(11)
    image = rng.integers(0, 256, (40, 52, 3)).astype(np.uint8)
    small = luma(resize(image, 32, 32)).astype(float)
    values = []
    for v in range(8):
        for u in range(8):
            if u or v:
                values.append(sum(small[y, x] * math.cos(math.pi * (2 * x + 1) * u / 64) * math.cos(math.pi * (2 * y + 1) * v / 64) for y in range(32) for x in range(32)))
    middle = sorted(values)[31]
    assert perceptual_hash(image) == sum(1 << i for i, x in enumerate(values) if x > middle)
