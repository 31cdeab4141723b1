"""Queries over decisions: the history of actions with undo and redo, what decisions make of statuses, and re-analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import replay, store
from frameloom.queries import quality, review, similarity, views
from frameloom.sources.tables import read_table

# The states of a job and the changes between them that are allowed.
STATES = ("draft", "estimated", "queued", "running", "awaiting_review", "exporting", "completed", "completed_with_errors", "cancelling", "cancelled", "interrupted", "failed")
CHANGES = {
    ("draft", "estimated"), ("estimated", "queued"), ("queued", "running"), ("running", "awaiting_review"), ("awaiting_review", "exporting"),
    ("exporting", "completed"), ("exporting", "completed_with_errors"), ("running", "cancelling"), ("exporting", "cancelling"), ("cancelling", "cancelled"),
    ("running", "interrupted"), ("exporting", "interrupted"), ("interrupted", "queued"), ("running", "failed"),
}

_OPS = {"view": "keep", "error": "exclude", "signup": "lock", "click": "undo", "purchase": "redo"}


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a log of actions on five assets of each project."""
    lookup = F.create_map(*[F.lit(x) for pair in _OPS.items() for x in pair])
    return read_table(spark, folder, "events").select(F.col("user_id").alias("project"), "event_id", (F.col("event_id") % 5).alias("asset"), lookup[F.col("event_type")].alias("action"))


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return replay.replay_actions(_log(spark, folder), "project", "event_id", "asset", "action")


def review_undo_redo(spark: SparkSession, folder: str) -> DataFrame:
    """The decision and lock of every asset after all actions, undos and redos of its project."""
    last = F.max_by(F.struct("decision", "locked"), "seq").alias("s")
    return _history(spark, folder).groupBy("project", "asset").agg(last).select("project", "asset", "s.decision", "s.locked")


def undoable_events(spark: SparkSession, folder: str) -> DataFrame:
    """The record that an undo would take in each project: the newest that isn't undone."""
    standing = replay.standing_records(_history(spark, folder), "project").where("not undone")
    return standing.groupBy("project").agg(F.max(F.struct("record", "asset", "action")).alias("r")).select("project", "r.*")


def redo_stack(spark: SparkSession, folder: str) -> DataFrame:
    """The undone records of each project in the order in which they would be redone."""
    undone = replay.standing_records(_history(spark, folder), "project").where("undone")
    first = undone.groupBy("project").agg(F.min("record").alias("lowest"))
    return undone.join(first, "project").select("project", "record", "asset", (F.col("record") - F.col("lowest") + 1).alias("place"))


def job_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted changes of the state of jobs, and whether each is allowed from where the job is."""
    names = F.array(*map(F.lit, STATES))
    wanted = read_table(spark, folder, "events").select(F.col("user_id").alias("job"), "event_id", names[(F.col("event_id") % len(STATES)).cast("int")].alias("wanted"))
    return replay.replay_transitions(wanted, "job", "event_id", "wanted", STATES[0], CHANGES)


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """Where every job ends, with the numbers of accepted and refused changes."""
    rows = job_transitions(spark, folder)
    end = F.max_by(F.when(F.col("accepted"), F.col("to_state")).otherwise(F.col("from_state")), "seq").alias("state")
    return rows.groupBy("job").agg(end, F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused"))


def decided(key: Column) -> Column:
    """The manual decision on an asset; here its last digit stands for one."""
    last = F.substring(key, -1, 1)
    return F.when(last.isin("0", "1"), "exclude").when(last.isin("2", "3", "4"), "keep")


def locked(key: Column) -> Column:
    return F.substring(key, -1, 1).isin("3", "5")


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of exact copies in the shape of similarity groups; the representative is the smallest key."""
    rows = similarity.review_assets(spark, folder).where("digest is not null and digest <> ''").select("asset_key", "digest").distinct()
    groups = rows.groupBy("digest").agg(F.min("asset_key").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, "digest").select("asset_key", F.substring("digest", 1, 12).alias("group_id"), (F.col("asset_key") == F.col("first")).alias("representative"))


def _states(spark: SparkSession, folder: str) -> DataFrame:
    """Every asset with what the analysis, its group and the reviewer say of it."""
    every = read_table(spark, folder, "review_inputs").where("asset_key is not null").select("asset_key").distinct()
    measured = views.metrics(spark, folder).select("asset_key", F.coalesce("pinned", F.lit(False)).alias("pinned"), quality.reasons().alias("reasons"))
    rows = every.join(measured, "asset_key", "left").join(_grouped(spark, folder), "asset_key", "left")
    clear = F.size("reasons") == 0
    held = locked(F.col("asset_key"))
    status = (
        F.when(F.col("reasons").isNull(), "error")
        .when(F.col("representative"), F.when(clear, "keep").otherwise("warning"))
        .when(F.col("group_id").isNotNull(), F.when(held, "warning").otherwise("suggest_exclude"))
        .when(clear, "keep").when(F.col("pinned"), "warning").otherwise("suggest_exclude")
    )
    better = F.concat(F.lit("相似组 "), F.col("group_id"), F.lit(" 中存在更合适的代表图"))
    reasons = F.when(F.col("group_id").isNotNull() & ~F.col("representative"), F.concat("reasons", F.array(better))).otherwise(F.col("reasons"))
    return rows.select("asset_key", "group_id", "representative", reasons.alias("reasons"), status.alias("automatic"), decided(F.col("asset_key")).alias("manual"), held.alias("locked"))


def grouped_status(spark: SparkSession, folder: str) -> DataFrame:
    """What a group makes of the status and reasons of its members."""
    rows = _states(spark, folder).where("group_id is not null")
    return rows.select("asset_key", "group_id", "representative", F.to_json("reasons").alias("reasons_json"), "automatic")


def effective_status(spark: SparkSession, folder: str) -> DataFrame:
    """The status that is shown: the reviewer's decision before that of the analysis."""
    shown = F.when(F.col("manual") == "exclude", "excluded").when(F.col("manual") == "keep", "keep").otherwise(F.col("automatic"))
    return _states(spark, folder).select("asset_key", "automatic", "manual", shown.alias("status"))


def review_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The eight counters over all assets, in one aggregation; warnings and failures count whatever the reviewer says."""
    open_ = F.col("manual").isNull()
    is_ = lambda v: F.col("automatic") == v
    return _states(spark, folder).agg(
        F.count("*").alias("n_total"), F.count_if((F.col("manual").eqNullSafe("keep")) | (open_ & is_("keep"))).alias("n_keep"), F.count_if(open_ & is_("suggest_exclude")).alias("n_suggested"),
        F.count_if(F.col("manual").eqNullSafe("exclude")).alias("n_excluded"), F.count_if(is_("warning")).alias("n_warning"), F.count_if(is_("error")).alias("n_failed"),
        F.count_if("locked").alias("n_locked"), F.countDistinct("group_id").alias("n_groups"),
    )


def review_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Items of one shown status, per source group: the filter of the review grid with a manual status."""
    items = review._items(spark, folder).select("asset_key", "source_group")
    chosen = effective_status(spark, folder).where("status = 'excluded'")
    return items.join(chosen, "asset_key").groupBy("source_group", "status").agg(F.count("*").alias("n_items"))


def group_representative_update(spark: SparkSession, folder: str) -> DataFrame:
    """Every group with another representative, where the wanted one belongs to it (here its greatest key; groups whose
    id begins with a digit ask for an asset they don't have, and stay as they are)."""
    members = _grouped(spark, folder)
    wanted = members.groupBy("group_id").agg(F.max("asset_key").alias("asset_key"))
    wanted = wanted.withColumn("asset_key", F.when(F.col("group_id") < "a", F.lit("candidate:none")).otherwise(F.col("asset_key")))
    states = _states(spark, folder).select("asset_key", "group_id", "representative", F.col("automatic").alias("status"), "locked").where("group_id is not null")
    return store.set_representatives(states, wanted, "group_id", "asset_key")


def review_reset(spark: SparkSession, folder: str) -> DataFrame:
    """The review rows as a new analysis finds them: automatic columns at their beginning, decisions and locks kept."""
    return store.reset_columns(_states(spark, folder), {"automatic": F.lit("keep"), "reasons": F.array().cast("array<string>"), "group_id": F.lit(None).cast("string"), "representative": F.lit(False)}).withColumn("reasons", F.to_json("reasons"))


def review_upsert_preserve(spark: SparkSession, folder: str) -> DataFrame:
    """A second analysis put over a first one (runs before and from July 2025): statuses are new, decisions and locks stay;
    a row that wasn't there is locked if it is pinned."""
    rows = read_table(spark, folder, "review_inputs").where("asset_key is not null").withColumn("at", F.col("analyzed_at"))
    scored = rows.select("asset_key", "at", F.coalesce("pinned", F.lit(False)).alias("locked"), F.when(F.col("decode_error").isNotNull(), "error").otherwise("keep").alias("automatic"))
    fold = lambda df: store.fold_versions(df.distinct(), ["asset_key"], ["at", "automatic", "locked"])
    old = fold(scored.where("at < '2025-07-01'")).withColumn("manual", decided(F.col("asset_key")))
    new = fold(scored.where("at >= '2025-07-01'")).withColumn("manual", F.lit(None).cast("string"))
    put = store.upsert(old, new, ["asset_key"], {"locked": store.KEEP_OLD, "manual": store.KEEP_OLD})
    return put.select("asset_key", "automatic", "manual", "locked", "existed")


QUERIES = {
    f.__name__: f
    for f in (
        review_undo_redo, undoable_events, redo_stack, job_transitions, job_states, grouped_status, effective_status, review_counts, review_grid,
        group_representative_update, review_reset, review_upsert_preserve,
    )
}

# States are 2 * decision (0 none, 1 keep, 2 exclude) + lock here.
_H = """WITH RECURSIVE l AS (SELECT user_id AS project, event_id AS seq, event_id % 5 AS asset, event_type AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  f AS (SELECT DISTINCT project, 0::BIGINT AS i, 0 AS k, []::STRUCT(asset BIGINT, op VARCHAR, a INT, b INT)[] AS ev, [0, 0, 0, 0, 0]::INT[] AS st, NULL::BIGINT AS touched FROM l
    UNION ALL SELECT project, i, CASE WHEN act THEN 0 WHEN un THEN k + 1 WHEN re THEN k - 1 ELSE k END,
      CASE WHEN act THEN list_append(ev, {'asset': asset, 'op': op, 'a': st[asset + 1], 'b': new}) ELSE ev END,
      list_transform(st, lambda v, j: CASE WHEN act AND j = asset + 1 THEN new WHEN un AND j = ev[n - k].asset + 1 THEN ev[n - k].a WHEN re AND j = ev[n - k + 1].asset + 1 THEN ev[n - k + 1].b ELSE v END),
      CASE WHEN act THEN asset WHEN un THEN ev[n - k].asset WHEN re THEN ev[n - k + 1].asset END
    FROM (SELECT l.project, l.i, l.asset, l.op, k, ev, st, len(ev)::INT AS n, l.op IN ('view', 'error', 'signup') AS act, l.op = 'click' AND k < len(ev) AS un, l.op = 'purchase' AND k > 0 AS re,
      CASE l.op WHEN 'view' THEN 2 + st[l.asset + 1] % 2 WHEN 'error' THEN 4 + st[l.asset + 1] % 2 ELSE 3 END AS new FROM f JOIN l ON l.project = f.project AND l.i = f.i + 1)),
  e AS (SELECT project, max_by(k, i) AS k, max_by(ev, i) AS ev, max_by(st, i) AS st, list(DISTINCT touched) AS touched FROM f GROUP BY project),
  x AS (SELECT project, k, len(ev) AS n, unnest(generate_series(1, len(ev))) AS record, unnest(ev) AS v FROM e)"""
_OP = "CASE op WHEN 'view' THEN 'keep' WHEN 'error' THEN 'exclude' ELSE 'lock' END"
_J = f"""WITH RECURSIVE allowed AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in sorted(CHANGES))}) t(a, b)),
  l AS (SELECT user_id AS job, event_id AS seq, {list(STATES)}[event_id % {len(STATES)} + 1] AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  f AS (SELECT DISTINCT job, 0::BIGINT AS i, NULL::BIGINT AS seq, ''::VARCHAR AS from_state, ''::VARCHAR AS to_state, false AS accepted, 'draft' AS state FROM l
    UNION ALL SELECT l.job, l.i, l.seq, f.state, wanted, EXISTS (SELECT 1 FROM allowed WHERE a = f.state AND b = wanted), CASE WHEN EXISTS (SELECT 1 FROM allowed WHERE a = f.state AND b = wanted) THEN wanted ELSE f.state END
    FROM f JOIN l ON l.job = f.job AND l.i = f.i + 1)"""
_DECIDED = "CASE WHEN right(asset_key, 1) IN ('0', '1') THEN 'exclude' WHEN right(asset_key, 1) IN ('2', '3', '4') THEN 'keep' END"
_LOCKED = "right(asset_key, 1) IN ('3', '5')"
_S = f"""{similarity._R}, d AS (SELECT DISTINCT asset_key, digest FROM r WHERE digest <> ''),
  g AS (SELECT asset_key, left(digest, 12) AS group_id, asset_key = min(asset_key) OVER (PARTITION BY digest) AS representative FROM d QUALIFY count(*) OVER (PARTITION BY digest) > 1),
  q AS (SELECT asset_key, coalesce(pinned, false) AS pinned, {quality._REASONS} AS reasons FROM metrics),
  states AS (SELECT asset_key, group_id, representative, CASE WHEN representative = false THEN list_append(reasons, '相似组 ' || group_id || ' 中存在更合适的代表图') ELSE reasons END AS reasons,
    CASE WHEN reasons IS NULL THEN 'error' WHEN representative THEN CASE WHEN len(reasons) = 0 THEN 'keep' ELSE 'warning' END WHEN group_id IS NOT NULL THEN CASE WHEN {_LOCKED} THEN 'warning' ELSE 'suggest_exclude' END
      WHEN len(reasons) = 0 THEN 'keep' WHEN pinned THEN 'warning' ELSE 'suggest_exclude' END AS automatic, {_DECIDED} AS manual, {_LOCKED} AS locked
    FROM (SELECT DISTINCT asset_key FROM review_inputs WHERE asset_key IS NOT NULL) LEFT JOIN q USING (asset_key) LEFT JOIN g USING (asset_key))"""
_SHOWN = "CASE manual WHEN 'exclude' THEN 'excluded' WHEN 'keep' THEN 'keep' ELSE automatic END"

ORACLES = {
    "review_undo_redo": _H + " SELECT project, asset, CASE st[asset + 1] // 2 WHEN 1 THEN 'keep' WHEN 2 THEN 'exclude' END AS decision, st[asset + 1] % 2 = 1 AS locked FROM (SELECT project, st, unnest(touched) AS asset FROM e) WHERE asset IS NOT NULL",
    "undoable_events": _H + f", y AS (SELECT project, v.asset AS asset, v.op AS op, record FROM x WHERE record = n - k) SELECT project, record, asset, {_OP} AS action FROM y",
    "redo_stack": _H + " SELECT project, record, v.asset AS asset, record - (n - k) AS place FROM x WHERE record > n - k",
    "job_transitions": _J + " SELECT job, seq, from_state, to_state, accepted FROM f WHERE i > 0",
    "job_states": _J + " SELECT job, max_by(state, i) AS state, count(*) FILTER (accepted) AS n_accepted, count(*) FILTER (NOT accepted) AS n_refused FROM f WHERE i > 0 GROUP BY job",
    "grouped_status": f"WITH {_S} SELECT asset_key, group_id, representative, to_json(reasons)::VARCHAR AS reasons_json, automatic FROM states WHERE group_id IS NOT NULL",
    "effective_status": f"WITH {_S} SELECT asset_key, automatic, manual, {_SHOWN} AS status FROM states",
    "review_counts": f"""WITH {_S} SELECT count(*) AS n_total, count(*) FILTER (manual = 'keep' OR (manual IS NULL AND automatic = 'keep')) AS n_keep, count(*) FILTER (manual IS NULL AND automatic = 'suggest_exclude') AS n_suggested,
        count(*) FILTER (manual = 'exclude') AS n_excluded, count(*) FILTER (automatic = 'warning') AS n_warning, count(*) FILTER (automatic = 'error') AS n_failed, count(*) FILTER (locked) AS n_locked, count(DISTINCT group_id) AS n_groups FROM states""",
    "review_grid": f"WITH {_S} SELECT a.source_group, 'excluded' AS status, count(*) AS n_items FROM states s JOIN metrics m USING (asset_key) JOIN assets a ON lower(a.id) = lower(trim(m.source_id)) WHERE manual = 'exclude' GROUP BY ALL",
    "group_representative_update": f"""WITH {_S}, w AS (SELECT group_id, CASE WHEN group_id < 'a' THEN 'candidate:none' ELSE max(asset_key) END AS w FROM g GROUP BY group_id)
        SELECT asset_key, group_id, CASE WHEN w = 'candidate:none' THEN representative ELSE asset_key = w END AS representative,
          CASE WHEN w = 'candidate:none' THEN automatic WHEN asset_key = w THEN 'keep' WHEN locked THEN 'warning' ELSE 'suggest_exclude' END AS status, locked, w <> 'candidate:none' AS changed
        FROM states JOIN w USING (group_id)""",
    "review_reset": f"SELECT DISTINCT asset_key, NULL::VARCHAR AS group_id, false AS representative, '[]' AS reasons, 'keep' AS automatic, {_DECIDED} AS manual, {_LOCKED} AS locked FROM review_inputs WHERE asset_key IS NOT NULL",
    "review_upsert_preserve": f"""WITH r AS (SELECT DISTINCT asset_key, analyzed_at AS t, coalesce(pinned, false) AS locked, CASE WHEN decode_error IS NULL THEN 'keep' ELSE 'error' END AS automatic FROM review_inputs WHERE asset_key IS NOT NULL),
        n AS (SELECT *, t >= '2025-07-01' AS fresh, row_number() OVER (PARTITION BY asset_key, t >= '2025-07-01' ORDER BY t DESC, automatic DESC, locked DESC) AS rn FROM r)
        SELECT coalesce(b.asset_key, a.asset_key) AS asset_key, coalesce(b.automatic, a.automatic) AS automatic, CASE WHEN a.asset_key IS NOT NULL THEN {_DECIDED.replace('asset_key', 'a.asset_key')} END AS manual,
          coalesce(a.locked, b.locked) AS locked, a.asset_key IS NOT NULL AS existed
        FROM (SELECT * FROM n WHERE rn = 1 AND NOT fresh) a FULL JOIN (SELECT * FROM n WHERE rn = 1 AND fresh) b ON a.asset_key = b.asset_key""",
}
