"""Backfill analytics."""

from __future__ import annotations

from flowtables.operators import replay as P
from flowtables.operators import runs as R
from flowtables.queries.registry import query
from flowtables.queries.runs import LATEST_SQL
from flowtables.queries.time import slots_sql

ONGOING = "('created', 'in progress', 'partial replayed', 'replayed')"
_STATES = "CASE (replay_id + day(scheduled_at)) % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'success' WHEN 2 THEN 'failed' ELSE 'pending' END"
COVERED_SQL = f"""{slots_sql("1994-12-01", "1995-05-31")},
covered AS (SELECT r.*, slot AS scheduled_at, lag_slot FROM replays_v r JOIN jobs_v USING (job_id) JOIN (SELECT *, lag(slot) OVER (PARTITION BY cron ORDER BY slot) AS lag_slot FROM slots) USING (cron) WHERE slot BETWEEN r.start_time AND r.end_time)"""
RUNS_SQL = f"""{COVERED_SQL},
rr AS (SELECT replay_id, job_id, project, status, created_at, scheduled_at, {_STATES} AS state FROM covered)"""
PROGRESS_SQL = f"""{RUNS_SQL},
progress AS (SELECT replay_id, status, count(*) FILTER (state = 'in_progress') AS n_in_progress, count(*) FILTER (state = 'failed') AS n_failed, count(*) FILTER (state = 'pending') AS n_pending,
  min(scheduled_at) FILTER (state = 'pending') AS first_pending, max(scheduled_at) FILTER (state = 'pending') AS last_pending FROM rr GROUP BY ALL)"""


def _replay_runs(t):
    return P.runs_of(t.replays_v, t.jobs_v).selectExpr("*", f"{_STATES} AS state")


@query(
    "replay_conflicts",
    f"""SELECT n.replay_id, count(o.replay_id) AS n_conflicts FROM replays_v n LEFT JOIN replays_v o ON o.project = n.project AND o.job_id = n.job_id AND o.replay_id <> n.replay_id
  AND o.status IN {ONGOING} AND o.start_time <= n.end_time AND o.end_time >= n.start_time WHERE n.status = 'created' GROUP BY ALL""",
)
def replay_conflicts(t):
    return P.conflicts(t.replays_v.where("status = 'created'"), P.ongoing(t.replays_v))


@query(
    "replay_run_conflicts",
    """SELECT n.replay_id, count(r.run_id) AS n_conflicts FROM replays_v n LEFT JOIN runs_v r ON r.job_id = n.job_id AND r.state IN ('queued', 'running') AND r.scheduled_at BETWEEN n.start_time AND n.end_time
WHERE n.status = 'created' GROUP BY ALL""",
)
def replay_run_conflicts(t):
    return P.run_conflicts(t.replays_v.where("status = 'created'"), t.runs_v)


@query(
    "replay_date_check",
    """SELECT replay_id, CASE WHEN known IS NULL THEN 'unknown job' WHEN start_time < start_at THEN 'begins before the job' WHEN end_time > least(TIMESTAMP '1995-03-05', coalesce(end_at, TIMESTAMP '1995-03-05')) THEN 'ends too late' END AS error
FROM replays_v LEFT JOIN (SELECT *, true AS known FROM jobs_v WHERE job_id % 23 <> 5) USING (job_id)""",
)
def replay_date_check(t):
    return P.date_errors(t.replays_v, t.jobs_v.where("job_id % 23 <> 5"), "TIMESTAMP '1995-03-05 00:00:00'")


@query(
    "replay_config",
    """WITH hits AS (SELECT u.job_id, u.scheduled_at, p.* EXCLUDE (job_id) FROM (SELECT DISTINCT job_id, scheduled_at FROM runs_v) u JOIN replays_v p ON p.job_id = u.job_id AND u.scheduled_at BETWEEN p.start_time AND p.end_time),
pairs AS (SELECT job_id, scheduled_at, created_at, replay_id, 'segment' AS key, segment AS value FROM hits
  UNION ALL SELECT job_id, scheduled_at, created_at, replay_id, CASE WHEN parallel THEN 'parallel' ELSE 'sequential' END, CAST(replay_id AS VARCHAR) FROM hits)
SELECT job_id, scheduled_at, key, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id, scheduled_at, key ORDER BY created_at DESC, replay_id DESC) AS rn FROM pairs) WHERE rn = 1""",
)
def replay_config(t):
    config = "map('segment', segment, IF(parallel, 'parallel', 'sequential'), CAST(replay_id AS STRING)) AS config"
    return P.run_config(t.runs_v, t.replays_v.selectExpr("*", config), "config")


@query(
    "replay_run_update",
    f"""WITH {RUNS_SQL}, {LATEST_SQL} SELECT replay_id, rr.job_id, rr.scheduled_at, CASE WHEN rr.state = 'in_progress' AND l.state IN ('success', 'failed') THEN l.state ELSE rr.state END AS state
FROM rr LEFT JOIN latest l ON l.job_id = rr.job_id AND l.scheduled_at = rr.scheduled_at""",
)
def replay_run_update(t):
    return P.updated_runs(_replay_runs(t), R.latest(t.runs_v))


@query("replay_bounds", f"WITH {PROGRESS_SQL} SELECT replay_id, first_pending, last_pending FROM progress")
def replay_bounds(t):
    return P.bounds(_replay_runs(t))


@query(
    "replay_status",
    f"""WITH {PROGRESS_SQL} SELECT r.replay_id, CASE WHEN n_in_progress > 0 THEN 'replayed' WHEN n_failed > 0 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN n_in_progress = 0 AND n_failed > 0 THEN concat('runs failed: ', n_failed) ELSE '' END AS message FROM replays_v r LEFT JOIN progress p ON p.replay_id = r.replay_id WHERE r.status = 'replayed'""",
)
def replay_status(t):
    return P.status(t.replays_v, _replay_runs(t))


@query(
    "replay_next_step",
    f"""WITH {PROGRESS_SQL}, s AS (SELECT r.replay_id, CASE WHEN n_in_progress = 0 THEN first_pending END AS run_now, coalesce(n_pending, 0) AS n FROM replays_v r LEFT JOIN progress p ON p.replay_id = r.replay_id WHERE r.status = 'partial replayed')
SELECT replay_id, run_now, CASE WHEN n - CASE WHEN run_now IS NULL THEN 0 ELSE 1 END = 0 THEN 'replayed' ELSE 'partial replayed' END AS status FROM s""",
)
def replay_next_step(t):
    return P.next_step(t.replays_v, _replay_runs(t))


@query(
    "replay_plan",
    f"""WITH {COVERED_SQL}, k AS (SELECT c.*, EXISTS (SELECT 1 FROM runs_v r WHERE r.job_id = c.job_id AND r.scheduled_at = c.scheduled_at) AS known FROM covered c WHERE status = 'created'),
w AS (SELECT *, count(*) OVER p AS n_runs, min(CASE WHEN known THEN scheduled_at END) OVER p AS first_known FROM k WINDOW p AS (PARTITION BY replay_id))
SELECT replay_id, scheduled_at, lag_slot AS logical_at, NOT known AS created, CASE WHEN parallel OR NOT known OR scheduled_at = first_known THEN 'in_progress' ELSE 'pending' END AS state,
  CASE WHEN NOT parallel AND n_runs > 1 THEN 'partial replayed' ELSE 'replayed' END AS replay_status FROM w""",
)
def replay_plan(t):
    return P.plan(t.replays_v, t.jobs_v, t.runs_v)


@query(
    "replay_slots",
    f"""WITH {RUNS_SQL}, j AS (SELECT project, job_id, count(*) AS held FROM rr WHERE state = 'in_progress' GROUP BY project, job_id), p AS (SELECT project, sum(held) AS held FROM j GROUP BY project),
a AS (SELECT *, row_number() OVER (PARTITION BY project, job_id ORDER BY created_at, replay_id, scheduled_at) AS r1 FROM rr WHERE state = 'pending'),
b AS (SELECT a.*, row_number() OVER (PARTITION BY a.project ORDER BY created_at, replay_id, scheduled_at) AS r2 FROM a LEFT JOIN j ON j.project = a.project AND j.job_id = a.job_id WHERE r1 <= 25 - coalesce(j.held, 0))
SELECT b.project, b.job_id, replay_id, scheduled_at FROM b LEFT JOIN p ON p.project = b.project WHERE r2 <= 2000 - coalesce(p.held, 0)""",
)
def replay_slots(t):
    """So many runs are in progress that the default limits would leave no slot."""
    return P.slots(t.replays_v, _replay_runs(t), per_project=2000, per_job=25).select("project", "job_id", "replay_id", "scheduled_at")


@query(
    "replay_pick",
    f"""WITH {RUNS_SQL}, one AS (SELECT replay_id, status FROM replays_v WHERE status IN ('created', 'partial replayed', 'replayed') ORDER BY updated_at DESC, replay_id LIMIT 1)
SELECT one.replay_id, one.status, scheduled_at, state FROM one JOIN rr ON rr.replay_id = one.replay_id""",
)
def replay_pick(t):
    return P.pick(t.replays_v, _replay_runs(t))


@query("replay_list", "SELECT replay_id, job_id, status, created_at FROM replays_v WHERE project = 'proj_1' ORDER BY created_at DESC, replay_id LIMIT 30")
def replay_list(t):
    return P.recent(t.replays_v, "proj_1").select("replay_id", "job_id", "status", "created_at")


@query(
    "replay_timeouts",
    f"SELECT replay_id, 'failed' AS status, 'no progress before the deadline' AS message FROM replays_v WHERE status IN {ONGOING} AND created_at + INTERVAL 3 HOUR <= TIMESTAMP '1995-05-01'",
)
def replay_timeouts(t):
    return P.timeouts(t.replays_v, "TIMESTAMP '1995-05-01 00:00:00'")
