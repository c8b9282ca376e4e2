"""Load methods, read back after the load."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables import session
from flowtables.plans import job as J
from flowtables.queries.registry import query
from flowtables.sources import loads

DAILY = """SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM {events} GROUP BY CAST(ts AS DATE), user_id"""
# The table as it is holds every day, those of user 7 without a day. The result holds every day again, changed, but
# for the 18th; user 11 is new in it, users divisible by 3 are missing from it, and user 8 has lost the day.
_OLD = "SELECT CASE WHEN user_id % 50 <> 7 THEN day END AS day, user_id, sum(n) AS n, sum(total) AS total FROM daily WHERE user_id % 50 <> 11 GROUP BY ALL"
_NEW = "SELECT CASE WHEN user_id % 50 <> 8 THEN day END AS day, user_id, sum(n) + 1000 AS n, sum(total) AS total FROM daily WHERE user_id % 3 <> 0 AND day <> DATE '2024-01-18' GROUP BY ALL"
_CAST = "SELECT day, user_id, CAST(n AS BIGINT) AS n, round(total, 2) AS total FROM"
_SQL = f"daily AS ({DAILY.format(events='events')}), old AS ({_CAST} ({_OLD}) o), new AS ({_CAST} ({_NEW}) o)"


def _target(t):
    """The target as stored before the load, and the result to load."""
    daily = t.sql(DAILY)
    path = session.scratch(t.spark, "target")
    old, new = (t.spark.sql(f"{_CAST} ({text.replace('FROM daily', 'FROM {daily}')}) o", daily=daily) for text in (_OLD, _NEW))
    loads.append(old.select("user_id", "n", "total", "day"), path, "day")
    return path, new.select("user_id", "n", "total", "day")


def _back(t, path, new):
    return loads.read(t.spark, path, new).withColumn("day", F.col("day").cast("string"))


@query("load_append", f"WITH {_SQL}, final AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_append(t):
    path, new = _target(t)
    loads.append(new, path, "day")
    return _back(t, path, new)


@query("load_replace", f"WITH {_SQL}, final AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.day IS NOT DISTINCT FROM old.day) UNION ALL SELECT * FROM new) SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_replace(t):
    path, new = _target(t)
    loads.replace(new, path, "day")
    return _back(t, path, new)


@query("load_replace_filter", f"WITH {_SQL}, final AS (SELECT * FROM old WHERE (day < DATE '2024-01-15' AND NOT EXISTS (SELECT 1 FROM new WHERE new.day = old.day)) OR (day IS NULL AND NOT EXISTS (SELECT 1 FROM new WHERE day IS NULL)) UNION ALL SELECT * FROM new) SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_replace_filter(t):
    """The 18th matches the filter and goes although the result has no rows for it."""
    path, new = _target(t)
    loads.replace_filter(new, path, "day", "day >= DATE '2024-01-15'")
    return _back(t, path, new)


@query("load_replace_all", f"WITH {_SQL}, final AS (SELECT * FROM new) SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_replace_all(t):
    path, new = _target(t)
    loads.replace_all(new, path, "day")
    return _back(t, path, new)


@query("load_merge", f"WITH {_SQL}, final AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.day IS NOT DISTINCT FROM old.day AND new.user_id = old.user_id) UNION ALL SELECT * FROM new) SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_merge(t):
    path, new = _target(t)
    loads.merge(new, path, "day", ["day", "user_id"])
    return _back(t, path, new)


# Users divisible by 7 lose their rows where the result has fewer, others add up; of the new ones only those with many rows come, without total;
# rows the result does not know are marked, and go where they were small.
_CLAUSES_SQL = """joined AS (SELECT old.day AS od, old.user_id AS ou, old.n AS o_n, old.total AS o_total, new.day AS nd, new.user_id AS nu, new.n AS n_n, new.total AS n_total, old.user_id IS NOT NULL AS in_t, new.user_id IS NOT NULL AS in_s
  FROM old FULL JOIN new ON old.day IS NOT DISTINCT FROM new.day AND old.user_id = new.user_id),
final AS (SELECT coalesce(od, nd) AS day, coalesce(ou, nu) AS user_id,
    CASE WHEN in_t AND in_s THEN o_n + n_n WHEN in_s THEN n_n ELSE -o_n END AS n, CASE WHEN in_t AND in_s THEN n_total WHEN in_s THEN NULL ELSE o_total END AS total
  FROM joined WHERE NOT coalesce((in_t AND in_s AND ou % 7 = 0 AND n_total < o_total + 1) OR (in_s AND NOT in_t AND n_n <= 1001) OR (in_t AND NOT in_s AND o_n = 1), false))"""


@query("load_merge_clauses", f"WITH {_SQL}, {_CLAUSES_SQL} SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_merge_clauses(t):
    """Updates, inserts and deletes with conditions, also of rows that the result does not hold; NULL days are keys too."""
    path, new = _target(t)
    loads.merge(
        new, path, "day", ["day", "user_id"],
        matched=[loads.Clause("delete", "t.user_id % 7 = 0 AND s.total < t.total + 1"), loads.Clause("update", values=(("n", "t.n + s.n"), ("total", "s.total")))],
        not_matched=[loads.Clause("insert", "s.n > 1001", (("day", "s.day"), ("user_id", "s.user_id"), ("n", "s.n")))],
        not_matched_by_source=[loads.Clause("delete", "t.n = 1"), loads.Clause("update", values=(("n", "-t.n"),))],
    )
    return _back(t, path, new)


@query("load_replace_merge", f"WITH {_SQL}, final AS (SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.day IS NOT DISTINCT FROM old.day AND new.user_id = old.user_id) UNION ALL SELECT * FROM new) SELECT CAST(day AS VARCHAR) AS day, user_id, n, total FROM final")
def load_replace_merge(t):
    """The result itself reads the target: partitions are replaced by old and new rows merged."""
    path, new = _target(t)
    old = loads.read(t.spark, path, new)
    days, keys = new.selectExpr("day AS d").distinct(), new.selectExpr("day AS d", "user_id AS u")
    touched = old.join(days, old.day.eqNullSafe(days.d), "left_semi")
    kept = touched.join(keys, touched.day.eqNullSafe(keys.d) & (touched.user_id == keys.u), "left_anti")
    loads.replace_merge(kept.unionByName(new), path, "day")
    return _back(t, path, new)


# Half days in folders whose names are escaped; user 5's rows move to the half before, those of user 6 have none.
_HOURS = "SELECT event_id, user_id, CASE WHEN user_id % 60 <> 6 THEN date_trunc('day', ts) + CASE WHEN extract(hour FROM ts) >= 12 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END END AS h FROM events WHERE user_id % 4 <> 1"
_MOVED = "SELECT event_id, user_id + 1000 AS user_id, CASE WHEN user_id % 60 <> 16 THEN date_trunc('day', ts) + CASE WHEN extract(hour FROM ts) >= 12 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END - CASE WHEN user_id % 60 = 5 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END END AS h FROM events WHERE user_id % 10 > 4"


def _hours(t):
    path = session.scratch(t.spark, "target")
    old, new = (t.spark.sql(text.replace("FROM events", "FROM {events}"), events=t.events).selectExpr("event_id", "user_id", "CAST(h AS TIMESTAMP) AS h") for text in (_HOURS, _MOVED))
    loads.append(old, path, "h")
    return path, new


_HOUR_SQL = f"old AS (SELECT * FROM ({_HOURS}) x), new AS (SELECT * FROM ({_MOVED}) x)"


@query("load_merge_hours", f"WITH {_HOUR_SQL} SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM new) UNION ALL SELECT * FROM new")
def load_merge_hours(t):
    """Half-day partitions and none: rows move between them."""
    path, new = _hours(t)
    loads.merge(new, path, "h", ["event_id"])
    return loads.read(t.spark, path, new)


@query("load_filter_hours", f"WITH {_HOUR_SQL} SELECT * FROM old WHERE h IS NOT NULL AND h < TIMESTAMP '2024-01-15 12:00:00' AND h NOT IN (SELECT h FROM new WHERE h IS NOT NULL) UNION ALL SELECT * FROM new")
def load_filter_hours(t):
    """From a certain noon on, and the rows without a time, all go; then the result comes."""
    path, new = _hours(t)
    loads.replace_filter(new, path, "h", "h IS NULL OR h >= TIMESTAMP '2024-01-15 12:00:00'")
    return loads.read(t.spark, path, new)


@query(
    "job_run",
    f"WITH daily AS ({DAILY.format(events='events')}) SELECT CAST(day AS VARCHAR) AS day, user_id, n FROM daily WHERE day = DATE '2024-01-14'",
)
def job_run(t):
    """A whole run: window, bounded read, SQL transform, replace load."""
    path = session.scratch(t.spark, "job")
    sql = "SELECT user_id, count(*) AS n, CAST(ts AS DATE) AS day FROM {source} WHERE ts >= :dstart AND ts < :dend GROUP BY user_id, CAST(ts AS DATE)"
    job = J.Job("daily_users", sql, path, "day", method="REPLACE", size="24h", offset="-24h", truncate_to="d")
    J.run(t.spark, job, t.events, "ts", "2024-01-16 02:00:00")
    return loads.read(t.spark, path, "user_id bigint, n bigint, day date").withColumn("day", F.col("day").cast("string"))
