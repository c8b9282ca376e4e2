"""Resolution of declared upstreams and downstream lookups."""

from __future__ import annotations

from flowtables.operators import lineage
from flowtables.queries.registry import query

# Declared upstreams of active jobs and their resolution among active jobs, the whole registry at once.
_HITS = "coalesce({0}.project, {1}.project, up_project) AS upstream_project, coalesce({0}.name, {1}.name, up_job) AS upstream_job, coalesce({0}.namespace, {1}.namespace) AS upstream_namespace, coalesce({0}.destination, {1}.destination, resource) AS resource"
_FIRST = """act AS (SELECT * FROM jobs_v WHERE NOT is_deleted), declared AS (
  SELECT s.job_id, CASE WHEN static_upstream LIKE '%/%' THEN split_part(static_upstream, '/', 1) ELSE project END AS up_project,
    CASE WHEN static_upstream LIKE '%/%' THEN split_part(static_upstream, '/', 2) ELSE static_upstream END AS up_job, NULL AS resource, 'static' AS type
  FROM job_static_v s JOIN act USING (job_id)
  UNION ALL SELECT job_id, NULL, NULL, source, 'inferred' FROM job_sources_v WHERE job_id IN (SELECT job_id FROM act)"""
_THEN = """),
resolved AS (
  SELECT d.job_id, {hits}, type, CASE WHEN n.name IS NULL AND t.name IS NULL THEN 'unresolved' ELSE 'resolved' END AS state
  FROM declared d LEFT JOIN act n ON n.project = up_project AND n.name = up_job LEFT JOIN act t ON t.destination = d.resource),
deduped AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY job_id, state, CASE WHEN state = 'unresolved' THEN type END,
    CASE WHEN state = 'unresolved' AND type = 'inferred' THEN resource ELSE concat(upstream_project, '/', upstream_job) END ORDER BY CASE type WHEN 'static' THEN 0 ELSE 1 END, resource) AS rn FROM resolved) WHERE rn = 1)"""
DECLARED_SQL = _FIRST + _THEN.format(hits=_HITS.format("n", "t"))

# Every tenth job also names one job and the table of another: the only case in which the order of matching shows.
BOTH = "SELECT j.job_id, k.project AS upstream_project, k.name AS upstream_job, l.destination AS resource, 'static' AS type FROM jobs_v j JOIN jobs_v k ON k.job_id = j.job_id - 3 JOIN jobs_v l ON l.job_id = j.job_id - 5 WHERE j.job_id % 10 = 0 AND NOT j.is_deleted"
_BULK_SQL = f"{_FIRST} UNION ALL {BOTH}" + _THEN.format(hits=_HITS.format("n", "t"))
_SINGLE_SQL = f"{_FIRST} UNION ALL {BOTH}" + _THEN.format(hits=_HITS.format("t", "n"))

_COLUMNS = "job_id, upstream_project, upstream_job, upstream_namespace, resource, type, state"


def _edges(t, prefer="name"):
    return lineage.bulk_resolve(t.jobs_v, t.job_sources_v, t.job_static_v, prefer)


@query("upstream_static", f"WITH {DECLARED_SQL} SELECT job_id, upstream_project, upstream_job, resource AS destination FROM resolved WHERE type = 'static' AND state = 'resolved'")
def upstream_static(t):
    wanted = lineage.declared(t.jobs_v, t.job_sources_v, t.job_static_v)
    return lineage.resolve_static(wanted, t.jobs_v).select("job_id", "upstream_project", "upstream_job", "destination")


@query("upstream_inferred", f"WITH {DECLARED_SQL} SELECT job_id, upstream_project, upstream_job, resource AS destination FROM resolved WHERE type = 'inferred' AND state = 'resolved'")
def upstream_inferred(t):
    wanted = lineage.declared(t.jobs_v, t.job_sources_v, t.job_static_v)
    return lineage.resolve_inferred(wanted, t.jobs_v).select("job_id", "upstream_project", "upstream_job", "destination")


def _with_both(t, prefer):
    wanted = lineage.declared(t.jobs_v, t.job_sources_v, t.job_static_v).unionByName(t.sql(BOTH))
    return lineage.deduplicate(lineage.resolve(wanted, t.jobs_v, prefer)).drop("external")


@query("upstream_bulk_resolve", f"WITH {_BULK_SQL} SELECT {_COLUMNS} FROM deduped")
def upstream_bulk_resolve(t):
    """Name before destination."""
    return _with_both(t, "name")


@query("upstream_single_resolve", f"WITH {_SINGLE_SQL} SELECT {_COLUMNS} FROM deduped")
def upstream_single_resolve(t):
    """Destination before name."""
    return _with_both(t, "destination")


@query("upstream_dedup", f"WITH {DECLARED_SQL} SELECT {_COLUMNS} FROM deduped")
def upstream_dedup(t):
    """Deduplication over a union with copies of every row."""
    once = lineage.resolve(lineage.declared(t.jobs_v, t.job_sources_v, t.job_static_v), t.jobs_v)
    return lineage.deduplicate(once.unionByName(once)).drop("external")


@query(
    "upstream_external",
    f"""WITH {DECLARED_SQL}, other AS (
  SELECT concat('ext_', s_suppkey) AS name, 'ext' AS project, concat('store://ext:unknown.t', 7 * s_suppkey) AS destination, 'host-a' AS host FROM supplier
  UNION ALL SELECT concat('missing_', 31 * s_suppkey), concat('proj_', (31 * s_suppkey) % 3), concat('store://ext:x.t', s_suppkey), 'host-b' FROM supplier)
SELECT d.job_id, type, coalesce(upstream_project, t.project) AS upstream_project, coalesce(upstream_job, t.name) AS upstream_job,
  CASE WHEN coalesce(n.host, t.host) IS NULL THEN 'unresolved' ELSE 'resolved' END AS state, coalesce(n.host, t.host) IS NOT NULL AS external, coalesce(n.host, t.host) AS host
FROM deduped d LEFT JOIN other n ON d.type = 'static' AND n.project = upstream_project AND n.name = upstream_job LEFT JOIN other t ON d.type = 'inferred' AND t.destination = d.resource
WHERE d.state = 'unresolved'""",
)
def upstream_external(t):
    a = t.supplier.selectExpr("concat('ext_', s_suppkey) AS name", "'ext' AS project", "'e' AS namespace", "concat('store://ext:unknown.t', 7 * s_suppkey) AS destination")
    b = t.supplier.selectExpr(
        "concat('missing_', 31 * s_suppkey) AS name", "concat('proj_', (31 * s_suppkey) % 3) AS project", "'e' AS namespace", "concat('store://ext:x.t', s_suppkey) AS destination"
    )
    found = lineage.resolve_elsewhere(_edges(t), {"host-a": a, "host-b": b})
    return found.select("job_id", "type", "upstream_project", "upstream_job", "state", "external", "host")


@query("upstream_unresolved", f"WITH {DECLARED_SQL} SELECT job_id, upstream_project, upstream_job FROM deduped WHERE state = 'unresolved' AND type = 'static'")
def upstream_unresolved(t):
    return lineage.unresolved_errors(_edges(t)).select("job_id", "upstream_project", "upstream_job")


@query(
    "downstream_by_destination",
    "SELECT p.job_id AS producer_id, s.job_id AS downstream_id FROM jobs_v p JOIN job_sources_v s ON s.source = p.destination JOIN jobs_v d ON d.job_id = s.job_id AND d.project = p.project AND NOT d.is_deleted",
)
def downstream_by_destination(t):
    return lineage.downstream_by_destination(t.jobs_v, t.job_sources_v)


@query(
    "downstream_by_sources",
    "SELECT job_id, project, name FROM jobs_v WHERE NOT is_deleted AND job_id IN (SELECT job_id FROM job_sources_v WHERE source IN (SELECT destination FROM jobs_v WHERE namespace = 'ns_1'))",
)
def downstream_by_sources(t):
    wanted = t.jobs_v.where("namespace = 'ns_1'").selectExpr("destination AS source")
    return lineage.downstream_by_sources(t.jobs_v, t.job_sources_v, wanted).select("job_id", "project", "name")


@query(
    "downstream_by_job",
    "SELECT src AS job_id, d.name AS downstream_name, d.project AS downstream_project FROM edges_v JOIN jobs_v d ON d.job_id = dst WHERE NOT d.is_deleted",
)
def downstream_by_job(t):
    return lineage.downstream_by_job(t.edges_v, t.jobs_v).selectExpr("src AS job_id", "downstream_name", "downstream_project")


@query(
    "duplicate_destination",
    """WITH w AS (SELECT job_id, name, concat('store://wh:shared.t', job_id % 700) AS destination FROM jobs_v WHERE NOT is_deleted),
g AS (SELECT destination, min(name) AS first, max(name) AS last, count(*) AS n FROM w GROUP BY destination HAVING count(*) > 1)
SELECT job_id, name, destination, n - 1 AS n_others, CASE WHEN name = first THEN last ELSE first END AS other_job FROM w JOIN g USING (destination)""",
)
def duplicate_destination(t):
    writers = t.jobs_v.selectExpr("job_id", "name", "concat('store://wh:shared.t', job_id % 700) AS destination", "is_deleted")
    return lineage.same_destination(writers)


@query(
    "destination_writers",
    """WITH w AS (SELECT job_id, name, concat('store://wh:shared.t', job_id % 700) AS destination FROM jobs_v WHERE NOT is_deleted)
SELECT destination, job_id, name, count(*) OVER (PARTITION BY destination) AS n_writers FROM w QUALIFY count(*) OVER (PARTITION BY destination) > 1""",
)
def destination_writers(t):
    """All writers of every table that several jobs write."""
    writers = t.jobs_v.selectExpr("job_id", "name", "concat('store://wh:shared.t', job_id % 700) AS destination", "is_deleted")
    return lineage.destination_writers(writers)
