"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.operators import graph as G
from flowtables.operators import lineage
from flowtables.queries.lineage import DECLARED_SQL
from flowtables.queries.registry import query
from flowtables.sources import backup

_DOWN = """seeds AS (SELECT DISTINCT src AS node FROM edges_v WHERE src NOT IN (SELECT dst FROM edges_v)),
walk AS (SELECT dst AS node, 1 AS depth FROM edges_v WHERE src IN (SELECT node FROM seeds) UNION SELECT dst, depth + 1 FROM walk JOIN edges_v ON src = node)"""


def _nodes(t):
    return t.jobs_v.selectExpr("job_id AS node")


@query("downstream_closure", f"WITH RECURSIVE {_DOWN} SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def downstream_closure(t):
    """Everything downstream of the jobs that read nothing."""
    edges = t.edges_v
    seeds = edges.selectExpr("src AS node").distinct().join(edges.selectExpr("dst AS node"), "node", "left_anti")
    return G.closure(edges, seeds)


@query(
    "upstream_closure",
    """WITH RECURSIVE walk AS (SELECT src AS node, 1 AS depth FROM edges_v WHERE dst NOT IN (SELECT src FROM edges_v) UNION SELECT src, depth + 1 FROM walk JOIN edges_v ON dst = node)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
)
def upstream_closure(t):
    """Everything upstream of the jobs nobody reads."""
    edges = t.edges_v
    seeds = edges.selectExpr("dst AS node").distinct().join(edges.selectExpr("src AS node"), "node", "left_anti")
    return G.closure(G.reverse(edges), seeds)


def _resolved(t):
    edges = lineage.bulk_resolve(t.jobs_v, t.job_sources_v, t.job_static_v, prefer="destination")
    return edges.where("state = 'resolved'").selectExpr("concat(upstream_project, '/', upstream_job) AS src", "job_id")


@query("dag_edges", f"WITH {DECLARED_SQL} SELECT DISTINCT concat(upstream_project, '/', upstream_job) AS upstream, concat(project, '/', name) AS job FROM deduped JOIN jobs_v USING (job_id) WHERE state = 'resolved'")
def dag_edges(t):
    jobs = t.jobs_v.selectExpr("job_id", "concat(project, '/', name) AS job")
    return _resolved(t).join(jobs, "job_id").selectExpr("src AS upstream", "job").distinct()


@query("dag_roots", f"WITH {DECLARED_SQL} SELECT job_id, name FROM act WHERE job_id NOT IN (SELECT job_id FROM deduped WHERE state = 'resolved')")
def dag_roots(t):
    nodes = lineage.active(t.jobs_v).selectExpr("job_id AS node", "name")
    return G.roots(_resolved(t).selectExpr("job_id AS dst"), nodes).selectExpr("node AS job_id", "name")


@query(
    "cycle_nodes",
    """WITH RECURSIVE e AS (SELECT src, dst FROM edges_v UNION ALL SELECT CAST(8 AS BIGINT), CAST(1 AS BIGINT)),
down AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM down JOIN e ON src = node), up AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT src FROM up JOIN e ON dst = node)
SELECT node FROM down WHERE node IN (SELECT node FROM up)""",
)
def cycle_nodes(t):
    """The registry with one more source, which closes a cycle."""
    back = t.jobs_v.where("job_id = 8").selectExpr("job_id AS src", "1L AS dst")
    return G.cycle_nodes(t.edges_v.unionByName(back))


_DOOMED = "doomed AS (SELECT job_id AS node FROM jobs_v WHERE is_deleted)"
_REACHED = f"{_DOOMED}, walk AS (SELECT dst AS node, 1 AS depth FROM edges_v WHERE src IN (SELECT node FROM doomed) UNION SELECT dst, depth + 1 FROM walk JOIN edges_v ON src = node)"


def _doomed(t):
    return t.jobs_v.where("is_deleted").selectExpr("job_id AS node")


@query("delete_blockers", f"WITH RECURSIVE {_REACHED} SELECT node, min(depth) AS depth FROM walk WHERE node NOT IN (SELECT node FROM doomed) GROUP BY node")
def delete_blockers(t):
    return G.delete_blockers(t.edges_v, _doomed(t))


@query(
    "delete_order",
    f"""WITH RECURSIVE {_REACHED}, gone AS (SELECT node FROM walk UNION SELECT node FROM doomed), inside AS (SELECT * FROM edges_v WHERE src IN (SELECT node FROM gone) AND dst IN (SELECT node FROM gone)),
deep AS (SELECT node, 0 AS level FROM gone WHERE node NOT IN (SELECT dst FROM inside) UNION SELECT dst, level + 1 FROM deep JOIN inside ON src = node), lv AS (SELECT node, max(level) AS level FROM deep GROUP BY node)
SELECT node, (SELECT max(level) FROM lv) - level AS step, CAST(NULL AS VARCHAR) AS error FROM lv""",
)
def delete_order(t):
    return G.delete_order(t.edges_v, _doomed(t))


@query(
    "dag_levels",
    """WITH RECURSIVE deep AS (SELECT job_id AS node, 0 AS level FROM jobs_v WHERE job_id NOT IN (SELECT dst FROM edges_v) UNION SELECT dst, level + 1 FROM deep JOIN edges_v ON src = node)
SELECT node, max(level) AS level FROM deep GROUP BY node""",
)
def dag_levels(t):
    return G.levels(t.edges_v, _nodes(t))


@query(
    "backup_set",
    """WITH RECURSIVE walk AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT dst FROM walk JOIN edges_v ON src = node)
SELECT job_id, destination FROM jobs_v WHERE job_id IN (SELECT node FROM walk) AND project = 'proj_1'""",
)
def backup_set(t):
    """The table of job 1 and all tables of its project that depend on it."""
    return backup.backup_set(t.jobs_v, t.edges_v, t.jobs_v.where("job_id = 1")).select("job_id", F.col("destination"))


_CYCLES = """e AS (SELECT src, dst FROM edges_v UNION SELECT CAST(8 AS BIGINT), CAST(1 AS BIGINT) UNION SELECT dst, src FROM edges_v WHERE src % 50 = 7),
reach AS (SELECT src AS a, dst AS b FROM e WHERE src IN (SELECT dst FROM e) UNION SELECT a, dst FROM reach JOIN e ON src = b),
mutual AS (SELECT DISTINCT r.a AS node, r.b AS other FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a),
comp AS (SELECT node, min(other) AS component FROM mutual GROUP BY node),
inside AS (SELECT e.src, e.dst, c.component FROM e JOIN comp c ON c.node = e.src JOIN comp d ON d.node = e.dst AND d.component = c.component),
walk AS (SELECT DISTINCT component, component AS node, 0 AS depth FROM comp UNION SELECT w.component, i.dst, w.depth + 1 FROM walk w JOIN inside i ON i.src = w.node WHERE w.depth < 60),
tree AS (SELECT component, node, min(depth) AS depth FROM walk GROUP BY component, node),
up AS (SELECT t.node, min(p.node) AS parent FROM tree t JOIN inside i ON i.dst = t.node JOIN tree p ON p.node = i.src AND p.depth = t.depth - 1 GROUP BY t.node),
last AS (SELECT t.component, min((t.depth, t.node)) AS l FROM tree t JOIN inside i ON i.src = t.node AND i.dst = t.component GROUP BY t.component),
path AS (SELECT component, l[1] AS step, l[2] AS node FROM last UNION ALL SELECT p.component, p.step - 1, u.parent FROM path p JOIN up u ON u.node = p.node WHERE p.step > 0)"""


@query("cycle_paths", f"WITH RECURSIVE {_CYCLES} SELECT component, step, node FROM path")
def cycle_paths(t):
    """One way round every cycle of the registry, with a source and some edges back that close cycles."""
    more = t.jobs_v.where("job_id = 8").selectExpr("job_id AS src", "1L AS dst")
    back = t.edges_v.where("src % 50 = 7").selectExpr("dst AS src", "src AS dst")
    return G.cycle_paths(t.edges_v.unionByName(more).unionByName(back))
