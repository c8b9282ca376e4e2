"""Registry analytics: lookup, validation, diff, priorities, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions import names as N
from flowtables.operators import lineage, registry
from flowtables.queries.registry import query


@query("jobs_by_filter", "SELECT job_id, name, namespace FROM jobs_v WHERE project = 'proj_1' AND namespace IN ('ns_1', 'ns_2')")
def jobs_by_filter(t):
    return registry.jobs_by_filter(t.jobs_v, project="proj_1", namespaces=["ns_1", "ns_2"], namespace="ns_3").select("job_id", "name", "namespace")


@query("jobs_active", "SELECT job_id, name, destination FROM jobs_v WHERE NOT is_deleted")
def jobs_active(t):
    return registry.active(t.jobs_v).select("job_id", "name", "destination")


@query("runs_by_state", "SELECT run_id, job_id, state FROM runs_v WHERE state IN ('running', 'failed')")
def runs_by_state(t):
    return registry.runs_in_states(t.runs_v, ["running", "failed"]).select("run_id", "job_id", "state")


_BACKUPS = "SELECT s_suppkey AS backup_id, s_name AS resource, CAST(DATE '2024-01-01' - CAST(s_suppkey % 200 AS INT) AS TIMESTAMP) + CASE WHEN s_suppkey % 2 = 0 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END AS created_at FROM {supplier}"


@query("recent_backups", f"WITH b AS ({_BACKUPS.format(supplier='supplier')}) SELECT * FROM b WHERE created_at > TIMESTAMP '2023-10-01 10:30:00'")
def recent_backups(t):
    return registry.recent_backups(t.sql(_BACKUPS), "2023-12-31 10:30:00")


@query(
    "run_query_validate",
    """SELECT replay_id, CASE WHEN job_id % 17 = 0 THEN 'job has no start date' WHEN r.start_time < start_at OR r.end_time < start_at THEN 'range begins before the job does' END AS error
FROM replays_v r JOIN jobs_v USING (job_id)""",
)
def run_query_validate(t):
    jobs = t.jobs_v.selectExpr("job_id", "IF(job_id % 17 = 0, NULL, start_at) AS job_start")
    return t.replays_v.join(jobs, "job_id").selectExpr("replay_id", f"{registry.query_error('start_time', 'end_time', 'job_start')} AS error")


@query(
    "urn_build",
    """SELECT job_id, concat(project, '/', name) AS full_name, concat('store', '://', name) AS destination_urn,
  CASE WHEN job_id % 10 = 0 THEN concat('store://', project, ':', namespace) ELSE concat('store://', project, ':', namespace, '.', name) END AS table_urn FROM jobs_v""",
)
def urn_build(t):
    return t.jobs_v.selectExpr(
        "job_id",
        f"{N.full_name('project', 'name')} AS full_name",
        f"""{N.urn("'store'", 'name')} AS destination_urn""",
        f"{N.table_urn('store', 'project', 'namespace', 'IF(job_id % 10 = 0, NULL, name)')} AS table_urn",
    )


@query(
    "static_name_split",
    """SELECT s.job_id, static_upstream, CASE WHEN static_upstream LIKE '%/%' THEN split_part(static_upstream, '/', 1) ELSE project END AS upstream_project,
  CASE WHEN static_upstream LIKE '%/%' THEN split_part(static_upstream, '/', 2) ELSE static_upstream END AS upstream_job FROM job_static_v s JOIN jobs_v j USING (job_id)""",
)
def static_name_split(t):
    return t.job_static_v.join(t.jobs_v.select("job_id", "project"), "job_id").selectExpr(
        "job_id",
        "static_upstream",
        f"{N.upstream_project('static_upstream', 'project')} AS upstream_project",
        f"{N.upstream_job('static_upstream')} AS upstream_job",
    )


_CHANGES = "SELECT s_suppkey * 3 AS job_id, CASE WHEN s_suppkey % 2 = 0 THEN 'enabled' ELSE 'disabled' END AS state FROM {supplier}"


@query(
    "job_state_sync",
    f"""WITH c AS ({_CHANGES.format(supplier='supplier')})
SELECT job_id, coalesce(c.state, 'enabled') AS state, NOT EXISTS (SELECT 1 FROM c c2 WHERE c2.job_id NOT IN (SELECT job_id FROM jobs_v)) AS all_matched FROM jobs_v LEFT JOIN c USING (job_id)""",
)
def job_state_sync(t):
    changes = t.sql(_CHANGES)
    jobs = t.jobs_v.selectExpr("job_id", "'enabled' AS state")
    all_matched = registry.unmatched(changes, jobs).isEmpty()
    return registry.with_states(jobs, changes).withColumn("all_matched", F.lit(all_matched))


@query(
    "namespace_move",
    """WITH m AS (SELECT p_partkey AS job_id, concat('moved_', p_partkey % 2) AS to_ns FROM part WHERE p_size % 4 = 2)
SELECT 'job' AS entity, job_id AS id, coalesce(to_ns, namespace) AS namespace FROM jobs_v LEFT JOIN m USING (job_id)
UNION ALL SELECT 'run', run_id, coalesce(to_ns, namespace) FROM runs_v JOIN jobs_v USING (job_id) LEFT JOIN m USING (job_id)
UNION ALL SELECT 'edge', dst, coalesce(to_ns, namespace) FROM edges_v JOIN jobs_v j ON j.job_id = dst LEFT JOIN m ON m.job_id = dst""",
)
def namespace_move(t):
    jobs = t.jobs_v.select("job_id", "namespace")
    mapping = t.part.where("p_size % 4 = 2").selectExpr("p_partkey AS job_id", "concat('moved_', p_partkey % 2) AS namespace")
    tables = {
        "job": jobs.selectExpr("job_id AS id", "job_id", "namespace"),
        "run": t.runs_v.join(jobs, "job_id").selectExpr("run_id AS id", "job_id", "namespace"),
        "edge": t.edges_v.withColumnRenamed("dst", "job_id").join(jobs, "job_id").selectExpr("job_id AS id", "job_id", "namespace"),
    }
    parts = [registry.moved(df, mapping, ["job_id"]).select(F.lit(n).alias("entity"), "id", "namespace") for n, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("spec_duplicates", "SELECT p_name AS name, p_brand AS brand, CAST(count(*) AS BIGINT) AS copies, count(*) = 1 AS is_valid FROM part GROUP BY p_name, p_brand")
def spec_duplicates(t):
    specs = t.part.selectExpr("p_name AS name", "p_brand AS brand", "p_partkey")
    repeated = registry.repeated_keys(specs, ["name", "brand"]).selectExpr("name", "brand", "copies", "false AS is_valid")
    valid = registry.unique_rows(specs, ["name", "brand"]).selectExpr("name", "brand", "1L AS copies", "true AS is_valid")
    return repeated.unionByName(valid)


# --- diffs --------------------------------------------------------------------------

_INCOMING = """SELECT job_id, name, project, namespace, CASE WHEN job_id % 13 = 0 THEN concat(w_size, '+') ELSE w_size END AS w_size, cron, job_id % 29 = 0 AS is_invalid
FROM jobs_v WHERE job_id % 11 <> 0 UNION ALL
SELECT 1000000 + s_suppkey, concat('job_', 1000000 + s_suppkey), concat('proj_', s_suppkey % 3), 'ns_9', '24h', '@daily', false FROM {supplier}"""

_DIFF_SQL = f"""inc AS ({_INCOMING.format(supplier='supplier')}),
ok AS (SELECT * FROM inc WHERE NOT is_invalid), old AS (SELECT * FROM jobs_v WHERE job_id NOT IN (SELECT job_id FROM inc WHERE is_invalid)),
diffed AS (SELECT coalesce(ok.project, old.project) AS project, coalesce(ok.name, old.name) AS name, coalesce(ok.namespace, old.namespace) AS namespace,
  CASE WHEN old.name IS NULL THEN 'added' WHEN ok.name IS NULL THEN 'deleted' WHEN ok.w_size = old.w_size THEN 'unmodified' ELSE 'modified' END AS change
  FROM old FULL OUTER JOIN ok ON old.project = ok.project AND old.name = ok.name)"""


def _diff(t, carry=()):
    incoming = t.sql(_INCOMING)
    return registry.diff(
        t.jobs_v, incoming.where("NOT is_invalid"), ["project", "name"], ["w_size", "cron", "namespace"], incoming.where("is_invalid"), carry
    )


@query("registry_diff", f"WITH {_DIFF_SQL} SELECT project, name, change FROM diffed")
def registry_diff(t):
    return _diff(t)


@query("change_counters", f"WITH {_DIFF_SQL} SELECT project, namespace, change, count(*) AS n FROM diffed GROUP BY ALL")
def change_counters(t):
    return registry.change_counters(_diff(t, ["namespace"]))


_RESOURCES = """SELECT p_partkey AS id, concat('warehouse-1.d', p_size % 5, '.t', p_partkey) AS full_name, concat('warehouse-1.d', p_size % 5) AS dataset,
  CASE p_partkey % 9 WHEN 0 THEN 'view' WHEN 1 THEN 'external_table' WHEN 2 THEN 'model' ELSE 'table' END AS kind,
  CASE p_partkey % 8 WHEN 0 THEN 'create_failure' WHEN 1 THEN 'to_create' WHEN 2 THEN 'to_update' WHEN 3 THEN 'exist_in_store' WHEN 4 THEN 'update_failure' WHEN 5 THEN 'skipped' ELSE 'success' END AS status,
  p_type AS schema_text FROM {part}"""


@query(
    "resource_diff",
    f"""WITH r AS ({_RESOURCES.format(part='part')})
SELECT full_name, CASE WHEN id % 10 = 0 THEN 'to_create' WHEN status = 'success' AND id % 3 <> 0 THEN 'skipped' WHEN status IN ('create_failure', 'to_create') THEN 'to_create'
  WHEN status = 'skipped' THEN 'validation_success' ELSE 'to_update' END AS action FROM r WHERE id % 15 <> 14""",
)
def resource_diff(t):
    resources = t.sql(_RESOURCES)
    existing = resources.where("id % 10 <> 0")
    incoming = resources.selectExpr(
        "full_name",
        "kind",
        "IF(id % 3 = 0, concat(schema_text, '!'), schema_text) AS schema_text",
        "IF(id % 15 = 14, 'validation_failure', 'validation_success') AS status",
    )
    return registry.resource_actions(existing, incoming, ["kind", "schema_text"])


@query(
    "missing_resources",
    f"""WITH r AS ({_RESOURCES.format(part='part')}) SELECT concat('warehouse-1.d', s_suppkey % 5, '.t', s_suppkey) AS full_name, 'resource not found' AS reason FROM supplier
WHERE concat('warehouse-1.d', s_suppkey % 5, '.t', s_suppkey) NOT IN (SELECT full_name FROM r)""",
)
def missing_resources(t):
    requested = t.supplier.selectExpr("concat('warehouse-1.d', s_suppkey % 5, '.t', s_suppkey) AS full_name")
    return registry.missing(requested, t.sql(_RESOURCES), ["full_name"], "resource not found")


@query(
    "orphan_deployments",
    """SELECT concat('proj_', (s_suppkey * 50) % 3) AS project, concat('job_', s_suppkey * 50) AS name, 'no such job' AS reason FROM supplier s
WHERE NOT EXISTS (SELECT 1 FROM jobs_v j WHERE j.project = concat('proj_', (s_suppkey * 50) % 3) AND j.name = concat('job_', s_suppkey * 50))""",
)
def orphan_deployments(t):
    deployed = t.supplier.selectExpr("concat('proj_', (s_suppkey * 50) % 3) AS project", "concat('job_', s_suppkey * 50) AS name")
    return registry.missing(deployed, t.jobs_v, ["project", "name"], "no such job")


@query(
    "refresh_downstream",
    """WITH changed AS (SELECT destination AS urn FROM jobs_v WHERE job_id % 6 = 0 OR job_id % 7 = 0)
SELECT project, name FROM jobs_v WHERE NOT is_deleted AND job_id IN (SELECT job_id FROM job_sources_v WHERE source IN (SELECT urn FROM changed))""",
)
def refresh_downstream(t):
    before = t.jobs_v.selectExpr("destination AS urn", "IF(job_id % 2 = 0, cron, NULL) AS view_query", "w_size AS schema", "namespace AS source")
    after = t.jobs_v.selectExpr(
        "destination AS urn",
        "CASE WHEN job_id % 6 = 0 THEN 'SELECT 1' WHEN job_id % 2 = 0 THEN cron END AS view_query",
        "IF(job_id % 7 = 0, concat(w_size, '!'), w_size) AS schema",
        "namespace AS source",
    )
    changed = registry.refresh_candidates(before, after).withColumnRenamed("urn", "source")
    return lineage.downstream_by_sources(t.jobs_v, t.job_sources_v, changed).select("project", "name")


# --- aggregates ---------------------------------------------------------------------


@query(
    "priority_weight",
    """WITH n AS (SELECT dst, count(*) AS c FROM edges_v JOIN jobs_v u ON u.job_id = src JOIN jobs_v d ON d.job_id = dst WHERE u.project = d.project AND u.namespace = d.namespace GROUP BY dst)
SELECT job_id, 10000 - 10 * coalesce(c, 0) AS priority FROM jobs_v LEFT JOIN n ON dst = job_id""",
)
def priority_weight(t):
    return registry.priorities(t.jobs_v, t.edges_v)


@query(
    "jobs_by_tenant",
    "SELECT project, namespace, name, count(*) OVER (PARTITION BY project, namespace) AS jobs_in_tenant FROM jobs_v",
)
def jobs_by_tenant(t):
    return registry.with_group_size(t.jobs_v.select("project", "namespace", "name"), ["project", "namespace"], "jobs_in_tenant")


@query(
    "label_summary",
    """SELECT p_partkey AS id, concat('brand=', p_brand, ',size=', p_size, ',type=', p_type) AS labels,
  CAST(CASE WHEN p_brand = p_type THEN 2 ELSE 3 END AS INTEGER) AS n_values FROM part""",
)
def label_summary(t):
    labels = F.expr("map('type', p_type, 'brand', p_brand, 'size', CAST(p_size AS STRING))")
    rows = t.part.select(F.col("p_partkey").alias("id"), labels.alias("m"))
    return rows.select("id", registry.label_text(F.col("m")).alias("labels"), F.size(F.array_distinct(F.map_values("m"))).alias("n_values"))


@query(
    "resource_batches",
    f"""WITH r AS ({_RESOURCES.format(part='part')}), a AS (SELECT dataset, kind FROM r UNION ALL SELECT DISTINCT dataset, 'dataset' FROM r WHERE dataset IN ('warehouse-1.d1', 'warehouse-1.d3'))
SELECT dataset, count(*) FILTER (kind = 'dataset') = 0 AS default_dataset, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'external_table') AS external_tables,
  count(*) FILTER (kind = 'view') AS views FROM a GROUP BY dataset""",
)
def resource_batches(t):
    resources = t.sql(_RESOURCES).select("dataset", "kind")
    own = resources.where("dataset IN ('warehouse-1.d1', 'warehouse-1.d3')").select("dataset", F.lit("dataset").alias("kind")).distinct()
    return registry.batches(resources.unionByName(own))
