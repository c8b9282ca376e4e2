"""Texts, macros, configuration maps, names and specification checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions import macros, names, text, windows
from flowtables.operators import lineage, skew
from flowtables.queries.registry import query
from flowtables.queries.time import SETTINGS_SQL, V1_SQL, V2_SQL
from flowtables.sources import specs
from flowtables.streaming import payloads

_STAMPS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN concat('order ', o_orderkey) WHEN o_orderkey % 10 = 1 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 02:00')
  WHEN o_orderkey % 10 = 2 THEN concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T23:30:00-05:00') ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T02:00:00Z') END AS stamp FROM {orders}"""


@query(
    "fn_date",
    f"WITH s AS ({_STAMPS.format(orders='orders')}) SELECT id, stamp, CASE WHEN id % 10 > 1 THEN substr(stamp, 1, 10) END AS day, CASE WHEN id % 10 < 2 THEN 'not an RFC 3339 time' END AS error FROM s",
)
def fn_date(t):
    return t.sql(_STAMPS).selectExpr(
        "id", "stamp", f"{text.date_of('stamp')} AS day", f"IF({text.is_rfc3339('stamp')}, NULL, 'not an RFC 3339 time') AS error"
    )


@query("fn_replace", "SELECT doc_id, md5(replace(text, ' ', '_')) AS digest, CAST(length(replace(text, 'e', '')) AS INTEGER) AS without_e FROM documents")
def fn_replace(t):
    return t.documents.selectExpr("doc_id", "md5(replace(text, ' ', '_')) AS digest", "length(replace(text, 'e', '')) AS without_e")


@query("fn_trunc", "SELECT doc_id, substr(text, 1, 12) AS head, md5(text) AS whole FROM documents")
def fn_trunc(t):
    return t.documents.selectExpr("doc_id", f"{text.trunc(12, 'text')} AS head", f"md5({text.trunc(-1, 'text')}) AS whole")


@query(
    "fn_todate_date",
    "SELECT o_orderkey AS id, date_trunc('day', o_orderdate) AS parsed, strftime(o_orderdate, '%b %-d, %Y') AS shown FROM orders",
)
def fn_todate_date(t):
    days = t.orders.selectExpr("o_orderkey AS id", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day")
    days = days.selectExpr("id", f"{text.to_date('2006-01-02', 'day')} AS parsed")
    return days.selectExpr("id", "parsed", f"{text.date('Jan 2, 2006', 'parsed')} AS shown")


@query(
    "fn_date_modify",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate ELSE o_orderdate - to_hours(CAST(o_orderkey % 50 AS BIGINT)) END AS moved FROM orders",
)
def fn_date_modify(t):
    rows = t.orders.selectExpr("o_orderkey AS id", "o_orderdate AS ts", "IF(o_orderkey % 3 = 2, 'soon', concat('-', o_orderkey % 50, 'h')) AS d")
    return text.with_date_modified(rows, "d", "ts", "moved").select("id", "moved")


@query("fn_epoch", "SELECT o_orderkey AS id, CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS epoch_text FROM orders")
def fn_epoch(t):
    return t.orders.selectExpr("o_orderkey AS id", f"{text.unix_epoch('o_orderdate')} AS epoch_text")


@query("fn_join", "SELECT p_partkey AS id, concat(p_brand, ' / ', p_type, ' / ', p_name) AS joined FROM part")
def fn_join(t):
    return t.part.selectExpr("p_partkey AS id", "array_join(array(p_brand, p_type, p_name), ' / ') AS joined")


# --- macros -------------------------------------------------------------------------

# Query text of each job: the tables it reads, one of them sometimes behind an ignore note.
_SQL_TEXTS = """SELECT job_id, destination, concat('SELECT * FROM `wh.d', CAST(FLOOR(job_id / 2.0) AS BIGINT) % 3, '.t', CAST(FLOOR(job_id / 2.0) AS BIGINT), '` a ',
  CASE WHEN job_id % 5 = 0 THEN concat('JOIN ', CASE WHEN job_id % 15 = 0 THEN '/* @ignoreupstream */ ' ELSE '' END, '`wh.d', CAST(FLOOR(job_id / 3.0) AS BIGINT) % 3, '.t', CAST(FLOOR(job_id / 3.0) AS BIGINT), '` b ON a.id = b.id ') ELSE '' END,
  '/* FROM `wh.old.t1` */ WHERE ts >= "@(.DSTART@)" AND ts < "@( .DEND | Date @)"', CASE WHEN job_id % 11 = 0 THEN ' AND x = @(.NOPE@)' ELSE '' END, ' -- JOIN `wh.old.t2`') AS sql_text FROM jobs_v"""


def _braced(sql: str, opener: str, closer: str) -> str:
    return sql.replace("@(", opener).replace("@)", closer)


@query(
    "macro_render",
    f"""WITH {SETTINGS_SQL}, {V2_SQL}, {V1_SQL}, texts AS ({_braced(_SQL_TEXTS, '{{', '}}')}),
joined AS (SELECT v.*, x.sql_text, CASE WHEN w_version = 1 THEN s1t ELSE s2 END AS lo, CASE WHEN w_version = 1 THEN e1 ELSE e2 END AS hi FROM v1 v JOIN texts x USING (job_id))
SELECT run_id, CASE WHEN job_id % 11 = 0 OR job_id % 17 = 3 THEN NULL ELSE replace(replace(sql_text, '{{{{.DSTART}}}}', strftime(lo, '%Y-%m-%dT%H:%M:%SZ')), '{{{{ .DEND | Date }}}}', strftime(hi, '%Y-%m-%d')) END AS rendered,
       CASE WHEN job_id % 17 = 3 THEN 'cannot render {{{{.DSTART}}}}' WHEN job_id % 11 = 0 THEN 'cannot render {{{{.NOPE}}}}' END AS render_error FROM joined""",
)
def macro_render(t):
    """The query text of every run, rendered with the run's own data window; runs without a window cannot be rendered."""
    versions = t.jobs_v.withColumn("w_version", F.expr("IF(job_id % 17 = 3, 5, w_version)"))
    jobs = windows.with_settings(versions.select("job_id", "w_version", "w_size", "w_offset", "w_truncate"), "w_size", "w_offset", "w_truncate")
    texts = t.sql(_braced(_SQL_TEXTS, "{{{{", "}}}}")).selectExpr("job_id", "destination", f"{macros.normalized('sql_text')} AS sql_text")
    runs = t.sql("SELECT run_id, job_id, scheduled_at + (run_id % 50000) * INTERVAL '1' SECOND AS at_time FROM runs_v")
    runs = skew.join_many_to_one(runs, jobs.join(texts, "job_id"), ["job_id"])
    bound = windows.with_bounds(runs, "at_time", "w_version")
    values = {"DSTART": macros.rfc3339("window_start"), "DEND": macros.rfc3339("window_end"), "JOB_DESTINATION": "destination"}
    return macros.render(bound, "sql_text", values).select("run_id", "rendered", "render_error")


@query(
    "config_layers",
    """SELECT job_id, 'GLOBAL__bucket' AS key, project AS value FROM jobs_v
UNION ALL SELECT job_id, 'GLOBAL__region', 'r1' FROM jobs_v
UNION ALL SELECT job_id, 'TASK__load', CASE WHEN job_id % 4 = 0 THEN 'REPLACE' ELSE 'APPEND' END FROM jobs_v
UNION ALL SELECT job_id, 'TASK__dataset', namespace FROM jobs_v
UNION ALL SELECT job_id, 'DEST', CASE WHEN job_id % 4 = 0 THEN destination ELSE 'none' END FROM jobs_v""",
)
def config_layers(t):
    base = F.create_map(F.lit("DEST"), F.lit("none"))
    project = F.create_map(F.lit("bucket"), F.col("project"), F.lit("region"), F.lit("r1"))
    task = F.create_map(F.lit("load"), F.lit("APPEND"), F.lit("dataset"), F.col("namespace"))
    own = F.when(F.col("job_id") % 4 == 0, F.create_map(F.lit("TASK__load"), F.lit("REPLACE"), F.lit("DEST"), F.col("destination"))).otherwise(
        F.expr("map_from_arrays(array(), array())").cast("map<string,string>")
    )
    layers = t.jobs_v.select(
        "job_id", base.alias("base"), macros.prefixed(project, "GLOBAL__").alias("p"), macros.prefixed(task, "TASK__").alias("t"), own.alias("own")
    )
    merged = macros.last_wins(*[F.col(c) for c in ("base", "p", "t", "own")])
    return layers.select("job_id", F.explode(merged).alias("key", "value"))


@query(
    "config_split",
    """SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'dest,load' ELSE 'dest,load,token' END AS plain_keys, CASE WHEN job_id % 3 = 0 THEN 'token' ELSE '' END AS secret_keys FROM jobs_v""",
)
def config_split(t):
    config = F.expr("map('dest', destination, 'load', 'APPEND', 'token', IF(job_id % 3 = 0, '{{.secret.token}}', 'none'))")
    maps = t.jobs_v.select("job_id", config.alias("config"))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return maps.select(
        "job_id", keys(macros.plain_part(F.col("config"))).alias("plain_keys"), keys(macros.secret_part(F.col("config"))).alias("secret_keys")
    )


# --- parsing and checks -------------------------------------------------------------


def raw_events(t):
    """The event stream as it arrives: JSON payloads, some of them faulty."""
    return t.run_events_v.selectExpr(
        "event_id",
        "IF(event_id % 23 = 0, 'TYPE_NOPE', concat('TYPE_', upper(type))) AS event_type",
        """to_json(named_struct('status', IF(event_id % 23 = 1, 'odd', 'SUCCESS'), 'event_time', IF(event_id % 23 = 2, NULL, unix_seconds(event_time)),
             'task_id', IF(event_id % 23 = 3, '', 'task'),
             'scheduled_at', CASE event_id % 23 WHEN 4 THEN NULL WHEN 5 THEN 'yesterday' ELSE date_format(scheduled_at, "yyyy-MM-dd'T'HH:mm:ss'Z'") END)) AS payload""",
    )


@query(
    "event_parse",
    """SELECT event_id, CASE WHEN event_id % 23 = 0 THEN NULL ELSE type END AS type,
  CASE WHEN event_id % 23 IN (0, 1, 2, 3, 4, 5) THEN NULL ELSE 'success' END AS status,
  CASE WHEN event_id % 23 IN (0, 1, 2, 3, 4, 5) THEN NULL ELSE date_trunc('second', event_time) END AS event_time,
  CASE WHEN event_id % 23 IN (0, 1, 2, 3, 4, 5) THEN NULL ELSE scheduled_at END AS scheduled_at,
  CASE event_id % 23 WHEN 0 THEN 'unknown event type' WHEN 1 THEN 'unknown status' WHEN 2 THEN 'event_time is missing' WHEN 3 THEN 'task_id is missing'
    WHEN 4 THEN 'scheduled_at is missing' WHEN 5 THEN 'scheduled_at is not readable' END AS error FROM run_events_v""",
)
def event_parse(t):
    parsed = payloads.parse(raw_events(t), "event_type", "payload")
    keep = lambda c: f"IF(error IS NULL, {c}, NULL) AS {c}"
    return parsed.selectExpr("event_id", "type", keep("status"), keep("event_time"), keep("scheduled_at"), "error")


@query(
    "state_parse",
    """SELECT run_id, CASE WHEN run_id % 12 = 0 THEN NULL ELSE state END AS state, CASE WHEN run_id % 12 = 0 THEN 'invalid state' END AS error FROM runs_v""",
)
def state_parse(t):
    texts = t.runs_v.selectExpr("run_id", "IF(run_id % 12 = 0, 'finished', upper(state)) AS s")
    return texts.selectExpr("run_id", f"{names.run_state('s')} AS state").selectExpr(
        "run_id", "state", "IF(state IS NULL, 'invalid state', NULL) AS error"
    )


@query(
    "replay_user_state",
    "SELECT replay_id, status, CASE WHEN status IN ('in progress', 'partial replayed', 'replayed') THEN 'in progress' ELSE status END AS user_state FROM replays_v",
)
def replay_user_state(t):
    return t.replays_v.selectExpr("replay_id", "status", f"{names.replay_user_state('status')} AS user_state")


@query(
    "resource_name_check",
    """WITH r AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'warehouse' WHEN 1 THEN concat('wh.', p_type) WHEN 2 THEN concat('warehouse-1.', p_type, '.t') WHEN 3 THEN concat('warehouse-1.', p_brand)
  WHEN 4 THEN concat('warehouse-1.raw.', p_brand) ELSE concat('warehouse-1.raw.t', p_partkey) END AS full_name, p_partkey % 12 = 3 AS is_dataset FROM part)
SELECT id, full_name, is_dataset, CASE WHEN len(string_split(full_name, '.')) < 2 THEN 'too few sections' WHEN NOT regexp_matches(split_part(full_name, '.', 1), '^[a-z][a-z0-9-]{4,28}[a-z0-9]$') THEN 'bad project name'
  WHEN NOT regexp_matches(split_part(full_name, '.', 2), '^[a-zA-Z0-9_]+$') THEN 'bad dataset name' WHEN is_dataset THEN NULL WHEN len(string_split(full_name, '.')) <> 3 THEN 'wrong number of sections'
  WHEN NOT regexp_matches(split_part(full_name, '.', 3), '^[a-zA-Z0-9_-]+$') THEN 'bad table name' END AS error FROM r""",
)
def resource_name_check(t):
    rows = t.part.selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 6 WHEN 0 THEN 'warehouse' WHEN 1 THEN concat('wh.', p_type) WHEN 2 THEN concat('warehouse-1.', p_type, '.t') "
        "WHEN 3 THEN concat('warehouse-1.', p_brand) WHEN 4 THEN concat('warehouse-1.raw.', p_brand) ELSE concat('warehouse-1.raw.t', p_partkey) END AS full_name",
        "p_partkey % 12 = 3 AS is_dataset",
    )
    return rows.selectExpr("id", "full_name", "is_dataset", f"{names.resource_name_error('full_name', 'is_dataset')} AS error")


@query(
    "resource_spec_check",
    """SELECT p_partkey AS id, concat_ws('; ', CASE WHEN p_partkey % 13 = 0 THEN 'schema is empty' END, CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 5 = 0 THEN 'id: field type is empty' END,
  CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 7 = 0 THEN 'props.key: unknown mode many' END, CASE WHEN p_partkey % 3 = 0 THEN 'range partition has no range' END, CASE WHEN p_partkey % 4 = 0 THEN 'cluster has an empty column' END) AS errors FROM part""",
)
def resource_spec_check(t):
    """Table specifications built per row, one fault or another in each."""
    rows = t.part.selectExpr(
        "p_partkey AS id",
        """IF(p_partkey % 13 = 0, array(), array(
             named_struct('path', 'id', 'name', 'id', 'type', IF(p_partkey % 5 = 0, '', 'INTEGER'), 'mode', 'required'),
             named_struct('path', 'props', 'name', 'props', 'type', 'RECORD', 'mode', 'nullable'),
             named_struct('path', 'props.key', 'name', 'key', 'type', 'STRING', 'mode', IF(p_partkey % 7 = 0, 'MANY', 'Nullable')))) AS fields""",
        "IF(p_partkey % 3 = 0, 'RANGE', 'DAY') AS partition_type",
        "CAST(NULL AS BIGINT) AS range_interval",
        "array('id', IF(p_partkey % 4 = 0, '', 'props')) AS cluster",
    )
    return rows.selectExpr("id", f"array_join({specs.table_errors('fields', 'partition_type', 'range_interval', 'cluster')}, '; ') AS errors")


@query(
    "job_spec_check",
    """SELECT p_partkey AS id, concat_ws('; ', CASE WHEN p_partkey % 10 = 0 THEN 'name is empty' END, CASE WHEN p_partkey % 10 = 1 THEN 'name is too long' END, CASE WHEN p_partkey % 6 = 0 THEN 'start date is not yyyy-MM-dd' END,
  CASE WHEN p_partkey % 4 = 0 THEN 'version must be positive' END, CASE WHEN p_partkey % 9 = 0 THEN 'owner is empty' END) AS errors FROM part""",
)
def job_spec_check(t):
    rows = t.part.selectExpr(
        "p_partkey AS id",
        "CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN repeat(p_brand, 30) ELSE p_name END AS name",
        "IF(p_partkey % 6 = 0, '2022-13-01', '2022-10-01') AS start_date",
        "CAST(p_partkey % 4 AS INT) AS version",
        "IF(p_partkey % 9 = 0, '', p_brand) AS owner",
    )
    return rows.selectExpr("id", f"array_join({names.job_spec_errors('name', 'start_date', 'version', 'owner')}, '; ') AS errors")


@query(
    "sql_lineage",
    """WITH pairs AS (SELECT job_id, destination, CAST(FLOOR(job_id / 2.0) AS BIGINT) AS k FROM jobs_v
  UNION SELECT job_id, destination, CAST(FLOOR(job_id / 3.0) AS BIGINT) FROM jobs_v WHERE job_id % 5 = 0 AND job_id % 15 <> 0)
SELECT job_id, concat('wh.d', k % 3, '.t', k) AS source_table FROM pairs WHERE concat('store://wh:d', k % 3, '.t', k) <> destination""",
)
def sql_lineage(t):
    texts = t.sql(_braced(_SQL_TEXTS, "{{{{", "}}}}"))
    own = "concat_ws('.', 'wh', replace(destination, 'store://wh:', ''))"
    return lineage.tables_in_sql(texts.selectExpr("job_id", "sql_text", f"{own} AS own"), "sql_text", "own").select("job_id", "source_table")


# Each job reads the tables of its two upstreams through a comma list in a sub-query or a join behind WITH; literals and comments name others.
_HARD_TEXTS = r"""SELECT job_id, destination, CASE WHEN job_id % 3 = 0
 THEN concat('WITH `wh.d9.cte` AS (SELECT "-- it\\"s /* FROM `wh.no.a`" AS x, "JOIN `wh.no.b`" AS y FROM `wh.d', a % 3, '.t', a, '`), two AS (SELECT 1) SELECT * FROM `wh.d9.cte` c # FROM `wh.no.c`
  JOIN two ON c.x IS DISTINCT FROM `wh.no.d` LEFT JOIN (SELECT EXTRACT(DAY FROM ts) AS d, `wh.no.e` FROM /* @ignoreupstream */ `wh.no.f`, `wh`.`d', b % 3, '`.`t', b, '` WHERE x IN (1, 2)) z, `wh.d8.all` USING (d)')
 ELSE concat('SELECT count(*), `wh.no.a` FROM (`wh.d', a % 3, '.t', a, '` x INNER JOIN `wh.d', b % 3, '.t', b, '` y ON f(x.a, y.b)), `wh.d8.all` WHERE z = "*/" AND w = @FROM `wh.no.b` " @
  UNION ALL SELECT "/*", `wh.no.c`, "," -- FROM `wh.no.x`
  GROUP BY `wh.no.d`, `wh.no.e`') END AS sql_text
FROM (SELECT *, CAST(FLOOR(job_id / 2.0) AS BIGINT) AS a, CAST(FLOOR(job_id / 3.0) AS BIGINT) AS b FROM jobs_v) j""".replace("@FROM", '"""FROM').replace('" @', '" """')


@query(
    "sql_lineage_hard",
    """WITH pairs AS (SELECT job_id, destination, unnest([CAST(FLOOR(job_id / 2.0) AS BIGINT), CAST(FLOOR(job_id / 3.0) AS BIGINT)]) AS k FROM jobs_v)
SELECT DISTINCT job_id, concat('wh.d', k % 3, '.t', k) AS source_table FROM pairs WHERE concat('store://wh:d', k % 3, '.t', k) <> destination
UNION ALL SELECT job_id, 'wh.d8.all' FROM jobs_v""",
)
def sql_lineage_hard(t):
    """Texts with literals, comments, WITH, comma lists, joins in brackets and sub-queries."""
    texts = t.sql(_HARD_TEXTS)
    own = "concat_ws('.', 'wh', replace(destination, 'store://wh:', ''))"
    return lineage.tables_in_sql(texts.selectExpr("job_id", "sql_text", f"{own} AS own"), "sql_text", "own").select("job_id", "source_table")
