"""The tables a job reads, the jobs that write them, and the edges between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables import session
from flowtables.functions import names as N
from flowtables.operators import skew

# What a query text is made of; strings and comments come first, so that nothing inside them is read as anything else.
NOTE = r"/\*\s*@ignoreupstream\s*\*/"
_TOKENS = "|".join(
    [
        NOTE,
        r"(?s:/\*.*?(?:\*/|\z))",
        r"--[^\n]*",
        r"#[^\n]*",
        r"(?s:'''.*?(?:'''|\z))",
        r'(?s:""".*?(?:"""|\z))',
        r"'[^'\\]*+(?:\\(?s:.)[^'\\]*+)*+(?:'|\z)",
        r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\z)',
        r"`[^`]*`(?:\.`[^`]*`|\.\w+)*",
        r"\w+",
        r"[(),;]",
    ]
)
# Words that end a list of tables, and those with which a query in brackets begins.
_ENDS = "'SELECT', 'WHERE', 'GROUP', 'HAVING', 'QUALIFY', 'WINDOW', 'ORDER', 'LIMIT', 'UNION', 'INTERSECT', 'EXCEPT', 'SET', 'WITH', 'VALUES', ';'"


def tables_in_sql(df: DataFrame, sql: str, own: str | None = None, into: str = "source_table") -> DataFrame:
    """One row per distinct table a query text reads: back-quoted three-part names in the lists after FROM or JOIN.

    The text is cut into strings, comments, quoted names, words and marks. These are folded with a state: whether a table is
    expected next, whether an ignore note stands before it, and for each open bracket whether a comma goes on with a list of
    tables. The note removes the name right after it; names that WITH defines are no tables. A job does not read its own
    destination (``own``, a column).

    Reading a text costs far more than moving it, and a file of many texts is small: they are dealt to all tasks first.
    """
    df = df.repartition(session.shuffle_pieces(df.sparkSession))
    tokens = F.regexp_extract_all(F.col(sql), F.lit(_TOKENS), F.lit(0))
    # Comments go, strings become one mark, words are compared in upper case.
    kind = rf"""filter(transform(__raw, t -> CASE WHEN t RLIKE r'^{NOTE}$' THEN '@' WHEN left(t, 2) IN ('/*', '--') OR left(t, 1) = '#' THEN ''
        WHEN ascii(t) IN (34, 39) THEN '$' WHEN left(t, 1) = '`' THEN t ELSE upper(t) END), t -> t <> '')"""
    start = "named_struct('expect', false, 'skip', false, 'lists', '0', 'last', '', 'found', CAST(array() AS ARRAY<STRING>))"
    top = "concat(left(s.lists, length(s.lists) - 1), {})"
    step = f"""named_struct(
        'expect', CASE WHEN t IN ('@', '(') THEN s.expect WHEN t = 'FROM' THEN s.last <> 'DISTINCT' WHEN t = 'JOIN' THEN true WHEN t = ',' THEN right(s.lists, 1) = '1' ELSE false END,
        'skip', t = '@' AND s.expect,
        'lists', CASE WHEN t = '(' THEN concat(IF(s.expect, {top.format("'1'")}, s.lists), '0') WHEN t = ')' THEN IF(length(s.lists) > 1, left(s.lists, length(s.lists) - 1), '0')
            WHEN t IN ({_ENDS}) THEN {top.format("'0'")} WHEN s.expect AND t <> '@' THEN {top.format("'1'")} ELSE s.lists END,
        'last', t,
        'found', IF(s.expect AND NOT s.skip AND left(t, 1) = '`', array_append(s.found, replace(t, '`', '')), s.found))"""
    # name AS ( ... is a query that WITH names.
    named = "filter(transform(__t, (t, i) -> IF(t = '(' AND i > 1 AND get(__t, i - 1) = 'AS', replace(get(__t, i - 2), '`', ''), NULL)), t -> t IS NOT NULL)"
    given = [f"`{c}`" for c in df.columns]
    rows = df.withColumn("__raw", tokens).selectExpr(*given, f"{kind} AS __t")
    rows = rows.selectExpr(*given, f"array_except(aggregate(__t, {start}, (s, t) -> {step}).found, {named}) AS __f")
    rows = rows.selectExpr(*given, rf"explode(filter(__f, t -> t RLIKE r'^[^.]+\.[^.]+\.[^.]+$')) AS {into}")
    return rows.where(f"{own} IS NULL OR {into} <> {own}") if own else rows


def active(jobs: DataFrame) -> DataFrame:
    """Deleted jobs neither need upstreams nor provide them. A registry without ``is_deleted`` has none."""
    return jobs.where("NOT coalesce(is_deleted, false)") if "is_deleted" in jobs.columns else jobs


def declared(jobs: DataFrame, sources: DataFrame, static: DataFrame) -> DataFrame:
    """What each active job declares: static names (split into project and job) and source tables, unresolved."""
    owners = active(jobs).select("job_id", "project", "name")
    by_name = skew.join_many_to_one(static, owners, ["job_id"]).selectExpr(
        "job_id",
        f"{N.upstream_project('static_upstream', 'project')} AS upstream_project",
        f"{N.upstream_job('static_upstream')} AS upstream_job",
        "CAST(NULL AS STRING) AS resource",
        "'static' AS type",
    )
    by_table = skew.join_many_to_one(sources, owners.select("job_id"), ["job_id"]).selectExpr(
        "job_id", "CAST(NULL AS STRING) AS upstream_project", "CAST(NULL AS STRING) AS upstream_job", "source AS resource", "'inferred' AS type"
    )
    return by_name.unionByName(by_table)


def resolve_static(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Declared names matched with jobs by (project, name): two equalities instead of an OR condition."""
    found = active(jobs).selectExpr("project AS upstream_project", "name AS upstream_job", "destination", "namespace AS upstream_namespace", "job_id AS upstream_id")
    return skew.join_many_to_one(wanted.where("type = 'static'"), found, ["upstream_project", "upstream_job"])


def resolve_inferred(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Source tables matched with the jobs that write them, in any project."""
    found = active(jobs).selectExpr(
        "destination AS resource", "project AS p", "name AS n", "destination", "namespace AS upstream_namespace", "job_id AS upstream_id"
    )
    hit = skew.join_many_to_one(wanted.where("type = 'inferred'").drop("upstream_project", "upstream_job"), found, ["resource"])
    return hit.withColumnsRenamed({"p": "upstream_project", "n": "upstream_job"})


def first_producer(jobs: DataFrame) -> DataFrame:
    """One active job per destination: the lowest (project, name)."""
    return active(jobs).groupBy("destination").agg(
        F.min_by(F.struct("project", "name", "namespace", "job_id"), F.struct("project", "name")).alias("j")
    ).select("destination", "j.*")


def resolve(wanted: DataFrame, jobs: DataFrame, prefer: str = "name", hot_tables: DataFrame | None = None) -> DataFrame:
    """Every declared upstream with the job it means, or unresolved.

    ``prefer`` is the match tried first: ``name`` for whole registries, ``destination`` for a single job.
    ``hot_tables`` are the tables a very large number of jobs read (``skew.hot_keys``).
    """
    by_name = active(jobs).selectExpr("project AS __project", "name AS __name", "struct(project, name, namespace, destination) AS by_name")
    by_dest = first_producer(jobs).selectExpr("destination AS __table", "struct(project, name, namespace, destination) AS by_destination")
    step = wanted.withColumns(
        {
            "__project": F.coalesce("upstream_project", F.lit("")),
            "__name": skew.or_nowhere("upstream_job", "job_id", "resource"),
            "__table": skew.or_nowhere("resource", "job_id", "upstream_job"),
        }
    )
    if hot_tables is not None:
        hot_tables = hot_tables.withColumnRenamed("resource", "__table")
    step = skew.join_many_to_one(step, by_dest, ["__table"], "left", hot_tables)
    step = skew.join_many_to_one(step, by_name, ["__project", "__name"], "left")
    order = ("by_name", "by_destination") if prefer == "name" else ("by_destination", "by_name")
    return step.withColumn("hit", F.coalesce(*order)).selectExpr(
        "job_id",
        "coalesce(hit.project, upstream_project) AS upstream_project",
        "coalesce(hit.name, upstream_job) AS upstream_job",
        "hit.namespace AS upstream_namespace",
        "coalesce(hit.destination, resource) AS resource",
        "type",
        "IF(hit IS NULL, 'unresolved', 'resolved') AS state",
        "false AS external",
    )


def deduplicate(edges: DataFrame) -> DataFrame:
    """One row per upstream of a job.

    Resolved ones by full name, static before inferred; unresolved static by full name; unresolved
    inferred by table.
    """
    key = F.when(F.expr("state = 'unresolved' AND type = 'inferred'"), F.concat(F.lit("t:"), "resource")).otherwise(
        F.concat(F.when(F.col("state") == "resolved", "r:").otherwise("s:"), "upstream_project", F.lit("/"), "upstream_job")
    )
    keyed = edges.withColumn("__key", key)
    order = [F.when(F.col("type") == "static", 0).otherwise(1), F.col("resource")]
    return skew.first_rows(keyed, ["job_id", "__key"], order).drop("__key")


def bulk_resolve(jobs: DataFrame, sources: DataFrame, static: DataFrame, prefer: str = "name") -> DataFrame:
    hot = skew.hot_keys(sources.selectExpr("source AS resource"), ["resource"])
    return deduplicate(resolve(declared(jobs, sources, static), jobs, prefer, hot))


def resolve_elsewhere(edges: DataFrame, registries: dict[str, DataFrame]) -> DataFrame:
    """Still unresolved upstreams looked up in other registries; hits are external and carry the host.

    A table may have several producers; all are returned. Misses stay unresolved.
    """
    other = None
    for host, jobs in registries.items():
        part = active(jobs).selectExpr("project", "name", "namespace", "destination", f"'{host}' AS host")
        other = part if other is None else other.unionByName(part)
    by_name = other.selectExpr("project AS __project", "name AS __name", "struct(project, name, namespace, destination, host) AS by_name")
    by_dest = other.selectExpr("destination AS __table", "struct(project, name, namespace, destination, host) AS by_table")
    open_ = edges.where("state = 'unresolved'").withColumns(
        {
            "__project": F.when(F.col("type") == "static", F.col("upstream_project")).otherwise(F.lit("")),
            "__name": F.when(F.col("type") == "static", F.col("upstream_job")),
            "__table": F.when(F.col("type") == "inferred", F.col("resource")),
        }
    )
    open_ = open_.withColumns({"__name": skew.or_nowhere("__name", "job_id", "resource"), "__table": skew.or_nowhere("__table", "job_id", "upstream_job")})
    step = open_.join(by_name, ["__project", "__name"], "left").join(by_dest, "__table", "left")
    return step.withColumn("hit", F.coalesce("by_name", "by_table")).selectExpr(
        "job_id",
        "coalesce(hit.project, upstream_project) AS upstream_project",
        "coalesce(hit.name, upstream_job) AS upstream_job",
        "hit.namespace AS upstream_namespace",
        "coalesce(hit.destination, resource) AS resource",
        "type",
        "IF(hit IS NULL, 'unresolved', 'resolved') AS state",
        "hit IS NOT NULL AS external",
        "hit.host AS host",
    )


def unresolved_errors(edges: DataFrame) -> DataFrame:
    """Declared upstreams that nobody provides; an unknown source table is no error."""
    return edges.where("state = 'unresolved' AND type = 'static'")


def downstream_by_destination(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """(job, reader) where the reader, active and in the same project, reads the job's destination."""
    readers = skew.join_many_to_one(sources, active(jobs).select("job_id", "project"), ["job_id"])
    producers = jobs.selectExpr("destination AS source", "project", "job_id AS producer_id")
    return skew.join_many_to_one(readers, producers, ["source", "project"]).selectExpr("producer_id", "job_id AS downstream_id")


def downstream_by_sources(jobs: DataFrame, sources: DataFrame, resources: DataFrame) -> DataFrame:
    """Active jobs of all projects that read any of the given tables."""
    # Readers are reduced to distinct jobs inside each salt-free semi join; no pair is produced.
    reading = sources.join(resources.select("source"), "source", "left_semi").select("job_id").distinct()
    return active(jobs).join(reading, "job_id", "left_semi")


def downstream_by_job(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """Stored edges whose reading job is active."""
    readers = active(jobs).selectExpr("job_id AS dst", "name AS downstream_name", "project AS downstream_project")
    return skew.join_many_to_one(edges, readers, ["dst"])


def destination_writers(jobs: DataFrame) -> DataFrame:
    """(destination, job_id, name, n_writers): every active job that writes a table several of them write, in long form.

    The writers of a table beside a job are the other rows of its destination; no pairs are made.
    """
    writers = active(jobs).select("destination", "job_id", "name")
    shared = writers.groupBy("destination").agg(F.count("*").alias("n_writers")).where("n_writers > 1")
    return skew.join_many_to_one(writers, shared, ["destination"])


def same_destination(jobs: DataFrame) -> DataFrame:
    """Active jobs whose destination other active jobs write too, with how many others and another writer's name.

    The two lowest names per destination are enough to name another writer, so no pairs are made.
    """
    jobs = active(jobs)
    writers = jobs.groupBy("destination").agg(
        F.count("*").alias("writers"), F.min("name").alias("first"), F.max("name").alias("last")
    ).where("writers > 1")
    return skew.join_many_to_one(jobs, writers, ["destination"]).selectExpr(
        "job_id", "name", "destination", "writers - 1 AS n_others", "IF(name = first, last, first) AS other_job"
    )
