"""Job and resource registries as tables: lookup, validation, diff, state and namespace changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables.functions import windows
from flowtables.operators import skew


def active(df: DataFrame) -> DataFrame:
    return df.where("NOT is_deleted")


def jobs_by_filter(
    jobs: DataFrame,
    *,
    destination: str | None = None,
    project: str | None = None,
    names: Sequence[str] = (),
    name: str | None = None,
    namespaces: Sequence[str] = (),
    namespace: str | None = None,
) -> DataFrame:
    """One lookup rule by precedence: destination, then project with names, name, namespaces, namespace or alone."""
    if destination:
        return jobs.where(F.col("destination") == destination)
    if not project:
        raise ValueError("no filter matched")
    mine = jobs.where(F.col("project") == project)
    if names:
        return mine.where(F.col("name").isin(list(names)))
    if name:
        return mine.where(F.col("name") == name)
    if namespaces:
        return mine.where(F.col("namespace").isin(list(namespaces)))
    if namespace:
        return mine.where(F.col("namespace") == namespace)
    return mine


def runs_in_states(runs: DataFrame, states: Sequence[str]) -> DataFrame:
    """No states means all runs."""
    return runs.where(F.col("state").isin(list(states))) if states else runs


def recent_backups(backups: DataFrame, now: str, months: int = 3) -> DataFrame:
    """Created after the same clock time ``months`` earlier; a day that month lacks counts on into the next."""
    border = windows.add_months(f"CAST('{now}' AS TIMESTAMP)", f"-{months}")
    return backups.where(F.col("created_at") > F.expr(border))


def query_error(range_start: str, range_end: str, job_start: str) -> str:
    """SQL: why a run query is refused, or NULL."""
    return (
        f"CASE WHEN {job_start} IS NULL THEN 'job has no start date' "
        f"WHEN {range_start} < {job_start} OR {range_end} < {job_start} THEN 'range begins before the job does' END"
    )


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; every copy of a repeated key is dropped.

    One aggregation with map-side combining: no copy is kept together with the others and nothing is joined.
    """
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.any_value(F.struct(*rest)).alias("__row")).where("__n = 1")
    return once.select(*keys, "__row.*").select(*df.columns)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key that occurs more than once, reported once, with its number of copies."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def _by_content(c: Column, kind: T.DataType) -> Column:
    """The value with the entries of all its maps sorted, however deep they are."""
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(_by_content(e["key"], kind.keyType).alias("k"), _by_content(e["value"], kind.valueType).alias("v")))
        return F.array_sort(pairs)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _by_content(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_by_content(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """Hash of the values; maps are compared by content at any depth, not by order of entries."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [_by_content(F.col(c), kinds[c]).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def diff(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str], invalid: DataFrame | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """added / modified / deleted / unmodified per key. Keys with an invalid incoming row take no part.

    The columns to ``carry`` come along, the incoming row's value before the existing one's.
    """
    keys = list(keys)
    old = existing.select(*keys, fingerprint(existing, columns).alias("__old"), *[F.col(c).alias(f"__old_{c}") for c in carry])
    new = incoming.select(*keys, fingerprint(incoming, columns).alias("__new"), *[F.col(c).alias(f"__new_{c}") for c in carry])
    if invalid is not None:
        old, new = (side.join(invalid.select(*keys), keys, "left_anti") for side in (old, new))
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "deleted")
        .when(F.col("__old") == F.col("__new"), "unmodified")
        .otherwise("modified")
    )
    carried = [F.coalesce(f"__new_{c}", f"__old_{c}").alias(c) for c in carry]
    return old.join(new, keys, "full_outer").select(*keys, *carried, change.alias("change"))


def resource_actions(existing: DataFrame, incoming: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What a deployment does with each valid incoming resource: to_create, to_update, skipped or keep its status."""
    old = existing.select("full_name", "status", fingerprint(existing, columns).alias("__old"))
    new = incoming.where("status = 'validation_success'").select("full_name", fingerprint(incoming, columns).alias("__new"))
    action = (
        F.when(F.col("status").isNull(), "to_create")
        .when((F.col("status") == "success") & (F.col("__old") == F.col("__new")), "skipped")
        .when(F.col("status").isin("create_failure", "to_create"), "to_create")
        .when(F.col("status").isin("success", "to_update", "exist_in_store", "update_failure"), "to_update")
        .otherwise("validation_success")
    )
    return new.join(old, "full_name", "left").select("full_name", action.alias("action"))


def missing(requested: DataFrame, known: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Requested keys nothing is known about, with the reason they are ignored."""
    return requested.join(known.select(*keys).distinct(), list(keys), "left_anti").withColumn("reason", F.lit(reason))


def with_states(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs with their new state; jobs not named keep theirs."""
    return jobs.join(changes.select("job_id", F.col("state").alias("__new")), "job_id", "left").withColumn(
        "state", F.coalesce("__new", "state")
    ).drop("__new")


def unmatched(changes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Changes that name no job: a state change is refused when there are any."""
    return changes.join(jobs.select("job_id"), "job_id", "left_anti")


def set_states(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``with_states``, refused as a whole when a change names no job."""
    if not unmatched(changes, jobs).isEmpty():
        raise ValueError("a state change names a job that does not exist")
    return with_states(jobs, changes)


def moved(df: DataFrame, mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the namespace of their job's move; the same mapping serves job, edge and run tables."""
    target = mapping.select(*keys, F.col("namespace").alias("__to"))
    return skew.join_many_to_one(df, target, keys, "left").withColumn("namespace", F.coalesce("__to", "namespace")).drop("__to").select(*df.columns)


def priorities(jobs: DataFrame, edges: DataFrame, top: int = 10_000, step: int = 10) -> DataFrame:
    """top - step x (upstreams in the same project and namespace)."""
    tenant = jobs.select("job_id", "project", "namespace")
    up = tenant.selectExpr("job_id AS src", "project AS up_project", "namespace AS up_namespace")
    down = tenant.selectExpr("job_id AS dst", "project", "namespace")
    both = skew.join_many_to_one(skew.join_many_to_one(edges, up, ["src"]), down, ["dst"])
    counts = both.where("project = up_project AND namespace = up_namespace").groupBy(F.col("dst").alias("job_id")).agg(F.count("*").alias("n"))
    return tenant.join(counts, "job_id", "left").selectExpr("job_id", f"{top} - {step} * coalesce(n, 0) AS priority")


def with_group_size(df: DataFrame, keys: Sequence[str], into: str) -> DataFrame:
    """Rows with the size of their group, kept in long form: no group is gathered into one row."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias(into))
    return skew.join_many_to_one(df, sizes, keys)


def label_text(labels: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def batches(resources: DataFrame) -> DataFrame:
    """One row per dataset: whether it has its own resource or needs a default one, and what it holds by kind."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return resources.groupBy("dataset").agg(
        (of("dataset") == 0).alias("default_dataset"),
        of("table").alias("tables"),
        of("external_table").alias("external_tables"),
        of("view").alias("views"),
    )


def batch_members(resources: DataFrame) -> DataFrame:
    """The members in long form; unknown kinds are dropped."""
    return resources.where(F.col("kind").isin("dataset", "table", "external_table", "view")).select("dataset", "kind", "full_name")


def refresh_candidates(before: DataFrame, after: DataFrame, special: Sequence[str] = ("view_query", "schema", "source")) -> DataFrame:
    """URNs of resources in which any special key changed; two NULLs count as equal."""
    old = before.select("urn", *[F.col(c).alias(f"__{c}") for c in special])
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in special])
    return after.join(old, "urn").where(changed).select("urn")


def change_counters(changes: DataFrame, keys: Sequence[str] = ("project", "namespace")) -> DataFrame:
    return changes.groupBy(*keys, "change").agg(F.count("*").alias("n"))
