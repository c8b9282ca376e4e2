"""Load methods: append, replace, replace by filter, replace all, merge.

A load is one write into a folder of its own and one file that puts it into effect (see ``versions``): whatever happens before, during or
after, readers find the table with the load or without it. All methods but append give the same table when a run is
repeated. NULL is a partition value and a key value like any other. Tables are read with ``read``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables.sources import schemas, versions
from flowtables.sources.versions import Content, Files


def read(spark: SparkSession, path: str, like: DataFrame | T.StructType | str | None = None) -> DataFrame:
    """The newest version of a stored table; ``like`` gives its columns, by default those of its current schema."""
    if like is None:
        like = schemas.current(spark, path).columns
    schema = like.schema if isinstance(like, DataFrame) else T._parse_datatype_string(like) if isinstance(like, str) else like
    return schemas.scan(spark, path, versions.latest(Files(spark), path)[1], schema)


@contextmanager
def _written(df: DataFrame, path: str, partition: str) -> Iterator[tuple[Files, str, list[str]]]:
    """Rows written but not in effect: (files, load, partitions). An error removes what no version names."""
    files = Files(df.sparkSession)
    schema = schemas.newest(files, path)
    load = schemas.load_name(uuid.uuid4().hex, schema)
    if schema:
        df = schemas.conform(df, schema)
    try:
        versions.write(df, path, partition, load)
        yield files, load, versions.arrived(files, path, load)
    except BaseException:
        if not any(load in x for x in versions.latest(files, path)[1].values()):
            files.delete(f"{path}/{versions.LOAD}={load}")
        raise


def append(df: DataFrame, path: str, partition: str) -> None:
    with _written(df, path, partition) as (files, load, names):
        versions.commit(files, path, versions.latest(files, path, partition), lambda c: {**c, **{n: [*c.get(n, []), load] for n in names}})


def replace(df: DataFrame, path: str, partition: str) -> None:
    """The partitions present in the result are replaced."""
    with _written(df, path, partition) as (files, load, names):
        versions.commit(files, path, versions.latest(files, path, partition), lambda c: {**c, **{n: [load] for n in names}})


def replace_all(df: DataFrame, path: str, partition: str) -> None:
    """The whole table is replaced."""
    with _written(df, path, partition) as (files, load, names):
        versions.commit(files, path, versions.latest(files, path, partition), lambda c: {n: [load] for n in names})


def replace_filter(df: DataFrame, path: str, partition: str, matches: str) -> None:
    """Partitions that match the SQL condition go, also those the result has no rows for; then the result takes their place."""
    spark, kind = df.sparkSession, df.schema[partition].dataType

    def change(content: Content, load: str, arriving: list[str]) -> Content:
        listed = _named(spark, content, partition, kind)
        gone = {r["name"] for r in listed.where(matches).collect()}
        return {**{n: x for n, x in content.items() if n not in gone}, **{n: [load] for n in arriving}}

    with _written(df, path, partition) as (files, load, names):
        versions.commit(files, path, versions.latest(files, path, partition), lambda c: change(c, load, names))


replace_merge = replace


# --- merge --------------------------------------------------------------------------


@dataclass(frozen=True)
class Clause:
    """What happens to a row: ``action`` is update, insert or delete, ``condition`` an SQL condition on the target's columns ``t.x`` and
    the source's ``s.x``, ``values`` an SQL expression per column. Without values an insert or update takes the source's
    row; columns that are not named keep their value, or are NULL in an insert."""

    action: str
    condition: str | None = None
    values: tuple[tuple[str, str], ...] | None = None


UPSERT = (Clause("update"),), (Clause("insert"),)


def merge(
    source: DataFrame, path: str, partition: str, keys: Sequence[str],
    matched: Sequence[Clause] = UPSERT[0], not_matched: Sequence[Clause] = UPSERT[1], not_matched_by_source: Sequence[Clause] = (),
) -> None:
    """Brings a source into a table, row by row; the first clause whose condition is true decides, and a row without one stays as it is.

    ``matched`` clauses (update, delete) decide on rows whose keys are equal, NULLs included; ``not_matched`` ones (insert) on source rows without a
    target row; ``not_matched_by_source`` ones (update, delete) on target rows without a source row. Without clauses, rows are
    updated or inserted. Repeated source keys are an error.

    Only partitions that hold a row with a source key are read for the result and written again; where the partition is one
    of the keys, no other partition is read at all. Rows that arrive in other partitions are added to those. Clauses for
    target rows without a source row read the whole table.
    """
    spark, keys = source.sparkSession, list(keys)
    files, staged = Files(spark), f"{path}/_staged-{uuid.uuid4().hex}"
    _check(matched, {"update", "delete"})
    _check(not_matched, {"insert"})
    _check(not_matched_by_source, {"update", "delete"})
    base, schema = versions.latest(files, path, partition), schemas.newest(files, path)
    if schema:
        # A column the source does not know would be lost.
        source = schemas.conform(source, schema, whole=True)
    try:
        source.write.parquet(staged)
        rows = spark.read.schema(source.schema).parquet(staged)
        kind = source.schema[partition].dataType
        # One pass over the keys tells whether any repeats, and which partitions they mean.
        counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
        wanted = F.collect_set(F.struct(F.col(partition).cast("string").alias("v"))) if partition in keys else F.lit(None)
        facts = counted.agg(F.max("__n").alias("most"), wanted.alias("values")).first()
        if (facts["most"] or 0) > 1:
            raise ValueError(f"source has several rows for one key ({', '.join(keys)})")
        if not_matched_by_source:
            read_names = set(base[1])
        elif partition in keys:
            listed = _named(spark, base[1], partition, kind)
            read_names = {r["name"] for r in listed.where(_is_any(partition, [x["v"] for x in facts["values"]], kind)).collect()}
        else:
            target = schemas.scan(spark, path, base[1], source.schema)
            held = target.select(partition, *[F.col(k).alias(f"__{k}") for k in keys])
            same = [F.col(f"__{k}").eqNullSafe(F.col(k)) for k in keys]
            # As many values as the table has folders at most.
            values = [r[0] for r in held.join(rows.select(*[F.col(k) for k in keys]).alias("s"), same, "left_semi").select(F.col(partition).cast("string")).distinct().collect()] if base[1] else []
            read_names = {r["name"] for r in _named(spark, base[1], partition, kind).where(_is_any(partition, values, kind)).collect()}
        target = schemas.scan(spark, path, {n: x for n, x in base[1].items() if n in read_names}, source.schema)
        result = _merged(target, rows, keys, matched, not_matched, not_matched_by_source)
        with _written(result, path, partition) as (_, load, names):

            def change(content: Content) -> Content:
                kept = {n: x for n, x in content.items() if n not in read_names}
                return {**kept, **{n: [*kept.get(n, []), load] for n in names}}

            # Elsewhere, rows may have come whose keys the source has too.
            versions.commit(files, path, base, change, read_names if partition in keys and not not_matched_by_source else None)
    finally:
        files.delete(staged)


def _check(clauses: Sequence[Clause], allowed: set[str]) -> None:
    for clause in clauses:
        if clause.action not in allowed:
            raise ValueError(f"{clause.action} is not one of {', '.join(sorted(allowed))} here")


def _merged(target: DataFrame, source: DataFrame, keys: Sequence[str], matched: Sequence[Clause], not_matched: Sequence[Clause], by_source: Sequence[Clause]) -> DataFrame:
    """The rows of the target after the merge: one full outer join, and the number of the clause that decides on each row."""
    here = F.lit(True).alias("__here")
    t, s = target.select("*", here).alias("t"), source.select("*", here).alias("s")
    joined = t.join(s, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys], "full_outer")
    in_t, in_s = F.col("t.__here").isNotNull(), F.col("s.__here").isNotNull()
    numbered = [(in_t & in_s, c) for c in matched] + [(in_s & ~in_t, c) for c in not_matched] + [(in_t & ~in_s, c) for c in by_source]
    # Target rows that no clause takes stay; source rows that none takes have no place.
    decide = F.when(in_t, F.lit(-1)).otherwise(F.lit(-2))
    for k, (where, clause) in reversed(list(enumerate(numbered))):
        holds = where if clause.condition is None else where & F.coalesce(F.expr(clause.condition), F.lit(False))
        decide = F.when(holds, F.lit(k)).otherwise(decide)
    decided = joined.withColumn("__clause", decide)
    deletes = [k for k, (_, c) in enumerate(numbered) if c.action == "delete"]
    left = decided.where(~F.col("__clause").isin(-2, *deletes))

    def column(field: T.StructField) -> Column:
        old, new = F.col(f"t.`{field.name}`"), F.col(f"s.`{field.name}`")
        value = old
        for k, (_, clause) in enumerate(numbered):
            if clause.action == "delete":
                continue
            given = dict(clause.values) if clause.values is not None else None
            mine = new if given is None else F.expr(given[field.name]) if field.name in given else old
            value = F.when(F.col("__clause") == k, mine).otherwise(value)
        return value.cast(field.dataType).alias(field.name)

    return left.select(*[column(f) for f in source.schema.fields])


def _is_any(partition: str, values: list[str | None], kind: T.DataType) -> Column:
    known = F.col(partition).isin(*[F.lit(v).cast(kind) for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    return known | F.col(partition).isNull() if None in values else known


# --- partitions ---------------------------------------------------------------------


def _named(spark: SparkSession, content: Content, partition: str, kind: T.DataType) -> DataFrame:
    """(name, value) of partitions: one row per folder name."""
    listed = spark.createDataFrame([(n, versions.value_of(n)) for n in sorted(content)], "name string, v string")
    return listed.select("name", F.col("v").try_cast(kind).alias(partition))


def partitions(spark: SparkSession, path: str, partition: str) -> dict[str, str | None]:
    """Partitions of a stored table, without reading a file of rows: folder name -> value (None for NULL)."""
    return {n: versions.value_of(n) for n in sorted(versions.latest(Files(spark), path, partition)[1])}


def drop_partitions(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    """Takes partitions out of the table by the names ``partitions`` gives; ``versions.clean`` deletes their files."""
    files, gone = Files(spark), set(names)
    if gone:
        versions.commit(files, path, versions.latest(files, path), lambda c: {n: x for n, x in c.items() if n not in gone})
