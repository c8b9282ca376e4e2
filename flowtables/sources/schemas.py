"""Schemas of a stored table: a history in which columns are known by numbers, not by names.

Every schema is a file ``_schemas/<number>`` below the table, created only if no other schema has taken its number. A load's
folder is named after the schema it was written under (see ``loads``), and its files are read under that one: columns keep
their number when they are renamed or widened, a dropped column is read no more, and a new column with an old
name is a column of its own, NULL in older rows. No file of rows is ever rewritten for a change of schema.

A table that has rows before its first schema is taken to hold them under it. Tables without a history are read as they are.
A nested type counts as a whole: it can be added, dropped and renamed, not changed.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field, replace as with_values

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables.sources import specs, versions
from flowtables.sources.versions import Files

HISTORY = "_schemas"


@dataclass(frozen=True)
class TableSchema:
    """``ids`` has the number of each column of ``columns``; ``last_id`` is the highest number ever given."""

    number: int
    columns: T.StructType
    ids: tuple[int, ...]
    last_id: int
    partition: str
    partitioning: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)

    def text(self) -> str:
        kept = {k: getattr(self, k) for k in ("ids", "last_id", "partition", "partitioning", "labels")}
        return json.dumps({"columns": self.columns.jsonValue(), **kept})

    @staticmethod
    def parse(number: int, text: str) -> TableSchema:
        held = json.loads(text)
        return TableSchema(number, T.StructType.fromJson(held.pop("columns")), tuple(held.pop("ids")), **held)


def _number(files: Files, path: str) -> int:
    return max((int(n) for n in files.names(f"{path}/{HISTORY}") if n.isdigit()), default=0)


def _get(files: Files, path: str, number: int) -> TableSchema:
    return TableSchema.parse(number, files.read(f"{path}/{HISTORY}/{number:020d}"))


def newest(files: Files, path: str) -> TableSchema | None:
    number = _number(files, path)
    return _get(files, path, number) if number else None


def current(spark: SparkSession, path: str) -> TableSchema:
    found = newest(Files(spark), path)
    if found is None:
        raise ValueError(f"{path} has no schema")
    return found


def history(spark: SparkSession, path: str) -> list[TableSchema]:
    """All schemas, oldest first."""
    files = Files(spark)
    return [_get(files, path, k) for k in range(1, _number(files, path) + 1)]


def _put(files: Files, path: str, schema: TableSchema) -> TableSchema:
    if not files.create(f"{path}/{HISTORY}/{schema.number:020d}", schema.text()):
        raise versions.Conflict(f"{path}: another schema has number {schema.number}")
    return schema


def create(spark: SparkSession, path: str, fields: list[dict], partition: str, partitioning: dict | None = None, labels: dict[str, str] | None = None) -> TableSchema:
    """The first schema of a table, from its specification."""
    columns = specs.struct_type(fields)
    _check_columns(columns, partition)
    ids = tuple(range(1, len(columns) + 1))
    return _put(Files(spark), path, TableSchema(1, columns, ids, len(columns), partition, partitioning or {}, labels or {}))


def _check_columns(columns: T.StructType, partition: str) -> None:
    names = [f.name.lower() for f in columns.fields]
    if len(set(names)) < len(names):
        raise ValueError("two columns have one name")
    if partition not in columns.names:
        raise ValueError(f"there is no column {partition} to partition by")


def replace(
    spark: SparkSession, path: str, fields: list[dict], renames: Mapping[str, str] | None = None,
    partitioning: dict | None = None, labels: dict[str, str] | None = None,
) -> TableSchema:
    """Puts a new specification in place of the current schema; ``renames`` maps old names to new ones.

    A column of the same name, or renamed, is the same column: its type may widen, a required one may become optional, and its
    description and place may change. All others are dropped or new; a new column must be optional. The partition column stays as it is, and
    so does range partitioning. Without ``partitioning`` or ``labels`` those of before hold. Of two replacements at
    once, one is refused.
    """
    files, old = Files(spark), current(spark, path)
    columns = specs.struct_type(fields)
    _check_columns(columns, old.partition)
    if partitioning is not None:
        specs.check_partitioning(old.partitioning, partitioning)
    renames = dict(renames or {})
    for before, after in renames.items():
        if before not in old.columns.names or after not in columns.names:
            raise ValueError(f"cannot rename {before} to {after}")
    if old.partition in renames or len(set(renames.values())) < len(renames):
        raise ValueError("the partition column keeps its name, and two columns cannot get one name")
    came_from = {after: before for before, after in renames.items()}
    known = dict(zip(old.columns.names, old.ids, strict=True))
    ids, last = [], old.last_id
    for new in columns.fields:
        # A name that was given away by a rename is free for a new column.
        before = came_from.get(new.name, new.name if new.name not in renames else None)
        if before in known:
            was = old.columns[before]
            specs.check_change(was, new, fixed=before == old.partition)
            ids.append(known[before])
        elif not new.nullable:
            raise ValueError(f"{new.name}: a required column cannot be added to existing data")
        else:
            last += 1
            ids.append(last)
    made = with_values(old, number=old.number + 1, columns=columns, ids=tuple(ids), last_id=last)
    if partitioning is not None:
        made = with_values(made, partitioning=partitioning)
    return _put(files, path, made if labels is None else with_values(made, labels=labels))


def conform(df: DataFrame, schema: TableSchema, whole: bool = False) -> DataFrame:
    """Rows in the columns and types of a schema, by name. Missing optional columns are NULL, unless rows must be ``whole``;
    a missing value of a required column fails the write."""
    unknown = set(df.columns) - set(schema.columns.names)
    missing = [f.name for f in schema.columns.fields if f.name not in df.columns and (whole or not f.nullable)]
    if unknown or missing:
        raise ValueError(f"columns not in the schema: {sorted(unknown)}; missing columns: {missing}")
    out = []
    for f in schema.columns.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        specs.check_change(T.StructField(f.name, df.schema[f.name].dataType, True), T.StructField(f.name, f.dataType, True))
        value = F.col(f"`{f.name}`").cast(f.dataType)
        if not f.nullable:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{f.name}: a required column has no value"))).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def load_name(load: str, schema: TableSchema | None) -> str:
    return f"{load}-{schema.number}" if schema else load


def _written_under(load: str) -> int:
    _, _, number = load.partition("-")
    return int(number) if number else 1


def scan(spark: SparkSession, path: str, content: Mapping[str, list[str]], wanted: T.StructType) -> DataFrame:
    """The rows of these partitions in the wanted columns, each file under the schema it was written with."""
    files = Files(spark)
    now = newest(files, path)
    if now is None:
        return versions.scan(spark, path, content, wanted)
    ids = dict(zip(now.columns.names, now.ids, strict=True))
    unknown = [f.name for f in wanted.fields if f.name not in ids]
    if unknown:
        raise ValueError(f"columns not in the schema: {unknown}")
    by_schema: dict[int, dict[str, list[str]]] = defaultdict(dict)
    for name, loads in content.items():
        for load in loads:
            by_schema[_written_under(load)].setdefault(name, []).append(load)
    out = None
    for number, part in sorted(by_schema.items()):
        then = now if number == now.number else _get(files, path, number)
        names = dict(zip(then.ids, then.columns.names, strict=True))
        held = [f for f in wanted.fields if ids[f.name] in names]
        # Only the columns asked for are read, under their names and types of then.
        asked = [then.columns[names[ids[f.name]]] for f in held]
        partition = then.columns[then.partition]
        rows = versions.scan(spark, path, part, T.StructType([*[f for f in asked if f.name != partition.name], partition]))
        rows = rows.select(*[
            (F.col(f"`{names[ids[f.name]]}`") if f in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields
        ])
        out = rows if out is None else out.unionByName(rows)
    return versions.scan(spark, path, {}, wanted) if out is None else out
