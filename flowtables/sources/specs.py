"""Table specifications: schema texts to Spark types, and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Specification type -> Spark type.
TYPES = {
    "STRING": T.StringType(),
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "BYTES": T.BinaryType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "DATETIME": T.TimestampNTZType(),
    "NUMERIC": T.DecimalType(38, 9),
}


def struct_type(fields: list[dict]) -> T.StructType:
    """Specification fields (name, type, mode, schema) as a StructType."""
    return T.StructType([_field(f) for f in fields])


def _field(spec: dict) -> T.StructField:
    kind, mode = spec["type"].upper(), (spec.get("mode") or "nullable").lower()
    if kind in ("RECORD", "STRUCT"):
        data = struct_type(spec.get("schema") or [])
    elif kind in TYPES:
        data = TYPES[kind]
    else:
        raise ValueError(f"{spec['name']}: type {spec['type']} is not supported")
    if mode not in ("nullable", "required", "repeated"):
        raise ValueError(f"{spec['name']}: unknown mode {mode}")
    if mode == "repeated":
        data = T.ArrayType(data, containsNull=False)
    return T.StructField(spec["name"], data, nullable=mode != "required", metadata={"comment": spec.get("description", "")})


def required_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in which a required column is NULL: they must not be written."""
    bad = [F.col(f.name).isNull() for f in schema.fields if not f.nullable]
    return df.where(F.greatest(*bad, F.lit(False), F.lit(False))) if bad else df.limit(0)


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns cast to the specification by name; a value that does not fit becomes NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


# Changes of type that lose nothing.
WIDER = {("int", "bigint"), ("int", "double"), ("int", "decimal(38,9)"), ("float", "double"), ("bigint", "decimal(38,9)"), ("date", "timestamp")}


def check_change(old: T.StructField, new: T.StructField, fixed: bool = False) -> None:
    """A column may be widened and become optional, not the reverse; a fixed one keeps its type."""
    pair = (old.dataType.simpleString(), new.dataType.simpleString())
    if pair[0] != pair[1] and (fixed or pair not in WIDER):
        raise ValueError(f"column {old.name} cannot change from {pair[0]} to {pair[1]}")
    if old.nullable and not new.nullable:
        raise ValueError(f"column {old.name} cannot become required")


def check_partitioning(old: dict, new: dict) -> None:
    """Time partitioning may change; range partitioning may not."""
    if old.get("type", "").upper() == "RANGE" and old != new:
        raise ValueError("range partitioning cannot be changed")


def evolve(df: DataFrame, old: T.StructType, new: T.StructType) -> DataFrame:
    """Old data under a new schema: columns may be added or widened, not dropped or narrowed (``schemas`` drops and renames)."""
    target = {f.name: f for f in new.fields}
    for f in old.fields:
        if f.name not in target:
            raise ValueError(f"column {f.name} cannot be dropped")
        check_change(T.StructField(f.name, f.dataType, False), T.StructField(f.name, target[f.name].dataType, True))
    added = [f for f in new.fields if f.name not in set(old.fieldNames())]
    if any(not f.nullable for f in added):
        raise ValueError("a required column cannot be added to existing data")
    names = set(old.fieldNames())
    return df.select(
        *[(F.col(f.name).cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
    )


def field_errors(fields: str) -> str:
    """SQL: complaints about flattened fields (array of path, name, type, mode); nested ones carry their path."""
    return f"""flatten(transform({fields}, f -> array_compact(array(
        IF(trim(f.name) = '', 'field name is empty', NULL),
        IF(trim(f.type) = '', concat(f.path, ': field type is empty'), NULL),
        IF(lower(coalesce(f.mode, '')) NOT IN ('', 'nullable', 'required', 'repeated'), concat(f.path, ': unknown mode ', lower(f.mode)), NULL)))))"""


def table_errors(fields: str, partition_type: str, range_interval: str, cluster: str) -> str:
    """SQL: all complaints about table specifications, as an array."""
    return f"""concat(
        IF(size({fields}) = 0, array('schema is empty'), array()), {field_errors(fields)},
        IF(lower({partition_type}) = 'range' AND {range_interval} IS NULL, array('range partition has no range'), array()),
        CASE WHEN size({cluster}) = 0 THEN array('cluster is empty') WHEN exists({cluster}, c -> c = '') THEN array('cluster has an empty column') ELSE array() END)"""


def external_errors(source_type: str, uris: str) -> str:
    return f"""array_compact(array(IF(coalesce({source_type}, '') = '', 'source type is empty', NULL),
        CASE WHEN coalesce(size({uris}), 0) <= 0 THEN 'uri list is empty' WHEN exists({uris}, u -> u = '') THEN 'uri is empty' END))"""


def view_errors(view_query: str) -> str:
    return f"array_compact(array(IF(trim(coalesce({view_query}, '')) = '', 'view query is empty', NULL)))"
