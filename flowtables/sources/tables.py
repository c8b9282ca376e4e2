"""Managed tables: creation, partition and cluster layout, expiry, external files, views."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowtables.functions import durations
from flowtables.sources import loads, specs
from flowtables.sources.specs import check_partitioning  # noqa: F401

# Partition type -> time unit.
UNITS = {"HOUR": "hour", "DAY": "day", "MONTH": "month", "YEAR": "year"}


class AlreadyExists(Exception):
    """The table is there already: not a failure of its creation."""


def create(spark: SparkSession, name: str, fields: list[dict], *, path: str | None = None, partition: str | None = None, properties: dict[str, str] | None = None) -> T.StructType:
    """Creates a table from its specification; labels and expiry are kept as table properties."""
    if spark.catalog.tableExists(name):
        raise AlreadyExists(name)
    schema = specs.struct_type(fields)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
    clauses = [f"CREATE TABLE {name} ({columns}) USING parquet"]
    if partition:
        clauses.append(f"PARTITIONED BY (`{partition}`)")
    if path:
        clauses.append(f"LOCATION '{path}'")
    if properties:
        clauses.append("TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")")
    try:
        spark.sql(" ".join(clauses))
    except AnalysisException as error:
        if error.getCondition() == "TABLE_OR_VIEW_ALREADY_EXISTS":
            raise AlreadyExists(name) from error
        raise
    return schema


def insert(df: DataFrame, name: str, schema: T.StructType) -> None:
    """Adds rows after casting them; rows without a required value are refused."""
    rows = specs.cast_to(df, schema)
    if not specs.required_missing(rows, schema).isEmpty():
        raise ValueError("a required column has no value")
    rows.write.insertInto(name)


def add_columns(spark: SparkSession, name: str, fields: list[dict]) -> None:
    """New nullable columns at the end of a table; existing rows have NULL there."""
    schema = specs.struct_type(fields)
    if any(not f.nullable for f in schema.fields):
        raise ValueError("a required column cannot be added to existing data")
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (" + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ")")


def update_properties(spark: SparkSession, name: str, properties: dict[str, str]) -> None:
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in properties.items()) + ")")


def time_partition(ts: Column, kind: str = "DAY") -> Column:
    """The partition a row belongs to; NULL times have a partition of their own."""
    return F.date_trunc(UNITS[(kind or "DAY").upper()], ts)


def range_partition(value: Column, start: int, end: int, interval: int) -> Column:
    """Lower bound of the row's range as text; NULL and out-of-range values have partitions of their own."""
    lower = F.floor((value - F.lit(start)) / F.lit(interval)) * F.lit(interval) + F.lit(start)
    return (
        F.when(value.isNull(), "__NULL__")
        .when((value < start) | (value >= end), "__UNPARTITIONED__")
        .otherwise(lower.cast("bigint").cast("string"))
    )


def expired_partitions(listing: DataFrame, partition: str, hours: int, now: str) -> DataFrame:
    """Partitions of a listing whose time to live is over."""
    return listing.where(F.timestamp_micros(F.unix_micros(F.col(partition).cast("timestamp")) + F.lit(hours * durations.HOUR)) <= F.expr(now))


def remove_expired(spark: SparkSession, path: str, partition: str, kind: str, hours: int, now: str) -> list[str]:
    """Deletes the partitions of a stored table whose time to live is over, and names them; no file is read.

    ``kind`` is the partition's type. The partition of NULL never expires.
    """
    listed = spark.createDataFrame(list(loads.partitions(spark, path, partition).items()), "name string, v string")
    gone = expired_partitions(listed.select("name", F.col("v").try_cast(kind).alias(partition)), partition, hours, now)
    names = sorted(r["name"] for r in gone.select("name").collect())
    loads.drop_partitions(spark, path, names)
    return names


def write_clustered(df: DataFrame, path: str, columns: Sequence[str], files: int | None = None) -> None:
    """Files hold narrow value ranges of the cluster columns, so that scans can skip them."""
    ordered = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    ordered.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def store_by_key(df: DataFrame, name: str, key: str, buckets: int, partition: str | None = None, path: str | None = None) -> None:
    """A table bucketed and sorted by a key that many joins share: tables stored alike join without a shuffle.

    For registries, edges and runs that are joined by job again and again. ``partition`` (for runs, the
    schedule date) is pruned as usual.
    """
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if partition:
        writer = writer.partitionBy(partition)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_external(
    spark: SparkSession, uris: Sequence[str], fmt: str, schema: T.StructType | None = None, skip_leading_rows: int = 0, cells: str = "", **options: str
) -> DataFrame:
    """External files. Without a schema it is detected; leading rows can be skipped in CSV files.

    ``cells`` limits every CSV file to a block of cells such as ``B3:D``, ``B:D`` or ``A1:C20``; leading rows are counted inside
    it. Without a schema, the last leading row names the columns. A record of such a file is one line.
    """
    if cells and fmt != "csv":
        raise ValueError("only CSV files have cells")
    if cells or (fmt == "csv" and skip_leading_rows > 1 and schema is None):
        return _read_cells(spark, uris, schema, skip_leading_rows, cell_range(cells), options)
    if fmt == "csv" and skip_leading_rows > 1:
        return _skip_lines(spark, uris, schema, skip_leading_rows, options)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv" and skip_leading_rows == 1:
        reader = reader.option("header", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.load(list(uris))


def _skip_lines(spark: SparkSession, uris: Sequence[str], schema: T.StructType, n: int, options: dict) -> DataFrame:
    lines = spark.read.text(list(uris)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    # Leading rows are in a file's first block, which one task reads in order. Only the n first of each file are
    # ranked beyond that task (Spark trims every file before the shuffle); the others pass as they are.
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line"))
    leading = lines.where("block = 0").select("file", "line", rank.alias("rank")).where(F.col("rank") <= n).groupBy("file").agg(F.max("line").alias("last"))
    rows = lines.join(leading, "file", "left").where("block > 0 OR last IS NULL OR line > last").select("value")
    parsed = rows.select(F.from_csv("value", F.lit(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)), options or None).alias("r"))
    return parsed.select("r.*")


def cell_range(text: str) -> tuple[int, int | None, int, int | None]:
    """First and last column, first and last row, from 1, of a range such as ``B3:D20``; None means to the end."""
    if not text:
        return 1, None, 1, None
    found = re.fullmatch(r"([A-Za-z]+)([1-9][0-9]*)?:([A-Za-z]+)?([1-9][0-9]*)?", text)
    if not found or not (found[3] or found[4]):
        raise ValueError(f"not a range of cells: {text!r}")
    column = lambda letters: sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters.upper())))
    first, last = column(found[1]), column(found[3]) if found[3] else None
    top, bottom = int(found[2] or 1), int(found[4]) if found[4] else None
    if (last is not None and last < first) or (bottom is not None and bottom < top):
        raise ValueError(f"a range of cells ends before it starts: {text!r}")
    return first, last, top, bottom


def _numbered_lines(spark: SparkSession, uris: Sequence[str]) -> DataFrame:
    """Lines with their file and their number in it, from 1. Large files are read in blocks by many tasks: a block's lines are
    counted first, and the counts of a file's earlier blocks are added up."""
    lines = spark.read.text(list(uris)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (earlier - F.col("first") + 1).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("value", "file", (F.col("line") + F.col("shift")).alias("row"))


# What texts that a cast accepts look like; some others do too.
_WHOLE = r"[+-]?[0-9]+"
_NUMBER = r"(?i:[+-]?(?:nan|inf(?:inity)?|0x[0-9a-f.]+p[+-]?[0-9]+[fd]?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[fd]?))"
_MOMENT = r"[+-]?(?:0[0-9]{6}|[0-2][0-9]{5}|[0-9]{4,5})(?:-.*)?|T[0-9].*|.*:.*"
_TRUTH = r"(?i:t|true|y|yes|1|f|false|n|no|0)"


def _detected(rows: DataFrame) -> DataFrame:
    """Text columns cast to the first type that every value has: whole number, number, date, time, truth value, else text."""
    # A failed cast costs far more than a pattern, so values that cannot have a type do not reach its cast.
    may_be = lambda pattern: rf"{{c}} RLIKE r'(?s)^[\s\p{{Cntrl}}]*(?:{pattern})[\s\p{{Cntrl}}]*$'"
    fits = {
        "bigint": f"{may_be(_WHOLE)} AND try_cast({{c}} AS BIGINT) IS NOT NULL",
        "double": f"{may_be(_NUMBER)} AND try_cast({{c}} AS DOUBLE) IS NOT NULL",
        "date": "trim({c}) RLIKE '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$' AND try_cast({c} AS DATE) IS NOT NULL",
        "timestamp": f"{may_be(_MOMENT)} AND try_cast({{c}} AS TIMESTAMP) IS NOT NULL",
        "boolean": f"{may_be(_TRUTH)} AND try_cast({{c}} AS BOOLEAN) IS NOT NULL",
    }
    tests = [f"bool_and({test.replace('{c}', f'c{k}')}) FILTER (WHERE c{k} IS NOT NULL) AS {kind}_{k}" for k in range(len(rows.columns)) for kind, test in fits.items()]
    found = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]).selectExpr(*tests).first()
    kinds = [next((kind for kind in fits if found[f"{kind}_{k}"]), "string") for k in range(len(rows.columns))]
    return rows.toDF(*[f"c{k}" for k in range(len(kinds))]).selectExpr(*[f"CAST(c{k} AS {kind}) AS c{k}" for k, kind in enumerate(kinds)]).toDF(*rows.columns)


def _read_cells(
    spark: SparkSession, uris: Sequence[str], schema: T.StructType | None, leading: int, cells: tuple[int, int | None, int, int | None], options: dict
) -> DataFrame:
    first, last, top, bottom = cells
    lines = _numbered_lines(spark, uris)
    inside = lines.where((F.col("row") >= top + leading) & (F.lit(True) if bottom is None else F.col("row") <= bottom))
    inside = inside.where(F.trim("value") != "")
    if schema is not None:
        if last is not None and last - first + 1 != len(schema):
            raise ValueError(f"{len(schema)} columns for a range of {last - first + 1}")
        kept = list(schema.fields)
    else:
        # One line tells the names, or how many columns there are: the last leading row, else the first row, of the first file.
        wanted = lines.where(F.col("row") == top + leading - 1) if leading else inside
        line = wanted.orderBy("file", "row").select("value").first()
        if line is None:
            return spark.createDataFrame([], T.StructType())
        width = len(re.findall(r"_c\d+: ", spark.range(1).select(F.schema_of_csv(F.lit(line["value"]), options or None)).first()[0]))
        texts = ", ".join(f"c{k} STRING" for k in range(width))
        shown = spark.range(1).select(F.from_csv(F.lit(line["value"]), F.lit(texts), options or None).alias("r")).first()["r"]
        kept = []
        for k in range(first - 1, min(width, last or width)):
            name = (shown[k] if leading else None) or f"_c{k}"
            taken = {f.name.lower() for f in kept}
            kept.append(T.StructField(f"{name}{k}" if name.lower() in taken else name, T.StringType()))
        if not kept:
            return spark.createDataFrame([], T.StructType())
    fields = [f"c{k} STRING" for k in range(first - 1)] + [f"c{first - 1 + k} {f.dataType.simpleString()}" for k, f in enumerate(kept)]
    rows = inside.select(F.from_csv("value", F.lit(", ".join(fields)), options or None).alias("r"))
    rows = rows.select(*[F.col(f"r.c{first - 1 + k}").alias(f.name) for k, f in enumerate(kept)])
    return rows if schema is not None else _detected(rows)


def create_view(spark: SparkSession, name: str, query: str, *, temporary: bool = True) -> DataFrame:
    """Creates a view or replaces its query."""
    spark.sql(f"CREATE OR REPLACE {'TEMPORARY ' if temporary else ''}VIEW {name} AS {query}")
    return spark.table(name)
