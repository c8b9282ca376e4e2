"""Helpers the operators of this package share."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables import session

# White space and words as every operator here means them.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    return session.prepare(spark)


def pieces(spark: SparkSession) -> int:
    """How many partitions a shuffle starts with."""
    return session.shuffle_pieces(spark)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that their names cannot clash with working columns."""
    return F.struct(*[col(c) for c in df.columns])


def unpack(df: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    return df.select(*[F.col(row)[c].alias(c) for c in columns])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name), F.lit(""))


def stored(df: DataFrame, label: str, row_group: int = 128 << 20) -> DataFrame:
    """Writes to the shared folder and reads back: lineage ends here and lost executors cost nothing twice.

    Compressed Parquet; narrow intermediate tables use ``session.cut_lineage`` instead, whose files Spark
    deletes by itself. These stay until ``clear`` or until the scratch folder is emptied.
    """
    spark = df.sparkSession
    path = f"{session.shared_dir(spark)}/flowtables/{spark.sparkContext.applicationId}/{label}-{_serial()}"
    df.write.option("compression", "zstd").option("parquet.block.size", row_group).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_count = 0


def _serial() -> int:
    global _count
    _count += 1
    return _count


def clear(spark: SparkSession) -> None:
    """Deletes what ``stored`` wrote in this application; call it when the results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{session.shared_dir(spark)}/flowtables/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_text(name: str) -> Column:
    """crc32 of an id as text; null ids count as the text ''."""
    return F.crc32(F.coalesce(col(name).cast("string"), F.lit("")).cast("binary"))


def crc_of(value: object) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())
