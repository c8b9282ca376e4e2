"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"

# One place for the settings every job relies on. Partition counts depend on the data: see ``sizing``.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even when a later step then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Settings only a new session can take: drop checkpoints nothing refers to any more, and do not record
# the Python call site of every expression (building long expressions is several times faster).
NEW_SESSION = {
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def sizing(input_bytes: int) -> dict[str, str]:
    """Partition counts for an input of this size.

    Shuffles start with pieces of about 256 MB, which adaptive execution merges where data shrank;
    scans of more than 10 TB take larger splits, so that the number of tasks stays in the low hundred thousands.
    """
    pieces = min(max(input_bytes // (256 << 20), 200), 400_000)
    split = 512 if input_bytes > 10 << 40 else 128
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(pieces),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": f"{split}m",
    }


def shuffle_pieces(spark: SparkSession) -> int:
    """How many partitions a shuffle starts with in this session."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(first or spark.conf.get("spark.sql.shuffle.partitions"))


def build(app: str = "flowtables", input_bytes: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    sized = sizing(input_bytes) if input_bytes else {}
    for key, value in {**SETTINGS, **NEW_SESSION, **sized, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """The settings above in a session someone else created: UTC and skew handling hold everywhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the cluster's setting, or a temporary one in local mode only."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="flowtables-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "flowtables", f"{label}-{uuid.uuid4().hex}")


# A finished query's shuffle files are deleted at its end instead of when the driver's garbage is collected.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs survive the loss of executors.

    Nothing reads the shuffle files behind a checkpoint again, so they go at once: loops of many steps do not fill the disks.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        # The setting holds for queries planned from here on, so the plan is made anew.
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


SMALL_BROADCAST = "256k"


@contextmanager
def small_broadcasts(spark: SparkSession, limit: str = SMALL_BROADCAST) -> Iterator[None]:
    """Inside, only tables below the limit are collected for broadcast joins: loops of very many joins send the driver
    a bounded amount each, whatever the size of their tables. Holds for queries planned and run inside."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, limit)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def zoneless(df: DataFrame) -> DataFrame:
    """Timestamps without zone, the type the stored tables use."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
