"""Backups: what to copy, under which name, until when; the copies; expiry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables.functions import durations
from flowtables.operators import graph

DATASET, PREFIX, TTL = "backup_dataset", "backup", "720h"


def backup_set(jobs: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen jobs and everything downstream of them in their projects."""
    seeds = chosen.selectExpr("job_id AS node")
    reached = graph.closure(edges, seeds).select("node").unionByName(seeds).distinct()
    return jobs.join(reached.withColumnRenamed("node", "job_id"), "job_id", "left_semi").join(
        chosen.select("project").distinct(), "project", "left_semi"
    )


def manifest(resources: DataFrame, created_at: str, dataset: str = DATASET, prefix: str = PREFIX, ttl: str = TTL) -> DataFrame:
    """Target name and expiry of each table; other kinds are ignored with a reason.

    ``resources`` has dataset, name and kind. The name is prefix_dataset_table_yyyy_MM_dd_HH_mm_ss.
    """
    step = resources.selectExpr("*", f"CAST({created_at} AS TIMESTAMP) AS __at", f"'{ttl}' AS __ttl")
    step = step.selectExpr("*", f"{durations.clock_micros('__ttl')} AS __keep")
    table = "kind = 'table'"
    target = f"concat_ws('_', '{prefix}', dataset, name, date_format(__at, 'yyyy_MM_dd_HH_mm_ss'))"
    return step.selectExpr(
        *resources.columns,
        f"IF({table}, concat('{dataset}.', {target}), NULL) AS target",
        f"IF({table}, timestamp_micros(unix_micros(__at) + __keep), NULL) AS expires_at",
        f"IF({table}, NULL, 'only tables are backed up') AS ignored_reason",
    )


def copy_table(df: DataFrame, path: str, name: str, created_at: datetime, hours: int = 720) -> str:
    """Copies one table's rows to ``path`` and registers it with its expiry; returns the table name."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    expires = (created_at + timedelta(hours=hours)).isoformat()
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('expires_at' = '{expires}')")
    return name


def run(spark: SparkSession, plan: DataFrame, rows_of: Callable[[str, str], DataFrame], root: str) -> DataFrame:
    """Carries out a manifest: copies each table below ``root`` and registers it with its expiry.

    ``rows_of(dataset, name)`` gives a table's rows. A manifest has one row per table, so its rows are few; the copies
    themselves are Spark jobs. The result has a row per manifest row: dataset, name, target, status, reason.
    """
    done = []
    for r in plan.collect():
        status, reason = ("ignored", r["ignored_reason"])
        if r["target"]:
            name = r["target"].rpartition(".")[2]
            try:
                rows_of(r["dataset"], r["name"]).write.mode("errorifexists").parquet(f"{root}/{name}")
                spark.sql(f"CREATE TABLE `{name}` USING parquet LOCATION '{root}/{name}'")
                spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('expires_at' = '{r['expires_at'].isoformat()}')")
                status, reason = "success", None
            except Exception as error:  # one table that cannot be copied does not stop the others
                status, reason = "failed", str(error).splitlines()[0][:200]
        done.append((r["dataset"], r["name"], r["target"], status, reason))
    return spark.createDataFrame(done, "dataset string, name string, target string, status string, reason string")


def remove_expired(spark: SparkSession, names: Sequence[str], now: datetime) -> list[str]:
    """Drops those of the backup tables whose expiry has come, with their files; tables without expiry stay."""
    gone = []
    for name in names:
        found = spark.sql(f"SHOW TBLPROPERTIES `{name}`").where("key = 'expires_at'").first()
        if found and datetime.fromisoformat(found["value"]) <= now:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark.sql(f"DESCRIBE EXTENDED `{name}`").where("col_name = 'Location'").first()["data_type"])
            spark.sql(f"DROP TABLE `{name}`")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            gone.append(name)
    return gone


def expired(items: DataFrame, now: str, expires_at: str = "expires_at") -> DataFrame:
    """Entries whose time has come; no expiry means keep."""
    return items.where(F.col(expires_at) <= F.expr(now))
