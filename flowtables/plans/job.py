"""One run of a job: window, bounded read, checks, transform, load, hooks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables import session
from flowtables.functions import macros
from flowtables.plans import incremental
from flowtables.sources import loads


@dataclass(frozen=True)
class RunContext:
    spark: SparkSession
    job: str
    scheduled_at: str
    start: datetime
    end: datetime
    config: dict[str, str]


Transform = str | Callable[[DataFrame, RunContext], DataFrame]
Hook = Callable[[DataFrame | None, RunContext], None]


@dataclass(frozen=True)
class Job:
    name: str
    transform: Transform
    target: str
    partition: str
    method: str = "APPEND"
    keys: Sequence[str] = ()
    partition_filter: str | None = None
    version: int = 2
    size: str = "24h"
    offset: str = "0"
    truncate_to: str = "d"
    config: dict[str, str] = field(default_factory=dict)
    checks: Sequence[Hook] = ()
    after: Sequence[Hook] = ()
    on_failure: Sequence[Hook] = ()


def load(df: DataFrame, job: Job) -> None:
    if job.method == "APPEND":
        loads.append(df, job.target, job.partition)
    elif job.method == "REPLACE" and job.partition_filter:
        loads.replace_filter(df, job.target, job.partition, job.partition_filter)
    elif job.method in ("REPLACE", "REPLACE_MERGE"):
        loads.replace(df, job.target, job.partition)
    elif job.method == "REPLACE_ALL":
        loads.replace_all(df, job.target, job.partition)
    elif job.method == "MERGE":
        loads.merge(df, job.target, job.partition, job.keys)
    else:
        raise ValueError(f"unknown load method {job.method}")


def rendered(spark: SparkSession, texts: dict[str, str], values: dict[str, str]) -> dict[str, str]:
    """Texts of one run with their macros replaced; one that cannot be rendered is an error."""
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, v string").selectExpr("k", f"{macros.normalized('v')} AS v")
    rows = rows.withColumns({f"m_{n}": F.lit(v) for n, v in values.items()})
    done = macros.render(rows, "v", {n: f"m_{n}" for n in values}).select("k", "rendered", "render_error").collect()
    for r in done:
        if r.render_error:
            raise ValueError(f"{r.k}: {r.render_error}")
    return {r.k: r.rendered for r in done}


def run(spark: SparkSession, job: Job, source: DataFrame, ts: str, scheduled_at: str, replay_config: dict[str, str] | None = None) -> RunContext:
    """Executes one run; hooks after it see what was loaded, failure hooks run when any step failed.

    A SQL transform reads the window's rows as ``{source}`` and may use ``:dstart`` and ``:dend``. Macros in its text and in
    the configuration are replaced; the configuration of a replay goes over the job's own.
    """
    start, end = incremental.bounds_of_run(
        spark, scheduled_at, version=job.version, size=job.size, offset=job.offset, unit=job.truncate_to
    )
    context = RunContext(spark, job.name, scheduled_at, start, end, {**job.config, **(replay_config or {})})
    result = None
    try:
        moments = {"DSTART": start, "DEND": end, "EXECUTION_TIME": datetime.fromisoformat(scheduled_at)}
        values = {n: v.strftime("%Y-%m-%dT%H:%M:%SZ") for n, v in moments.items()} | {"JOB_DESTINATION": job.target}
        context.config.update(rendered(spark, context.config, values))
        rows = incremental.read_window(source, ts, start, end)
        for check in job.checks:
            check(rows, context)
        if isinstance(job.transform, str):
            text = rendered(spark, {job.name: job.transform}, values)[job.name]
            result = spark.sql(text, args={"dstart": start, "dend": end}, source=rows)
        else:
            result = job.transform(rows, context)
        if job.after:
            # Hooks must see the loaded rows, not a second computation from a target that has changed since.
            result = session.cut_lineage(result)
        load(result, job)
        for hook in job.after:
            hook(result, context)
    except Exception:
        for hook in job.on_failure:
            hook(result, context)
        raise
    return context
