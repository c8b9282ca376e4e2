"""Alerts: who is told about an event, in which batch, and how much of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtables.operators import skew

MAX_BREACHES = 8


def settings_of(jobs: DataFrame, alerts: str = "alerts") -> DataFrame:
    """(job_id, alert_on, channel) from each job's alerts, an array of (on, channels, config)."""
    one = jobs.selectExpr("job_id", f"explode({alerts}) AS a")
    return one.selectExpr("job_id", "a.on AS alert_on", "explode(a.channels) AS channel")


def routes(events: DataFrame, settings: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per event and channel of its job whose category fits; channels are ``scheme://route``.

    ``hot`` are jobs with a very large number of events (``skew.hot_keys``).
    """
    of_category = events.where("type IN ('sla_miss', 'failure')").withColumn("alert_on", F.col("type"))
    wanted = settings.select("job_id", "alert_on", "channel")
    if hot is None:
        matched = of_category.join(wanted, ["job_id", "alert_on"])
    else:
        matched = skew.join_many_to_one(of_category, wanted.withColumnRenamed("alert_on", "on"), ["job_id"], hot=hot).where("alert_on = on").drop("on")
    return matched.selectExpr(
        *events.columns, "split_part(channel, '://', 1) AS scheme", "split_part(channel, '://', 2) AS route"
    )


def batches(routed: DataFrame, every: str = "10 seconds") -> DataFrame:
    """One message per route and flush interval. The alerts themselves stay in ``routed``; no list is built."""
    w = F.window("event_time", every)
    return routed.groupBy(w.alias("w"), "scheme", "route").agg(
        F.count("*").alias("n_alerts"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    ).select(F.col("w.start").alias("flushed_from"), "scheme", "route", "n_alerts", "first_event", "last_event")


def in_messages(routed: DataFrame, every: str = "10 seconds") -> DataFrame:
    """Every routed alert with the message it goes into (``flushed_from``) and its position there, from 1.

    Positions are running counts over bins of equal size, so a route that gets most alerts is no single task. Alerts without a time
    belong to no message.
    """
    timed = routed.where("event_time IS NOT NULL").withColumn("flushed_from", F.window("event_time", every)["start"])
    return skew.running_sums(timed, ["scheme", "route", "flushed_from"], ["event_time", "event_id"], {"position": F.lit(1)})


def message_items(breaches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What a message shows of its breaches: the first eight, the eighth with a note that the list is cut.

    The limit is applied per task before the shuffle, so a message with millions of breaches is no group.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    shown = breaches.withColumn("position", position).where(F.col("position") <= MAX_BREACHES)
    return shown.withColumn("is_cut", F.col("position") == MAX_BREACHES)
