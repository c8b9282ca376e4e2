"""Streams end with the result of the same batch query."""

import glob
import os

import pytest
from conftest import SF
from pyspark.sql import functions as F

from flowtables.operators import events as E
from flowtables.sources import feed
from flowtables.streaming import late, payloads, run_state, timeouts, windows


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    """The event stream as a folder of files, out of order."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    shuffled = tables.run_events_v.withColumn("late", F.col("event_id") % 97)
    shuffled.repartitionByRange(4, "late").drop("late").write.parquet(path)
    return path


def stream(spark, path, files=1):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


def test_run_state_stream_equals_batch(spark, stored, tmp_path):
    state = str(tmp_path / "state")
    run_state.start(stream(spark, stored), state, str(tmp_path / "cp")).awaitTermination()
    batch = E.fold_runs(spark.read.parquet(stored)).drop("monitoring")
    same(run_state.current(spark, state).drop("monitoring"), batch)
    run_state.compact(spark, state)
    same(run_state.current(spark, state).drop("monitoring"), batch)
    assert len([f for f in os.listdir(state) if f.startswith("batch=")]) == 1
    # A backfill of a run far in the past arrives last, and the compacted stream goes on.
    old = spark.read.parquet(stored).withColumns({"scheduled_at": F.expr("scheduled_at - INTERVAL 400 DAYS"), "event_id": F.col("event_id") + 1_000_000}).limit(20)
    old.write.mode("append").parquet(stored + "-more")
    run_state.start(stream(spark, stored + "-more"), state, str(tmp_path / "cp2")).awaitTermination()
    more = spark.read.parquet(stored).unionByName(spark.read.parquet(stored + "-more"))
    same(run_state.current(spark, state).drop("monitoring"), E.fold_runs(more).drop("monitoring"))


def test_sla_lists_flag_runs_and_open_none(spark):
    kind = "project string, job_id long, scheduled_at timestamp, type string, operator_name string, event_time timestamp, event_id long, slas array<struct<job_id: long, scheduled_at: timestamp>>, monitoring map<string, string>"
    at = lambda n: __import__("datetime").datetime(2024, 1, n)
    rows = [
        ("p", 1, at(1), "task_start", "t", at(2), 1, None, {"rows": "1"}), ("p", 1, at(1), "job_success", None, at(3), 2, None, {"rows": "2"}),
        ("p", 2, at(1), "task_start", "t", at(2), 3, None, None), ("q", 1, at(1), "task_start", "t", at(2), 4, None, None),
        ("p", None, None, "sla_miss", None, at(4), 5, [(1, at(1)), (9, at(1))], None),
    ]
    got = {(r.project, r.job_id): (r.state, r.sla_alert, r.monitoring) for r in E.fold_runs(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("p", 1): ("success", True, {"rows": "2"}), ("p", 2): ("in_progress", False, None), ("q", 1): ("in_progress", False, None)}


def test_operator_run_stream_equals_batch(spark, stored, tmp_path):
    paths = [str(tmp_path / p) for p in ("store", "fold", "cp")]
    run_state.start_operator_runs(stream(spark, stored, 2), *paths).awaitTermination()
    same(run_state.current_operator_runs(spark, paths[1]), E.operator_runs(spark.read.parquet(stored)))


def _to_table(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_registration_stream_keeps_one_row_per_run(spark, stored, tmp_path):
    _to_table(windows.registrations(stream(spark, stored), "60 days"), tmp_path, "registered")
    rows = spark.table("registered")
    assert rows.count() == rows.select(*E.RUN).distinct().count() == spark.read.parquet(stored).select(*E.RUN).distinct().count()


def test_first_pokes(spark, stored, tmp_path):
    _to_table(windows.first_pokes(stream(spark, stored), E.RUN, "60 days"), tmp_path, "pokes")
    assert spark.table("pokes").count() == spark.read.parquet(stored).where("type = 'sensor_start'").select(*E.RUN).distinct().count()


def test_window_counters_and_late_rows(spark, tables, tmp_path):
    path = str(tmp_path / "ordered")
    events = tables.run_events_v
    for rows in (events.where("event_id < 900"), events.where("event_id >= 900"), events.where("event_id < 10")):
        rows.coalesce(1).write.mode("append").parquet(path)
    query = _to_table(windows.counters(stream(spark, path), "1 hour", "1 hour"), tmp_path, "counted")
    closed = spark.table("counted")
    batch = E.windowed_counters(events).join(closed.select(F.max("window_end").alias("m")), F.col("window_end") <= F.col("m"))
    # Files are read in the order they were written: the ten repeated rows come after the watermark.
    assert windows.dropped_as_late(query) > 0
    assert closed.exceptAll(batch.drop("m").select(closed.columns)).isEmpty() and closed.count() > 0


def test_alert_batches_stream(spark, tables, stored, tmp_path):
    from flowtables.operators import alerts

    events = tables.run_events_v
    path = str(tmp_path / "alerts")
    events.coalesce(1).write.parquet(path)
    _to_table(windows.alert_batches(stream(spark, path), tables.job_alerts_v), tmp_path, "batches")
    sent = spark.table("batches")
    full = alerts.batches(alerts.routes(events, tables.job_alerts_v))
    assert sent.count() > 0 and sent.exceptAll(full).isEmpty()


def test_replay_timeouts(spark, tmp_path):
    path = str(tmp_path / "updates")
    rows = "replay_id bigint, status string, created_at string, updated_at string"
    batches = [
        [(1, "created", "2024-01-01 00:00:00", "2024-01-01 00:00:00"), (2, "created", "2024-01-01 00:00:00", "2024-01-01 00:00:00")],
        [(2, "success", "2024-01-01 00:00:00", "2024-01-01 01:00:00"), (3, "in progress", "2024-01-01 05:00:00", "2024-01-01 05:00:00")],
        [(4, "created", "2024-01-01 05:30:00", "2024-01-01 05:30:00")],
    ]
    for b in batches:
        spark.createDataFrame(b, rows).selectExpr(
            "replay_id", "status", "CAST(created_at AS TIMESTAMP) AS created_at", "CAST(updated_at AS TIMESTAMP) AS updated_at"
        ).coalesce(1).write.mode("append").parquet(path)
    query = timeouts.replay_timeouts(stream(spark, path)).writeStream.format("memory").queryName("timed_out").outputMode("append")
    query.option("checkpointLocation", str(tmp_path / "t")).trigger(availableNow=True).start().awaitTermination()
    assert [r.replay_id for r in spark.table("timed_out").collect()] == [1]


def test_change_feed_restart_sends_every_message_once(spark, stored, tmp_path):
    target, checkpoint = str(tmp_path / "feed"), str(tmp_path / "cp")
    def messages():
        return stream(spark, stored).select(F.to_json(F.struct("event_id", "type")).alias("value"))

    feed.write_stream(messages(), target, checkpoint, available_now=True).awaitTermination()
    # The last batch is in the sink but its commit record is lost, as when the driver dies.
    last = sorted(int(os.path.basename(p)) for p in glob.glob(f"{checkpoint}/commits/[0-9]*"))[-1]
    os.remove(f"{checkpoint}/commits/{last}")
    crc = f"{checkpoint}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    feed.write_stream(messages(), target, checkpoint, available_now=True).awaitTermination()
    sent = spark.read.parquet(target)
    assert sent.count() == spark.read.parquet(stored).count() == sent.select("value").distinct().count()


def test_event_parse_sla_lists(spark):
    rows = [
        ("TYPE_SLA_MISS", '{"slas": [{"dag_id": "a", "scheduled_at": "2022-01-02T15:04:05Z"}]}', None),
        ("TYPE_SLA_MISS", '{"slas": []}', "sla list is empty"),
        ("sla_miss", '{"slas": [{"dag_id": "", "scheduled_at": "2022-01-02T15:04:05Z"}]}', "sla without a job"),
        ("sla_miss", '{"slas": [{"dag_id": "a", "scheduled_at": "2 Jan"}]}', "sla with an unreadable scheduled_at"),
        ("TYPE_TASK_RETRY", '{"status": "Retried", "event_time": 16000631, "task_id": "t", "scheduled_at": "2022-01-02T15:04:05Z"}', None),
        ("TYPE_TASK_RETRY", "not json", "unknown status"),
        ("TYPE_UNKNOWN", "{}", "unknown event type"),
    ]
    df = spark.createDataFrame(rows, "event_type string, payload string, want string")
    assert payloads.parse(df, "event_type", "payload").where("NOT (error <=> want)").count() == 0


def test_sf_events_exist(spark):
    assert spark.read.parquet(f"{SF}/events.parquet").count() > 0


def test_late_rows_are_kept_over_a_restart(spark, tables, tmp_path):
    path, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "split"), str(tmp_path / "cp")
    events = tables.run_events_v.withColumn("batch_no", F.lit(0))
    kind = events.schema
    third = events.approxQuantile("event_id", [0.33, 0.66], 0.0)
    given = [events.where(F.col("event_id") < third[0]), events.where(F.col("event_id") > third[1]), events.where(F.col("event_id").between(*third))]
    assert late.counts(spark, target, kind).isEmpty()
    for n, part in enumerate(given):
        part.withColumn("batch_no", F.lit(n)).coalesce(1).write.mode("append").parquet(path)
        # Every part is a run of its own: the query stops and starts again.
        late.start(stream(spark, path), target, checkpoint, "2 days").awaitTermination()
    limit = given[1].select(F.max("event_time") - F.expr("INTERVAL 2 DAYS")).first()[0]
    all_given = spark.read.parquet(path)
    kept, gone = late.kept(spark, target, kind), late.late(spark, target, kind)
    same(kept.unionByName(gone.select(*kind.names)), all_given)
    same(gone.select(*kind.names), all_given.where((F.col("batch_no") == 2) & (F.col("event_time") < F.lit(limit))))
    assert gone.count() > 0 and {r.watermark for r in gone.select("watermark").distinct().collect()} == {limit}
    by_batch = {r.batch: (r.n_kept, r.n_late) for r in late.counts(spark, target, kind).collect()}
    assert sum(map(sum, by_batch.values())) == all_given.count() and [n for _, (_, n) in sorted(by_batch.items())][:2] == [0, 0]


def test_a_batch_that_died_before_its_mark_is_not_read_and_is_replaced(spark, tables, tmp_path):
    path, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "split"), str(tmp_path / "cp")
    events = tables.run_events_v
    events.coalesce(1).write.parquet(path)
    half = events.limit(7).withColumns({"watermark": F.lit(None).cast("timestamp"), "is_late": F.lit(False)})
    half.write.partitionBy("is_late").parquet(f"{target}/rows/batch=0")
    assert late.rows(spark, target, events.schema).isEmpty()
    late.start(stream(spark, path), target, checkpoint).awaitTermination()
    same(late.kept(spark, target, events.schema), events)
