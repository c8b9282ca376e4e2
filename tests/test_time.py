"""Windows, durations and cron against known vectors."""

import pytest

from flowtables.functions import cron, durations, windows

# Windows that must come out. scheduled_at, size, offset, truncate_to, start, end
V2 = [
    ("2022-07-05 02:10:10", "24h", "0", "h", "2022-07-04 02:00:00", "2022-07-05 02:00:00"),
    ("2022-07-05 02:10:10", "24h", "0", "", "2022-07-04 02:10:10", "2022-07-05 02:10:10"),
    ("2022-07-05 02:10:10", "24h", "0", "d", "2022-07-04 00:00:00", "2022-07-05 00:00:00"),
    ("2022-07-05 02:10:10", "24h", "0", "w", "2022-07-03 00:00:00", "2022-07-04 00:00:00"),
    ("2022-07-05 02:10:10", "24h", "0", "M", "2022-06-30 00:00:00", "2022-07-01 00:00:00"),
    ("2022-07-05 02:00:00", "24h", "0", "h", "2022-07-04 02:00:00", "2022-07-05 02:00:00"),
    ("2022-07-05 00:00:00", "24h", "0", "d", "2022-07-04 00:00:00", "2022-07-05 00:00:00"),
    ("2022-07-04 00:00:00", "24h", "0", "w", "2022-07-03 00:00:00", "2022-07-04 00:00:00"),
    ("2022-07-01 00:00:00", "24h", "0", "M", "2022-06-30 00:00:00", "2022-07-01 00:00:00"),
    ("2022-07-05 02:10:10", "24h30m", "0", "d", "2022-07-03 23:30:00", "2022-07-05 00:00:00"),
    ("2022-07-05 02:10:10", "2M", "0", "M", "2022-05-01 00:00:00", "2022-07-01 00:00:00"),
    ("2022-07-05 02:10:10", "1M24h", "0", "M", "2022-05-30 00:00:00", "2022-07-01 00:00:00"),
    ("2022-07-05 02:10:10", "60m", "0", "d", "2022-07-04 23:00:00", "2022-07-05 00:00:00"),
    ("2022-07-05 02:10:10", "", "0", "d", "2022-07-05 00:00:00", "2022-07-05 00:00:00"),
    ("2022-07-05 02:10:10", "24h", "24h", "d", "2022-07-05 00:00:00", "2022-07-06 00:00:00"),
    ("2022-07-05 02:10:10", "1M", "-1M", "M", "2022-05-01 00:00:00", "2022-06-01 00:00:00"),
    ("2022-07-05 02:10:10", "1M", "-1M24h", "M", "2022-04-30 00:00:00", "2022-05-30 00:00:00"),
    ("2022-07-05 02:10:10", "24h", "-24h", "d", "2022-07-03 00:00:00", "2022-07-04 00:00:00"),
    ("2022-07-05 02:10:10", "24h", "", "d", "2022-07-04 00:00:00", "2022-07-05 00:00:00"),
    ("2022-03-31 00:00:00", "1M", "0", "", "2022-03-03 00:00:00", "2022-03-31 00:00:00"),
]
V1 = [
    ("2021-02-25 00:00:00", "24h", "0", "", "2021-02-24 00:00:00", "2021-02-25 00:00:00"),
    ("2020-07-10 06:33:22", "24h", "0", "", "2020-07-09 06:33:22", "2020-07-10 06:33:22"),
    ("2020-07-10 06:33:22", "24h", "0", "h", "2020-07-09 06:00:00", "2020-07-10 06:00:00"),
    ("2020-07-10 06:33:22", "24h", "0", "d", "2020-07-09 00:00:00", "2020-07-10 00:00:00"),
    ("2020-07-10 06:33:22", "48h", "24h", "d", "2020-07-09 00:00:00", "2020-07-11 00:00:00"),
    ("2020-07-10 06:33:22", "24h", "-24h", "d", "2020-07-08 00:00:00", "2020-07-09 00:00:00"),
    ("2020-07-10 06:33:22", "168h", "0", "w", "2020-07-05 00:00:00", "2020-07-12 00:00:00"),
    ("2021-02-25 06:33:22", "720h", "0", "M", "2021-02-01 00:00:00", "2021-02-28 00:00:00"),
    ("2021-02-25 06:33:22", "720h", "720h", "M", "2021-03-01 00:00:00", "2021-03-31 00:00:00"),
    ("2021-02-25 06:33:22", "720h", "-720h", "M", "2021-01-01 00:00:00", "2021-01-31 00:00:00"),
    ("2021-02-25 06:33:22", "480h", "0", "M", "2021-02-01 00:00:00", "2021-02-28 00:00:00"),
    ("2021-02-25 06:33:22", "1440h", "0", "M", "2021-01-01 00:00:00", "2021-02-28 00:00:00"),
    ("2021-03-31 06:33:22", "720h", "-720h", "M", "2021-02-01 00:00:00", "2021-02-28 00:00:00"),
]


@pytest.mark.parametrize("version,vectors", [(2, V2), (1, V1)])
def test_window_vectors(spark, version, vectors):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(vectors)], "i int, at string, size string, off string, unit string, s string, e string")
    rows = rows.selectExpr("i", "CAST(at AS TIMESTAMP) AS at", "size", "off", "unit", "CAST(s AS TIMESTAMP) AS s", "CAST(e AS TIMESTAMP) AS e")
    got = windows.with_bounds(windows.with_settings(rows, "size", "off", "unit"), "at", version)
    bad = got.where("NOT (window_start <=> s AND window_end <=> e)").collect()
    assert bad == []


def test_window_versions(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 2, 3)], "v int").selectExpr("v", "TIMESTAMP '2022-07-05 02:10:10' AS at")
    got = windows.with_bounds(windows.with_settings(rows, "'24h'", "'0'", "'w'"), "at", "v").orderBy("v").collect()
    assert got[0][2:] == got[1][2:] and got[1].window_end != got[2].window_end and got[3].window_start is None


def _errors(spark, values):
    rows = spark.createDataFrame(values, "size string, off string, unit string")
    return [len(r.errors) for r in windows.with_errors(rows, "size", "off", "unit").collect()]


def test_window_validity(spark):
    good_sizes = ["1h", "24h", "1h30m", "1M", "1M24h", "0", "", "100ms", "1.5h"]
    bad_sizes = ["60", "60S", "2d", "-1M", "-24h"]
    good_offsets = ["", "0", "24h", "-24h", "1M", "-1M", "1M24h", "-1M24h", "+3h", "-1.5h"]
    bad_offsets = ["1", "M24"]
    bad_units = ["x", "H", "D", "y", "day", "m", "W"]
    assert _errors(spark, [(s, "0", "h") for s in good_sizes]) == [0] * 9
    assert _errors(spark, [(s, "0", "h") for s in bad_sizes]) == [1] * 5
    assert _errors(spark, [("24h", o, "d") for o in good_offsets]) == [0] * 10
    assert _errors(spark, [("24h", o, "d") for o in bad_offsets]) == [1] * 2
    assert _errors(spark, [("24h", "0", u) for u in bad_units]) == [1] * 7


def test_duration_signs(spark):
    rows = spark.createDataFrame([("-1M24h",), ("1M-24h",), ("2h45m30.5s",), ("1h1h",), ("-0",), ("--1h",), ("1M1M",)], "d string")
    v2 = durations.parse_v2(rows, {"v": "d"}).collect()
    v1 = durations.parse_v1(rows, {"v": "d"}).collect()
    h = durations.HOUR
    assert [(r.v_months, r.v_micros) for r in v2] == [(-1, -24 * h), (1, -24 * h), (0, int(2.75 * h + 30.5e6)), (0, 2 * h), (0, 0), (None, None), (None, None)]
    assert [r.v for r in v1] == [-720 * h + 24 * h, 720 * h - 24 * h, int(2.75 * h + 30.5e6), 2 * h, 0, None, 720 * h]


# expression, time, previous, next
CRON = [
    ("@midnight", "2022-03-25 02:00:00", "2022-03-25 00:00:00", "2022-03-26 00:00:00"),
    ("0 2 2,11,19,26 * *", "2022-03-19 01:59:59", "2022-03-11 02:00:00", "2022-03-19 02:00:00"),
    ("0 2 2,11,19,26 * *", "2022-03-19 02:01:59", "2022-03-19 02:00:00", "2022-03-26 02:00:00"),
    ("@monthly", "2022-03-01 00:00:00", "2022-02-01 00:00:00", "2022-04-01 00:00:00"),
    ("*/15 9-17/4 * * mon-fri", "2022-03-05 12:00:00", "2022-03-04 17:45:00", "2022-03-07 09:00:00"),
    ("30 6 13 * 5", "2022-05-10 00:00:00", "2022-05-06 06:30:00", "2022-05-13 06:30:00"),
    ("0 0 29 FEB ?", "2022-03-01 00:00:00", "2020-02-29 00:00:00", "2024-02-29 00:00:00"),
    ("5/20 * 1 jan *", "2022-06-01 00:00:00", "2022-01-01 23:45:00", "2023-01-01 00:05:00"),
    ("0 0 31 4 *", "2022-06-01 00:00:00", None, None),
]


def test_cron_neighbours(spark):
    rows = spark.createDataFrame(CRON, "e string, t string, p string, n string").selectExpr(
        "e", "CAST(t AS TIMESTAMP) AS t", "CAST(p AS TIMESTAMP) AS p", "CAST(n AS TIMESTAMP) AS n"
    )
    got = cron.with_plan(rows, "e").selectExpr("e", f"{cron.prev_time('plan', 't')} <=> p AS p", f"{cron.next_time('plan', 't')} <=> n AS n")
    assert [r.e for r in got.collect() if not (r.p and r.n)] == []


def test_cron_errors(spark):
    texts = ["0 2 * *", "60 * * * *", "* * 0 * *", "* * * * 7", "5-1 * * * *", "*/0 * * * *", "a * * * *", "@every 1h", "", "* * * * * *"]
    rows = spark.createDataFrame([(x,) for x in texts], "e string")
    got = cron.with_plan(rows, "e").selectExpr(f"{cron.error('e', 'plan')} AS error").collect()
    assert all(r.error for r in got)


def test_cron_range_is_closed_and_agrees_with_next(spark):
    rows = spark.createDataFrame([("0 */6 * * *",), ("@weekly",), ("0 0 1,15 * 3",)], "e string")
    times = cron.explode_schedule(rows, "e", "'2024-01-01'", "'2024-02-01'", "at")
    counts = {r.e: r["count"] for r in times.groupBy("e").count().collect()}
    assert counts == {"0 */6 * * *": 31 * 4 + 1, "@weekly": 4, "0 0 1,15 * 3": 3 + 5}
    step = cron.with_plan(times, "e").selectExpr("e", "at", f"{cron.prev_time('plan', 'at')} AS before")
    joined = step.join(times.selectExpr("e", "at AS before", "1 AS known"), ["e", "before"], "left")
    assert joined.where("known IS NULL").count() == 3  # only each schedule's first time has no predecessor in range


def test_logical_and_execution_time(spark):
    rows = spark.createDataFrame([("@midnight",)], "e string").selectExpr("e", "TIMESTAMP '2022-01-01 01:01:01' AS s", "TIMESTAMP '2022-01-01 00:00:00' AS exact")
    row = cron.with_plan(rows, "e").selectExpr(f"{cron.prev_time('plan', 's')} AS a", f"{cron.prev_time('plan', 'exact')} AS b", f"{cron.matches('plan', 'exact')} AS m").first()
    assert str(row.a) == "2022-01-01 00:00:00" and str(row.b) == "2021-12-31 00:00:00" and row.m


def _by_hand(expr, start, minutes):
    """Schedule minutes of an expression, checked minute by minute."""
    from datetime import timedelta

    def allowed(field, low, high):
        values, star = set(), False
        for part in field.split(","):
            span, _, step = part.partition("/")
            n = int(step or 1)
            if span == "*":
                a, b, star = low, high, star or n == 1
            elif "-" in span:
                a, b = map(int, span.split("-"))
            else:
                a = int(span)
                b = high if step else a
            values |= set(range(a, b + 1, n))
        return values, star

    m, h, d, mo, w = expr.split()
    (m, _), (h, _), (d, d_any), (mo, _), (w, w_any) = allowed(m, 0, 59), allowed(h, 0, 23), allowed(d, 1, 31), allowed(mo, 1, 12), allowed(w, 0, 6)
    out = []
    for i in range(minutes + 1):
        t = start + timedelta(minutes=i)
        day, week = t.day in d, (t.weekday() + 1) % 7 in w
        if t.minute in m and t.hour in h and t.month in mo and ((day and week) if d_any or w_any else (day or week)):
            out.append(t)
    return out


def test_random_schedules_equal_a_check_of_every_minute(spark):
    import random
    from datetime import datetime

    rng = random.Random(11)

    def field(low, high):
        parts = []
        for _ in range(rng.choice([1, 1, 2])):
            a = rng.randint(low, high)
            parts.append(rng.choice(["*", f"*/{rng.randint(1, 9)}", str(a), f"{a}-{rng.randint(a, high)}", f"{a}/{rng.randint(1, 9)}", f"{a}-{high}/{rng.randint(1, 5)}"]))
        return ",".join(parts)

    exprs = sorted({" ".join([field(0, 59), field(0, 23), rng.choice(["*", field(1, 31)]), rng.choice(["*", field(1, 12)]), rng.choice(["*", field(0, 6)])]) for _ in range(60)})
    rows = spark.createDataFrame([(e,) for e in exprs], "e string")
    start = datetime(2024, 2, 25)
    got = cron.explode_schedule(rows, "e", "'2024-02-25'", "'2024-03-06'", "at").groupBy("e").count()
    assert {r.e: r["count"] for r in got.collect()} == {e: len(x) for e in exprs if (x := _by_hand(e, start, 10 * 1440))}

    probe = "TIMESTAMP '2024-02-28 13:17:30'"
    steps = cron.with_plan(rows, "e").selectExpr("e", f"{cron.prev_time('plan', probe)} AS p", f"{cron.next_time('plan', probe)} AS n").collect()
    middle = datetime(2024, 2, 28, 13, 17, 30)
    for r in steps:
        times = _by_hand(r.e, start, 10 * 1440)
        before, after = [t for t in times if t < middle], [t for t in times if t > middle]
        assert not before or r.p == before[-1]
        assert not after or r.n == after[0]


@pytest.mark.parametrize("size,offset,unit", [("168h", "0", "d"), ("36h", "-90m", ""), ("1M24h", "1h", "w"), ("1.5s", "0", "h")])
def test_window_aggregates_equal_a_range_join(spark, tables, size, offset, unit):
    from pyspark.sql import functions as F

    from flowtables.plans import incremental

    runs = incremental.run_windows(spark, cron_expr="17 */8 * * *", start="2024-01-05", end="2024-01-25", version=2, size=size, offset=offset, unit=unit)
    events = tables.events.selectExpr("ts", "CAST(value AS DECIMAL(18, 4)) AS value")
    got = incremental.aggregate_windows(events, "ts", runs, {"n": F.lit(1)}, {"total": F.col("value")})
    stamped = events.withColumn("at", F.col("ts").cast("timestamp"))
    want = runs.join(stamped, F.expr("at >= window_start AND at < window_end")).groupBy("scheduled_at").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = lambda df: sorted((r.scheduled_at, r.n, r.total) for r in df.collect())
    assert rows(got) == rows(want)
