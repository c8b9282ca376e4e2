"""Skew-safe building blocks against plain windows and joins, resolution rules, graph shapes, loads."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtables import session
from flowtables.functions import macros, text
from flowtables.operators import events as E
from flowtables.operators import graph, lineage, registry, replay, skew
from flowtables.operators import runs as R
from flowtables.plans import job as J
from flowtables.sources import loads, specs, versions
from flowtables.sources import tables as managed


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert a.select(columns).exceptAll(b.select(columns)).isEmpty() and b.select(columns).exceptAll(a.select(columns)).isEmpty()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows on one key."""
    return spark.range(3000).selectExpr(
        "id", "IF(id % 3 = 0, 0, id % 11) AS k", "timestamp_seconds((id * 7919) % 900000) AS at", "id % 5 AS v"
    )


def test_running_sums_equal_plain_window(hot):
    w = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    same(skew.running_sums(hot, ["k"], ["at", "id"], {"s": F.col("v")}), hot.withColumn("s", F.sum("v").over(w)))


def test_previous_value_equals_lag(hot):
    w = Window.partitionBy("k").orderBy("at", "id")
    value = F.when(F.col("v") > 0, F.col("v"))
    same(skew.previous_value(hot, ["k"], ["at", "id"], value, "p"), hot.withColumn("p", F.lag(value).over(w)))


def test_null_keys_share_one_exchange(spark):
    rows = spark.createDataFrame([(None, k, 1) for k in range(20)] + [(1, k, 1) for k in range(20)], "k int, at int, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summed = skew.running_sums(rows, ["k"], ["at"], {"s": F.col("v")})
        got = {(r.k, r.at): r.s for r in summed.collect()}
        plan = summed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(k, at): at + 1 for k in (None, 1) for at in range(20)}
    # One exchange for the rows; the three others have a row per key and bin.
    assert plan.count("Exchange hashpartitioning(__key") == 4, plan


def test_sums_at_equal_range_join(spark, hot):
    probes = spark.range(200).selectExpr("id % 11 AS k", "timestamp_seconds((id * 7919 * 3) % 900000) AS at", "id AS probe", "id % 2 = 0 AS inclusive")
    got = skew.sums_at(hot.select("k", "at", "v"), probes, ["k"], "at", ["v"])
    pairs = probes.alias("p").join(hot.alias("h"), F.expr("p.k = h.k AND (h.at < p.at OR (inclusive AND h.at = p.at))"), "left")
    want = pairs.groupBy("p.k", "p.at", "probe", "inclusive").agg(F.coalesce(F.sum("h.v"), F.lit(0)).alias("v"))
    same(got, want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, hot, how):
    one = spark.range(8).selectExpr("id AS k", "id * 2 AS x")
    keys = skew.hot_keys(hot, ["k"], rows=500)
    assert keys.count() == 1
    same(skew.join_many_to_one(hot, one, ["k"], how, keys, salts=4), hot.join(one, "k", how))


def test_null_keys_are_kept(spark):
    rows = spark.sql("SELECT CAST(NULL AS INT) AS k, id AS at, id AS v FROM range(10)")
    assert skew.running_sums(rows, ["k"], ["at"], {"s": F.col("v")}).agg(F.max("s")).first()[0] == 45


def test_bins_split_a_hot_key(hot):
    spark = hot.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in skew._binned(hot.where("k = 0"), ["k"], ["at", "id"]).groupBy("__bin").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 2 and max(sizes) < 0.6 * sum(sizes)


def test_blocks_cover_exactly_the_interval(spark):
    spans = spark.range(300).selectExpr("id", "timestamp_micros(id * 37000000 + id % 3) AS lo", "timestamp_micros(id * 37000000 + (id * id * 7919 % 40000) * 1000000) AS hi")
    moments = spark.range(400).selectExpr("timestamp_seconds(id * 61) AS at")
    want = moments.join(spans, F.expr("at BETWEEN lo AND hi")).select("id", "at")
    blocks = spans.selectExpr("id", f"explode({skew.blocks_of('lo', 'hi')}) AS b")
    around = moments.selectExpr("at", f"explode({skew.blocks_over('at')}) AS b")
    got = around.join(blocks, "b").select("id", "at")
    assert got.count() == got.distinct().count() == want.count() > 100
    assert got.exceptAll(want).isEmpty()
    long = spark.sql(f"SELECT size({skew.blocks_of("TIMESTAMP '1990-01-01'", "TIMESTAMP '2020-01-01'")}) AS n").first().n
    assert long < 280


def test_first_rows_are_trimmed_before_the_shuffle(hot):
    df = skew.first_rows(hot, ["k"], [F.col("at"), F.col("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert df.count() == 11 * 3


# --- registry and lineage -----------------------------------------------------------


def _jobs(spark):
    rows = [
        (1, "a", "p1", "n", "t://x", False),
        (2, "b", "p1", "n", "t://y", False),
        (3, "a", "p2", "n", "t://z", False),
        (4, "c", "p2", "n", "t://x", False),
        (5, "d", "p2", "m", "t://w", True),
    ]
    return spark.createDataFrame(rows, "job_id long, name string, project string, namespace string, destination string, is_deleted boolean")


def test_resolution_order(spark):
    """An upstream with both a name and a table: names win for whole registries, tables for a single job."""
    wanted = spark.createDataFrame([(9, "p2", "a", "t://y", "static")], "job_id long, upstream_project string, upstream_job string, resource string, type string")
    by_name = lineage.resolve(wanted, _jobs(spark)).first()
    by_table = lineage.resolve(wanted, _jobs(spark), prefer="destination").first()
    assert (by_name.upstream_project, by_name.upstream_job) == ("p2", "a")
    assert (by_table.upstream_project, by_table.upstream_job) == ("p1", "b")


def test_two_producers_resolve_to_the_lowest(spark):
    sources = spark.createDataFrame([(2, "t://x"), (2, "t://none")], "job_id long, source string")
    static = spark.createDataFrame([(2, "p1/a"), (2, "nope")], "job_id long, static_upstream string")
    edges = lineage.bulk_resolve(_jobs(spark), sources, static)
    got = {(r.upstream_project, r.upstream_job, r.type, r.state) for r in edges.collect()}
    # The same upstream by name and by table is kept once, as static.
    assert got == {("p1", "a", "static", "resolved"), ("p1", "nope", "static", "unresolved"), (None, None, "inferred", "unresolved")}
    assert lineage.unresolved_errors(edges).count() == 1


def test_hot_tables_do_not_change_the_result(spark):
    jobs = _jobs(spark)
    sources = spark.range(10, 400).selectExpr("id AS job_id", "IF(id % 3 = 0, 't://y', 't://z') AS source")
    wanted = sources.selectExpr("job_id", "CAST(NULL AS STRING) AS upstream_project", "CAST(NULL AS STRING) AS upstream_job", "source AS resource", "'inferred' AS type")
    hot_tables = skew.hot_keys(wanted, ["resource"], rows=100)
    same(lineage.resolve(wanted, jobs, hot_tables=hot_tables), lineage.resolve(wanted, jobs))


def test_tables_in_sql(spark):
    sql = """SELECT * FROM `p.d.a` a /* JOIN `p.d.no` */ LEFT JOIN /* @ignoreupstream */
      `p.d.b` b join `p.d.c` -- FROM `p.d.no2`
      ON 1 = 1 JOIN `p.d.own` JOIN `p.d.a` JOIN `two.parts`"""
    df = spark.createDataFrame([(1, sql, "p.d.own")], "job_id int, sql string, own string")
    assert sorted(r.source_table for r in lineage.tables_in_sql(df, "sql", "own").collect()) == ["p.d.a", "p.d.c"]


@pytest.mark.parametrize(
    ("sql", "tables"),
    [
        ("SELECT '-- x' FROM `p.d.t4`, `p.d.t5`", "t4 t5"),
        ("SELECT '/* ' FROM `p.d.a` WHERE x = '*/' AND y IN (SELECT z FROM `p.d.b`)", "a b"),
        ("SELECT 'FROM `p.d.no`', \"JOIN `p.d.no`\" FROM `p.d.a` x, (SELECT 1, 2 FROM `p.d.b`) y, `p.d.c`", "a b c"),
        ("WITH `p.d.x` AS (SELECT * FROM `p.d.a`), y AS (SELECT 1 FROM `p.d.b`) SELECT * FROM `p.d.x`, y", "a b"),
        ("SELECT a, `p.d.no` FROM `p.d.a` WHERE a IS NOT DISTINCT FROM `p.d.no` ORDER BY a, `p.d.no`", "a"),
        ("SELECT * FROM `p`.`d`.`a` JOIN `p.d`.b USING (x), `p.d.c` /* open FROM `p.d.no`", "a b c"),
        ("SELECT f(FROM_UNIXTIME(x), `p.d.no`), trim(BOTH ' ' FROM `p.no`) from((`p.d.a` join `p.d.b` on (1=1)), `p.d.c`)", "a b c"),
        ("SELECT 'it\\'s FROM `p.d.no`' FROM /* @ignoreupstream */ `p.d.no`, /*@ignoreupstream*/ `p.d.no`, `p.d.a` -- `p.d.no`\n, `p.d.b`", "a b"),
        ("SELECT r'''FROM `p.d.no` ' \" ''' FROM `p.d.a` UNION ALL SELECT 1, `p.d.no` FROM `p.d.a`; DELETE FROM `p.d.b`", "a b"),
        ("", ""), (None, ""), ("'never closed FROM `p.d.no`", ""), (")) FROM `p.d.a`, (", "a"), ("FROM", ""),
    ],
)
def test_tables_in_hard_sql(spark, sql, tables):
    df = spark.createDataFrame([(1, sql)], "job_id int, sql string")
    assert sorted(r.source_table for r in lineage.tables_in_sql(df, "sql").collect()) == [f"p.d.{x}" for x in tables.split()]


def test_long_texts_are_scanned(spark):
    body = "'" + "a''b\\'" * 300 + "' " + "/* * " * 2000 + "*/" + "(" * 500 + "x, " * 5000 + ")" * 500
    df = spark.createDataFrame([(1, f"SELECT {body} FROM `p.d.a`, `p.d.b`")], "job_id int, sql string")
    assert lineage.tables_in_sql(df, "sql").count() == 2


def test_runs_in_progress_hold_slots(spark):
    replays = spark.createDataFrame([(k, "p", k // 2, "2024-01-0" + str(1 + k)) for k in range(6)], "replay_id long, project string, job_id long, created_at string")
    runs = [(0, "in_progress", k) for k in range(5)] + [(1, "pending", k) for k in range(9)] + [(2, "in_progress", 0), (2, "pending", 1)] + [(k, "pending", n) for k in (3, 4, 5) for n in range(4)]
    given = replay.slots(replays, spark.createDataFrame(runs, "replay_id long, state string, scheduled_at long"))
    # Job 0 is full; job 1 has four left and the project four in all.
    assert sorted((r.replay_id, r.scheduled_at) for r in given.collect()) == [(2, 1), (3, 0), (3, 1), (3, 2)]
    more = replay.slots(replays, spark.createDataFrame(runs, "replay_id long, state string, scheduled_at long"), per_project=100)
    assert more.where("job_id = 0").count() == 0 and more.where("job_id = 1").count() == 4 and more.where("job_id = 2").count() == 5


def _plain_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for n in nodes:
            more = set().union(*[reach[m] for m in reach[n]]) - reach[n]
            if more:
                reach[n] |= more
                grown = True
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", [2])
def test_components_and_cycle_paths(spark, seed):
    import random

    draw = random.Random(seed)
    # Two pairs joined by 3, a loop, a long way and random edges.
    edges = {(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (9, 9), (5, 9)} | {(20 + k, 21 + k) for k in range(6)} | {(26, 20)}
    edges |= {(draw.randrange(40, 60), draw.randrange(40, 60)) for _ in range(14 + 4 * seed)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    want = _plain_components(edges)
    assert {r.node: r.component for r in graph.strong_components(df).collect()} == want
    assert {r.node for r in graph.cycle_nodes(df, hot_rows=2).collect()} == set(want) and 3 not in want
    paths = {}
    for r in sorted(graph.cycle_paths(df).collect(), key=lambda r: (r.component, r.step)):
        paths.setdefault(r.component, []).append(r.node)
    assert set(paths) == set(want.values())
    for component, path in paths.items():
        assert path[0] == component and len(set(path)) == len(path) and all(want[n] == component for n in path)
        assert all(step in edges for step in zip(path, path[1:] + path[:1], strict=True))
    assert paths[20] == [20, 21, 22, 23, 24, 25, 26] and paths[9] == [9] and paths[1] == [1, 2] and paths[4] == [4, 5]


def test_no_cycle_has_no_path(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert graph.cycle_paths(df).count() == graph.strong_components(df).count() == 0


def test_filter_precedence(spark):
    jobs = _jobs(spark)
    assert registry.jobs_by_filter(jobs, destination="t://x", project="p2").count() == 2
    assert registry.jobs_by_filter(jobs, project="p2", names=["a"], name="c").first().job_id == 3
    with pytest.raises(ValueError):
        registry.jobs_by_filter(jobs, namespace="n")


def test_diff_compares_maps_by_content(spark):
    old = spark.sql("SELECT 'a' AS name, map('x', 1, 'y', 2) AS m UNION ALL SELECT 'b', map('x', 1) UNION ALL SELECT 'c', map()")
    new = spark.sql("SELECT 'a' AS name, map('y', 2, 'x', 1) AS m UNION ALL SELECT 'b', map('x', 2) UNION ALL SELECT 'd', map()")
    got = {r.name: r.change for r in registry.diff(old, new, ["name"], ["m"]).collect()}
    assert got == {"a": "unmodified", "b": "modified", "c": "deleted", "d": "added"}


def test_macro_vectors(spark):
    cases = [
        ("from {{.BEGIN}} to {{.FINISH}}", "from 2031-07-04T05:06:07Z to 2031-08-01T00:00:00Z"),
        ("label: '{{.LABEL}}'", "label: 'none yet'"),
        ("no braces, so .BEGIN stays", "no braces, so .BEGIN stays"),
        ("{{ .BEGIN|Date }} / {{.FINISH}}", "2031-07-04 / 2031-08-01T00:00:00Z"),
        ("{{ .BEGIN | Date }}..{{ Date .FINISH }}", "2031-07-04..2031-08-01"),
        ("\n  padded {{.BEGIN | Date }} \t\n", "padded 2031-07-04"),
        ("{{.BEGIN}}{{.BEGIN}}", "2031-07-04T05:06:07Z2031-07-04T05:06:07Z"),
        ("a label is no date: {{ .LABEL | Date }}", None),
        ("nobody knows {{ .OTHER }}", None),
    ]
    df = spark.createDataFrame(cases, "q string, want string")
    values = {"BEGIN": "'2031-07-04T05:06:07Z'", "FINISH": "'2031-08-01T00:00:00Z'", "LABEL": "'none yet'"}
    rows = macros.render(df.selectExpr("q", "want", f"{macros.normalized('q')} AS n"), "n", values).collect()
    assert [(r.q, r.rendered) for r in rows if (r.rendered or "").strip() != (r.want or "")] == []
    assert [r.want is None for r in rows] == [r.render_error is not None for r in rows]


def test_layouts():
    assert text.pattern("2006-01-02T15:04:05Z07:00") == "yyyy-MM-dd'T'HH:mm:ssXXX"
    assert text.pattern("Jan 2, 2006") == "MMM d, yyyy"


# --- graph --------------------------------------------------------------------------


def _graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_closure_levels_and_cycles(spark):
    edges = _graph(spark, [(1, 2), (2, 3), (3, 4), (1, 4), (4, 2), (5, 1), (4, 6)])
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.depth for r in graph.closure(edges, seeds, hot_rows=2).collect()} == {2: 1, 3: 2, 4: 1, 6: 2}
    assert {r.node for r in graph.cycle_nodes(edges).collect()} == {2, 3, 4}
    assert {r.node: r.level for r in graph.levels(edges).collect()} == {5: 0, 1: 1, 2: None, 3: None, 4: None, 6: None}
    dag = _graph(spark, [(1, 2), (1, 3), (2, 3), (3, 4)])
    assert graph.cycle_nodes(dag).count() == 0
    assert [r.node for r in graph.delete_order(dag, spark.createDataFrame([(2,)], "node long")).orderBy("step").collect()] == [4, 3, 2]
    assert {r.node for r in graph.delete_blockers(dag, spark.createDataFrame([(2,), (3,)], "node long")).collect()} == {4}


def test_priorities(spark):
    jobs = spark.createDataFrame([(1, "p", "n"), (2, "p", "n"), (3, "p", "n"), (4, "q", "n")], "job_id long, project string, namespace string")
    edges = _graph(spark, [(1, 3), (2, 3), (4, 3), (4, 2)])
    assert {r.job_id: r.priority for r in registry.priorities(jobs, edges).collect()} == {1: 10000, 2: 10000, 3: 9980, 4: 10000}


# --- replay and events --------------------------------------------------------------


def test_conflicts_equal_pairwise_check(spark):
    rows = spark.range(300).selectExpr(
        "id AS replay_id", "'p' AS project", "IF(id % 3 = 0, 0, id % 7) AS job_id", "timestamp_seconds((id * 977) % 50000) AS start_time",
        "timestamp_seconds((id * 977) % 50000 + (id * 31) % 900) AS end_time",
    )
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.job_id = b.job_id AND a.replay_id <> b.replay_id AND b.start_time <= a.end_time AND b.end_time >= a.start_time"), "left")
    want = pairs.groupBy("a.replay_id").agg(F.count("b.replay_id").alias("n_conflicts"))
    same(replay.conflicts(rows, rows), want)


def test_operator_outcome_without_start_opens_the_run(spark):
    rows = [(1, "task_fail", "t", "2024-01-01 01:00:00"), (2, "task_retry", "t", "2024-01-01 02:00:00"), (3, "task_start", "t", "2024-01-01 03:00:00"), (4, "task_success", "t", "2024-01-01 04:00:00"), (5, "job_success", "", "2024-01-01 05:00:00")]
    events = spark.createDataFrame(rows, "event_id long, type string, operator_name string, at string").selectExpr(
        "event_id", "'p' AS project", "1L AS job_id", "DATE '2024-01-01' AS scheduled_at", "type", "operator_name", "CAST(at AS TIMESTAMP) AS event_time"
    )
    attempts = {r.attempt: (str(r.start_time)[11:13], str(r.end_time)[11:13], r.status) for r in E.operator_runs(events).collect()}
    assert attempts == {0: ("01", "02", "retried"), 1: ("03", "04", "success")}
    early = E.fold_runs(events.where("event_id <= 2")).first()
    assert (early.state, early.end_time) == ("in_progress", None)
    assert E.fold_runs(events).first().state == "success"
    assert [r.state for r in E.state_changes(events).orderBy("event_time").collect()] == ["in_progress", "success"]


# --- tables and loads ---------------------------------------------------------------


def _table(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, day string").selectExpr("id", "v", "CAST(day AS DATE) AS day")


def _rows(spark, path, like):
    return sorted((r.id, r.v, str(r.day)) for r in loads.read(spark, path, like).collect())


def test_loads_are_idempotent(spark, tmp_path):
    old = _table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (3, "c", "2024-01-03")])
    new = _table(spark, [(2, "B", "2024-01-02"), (4, "D", "2024-01-04")])
    calls = {
        "replace": lambda p: loads.replace(new, p, "day"),
        "filter": lambda p: loads.replace_filter(new, p, "day", "day >= DATE '2024-01-02'"),
        "all": lambda p: loads.replace_all(new, p, "day"),
        "merge": lambda p: loads.merge(new, p, "day", ["id"]),
    }
    sizes = {"replace": 4, "filter": 3, "all": 2, "merge": 4}
    for name, call in calls.items():
        path = str(tmp_path / name)
        loads.append(old, path, "day")
        call(path)
        once = _rows(spark, path, old)
        call(path)
        assert _rows(spark, path, old) == once and len(once) == sizes[name]


def test_merge_moves_rows_between_partitions_and_refuses_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    old = _table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")])
    loads.append(old, path, "day")
    loads.merge(_table(spark, [(1, "A", "2024-01-02")]), path, "day", ["id"])
    assert _rows(spark, path, old) == [(1, "A", "2024-01-02"), (2, "b", "2024-01-02")]
    with pytest.raises(ValueError):
        loads.merge(_table(spark, [(1, "x", "2024-01-02"), (1, "y", "2024-01-02")]), path, "day", ["id"])


def _stored(spark, path, like):
    return sorted(map(str, (tuple(r) for r in loads.read(spark, path, like).collect())))


@pytest.mark.parametrize("kind", ["date", "timestamp", "string"])
def test_loads_with_null_and_escaped_partitions(spark, tmp_path, kind):
    """Every method twice, with a NULL partition, NULL keys and values whose folder names are escaped."""
    part = {"date": "day", "timestamp": "timestampadd(HOUR, id, day)", "string": "concat('a=b/c:', day)"}[kind]
    frame = lambda rows: _table(spark, rows).selectExpr("id", "v", f"CAST({part} AS {kind}) AS p")
    old = frame([(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (5, "five", None), (None, "none", "2024-01-01"), (6, "six", None)])
    new = frame([(2, "B", "2024-01-02"), (9, "nine", None), (None, "NONE", "2024-01-01"), (5, "FIVE", "2024-01-03")])
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    touched = {str(r.p) for r in new.select("p").distinct().collect()}
    untouched = [r for r in old.collect() if str(r.p) not in touched]
    want = {
        "replace": rows(new) + [str(tuple(r)) for r in untouched],
        "filter": rows(new) + rows(old.where("p IS NOT NULL AND id = 1")),
        "all": rows(new),
        "merge": rows(new) + rows(old.where("id IN (1, 6)")),
    }
    if kind != "timestamp":
        want["filter"] = rows(new)
    calls = {
        "replace": lambda p: loads.replace(new, p, "p"),
        "filter": lambda p: loads.replace_filter(new, p, "p", "p IS NULL OR hour(p) <> 1" if kind == "timestamp" else "true"),
        "all": lambda p: loads.replace_all(new, p, "p"),
        "merge": lambda p: loads.merge(new, p, "p", ["id"]),
    }
    for name, call in calls.items():
        path = f"{tmp_path}/{name}"
        loads.append(old, path, "p")
        for _ in range(2):
            call(path)
            assert _stored(spark, path, old) == sorted(want[name]), name
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted(calls), "nothing stays beside the tables"


def test_a_failing_load_leaves_the_target_and_nothing_else(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = _table(spark, [(1, "a", "2024-01-01")])
    bad = old.selectExpr("id", "CAST(raise_error('boom') AS STRING) AS v", "day")
    loads.append(old, path, "day")
    for call in (
        lambda: loads.replace(bad, path, "day"), lambda: loads.replace_all(bad, path, "day"),
        lambda: loads.replace_filter(bad, path, "day", "true"), lambda: loads.merge(bad, path, "day", ["id"]),
    ):
        with pytest.raises(Exception, match="boom"):
            call()
        assert _rows(spark, path, old) == [(1, "a", "2024-01-01")] and [f.name for f in tmp_path.iterdir()] == ["t"]


def test_results_may_read_their_own_target(spark, tmp_path):
    path = f"{tmp_path}/t"
    old = _table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")])
    loads.append(old, path, "day")
    more = loads.read(spark, path, old).selectExpr("id + 10 AS id", "v", "day")
    loads.replace_all(more.unionByName(loads.read(spark, path, old)), path, "day")
    assert [r[0] for r in _rows(spark, path, old)] == [1, 2, 11, 12]


def test_merge_reads_only_the_partitions_it_touches(spark, tmp_path, monkeypatch):
    path, read = f"{tmp_path}/t", []
    old = _table(spark, [(k, "a", f"2024-01-0{k}") for k in range(1, 9)])
    loads.append(old, path, "day")
    write = versions.write
    monkeypatch.setattr(versions, "write", lambda df, *a: (read.append({m[0] for f in df.inputFiles() if (m := re.search("day=[0-9-]+", f))}), write(df, *a)))
    loads.merge(_table(spark, [(3, "B", "2024-01-03"), (3, "C", "2024-01-05")]), path, "day", ["day", "id"])
    loads.merge(_table(spark, [(3, "D", "2024-01-09"), (7, "E", "2024-01-07")]), path, "day", ["id"])
    assert read == [{"day=2024-01-03", "day=2024-01-05"}, {"day=2024-01-03", "day=2024-01-05", "day=2024-01-07"}]
    assert _rows(spark, path, old)[2] == (3, "D", "2024-01-09") and len(_rows(spark, path, old)) == 9


def _merge_plainly(target, source, matched, not_matched, by_source):
    """Rows (id, v, day) by id, clauses as (action, condition, values) of Python functions of both rows."""
    out, by_key = [], {s[0]: s for s in source}
    for t in target:
        s = by_key.get(t[0]) if t[0] in by_key else None
        for action, holds, values in matched if s else by_source:
            if holds(t, s):
                if action == "update":
                    out.append(values(t, s))
                break
        else:
            out.append(t)
    known = {t[0] for t in target}
    for s in source:
        if s[0] not in known:
            for _, holds, values in not_matched:
                if holds(None, s):
                    out.append(values(None, s))
                    break
    return sorted(out, key=str)


def test_merge_clauses_equal_a_plain_merge(spark, tmp_path):
    C = loads.Clause
    target = [(k if k else None, "abc"[k % 3] if k % 4 else None, f"2024-01-0{1 + k % 3}") for k in range(12)]
    source = [(k if k else None, "xyz"[k % 3] if k % 5 else None, f"2024-01-0{1 + k % 4}") for k in range(0, 20, 2)]
    cases = [
        ((), (), ()),
        ((C("delete", "t.v = 'a'"), C("update", "s.v IS NOT NULL")), (C("insert", "s.id > 14"), C("insert", "s.id = 12", (("id", "s.id"), ("day", "s.day")))), ()),
        ((C("update", None, (("v", "concat(t.v, s.v)"), ("day", "s.day"))),), (), (C("delete", "t.id < 6"), C("update", "t.v = 'b'", (("v", "'gone'"),)))),
        ((C("delete"),), (C("insert"),), (C("delete"),)),
    ]
    both = lambda t, s: None if t[1] is None or s[1] is None else t[1] + s[1]
    always = lambda t, s: True
    plain = [
        ((), (), ()),
        (
            (("delete", lambda t, s: t[1] == "a", None), ("update", lambda t, s: s[1] is not None, lambda t, s: s)),
            (("insert", lambda t, s: s[0] is not None and s[0] > 14, lambda t, s: s), ("insert", lambda t, s: s[0] == 12, lambda t, s: (s[0], None, s[2]))), (),
        ),
        (
            (("update", always, lambda t, s: (t[0], both(t, s), s[2])),), (),
            (("delete", lambda t, s: t[0] is not None and t[0] < 6, None), ("update", lambda t, s: t[1] == "b", lambda t, s: (t[0], "gone", t[2]))),
        ),
        ((("delete", always, None),), (("insert", always, lambda t, s: s),), (("delete", always, None),)),
    ]
    old, new = _table(spark, target), _table(spark, source)
    for k, (clauses, expected) in enumerate(zip(cases, plain, strict=True)):
        path = f"{tmp_path}/{k}"
        loads.append(old, path, "day")
        loads.merge(new, path, "day", ["id"], *clauses)
        got = sorted(((r.id, r.v, str(r.day)) for r in loads.read(spark, path, old).collect()), key=str)
        assert got == _merge_plainly(target, source, *expected), k
    with pytest.raises(ValueError, match="insert"):
        loads.merge(new, f"{tmp_path}/0", "day", ["id"], matched=[C("insert")])


class _Killed(BaseException):
    pass


def test_a_load_killed_at_any_call_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    """Dies before or after every single operation on the store; nothing runs any more after that, clean-up included."""
    old = _table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02"), (5, "e", None)])
    new = _table(spark, [(1, "NEW", "2024-01-01"), (3, "c", "2024-01-03"), (5, "E", None)])
    calls = {
        "append": lambda p: loads.append(new, p, "day"),
        "replace": lambda p: loads.replace(new, p, "day"),
        "filter": lambda p: loads.replace_filter(new, p, "day", "day IS NULL OR day >= DATE '2024-01-02'"),
        "all": lambda p: loads.replace_all(new, p, "day"),
        "merge": lambda p: loads.merge(new, p, "day", ["day", "id"]),
        "drop": lambda p: loads.drop_partitions(spark, p, ["day=2024-01-02"]),
    }
    count, limit, after = [0], [None], [False]

    def dying(real):
        def call(*args):
            count[0] += 1
            if limit[0] is None or count[0] < limit[0]:
                return real(*args)
            if count[0] == limit[0] and after[0]:
                real(*args)
            raise _Killed

        return call

    for owner, names in ((versions.Files, ("names", "read", "create", "delete")), (versions, ("write",))):
        for name in names:
            monkeypatch.setattr(owner, name, dying(getattr(owner, name)))
    for name, call in calls.items():
        limit[0] = None
        whole = f"{tmp_path}/{name}"
        loads.append(old, whole, "day")
        before = _rows(spark, whole, old)
        count[0] = 0
        call(whole)
        steps, want = count[0], _rows(spark, whole, old)
        seen = set()
        for step in range(1, steps + 1):
            for dies_after in (False, True):
                path = f"{tmp_path}/{name}-{step}-{dies_after}"
                limit[0] = None
                loads.append(old, path, "day")
                count[0], limit[0], after[0] = 0, step, dies_after
                with pytest.raises(_Killed):
                    call(path)
                limit[0] = None
                found = _rows(spark, path, old)
                assert found in (before, want), (name, step, dies_after)
                seen.add(found == want)
        assert seen == {False, True} and before != want
        # A repeated load and a clean table in the end.
        call(path)
        versions.clean(spark, path, hours=-1)
        assert _rows(spark, path, old)


def test_concurrent_loads_and_clean(spark, tmp_path):
    path, files = f"{tmp_path}/t", versions.Files(spark)
    old = _table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-02")])
    old.write.partitionBy("day").parquet(path)  # by plain Spark
    assert len(_rows(spark, path, old)) == 2
    base = versions.latest(files, path)
    reader = loads.read(spark, path, old)
    loads.replace(_table(spark, [(1, "A", "2024-01-01")]), path, "day")
    assert sorted(r.v for r in reader.collect()) == ["a", "b"], "a reader keeps its version"
    assert [r[1] for r in _rows(spark, path, old)] == ["A", "b"]
    with pytest.raises(versions.Conflict):
        versions.commit(files, path, base, lambda c: {}, ["day=2024-01-01"])
    with pytest.raises(versions.Conflict):
        versions.commit(files, path, base, lambda c: {}, None)
    versions.commit(files, path, base, lambda c: {**c, "day=2024-01-02": []}, ["day=2024-01-02"])
    assert [r[1] for r in _rows(spark, path, old)] == ["A"]
    assert versions.clean(spark, path) == []
    assert sorted(x for x in versions.clean(spark, path, hours=-1)) == ["_versions/00000000000000000001", "day=2024-01-01", "day=2024-01-02"]
    assert [r[1] for r in _rows(spark, path, old)] == ["A"] and versions.clean(spark, path, hours=-1) == []


def test_job_run_hooks(spark, tables, tmp_path):
    seen = []

    def check(rows, context):
        seen.append("check")

    def boom(rows, context):
        raise RuntimeError("boom")

    def note(name):
        return lambda result, context: seen.append(name)

    target = str(tmp_path / "out")
    base = {"name": "j", "target": target, "partition": "day", "method": "REPLACE", "offset": "-24h", "after": [note("after")], "on_failure": [note("failed")]}
    ok = J.Job(transform=lambda rows, c: rows.selectExpr("user_id", "CAST(ts AS DATE) AS day"), checks=[check], **base)
    context = J.run(spark, ok, tables.events, "ts", "2024-01-16 02:00:00")
    assert seen == ["check", "after"] and str(context.start) == "2024-01-14 00:00:00"
    first = loads.read(spark, target, "user_id bigint, day date").count()
    J.run(spark, ok, tables.events, "ts", "2024-01-16 02:00:00")
    assert loads.read(spark, target, "user_id bigint, day date").count() == first > 0
    seen.clear()
    with pytest.raises(RuntimeError):
        J.run(spark, J.Job(transform=lambda rows, c: rows, checks=[boom], **base), tables.events, "ts", "2024-01-16 02:00:00")
    assert seen == ["failed"]


def test_spec_schema_rules(spark):
    schema = specs.struct_type([{"name": "a", "type": "integer", "mode": "REQUIRED"}, {"name": "b", "type": "RECORD", "mode": "repeated", "schema": [{"name": "c", "type": "NUMERIC"}]}])
    assert schema.simpleString() == "struct<a:bigint,b:array<struct<c:decimal(38,9)>>>" and not schema["a"].nullable
    for bad in ({"name": "x", "type": "GEOGRAPHY"}, {"name": "x", "type": "STRING", "mode": "many"}):
        with pytest.raises(ValueError):
            specs.struct_type([bad])
    with pytest.raises(ValueError):
        specs.evolve(spark.range(1), spark.range(1).schema, specs.struct_type([{"name": "other", "type": "STRING"}]))
    with pytest.raises(ValueError):
        managed.check_partitioning({"type": "RANGE", "start": 0}, {"type": "RANGE", "start": 1})
    managed.check_partitioning({"type": "DAY"}, {"type": "HOUR"})


def test_window_read_reaches_the_scan(spark, tables):
    from datetime import datetime

    from flowtables.plans import incremental

    df = incremental.read_window(tables.events, "ts", datetime(2024, 1, 14), datetime(2024, 1, 15)).select("user_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_clustered_files_hold_narrow_ranges(spark, tables, tmp_path):
    from flowtables.sources import tables as tb

    path = str(tmp_path / "c")
    tb.write_clustered(tables.lineitem, path, ["l_partkey"], files=4)
    ranges = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi")).orderBy("lo").collect()
    assert len(ranges) == 4 and all(a.hi < b.lo for a, b in zip(ranges, ranges[1:]))


def test_table_update_and_external_files(spark, tmp_path):
    fields = [{"name": "id", "type": "INTEGER", "mode": "required"}, {"name": "day", "type": "DATE"}]
    schema = managed.create(spark, "t_update", fields, path=str(tmp_path / "t"), partition="day", properties={"expires_at": "2024-02-01"})
    with pytest.raises(managed.AlreadyExists):
        managed.create(spark, "t_update", fields)
    managed.insert(spark.sql("SELECT 1 AS id, DATE '2024-01-01' AS day"), "t_update", schema)
    with pytest.raises(ValueError):
        managed.insert(spark.sql("SELECT CAST(NULL AS INT) AS id, DATE '2024-01-01' AS day"), "t_update", schema)
    managed.add_columns(spark, "t_update", [{"name": "note", "type": "STRING"}])
    managed.update_properties(spark, "t_update", {"label.team": "x"})
    row = spark.table("t_update").first()
    assert (row.id, row.note) == (1, None)
    assert "label.team" in {r.key for r in spark.sql("SHOW TBLPROPERTIES t_update").collect()}
    spark.sql("DROP TABLE t_update")

    spark.sql("SELECT 1 AS a, 'x' AS b").write.json(str(tmp_path / "j"))
    assert managed.read_external(spark, [str(tmp_path / "j")], "json").dtypes == [("a", "bigint"), ("b", "string")]
    (tmp_path / "c1.csv").write_text("n,m\n1,2\n")
    assert managed.read_external(spark, [str(tmp_path / "c1.csv")], "csv", skip_leading_rows=1).first().asDict() == {"n": 1, "m": 2}


def test_spec_errors_of_external_tables_and_views(spark):
    rows = spark.sql("SELECT * FROM VALUES ('csv', array('a')), ('', array('a')), ('csv', CAST(array() AS ARRAY<STRING>)), ('csv', array('')) AS t(kind, uris)")
    got = [len(r.e) for r in rows.selectExpr(f"{specs.external_errors('kind', 'uris')} AS e").collect()]
    assert got == [0, 1, 1, 1]
    got = [len(r.e) for r in spark.sql("SELECT * FROM VALUES ('SELECT 1'), (' ') AS t(q)").selectExpr(f"{specs.view_errors('q')} AS e").collect()]
    assert got == [0, 1]


def test_state_changes_are_refused_as_a_whole(spark):
    jobs = spark.createDataFrame([(1, "enabled"), (2, "enabled")], "job_id long, state string")
    change = spark.createDataFrame([(1, "disabled"), (9, "disabled")], "job_id long, state string")
    with pytest.raises(ValueError):
        registry.set_states(jobs, change)
    assert {r.job_id: r.state for r in registry.set_states(jobs, change.where("job_id = 1")).collect()} == {1: "disabled", 2: "enabled"}


def test_first_sla_alert_with_a_duration_counts(spark):
    from flowtables.operators import runs

    jobs = spark.sql("""SELECT 1L AS job_id, array(named_struct('on', 'sla_miss', 'config', map('x', '1h')), named_struct('on', 'sla_miss', 'config', map('duration', '1h30m')),
        named_struct('on', 'sla_miss', 'config', map('duration', '9h'))) AS alerts UNION ALL SELECT 2L, array(named_struct('on', 'failure', 'config', map('duration', '1h')))""")
    assert {r.job_id: r.sla_seconds for r in runs.with_sla_seconds(jobs).collect()} == {1: 5400, 2: 0}


def test_tables_stored_by_key_join_without_a_shuffle(spark, tables):
    managed.store_by_key(tables.runs_v, "runs_by_job", "job_id", 4)
    managed.store_by_key(tables.jobs_v, "jobs_by_job", "job_id", 4)
    joined = spark.table("runs_by_job").hint("merge").join(spark.table("jobs_by_job"), "job_id").groupBy("job_id").agg(F.count("*").alias("n"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    same(joined, tables.runs_v.join(tables.jobs_v, "job_id").groupBy("job_id").agg(F.count("*").alias("n")))
    for name in ("runs_by_job", "jobs_by_job"):
        spark.sql(f"DROP TABLE {name}")


def test_sizing_grows_with_the_input():
    from flowtables import session

    small, large = session.sizing(1 << 30), session.sizing(100 << 40)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert small[key] == "200" and int(large[key]) == 400_000 and large["spark.sql.files.maxPartitionBytes"] == "512m"


def test_odd_durations(spark):
    from flowtables.functions import durations

    df = spark.createDataFrame([("9999999999999us",), ("99999999999999999999us",), ("9223372036855s",), ("1h",), (None,)], "d string")
    got = [r.x for r in df.selectExpr(f"{durations.clock_micros('d')} AS x").collect()]
    assert got == [9999999999999, None, None, 3600000000, None]


def test_nested_maps_compare_by_content(spark):
    kind = "k int, v array<struct<on: string, config: map<string, string>>>, m map<string, map<string, int>>"
    one = spark.createDataFrame([(1, [("fail", {"a": "1", "b": "2"})], {"x": {"p": 1, "q": 2}}), (2, None, None), (3, [("x", None)], {})], kind)
    two = spark.createDataFrame([(1, [("fail", {"b": "2", "a": "1"})], {"x": {"q": 2, "p": 1}}), (2, None, None), (3, [("x", {})], {})], kind)
    got = {r.k: r.change for r in registry.diff(one, two, ["k"], ["v", "m"]).collect()}
    assert got == {1: "unmodified", 2: "unmodified", 3: "modified"}


def test_missing_values_are_errors_not_gaps(spark):
    from flowtables.operators import quality

    rows = spark.createDataFrame([("a", 1), (None, 2), (None, None)], "g string, x int")
    assert {r.group_value: (r.n_rows, r.n_nulls, r.max_value) for r in quality.profile(rows, ["x"], "g").collect()} == {"a": (1, 0, "1"), None: (2, 1, "2")}
    text = spark.createDataFrame([("at {{.D}}", None), ("at {{.D}}", "x")], "t string, d string")
    assert [(r.rendered, r.render_error) for r in macros.render(text, "t", {"D": "d"}).collect()] == [(None, "cannot render {{.D}}"), ("at x", None)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "src long, dst long")
    got = {r.node: (r.step, r.error) for r in graph.delete_order(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got[1] == (0, None) and all(got[n] == (None, "on or behind a cycle") for n in (2, 3, 4))
    replays = spark.createDataFrame([(1, 99)], "replay_id long, job_id long").selectExpr("*", "TIMESTAMP '2024-01-01' AS start_time", "TIMESTAMP '2024-01-02' AS end_time")
    jobs = spark.createDataFrame([(1,)], "job_id long").selectExpr("*", "TIMESTAMP '2023-01-01' AS start_at", "CAST(NULL AS TIMESTAMP) AS end_at")
    assert [r.error for r in replay.date_errors(replays, jobs, "TIMESTAMP '2024-02-01'").collect()] == ["unknown job"]


def test_recent_means_the_same_clock_time_months_ago(spark):
    backups = spark.sql("SELECT CAST(x AS TIMESTAMP) AS created_at FROM VALUES ('2024-02-29 12:00:00'), ('2024-03-02 09:59:59'), ('2024-03-02 10:00:01') AS v(x)")
    assert [str(r.created_at) for r in registry.recent_backups(backups, "2024-05-31 10:00:00").collect()] == ["2024-03-02 10:00:01"]


def test_deleted_jobs_take_no_part(spark):
    jobs, none = _jobs(spark), spark.createDataFrame([], "job_id long, static_upstream string")
    sources = spark.createDataFrame([(5, "t://x"), (2, "t://w"), (3, "t://x")], "job_id long, source string")
    edges = lineage.bulk_resolve(jobs, sources, none).collect()
    assert {(e.job_id, e.state) for e in edges} == {(2, "unresolved"), (3, "resolved")}
    assert {r.job_id for r in lineage.downstream_by_sources(jobs, sources, sources.select("source")).collect()} == {2, 3}
    assert {r.downstream_id for r in lineage.downstream_by_destination(jobs, sources).collect()} == {3}


def test_expired_partitions_are_removed(spark, tmp_path):
    path = f"{tmp_path}/t"
    loads.append(_table(spark, [(1, "a", "2024-01-01"), (2, "b", "2024-01-05"), (3, "c", None)]), path, "day")
    assert managed.remove_expired(spark, path, "day", "date", 48, "TIMESTAMP '2024-01-06 00:00:00'") == ["day=2024-01-01"]
    assert [r[0] for r in _rows(spark, path, _table(spark, []))] == [2, 3]


def test_leading_lines_are_skipped(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("".join(f"head {i}\n" for i in range(2)) + "".join(f"{k},{i}\n" for i in range(k * 2)))
    rows = managed.read_external(spark, [str(tmp_path)], "csv", specs.struct_type([{"name": "a", "type": "INTEGER"}, {"name": "b", "type": "INTEGER"}]), skip_leading_rows=2)
    assert sorted(map(tuple, rows.collect())) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_backup_runs_and_expires(spark, tmp_path):
    from datetime import datetime

    from flowtables.sources import backup

    resources = spark.createDataFrame([("d", "one", "table"), ("d", "two", "view"), ("d", "gone", "table")], "dataset string, name string, kind string")
    plan = backup.manifest(resources, "TIMESTAMP '2024-01-02 03:04:05'", ttl="24h")

    def rows_of(dataset, name):
        if name == "gone":
            raise LookupError("no such table")
        return spark.range(5)

    got = {r.name: (r.status, r.reason) for r in backup.run(spark, plan, rows_of, str(tmp_path)).collect()}
    assert got["one"] == ("success", None) and got["two"][0] == "ignored" and got["gone"] == ("failed", "no such table")
    name = "backup_d_one_2024_01_02_03_04_05"
    assert spark.table(name).count() == 5
    assert backup.remove_expired(spark, [name], datetime(2024, 1, 3, 3, 4, 4)) == []
    assert backup.remove_expired(spark, [name], datetime(2024, 1, 3, 3, 4, 5)) == [name]
    assert not spark.catalog.tableExists(name) and not (tmp_path / name).exists()


def test_job_run_renders_macros_and_hooks_see_what_was_loaded(spark, tables, tmp_path):
    seen = {}

    def look(result, context):
        seen.update(context.config, rows=sorted(tuple(r) for r in result.collect()))

    sql = "SELECT user_id, count(*) AS n, DATE '{{ .DSTART | Date }}' AS day FROM {source} GROUP BY user_id"
    job = J.Job("m", sql, f"{tmp_path}/t", "day", method="REPLACE", config={"from": "{{.DSTART}}", "mode": "all"}, after=[look])
    J.run(spark, job, tables.events, "ts", "2024-01-16 02:00:00", {"mode": "replay"})
    stored = loads.read(spark, f"{tmp_path}/t", "user_id bigint, n bigint, day date")
    assert seen["rows"] == sorted(tuple(r) for r in stored.collect()) and len(seen["rows"]) > 0
    assert seen["from"].endswith("Z") and seen["mode"] == "replay"
    with pytest.raises(ValueError, match="NOPE"):
        J.run(spark, J.Job("m", "SELECT {{.NOPE}}", f"{tmp_path}/t", "day"), tables.events, "ts", "2024-01-16 02:00:00")


def test_calendars_follow_the_runs(spark):
    jobs = spark.sql("""SELECT * FROM VALUES (1L, '@daily', TIMESTAMP '2024-01-10'), (2L, '@daily', TIMESTAMP '2024-01-20'), (3L, '@daily', NULL),
        (4L, '0 2 * * *', TIMESTAMP '2024-01-20') t(job_id, cron, start_at)""")
    runs = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP '2024-01-02'), (1L, TIMESTAMP '2024-01-04'), (1L, NULL), (9L, TIMESTAMP '2024-01-02') t(job_id, scheduled_at)")
    got = R.expected(R.spans(jobs, runs), "lo", "hi")
    assert sorted((r.job_id, r.scheduled_at.day) for r in got.collect()) == [(1, 2), (1, 3), (1, 4), (2, 20)]
    assert R.expected(R.spans(jobs, runs.limit(0)), "lo", "hi").count() == 2
    assert R.expected(R.spans(jobs.limit(0), runs), "lo", "hi").count() == 0


def _attempts(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, seconds long, minute long")
    return df.selectExpr(
        "'p' AS project", "job_id", "TIMESTAMP '2024-01-01' AS scheduled_at", "'task' AS operator_type", "'' AS operator_name", "1L AS attempt",
        "timestamp_seconds(1704067200 + minute * 60 - seconds) AS start_time", "timestamp_seconds(1704067200 + minute * 60) AS end_time",
    )


def test_job_durations_stay_within_their_bound(spark):
    from random import Random

    r = Random(1)
    rows = [(job, r.choice([0, 3, 255, 256, r.randrange(1000), int(1.4 ** r.randrange(60))]), k) for k in range(6000) for job in [k % 40 if k % 3 else 7]]
    attempts = _attempts(spark, rows)
    got = {x.job_id: x for x in E.job_durations(E.duration_partials(attempts), thousandths=(1, 500, 950, 1000)).collect()}
    assert len(got) == 40
    for job, x in got.items():
        values = sorted(s for j, s, _ in rows if j == job)
        assert (x.n, x.total_seconds, x.max_seconds) == (len(values), sum(values), values[-1])
        assert x.last_seconds == max((k, s) for j, s, k in rows if j == job)[1]
        for p in (1, 500, 950, 1000):
            exact = values[(len(values) * p + 999) // 1000 - 1]
            assert exact <= x[f"p{p}_seconds"] <= exact * (1 + 1 / 128)
            if exact < 256:
                assert x[f"p{p}_seconds"] == exact


def test_stored_duration_partials_merge_in_any_order(spark):
    attempts = _attempts(spark, [(k % 3, k * 37 % 900, k * 31) for k in range(500)] + [(5, 7, 1), (5, 7, 1)])
    whole = E.job_durations(E.duration_partials(attempts))
    early, late = (E.duration_partials(attempts.where(f"end_time {sign} TIMESTAMP '2024-01-05'")) for sign in ("<", ">="))
    merged = E.job_durations(E.merge_durations(late.unionByName(early), [*E.JOB_OPERATOR, "day"]))
    assert sorted(whole.collect()) == sorted(merged.collect())
    open_ones = attempts.withColumn("end_time", F.lit(None).cast("timestamp"))
    assert E.job_durations(E.duration_partials(open_ones)).count() == 0
    backwards = _attempts(spark, [(1, -300, 1), (1, -5, 2), (1, 9, 3)])
    assert E.job_durations(E.duration_partials(backwards)).first().p500_seconds == -5


def test_ranges_of_cells():
    assert managed.cell_range("") == (1, None, 1, None)
    assert managed.cell_range("B3:d20") == (2, 4, 3, 20)
    assert managed.cell_range("AA:AB") == (27, 28, 1, None)
    assert managed.cell_range("B2:9") == (2, None, 2, 9)
    for wrong in ("B3", "3:4", "D:B", "A9:B2", "Sheet!A1:B2", "A0:B", "A:"):
        with pytest.raises(ValueError):
            managed.cell_range(wrong)


def test_external_cells_of_large_and_small_files(spark, tmp_path):
    lines = {f: ["title", "", "k,Name,when,ok,name"] + [f"{n},{'x' if n % 2 else ''},2024-01-0{1 + n % 9},true,{n / 2}" for n in range(rows)] for f, rows in (("a", 3000), ("b", 5), ("c", 0))}
    for f, text_ in lines.items():
        (tmp_path / f"{f}.csv").write_text("\n".join(text_) + "\n")
    (tmp_path / "empty.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = lambda **more: managed.read_external(spark, [str(tmp_path)], "csv", **more)
        whole = read(skip_leading_rows=3)
        assert whole.rdd.getNumPartitions() > 4
        assert whole.dtypes == [("k", "bigint"), ("Name", "string"), ("when", "date"), ("ok", "boolean"), ("name4", "double")]
        assert sorted(r.k for r in whole.collect()) == sorted([*range(3000), *range(5)])
        part = read(skip_leading_rows=1, cells="A3:C2503")
        assert part.columns == ["k", "Name", "when"] and sorted(r.k for r in part.collect()) == sorted([*range(2500), *range(5)])
        typed = read(cells="C4:D6", schema=spark.range(0).selectExpr("DATE '2024-01-01' AS d", "true AS b").schema)
        assert typed.count() == 6 and typed.where("d IS NULL OR NOT b").count() == 0
        assert read(cells="A9000:B").columns == []
        with pytest.raises(ValueError):
            read(cells="A1:B2", schema=spark.range(0).schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_profile_of_windows_merges_to_the_profile_of_all_rows(spark):
    from flowtables.operators import quality

    rows = spark.range(20000).selectExpr("id % 7 AS day", "IF(id % 5 = 0, NULL, concat('g', id % 3)) AS g", "IF(id % 4 = 0, NULL, id % 900) AS x", "id AS y", "CAST(NULL AS DATE) AS z")
    parts = quality.partials(rows, ["x", "y", "z"], "g", F.col("day"))
    plain = {(r.group_value, r.column_name): r for r in quality.profile(rows, ["x", "y", "z"], "g").collect()}
    got = quality.report(parts).collect()
    assert len(got) == len(plain) == 12
    for r in got:
        p = plain[r.group_value, r.column_name]
        assert (r.n_rows, r.n_nulls, r.min_value, r.max_value, r.completeness) == (p.n_rows, p.n_nulls, p.min_value, p.max_value, p.completeness)
        assert r.n_distinct == p.n_distinct if p.n_distinct < 1000 else abs(r.n_distinct - p.n_distinct) <= 0.03 * p.n_distinct
    # A window loaded again counts once; one that is now empty is not in the fresh partials and must be dropped by the caller.
    again = quality.partials(rows.where("day = 3 AND x > 100"), ["x", "y", "z"], "g", F.col("day"))
    same(
        quality.report(quality.replace_window(parts, again)).drop("n_distinct"),
        quality.report(quality.partials(rows.where("day <> 3 OR x > 100"), ["x", "y", "z"], "g", F.col("day"))).drop("n_distinct"),
    )
    assert quality.report(parts, "incremental").count() == 7 * 4 * 3
    assert quality.report(parts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.report(parts, "partial")


def test_alerts_of_a_busy_route_are_numbered_by_message(spark):
    from flowtables.operators import alerts

    routed = spark.range(900).selectExpr(
        "id AS event_id", "'chat' AS scheme", "IF(id % 3 = 0, concat('r', id % 5), 'busy') AS route",
        "IF(id = 7, NULL, timestamp_seconds(1704067200 + id DIV 40)) AS event_time",
    )
    w = Window.partitionBy("scheme", "route", "flushed_from").orderBy("event_time", "event_id")
    got = alerts.in_messages(routed)
    assert got.count() == 899
    same(got, got.drop("position").withColumn("position", F.row_number().over(w).cast("bigint")))
    batches = {(r.route, r.flushed_from): r.n_alerts for r in alerts.batches(routed).collect()}
    assert {(r.route, r.flushed_from): r.n for r in got.groupBy("route", "flushed_from").agg(F.max("position").alias("n")).collect()} == batches


def test_changes_are_counted_once_whatever_the_job_ids(spark):
    """Jobs of the registry with ids in the range of the new ones; the namespace comes with the change, not from a second look-up."""
    from flowtables.fixtures import Tables
    from flowtables.queries import registry_queries

    class Far(Tables):
        @property
        def part(self):
            return self.spark.sql("SELECT 999990 + id AS p_partkey, CAST(id % 50 + 1 AS INT) AS p_size FROM range(40)")

        @property
        def supplier(self):
            return self.spark.sql("SELECT id AS s_suppkey FROM range(3)")

    got = registry_queries.change_counters(Far(spark, "")).collect()
    incoming = {k for k in range(999990, 1000030) if k % 11}
    counted = [k for k in range(999990, 1000030) if k not in incoming or k % 29]
    assert sum(r.n for r in got) == len(counted) + 3
    assert sum(r.n for r in got if r.namespace == "ns_9") == 3
    jobs = spark.createDataFrame([("p", "a", "n1", 1), ("p", "b", "n2", 1)], "project string, name string, namespace string, x int")
    new = spark.createDataFrame([("p", "a", "n3", 1), ("p", "c", "n4", 1)], "project string, name string, namespace string, x int")
    got = registry.diff(jobs, new, ["project", "name"], ["x"], carry=["namespace"]).collect()
    assert {(r.name, r.namespace, r.change) for r in got} == {("a", "n3", "unmodified"), ("b", "n2", "deleted"), ("c", "n4", "added")}


@pytest.mark.parametrize("mode", ["complete", "incremental"])
def test_profiles_count_many_distinct_values_exactly(spark, mode):
    """More values than a sketch counts exactly, NULL groups and windows, and both zeros."""
    from flowtables.operators import quality

    rows = spark.range(60000).selectExpr(
        "IF(id % 4 = 3, NULL, id % 4) AS day", "IF(id % 5 = 0, NULL, concat('g', id % 3)) AS g", "IF(id % 7 = 0, NULL, id % 9001) AS x", "CAST(NULL AS INT) AS y",
        "IF(id % 2 = 0, -0D, 0D) AS z", "id AS w",
    )
    columns = ["x", "y", "z"]
    got = quality.report(quality.partials(rows, [*columns, "w"], "g", F.col("day")), mode, quality.distinct_values(rows, columns, "g", F.col("day")))
    keys = ["day", "g"] if mode == "incremental" else ["g"]
    want = {tuple(r[: len(keys)]): r for r in rows.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in [*columns, "w"]]).collect()}
    got = got.collect()
    assert len(got) == 4 * len(want)
    for r in got:
        exact = want[(r.window_key, r.group_value) if mode == "incremental" else (r.group_value,)][r.column_name]
        assert r.n_distinct == exact if r.column_name != "w" else abs(r.n_distinct - exact) <= 0.03 * exact


def test_run_configuration_needs_no_sorted_entries(spark):
    """The latest entry per key wins, also among ties and NULLs, and entries are combined in hash tables, not sorted by the task that reads them."""
    replays = spark.range(3000).selectExpr(
        "id % 7 AS job_id", "IF(id % 2 = 0, id, id - 1) AS replay_id", "timestamp_seconds(86400 * (id % 11)) AS start_time", "timestamp_seconds(86400 * (id % 11 + id % 5)) AS end_time",
        "IF(id % 13 = 0, NULL, timestamp_seconds(id % 90)) AS created_at", "map(concat('k', id % 3), IF(id % 17 = 0, NULL, CAST(id AS STRING)), 'all', concat('v', id % 19)) AS config",
    )
    runs = spark.range(500).selectExpr("id % 8 AS job_id", "timestamp_seconds(3600 * id) AS scheduled_at")
    got = replay.run_config(runs, replays, "config")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    hits = runs.distinct().join(replays.selectExpr("*", "explode(config) AS (key, value)"), "job_id").where("scheduled_at BETWEEN start_time AND end_time")
    want = hits.groupBy("job_id", "scheduled_at", "key").agg(F.max(F.struct("created_at", "replay_id", "value")).alias("v"))
    same(got, want.selectExpr("job_id", "scheduled_at", "key", "v.value AS value"))


def test_graph_loops_collect_small_tables_only(spark, monkeypatch):
    """Every step is planned under a small limit for broadcasts, the edges are computed once, and the session's own limits hold again afterwards."""
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before, seen, cut = [spark.conf.get(k, None) for k in keys], [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: (seen.append([spark.conf.get(k, None) for k in keys]), cut(df))[1])
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    edges = spark.range(400).selectExpr("id AS src", "IF(id % 4 = 3, id - 3, id + 1) AS dst").mapInArrow(counted, "src long, dst long")
    for fn in (graph.cycle_paths, graph.strong_components, graph.levels, lambda e: graph.closure(e, spark.range(1).selectExpr("id AS node"))):
        seen.clear()
        computed.value = 0
        assert fn(edges).count() in (400, 4)
        assert seen and all(s == [session.SMALL_BROADCAST] * 2 for s in seen)
        assert computed.value == 400
        assert [spark.conf.get(k, None) for k in keys] == before


def test_query_texts_of_one_partition_are_read_by_many_tasks(spark):
    texts = spark.range(200).coalesce(1).selectExpr("id", "concat('SELECT 1 FROM `a.b.t', id, '`') AS q")
    read = lineage.tables_in_sql(texts, "q").withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.source_table for r in read) == sorted(f"a.b.t{k}" for k in range(200))
    assert len({r.task for r in read}) == session.shuffle_pieces(spark)


def test_types_are_detected_without_casts_that_must_fail(spark):
    """Whatever a cast accepts passes the pattern before it; ordinary texts of another type never reach the cast."""
    accepted = "1| 1 |+1|-1|1.|1.5|.5|-.5|1e5|1E+5|1d|1.5f|NaN|inf|-inf|+Infinity|0x1p3|\t7\n|2024|02024|200000|2024-01|2024-1-1|2024-01-01 1:02|12:00|T12:00:00|T1|2024-01-01T00:00|t|TRUE|Yes|n| f |0"
    refused = "1-URGENT|5-LOW|TRUCK|#|deadbeef|1234567 a|x1"
    rows = spark.createDataFrame([(v, k) for k, text in enumerate((accepted, refused)) for v in text.split("|")], "c string, k int")
    for kind, pattern in (("BIGINT", managed._WHOLE), ("DOUBLE", managed._NUMBER), ("TIMESTAMP", managed._MOMENT), ("BOOLEAN", managed._TRUTH)):
        seen = rows.selectExpr("c", "k", f"c RLIKE r'(?s)^[\\s\\p{{Cntrl}}]*(?:{pattern})[\\s\\p{{Cntrl}}]*$' AS may_be", f"try_cast(c AS {kind}) IS NOT NULL AS fits").collect()
        assert not [r.c for r in seen if r.fits and not r.may_be]
        assert not [r.c for r in seen if r.k and r.may_be]
    some = spark.createDataFrame([("1", "1-A", "2024-01-01 10:00:00", "t", "1.5", "2024-01-01", None), ("2", "x", "2024-01-02", " no ", "2", "2024-1-2", None)], "a string, b string, c string, d string, e string, f string, g string")
    assert managed._detected(some).schema.simpleString() == "struct<a:bigint,b:string,c:timestamp,d:boolean,e:double,f:date,g:string>"
