"""The schema history of a stored table."""

import pytest

from flowtables.sources import loads, schemas, versions

FIELDS = [
    {"name": "id", "type": "INTEGER", "mode": "required", "description": "key"},
    {"name": "a", "type": "STRING"},
    {"name": "n", "type": "INTEGER"},
    {"name": "day", "type": "DATE"},
]
ID, A, N, DAY = FIELDS


def rows(spark, values, kinds="id long, a string, n long, day string"):
    df = spark.createDataFrame(values, kinds)
    return df.withColumn("day", df["day"].cast("date"))


def back(spark, path, order="id"):
    return [tuple(r) for r in loads.read(spark, path).drop("day").orderBy(order).collect()]


@pytest.fixture
def path(spark, tmp_path):
    path = f"{tmp_path}/t"
    schemas.create(spark, path, FIELDS, "day", labels={"team": "x"})
    loads.append(rows(spark, [(1, "one", 10, "2024-01-01"), (2, None, None, None)]), path, "day")
    return path


def test_rename_drop_add_and_the_old_name_again(spark, path):
    schemas.replace(spark, path, [ID, {"name": "b", "type": "STRING"}, DAY, {"name": "a", "type": "BOOLEAN"}], renames={"a": "b"})
    assert back(spark, path) == [(1, "one", None), (2, None, None)]
    loads.append(rows(spark, [(3, "three", True, "2024-01-01")], "id long, b string, a boolean, day string"), path, "day")
    assert back(spark, path) == [(1, "one", None), (2, None, None), (3, "three", True)]
    # n was dropped; a new n does not bring the old values back.
    schemas.replace(spark, path, [ID, {"name": "b", "type": "STRING"}, DAY, N])
    assert back(spark, path) == [(1, "one", None), (2, None, None), (3, "three", None)]
    ids = [dict(zip(s.columns.names, s.ids, strict=True)) for s in schemas.history(spark, path)]
    assert ids[0]["a"] == ids[1]["b"] == ids[2]["b"] and len({ids[0]["n"], ids[1]["a"], ids[2]["n"]}) == 3


def test_two_names_are_swapped(spark, path):
    schemas.replace(spark, path, [ID, {"name": "m", "type": "INTEGER"}, {"name": "x", "type": "STRING"}, DAY], renames={"a": "x", "n": "m"})
    schemas.replace(spark, path, [ID, {"name": "x", "type": "INTEGER"}, {"name": "m", "type": "STRING"}, DAY], renames={"m": "x", "x": "m"})
    assert back(spark, path) == [(1, 10, "one"), (2, None, None)]


def test_widened_columns_and_merge_over_both_schemas(spark, path):
    schemas.replace(spark, path, [ID, A, {"name": "n", "type": "NUMERIC"}, DAY])
    assert dict(loads.read(spark, path).dtypes)["n"] == "decimal(38,9)"
    loads.merge(rows(spark, [(1, "uno", 11, "2024-01-01"), (4, "four", 4, "2024-01-01")]), path, "day", ["id"])
    assert [(i, a, None if n is None else int(n)) for i, a, n in back(spark, path)] == [(1, "uno", 11), (2, None, None), (4, "four", 4)]
    with pytest.raises(ValueError, match="missing columns"):
        loads.merge(rows(spark, [(1, "uno", "2024-01-01")], "id long, a string, day string"), path, "day", ["id"])


def test_descriptions_labels_and_optional(spark, path):
    made = schemas.replace(spark, path, [{"name": "id", "type": "INTEGER", "description": "number"}, A, N, DAY], labels={"team": "y"})
    assert made == schemas.current(spark, path) and made.labels == {"team": "y"} and made.ids == (1, 2, 3, 4)
    assert made.columns["id"].metadata["comment"] == "number" and made.columns["id"].nullable
    assert schemas.history(spark, path)[0].labels == {"team": "x"}
    loads.append(rows(spark, [(None, "x", 1, "2024-01-01")]), path, "day")
    assert len(back(spark, path)) == 3


@pytest.mark.parametrize(
    "fields, renames, message",
    [
        ([ID, A, {"name": "n", "type": "STRING"}, DAY], None, "cannot change"),
        ([ID, {**A, "mode": "required"}, N, DAY], None, "become required"),
        ([*FIELDS, {"name": "z", "type": "STRING", "mode": "required"}], None, "required column cannot be added"),
        ([ID, A, N], None, "no column day"),
        ([ID, A, N, {"name": "day", "type": "TIMESTAMP"}], None, "cannot change"),
        ([*FIELDS, {"name": "A", "type": "STRING"}], None, "one name"),
        (FIELDS, {"q": "a"}, "cannot rename"),
    ],
)
def test_refused_changes(spark, path, fields, renames, message):
    with pytest.raises(ValueError, match=message):
        schemas.replace(spark, path, fields, renames)
    assert schemas.current(spark, path).number == 1


def test_range_partitioning_stays(spark, tmp_path):
    path, ranged = f"{tmp_path}/r", {"type": "RANGE", "start": 0, "end": 10, "interval": 5}
    schemas.create(spark, path, FIELDS, "day", partitioning=ranged)
    with pytest.raises(ValueError, match="range partitioning"):
        schemas.replace(spark, path, FIELDS, partitioning={**ranged, "end": 20})
    assert schemas.replace(spark, path, FIELDS, partitioning=ranged).partitioning == ranged


def test_rows_of_before_the_history_are_of_its_first_schema(spark, tmp_path):
    path = f"{tmp_path}/old"
    loads.append(rows(spark, [(1, "a", 1, "2024-01-01")]), path, "day")
    schemas.create(spark, path, FIELDS, "day")
    schemas.replace(spark, path, [ID, {"name": "b", "type": "STRING"}, DAY], renames={"a": "b"})
    assert back(spark, path) == [(1, "a")]


def test_required_values_unknown_columns_and_taken_numbers(spark, path):
    with pytest.raises(Exception, match="required column has no value"):
        loads.append(rows(spark, [(None, "x", 1, "2024-01-01")]), path, "day")
    with pytest.raises(ValueError, match="not in the schema"):
        loads.append(rows(spark, [(1, "x", 1, "2024-01-01", 5)], "id long, a string, n long, day string, z long"), path, "day")
    with pytest.raises(versions.Conflict):
        schemas.create(spark, path, FIELDS, "day")
    assert len(back(spark, path)) == 2


def test_only_wanted_columns_are_read(spark, path):
    schemas.replace(spark, path, [ID, {"name": "b", "type": "STRING"}, N, DAY], renames={"a": "b"})
    loads.append(rows(spark, [(3, "c", 3, "2024-01-02")], "id long, b string, n long, day string"), path, "day")
    plan = loads.read(spark, path).where("day = DATE'2024-01-02'").select("b")._jdf.queryExecution().executedPlan().toString()
    assert "n#" not in "".join(x.split("ReadSchema")[1] for x in plan.splitlines() if "ReadSchema" in x)
    assert [r.b for r in loads.read(spark, path).where("day = DATE'2024-01-02'").select("b").collect()] == ["c"]
