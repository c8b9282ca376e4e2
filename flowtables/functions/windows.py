"""Data windows of scheduled runs (half-open, UTC).

Settings are texts on a job; ``with_settings`` turns them into numbers once per job, and
``with_bounds`` applies the numbers to any number of run times with plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.functions import durations as D

_NUMBERS = ("ws_unit", "ws_size_months", "ws_size_micros", "ws_offset_months", "ws_offset_micros", "ws_size_v1", "ws_offset_v1")


def _shift(ts: str, micros: str | int) -> str:
    return f"timestamp_micros(unix_micros({ts}) + {micros})"


def add_months(ts: str, months: str) -> str:
    """Calendar months with day overflow: Jan 31 plus one month is Mar 2 or 3, not Feb 28."""
    moved = f"date_add(add_months(trunc({ts}, 'MM'), {months}), day({ts}) - 1)"
    return _shift(f"CAST({moved} AS TIMESTAMP)", f"unix_micros({ts}) - unix_micros(date_trunc('DAY', {ts}))")


def _truncate(ts: str, unit: str) -> str:
    """h/d/w/M; weeks start on Monday; any other text leaves the time alone."""
    return (
        f"CASE {unit} WHEN 'h' THEN date_trunc('HOUR', {ts}) WHEN 'd' THEN date_trunc('DAY', {ts})"
        f" WHEN 'w' THEN date_trunc('WEEK', {ts}) WHEN 'M' THEN date_trunc('MONTH', {ts}) ELSE {ts} END"
    )


# Version 1 pieces: a week ends on the next Sunday; M counts whole 30-day months.
_CLOCK_END = _shift(
    "CASE ws_unit WHEN 'h' THEN date_trunc('HOUR', __ts) WHEN 'd' THEN date_trunc('DAY', __ts)"
    f" WHEN 'w' THEN {_shift('date_trunc("DAY", __ts)', f'(8 - dayofweek(__ts)) * {D.DAY}L')} ELSE __ts END",
    "ws_offset_v1",
)
_MONTH = f"add_months(trunc(__ts, 'MM'), CAST(ws_offset_v1 DIV {D.MONTH_V1}L AS INT))"
_MONTH_START = f"CAST(add_months(__month, -CAST(greatest(ws_size_v1 DIV {D.MONTH_V1}L - 1, 0) AS INT)) AS TIMESTAMP)"

_ERRORS = """array_compact(array(
  IF(__unit NOT IN ('', 'h', 'd', 'w', 'M'), 'truncate_to: must be one of h, d, w, M', NULL),
  IF(__offset <> '' AND __o_micros IS NULL, 'offset: not a duration', NULL),
  CASE WHEN __size <> '' AND __s_micros IS NULL THEN 'size: not a duration'
       WHEN __s_months < 0 OR startswith(__size, '-') THEN 'size: cannot be negative' END))"""


def with_errors(df: DataFrame, size: str, offset: str, unit: str, into: str = "errors") -> DataFrame:
    """Adds all complaints about a version 2 window as an array. Arguments are SQL expressions."""
    step = df.selectExpr("*", f"{size} AS __size", f"{offset} AS __offset", f"{unit} AS __unit")
    step = D.parse_v2(step, {"__s": "__size", "__o": "__offset"})
    return step.selectExpr(*df.columns, f"{_ERRORS} AS {into}")


def with_settings(df: DataFrame, size: str, offset: str, unit: str) -> DataFrame:
    """Adds a window's settings as numbers, for both versions; NULL where a version rejects them."""
    keep = df.columns
    step = df.selectExpr("*", f"{size} AS __size", f"{offset} AS __offset", f"{unit} AS __unit")
    step = D.parse_v2(step, {"__s": "IF(__size = '', '0', __size)", "__o": "IF(__offset = '', '0', __offset)"})
    step = D.parse_v1(step, {"__s1": "IF(__size = '', '24h', __size)", "__o1": "IF(__offset = '', '0', __offset)"})
    step = step.selectExpr("*", f"size({_ERRORS}) = 0 AS __ok", "__s1 IS NOT NULL AND __o1 IS NOT NULL AS __ok1")
    numbers = ("__s_months", "__s_micros", "__o_months", "__o_micros")
    return step.selectExpr(
        *keep,
        "__unit AS ws_unit",
        *[f"IF(__ok, {c}, NULL) AS {name}" for c, name in zip(numbers, _NUMBERS[1:5])],
        "IF(__ok1, __s1, NULL) AS ws_size_v1",
        "IF(__ok1, __o1, NULL) AS ws_offset_v1",
    )


def with_bounds(
    df: DataFrame, ts: str, version: str | int, start: str = "window_start", end: str = "window_end"
) -> DataFrame:
    """Adds DSTART and DEND and drops the settings columns.

    Version 2: end = truncated time + offset, start = end - size, clock part before months.
    Version 1 (also asked for as 0): 30-day months, a week ends on the next Sunday, ``M`` ends on
    the last day of the month. An unknown version gives NULL bounds.
    """
    keep = [c for c in df.columns if c not in _NUMBERS]
    step = df.selectExpr("*", f"{ts} AS __ts", f"CAST({version} AS INT) AS __version")
    step = step.selectExpr("*", f"{_shift(_truncate('__ts', 'ws_unit'), 'ws_offset_micros')} AS __cut2", f"{_CLOCK_END} AS __end1", f"{_MONTH} AS __month")
    step = step.selectExpr("*", f"{add_months('__cut2', 'ws_offset_months')} AS __end2")
    step = step.selectExpr("*", f"{_shift('__end2', '-ws_size_micros')} AS __back2")
    return step.selectExpr(
        *keep,
        f"CASE WHEN __version = 2 THEN {add_months('__back2', '-ws_size_months')} WHEN __version NOT IN (0, 1) THEN NULL "
        f"WHEN ws_unit = 'M' THEN {_MONTH_START} ELSE {_shift('__end1', '-ws_size_v1')} END AS {start}",
        "CASE WHEN __version = 2 THEN __end2 WHEN __version NOT IN (0, 1) THEN NULL "
        f"WHEN ws_unit = 'M' THEN IF(__end1 IS NULL, NULL, CAST(last_day(__month) AS TIMESTAMP)) ELSE __end1 END AS {end}",
    )


def version_error(version: Column) -> Column:
    return F.when(
        ~version.isin(0, 1, 2),
        F.concat(F.lit("no window rules of version "), version.cast("string")),
    )


def with_last_covered_run(df: DataFrame, ts: str, size: str, into: str) -> DataFrame:
    """Adds the inclusive last run a window of this size reaches from ``ts``: one day before its end."""
    step = D.parse_v2(df.selectExpr("*", f"{ts} AS __ts"), {"__s": size})
    step = step.selectExpr("*", f"{_shift('__ts', '__s_micros')} AS __moved")
    step = step.selectExpr("*", f"{add_months('__moved', '__s_months')} AS __end")
    return step.selectExpr(*df.columns, f"{_shift('__end', -D.DAY)} AS {into}")
