"""Five-field cron expressions evaluated row by row. Arguments are SQL expressions.
Lambda variables start with two underscores, so that they never hide a column.

No calendar table is joined: the next, previous or full set of schedule times follows from
the expression and the time in the row, so nothing is shuffled and no expression is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Descriptor -> five fields.
DESCRIPTORS = {
    "@yearly": "0 0 1 1 *",
    "@annually": "0 0 1 1 *",
    "@monthly": "0 0 1 * *",
    "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()

# Day search distances: nearly every schedule is found in the first step, the later ones
# are only evaluated when it came back empty. Nine years cover a skipped leap day.
_REACH = (1, 2, 8, 32, 367, 9 * 366)


def normalize(expr: str) -> str:
    """SQL: descriptors become five fields; anything else stays."""
    return f"CASE {expr} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DESCRIPTORS.items())} ELSE {expr} END"


# The five fields: lowest and highest value, names, number of the first name.
_FIELDS = {
    "minutes": (0, 59, [], 0),
    "hours": (0, 23, [], 0),
    "days": (1, 31, [], 0),
    "months": (1, 12, MONTHS, 1),
    "weekdays": (0, 6, WEEKDAYS, 0),
}


def _number(token: str, names: list[str], base: int) -> str:
    number = f"IF({token} RLIKE '^[0-9]+$', try_cast({token} AS INT), NULL)"
    if not names:
        return number
    known = " ".join(f"WHEN '{n}' THEN {i + base}" for i, n in enumerate(names))
    return f"coalesce({number}, CASE lower({token}) {known} END)"


def _parts(text: str, low: int, high: int, names: list[str], base: int) -> str:
    """SQL for the comma-separated parts of a field as (first, last, step, unrestricted)."""
    span, star = "split_part(__p, '/', 1)", "split_part(__p, '/', 1) IN ('*', '?')"
    stepped, ranged = "instr(__p, '/') > 0", "instr(split_part(__p, '/', 1), '-') > 0"
    step = f"IF({stepped}, {_number("split_part(__p, '/', 2)", [], 0)}, 1)"
    first = _number(f"split_part({span}, '-', 1)", names, base)
    last = _number(f"split_part({span}, '-', 2)", names, base)
    return (
        f"transform(split({text}, ','), __p -> named_struct('a', IF({star}, {low}, {first}), 'b', CASE WHEN {star} THEN {high} "
        f"WHEN {ranged} THEN {last} WHEN {stepped} THEN {high} ELSE {first} END, 'n', {step}, "
        f"'star', {star} AND {step} = 1))"
    )


def with_plan(df: DataFrame, expr: str, into: str = "plan") -> DataFrame:
    """Adds the parsed expression: allowed ticks (minutes of the day), days, months and weekdays.

    NULL when the text is no schedule. Worked out in steps so that no part is parsed twice; a field that
    is unrestricted or a single number, as most are, takes no list processing.
    """
    step = df.selectExpr("*", rf"split(trim({normalize(expr)}), r'\s+') AS __f")
    step = step.selectExpr("*", *[f"coalesce(get(__f, {i}), '') AS __t_{n}" for i, n in enumerate(_FIELDS)])
    star = [f"__t_{n} IN ('*', '?') AS __any_{n}" for n in _FIELDS]
    single = [f"IF(__t_{n} RLIKE '^[0-9]+$', try_cast(__t_{n} AS INT), NULL) AS __one_{n}" for n in _FIELDS]
    step = step.selectExpr("*", *star, *single)
    step = step.selectExpr("*", *[f"IF(__any_{n} OR __one_{n} IS NOT NULL, NULL, {_parts(f'__t_{n}', *spec)}) AS __p_{n}" for n, spec in _FIELDS.items()])
    checks = [
        f"CASE WHEN __any_{n} THEN true WHEN __one_{n} IS NOT NULL THEN __one_{n} BETWEEN {low} AND {high} ELSE "
        f"forall(__p_{n}, __p -> coalesce(__p.a >= {low} AND __p.b <= {high} AND __p.a <= __p.b AND __p.n >= 1, false)) END"
        for n, (low, high, _, _) in _FIELDS.items()
    ]
    allowed = [
        f"CASE WHEN __any_{n} THEN sequence({low}, {high}) WHEN __one_{n} IS NOT NULL THEN array(__one_{n}) ELSE "
        f"filter(sequence({low}, {high}), __x -> exists(__p_{n}, __p -> __x >= __p.a AND __x <= __p.b AND (__x - __p.a) % nullif(__p.n, 0) = 0)) END AS __a_{n}"
        for n, (low, high, _, _) in _FIELDS.items()
    ]
    free = lambda n: f"(__any_{n} OR coalesce(exists(__p_{n}, __p -> __p.star), false))"
    step = step.selectExpr("*", f"size(__f) = 5 AND {' AND '.join(checks)} AS __ok", f"{free('days')} OR {free('weekdays')} AS __both", *allowed)
    ticks = "flatten(transform(__a_hours, __h -> transform(__a_minutes, __m -> __h * 60 + __m)))"
    fields = f"'ticks', {ticks}, 'days', __a_days, 'months', __a_months, 'weekdays', __a_weekdays, 'both', __both"
    return step.selectExpr(*df.columns, f"IF(__ok, named_struct({fields}), NULL) AS {into}")


def error(expr: str, plan: str) -> str:
    """Why an expression has no calendar, or NULL."""
    return (
        f"CASE WHEN startswith({expr}, '@every') THEN 'relative interval has no fixed calendar' "
        f"WHEN {plan} IS NULL THEN 'not a five-field cron expression' END"
    )


def day_matches(plan: str, day: str) -> str:
    """Day of month AND weekday when one of them is unrestricted, otherwise OR."""
    by_day, by_week = f"array_contains({plan}.days, day({day}))", f"array_contains({plan}.weekdays, dayofweek({day}) - 1)"
    return (
        f"(array_contains({plan}.months, month({day})) AND "
        f"IF({plan}.both, {by_day} AND {by_week}, {by_day} OR {by_week}))"
    )


def _at(day: str, tick: str) -> str:
    return f"timestamp_seconds(unix_seconds(CAST({day} AS TIMESTAMP)) + {tick} * 60)"


def _clock(ts: str) -> str:
    return f"(unix_micros({ts}) - unix_micros(date_trunc('DAY', {ts})))"


def matches(plan: str, ts: str) -> str:
    return f"({day_matches(plan, ts)} AND exists({plan}.ticks, __t -> __t * 60000000L = {_clock(ts)}))"


def _step(plan: str, ts: str, order: str, pick: int, move: str) -> str:
    """The nearest schedule time on one side of ``ts``: on its own day, else on the nearest matching day."""
    same_day = f"try_element_at(filter({plan}.ticks, __t -> __t * 60000000L {order} {_clock(ts)}), {pick})"
    days = [
        f"try_element_at(filter(transform(sequence({near}, {far - 1}), __n -> {move}(CAST({ts} AS DATE), __n)), __d -> {day_matches(plan, '__d')}), 1)"
        for near, far in zip(_REACH, _REACH[1:])
    ]
    other_day = _at(f"coalesce({', '.join(days)})", f"try_element_at({plan}.ticks, {pick})")
    return f"coalesce(IF({day_matches(plan, ts)}, {_at(f'CAST({ts} AS DATE)', same_day)}, NULL), {other_day})"


def next_time(plan: str, ts: str) -> str:
    """First schedule time strictly after ``ts``; NULL when none follows."""
    return _step(plan, ts, ">", 1, "date_add")


def prev_time(plan: str, ts: str) -> str:
    """Last schedule time strictly before ``ts``; NULL when there is none."""
    return _step(plan, ts, "<", -1, "date_sub")


def explode_schedule(df: DataFrame, expr: str, start: str, end: str, into: str = "scheduled_at") -> DataFrame:
    """One row per schedule time in the closed range [start, end]. Only the input rows move, not the times."""
    names = df.columns
    # Few rows become many: they are spread evenly first, whatever files they came from.
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    step = with_plan(spread.selectExpr("*", f"CAST({start} AS TIMESTAMP) AS __lo", f"CAST({end} AS TIMESTAMP) AS __hi"), expr, "__plan")
    # Filters only on generated columns, and none from which "plan is not null" follows: it would be
    # pushed below the parsing and repeat it.
    days = step.where("__lo <= __hi").selectExpr("*", "explode_outer(sequence(CAST(__lo AS DATE), CAST(__hi AS DATE))) AS __day")
    ticks = days.where(f"coalesce({day_matches('__plan', '__day')}, false)").selectExpr("*", "explode_outer(__plan.ticks) AS __tick")
    times = ticks.selectExpr(*names, "__lo", "__hi", f"{_at('__day', '__tick')} AS {into}")
    return times.where(f"{into} BETWEEN __lo AND __hi").select(*names, into)
