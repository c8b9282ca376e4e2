"""Rendering of ``{{.NAME}}`` macros over a table of texts, and configuration maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.functions import text as X

SYSTEM_NAMES = ("DSTART", "DEND", "EXECUTION_TIME", "JOB_DESTINATION")
SECRET_MARK = ".secret."


def rfc3339(ts: str) -> str:
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def normalized(source: str) -> str:
    """SQL: every known macro form in one spelling, ``{{.NAME}}`` or ``{{.NAME|Date}}``.

    It depends on the text alone: apply it to the table of texts, before the texts meet their runs.
    """
    text = source
    for form, spelling in ((r"\.(\w+)", "{{.$1}}"), (r"\.(\w+)\s*\|\s*Date", "{{.$1|Date}}"), (r"Date\s+\.(\w+)", "{{.$1|Date}}")):
        text = rf"regexp_replace({text}, r'\{{\{{\s*{form}\s*\}}\}}', '{spelling}')"
    return text


def render(df: DataFrame, source: str, values: dict[str, str], into: str = "rendered", error: str = "render_error") -> DataFrame:
    """Replaces each known macro, plain or through ``Date``, by the value given for it, then trims.

    ``source`` is a column with normalized texts. ``error`` names what could not be rendered: a macro
    that is left over, or a Date of something else.
    """
    names = list(values)
    step = df.selectExpr("*", *[f"{sql} AS __v_{n}" for n, sql in values.items()])
    body = source
    for n in names:
        # A NULL value keeps the macro, so it shows up as an error below.
        dated = f"replace({body}, '{{{{.{n}|Date}}}}', coalesce({X.date_of(f'__v_{n}')}, '{{{{.{n}|Date}}}}'))"
        step = step.selectExpr("*", f"IF(instr({body}, '{{{{.{n}|Date}}}}') > 0, {dated}, {body}) AS __d_{n}")
        body = f"__d_{n}"
        plain = f"coalesce(replace({body}, '{{{{.{n}}}}}', __v_{n}), {body})"
        step = step.selectExpr("*", f"IF(instr({body}, '{{{{.{n}}}}}') > 0, {plain}, {body}) AS __r_{n}")
        body = f"__r_{n}"
    left = rf"IF(instr({body}, '{{{{') > 0, nullif(regexp_extract({body}, r'\{{\{{[^}}]*\}}\}}', 0), ''), NULL)"
    return step.selectExpr("*", f"{left} AS __left").selectExpr(
        *df.columns,
        f"IF(__left IS NULL, trim({body}), NULL) AS {into}",
        f"concat('cannot render ', __left) AS {error}",
    )


def last_wins(*maps: Column) -> Column:
    """One map; keys of later maps replace those of earlier ones."""
    merged = maps[0]
    for later in maps[1:]:
        merged = F.map_concat(_without_keys_of(merged, later), later)
    return merged


def _without_keys_of(config: Column, other: Column) -> Column:
    return F.map_filter(config, lambda k, v: ~F.array_contains(F.map_keys(other), k))


def prefixed(config: Column, prefix: str) -> Column:
    return F.transform_keys(config, lambda k, v: F.concat(F.lit(prefix), k))


def plain_part(config: Column) -> Column:
    return F.map_filter(config, lambda k, v: ~F.contains(v, F.lit(SECRET_MARK)))


def secret_part(config: Column) -> Column:
    return F.map_filter(config, lambda k, v: F.contains(v, F.lit(SECRET_MARK)))
