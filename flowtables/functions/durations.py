"""Duration texts such as ``1M24h`` in whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame

HOUR = 3_600_000_000
DAY = 24 * HOUR
MONTH_V1 = 30 * DAY

_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
_MONTH = r"([-+]?)([0-9]+)M"

# Microseconds per unit.
_UNIT = {"ns": "0.001", "us": "1", "µs": "1", "μs": "1", "ms": "1000", "s": "1000000", "m": "60000000", "h": str(HOUR)}


# Fixed value: the longest duration, 64-bit nanoseconds, in microseconds.
MOST_MICROS = 9223372036854775


def clock_micros(c: str) -> str:
    """SQL for the microseconds of a text such as ``-1h30m`` in column ``c``; NULL when it is no duration or beyond 64-bit nanoseconds."""
    unit = " ".join(f"WHEN '{u}' THEN {v}" for u, v in _UNIT.items())
    amount = f"(__n, __u) -> try_cast(__n AS DECIMAL(22, 6)) * CAST(CASE __u {unit} END AS DECIMAL(14, 3))"
    parts = f"zip_with(regexp_extract_all({c}, r'{_PART}', 1), regexp_extract_all({c}, r'{_PART}', 2), {amount})"
    total = f"aggregate({parts}, CAST(0 AS DECIMAL(38, 9)), (__a, __x) -> try_cast(__a + __x AS DECIMAL(38, 9)), __a -> IF(__a <= {MOST_MICROS}, CAST(__a AS BIGINT), NULL))"
    return (
        f"IF(startswith({c}, '-'), -1, 1) * "
        f"CASE WHEN {c} IN ('0', '+0', '-0') THEN 0L WHEN {c} RLIKE r'^[-+]?({_PART})+$' THEN {total} END"
    )


def parse_v2(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds ``<name>_months`` and ``<name>_micros`` for each SQL text; both NULL when it is not valid.

    Version 2: the text before the first ``M`` is a month count; its minus sign also governs the rest.
    Worked out in steps so that each text is parsed once.
    """
    keep = df.columns
    step = df.selectExpr(*keep, *[f"{sql} AS __x_{n}" for n, sql in texts.items()])
    step = step.selectExpr(
        "*",
        *[
            f"CASE WHEN instr(__x_{n}, 'M') = 0 THEN 0 WHEN __x_{n} RLIKE r'^[-+]?\\d+M' THEN try_cast(substring_index(__x_{n}, 'M', 1) AS INT) END AS __m_{n}"
            for n in texts
        ],
    )
    rest = "regexp_replace({x}, '^[^M]*M', '')"
    clock = (
        "CASE WHEN instr({x}, 'M') = 0 THEN {x} WHEN endswith({x}, 'M') AND instr({x}, 'M') = length({x}) THEN '0' "
        "WHEN {m} < 0 THEN concat('-', {rest}) ELSE {rest} END"
    )
    step = step.selectExpr(
        "*", *[clock.format(x=f"__x_{n}", m=f"__m_{n}", rest=rest.format(x=f"__x_{n}")) + f" AS __c_{n}" for n in texts]
    )
    step = step.selectExpr("*", *[f"{clock_micros(f'__c_{n}')} AS __u_{n}" for n in texts])
    both = [f"IF(__u_{n} IS NULL, NULL, __m_{n}) AS {n}_months" for n in texts]
    both += [f"IF(__m_{n} IS NULL, NULL, __u_{n}) AS {n}_micros" for n in texts]
    return step.selectExpr(*keep, *both)


def parse_v1(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds the microseconds of version 1 durations.

    The first ``NM`` counts N x 30 days with its own sign; the remainder is added as it is.
    """
    keep = df.columns
    step = df.selectExpr(*keep, *[f"{sql} AS __x_{n}" for n, sql in texts.items()])
    step = step.selectExpr("*", *[f"trim(regexp_replace(__x_{n}, r'{_MONTH}', '')) AS __r_{n}" for n in texts])
    step = step.selectExpr("*", *[f"{clock_micros(f'__r_{n}')} AS __u_{n}" for n in texts])
    value = (
        "CASE WHEN NOT {x} RLIKE '[0-9]M' THEN {u} ELSE IF(regexp_extract({x}, r'{month}', 1) = '-', -1, 1)"
        " * try_cast(regexp_extract({x}, r'{month}', 2) AS BIGINT) * {size}L + IF({r} = '', 0L, {u}) END AS {n}"
    )
    return step.selectExpr(
        *keep, *[value.format(x=f"__x_{n}", r=f"__r_{n}", u=f"__u_{n}", n=n, month=_MONTH, size=MONTH_V1) for n in texts]
    )
