"""Template functions on texts and times. Arguments and results are SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowtables.functions import durations

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"

# Reference-time layout tokens, longest first, and their date pattern letters.
LAYOUT = {
    "January": "MMMM", "Monday": "EEEE", "Z07:00": "XXX", "-07:00": "xxx", "-0700": "xx", "2006": "yyyy",
    "Jan": "MMM", "Mon": "EEE", "MST": "z", "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy",
    "15": "HH", "PM": "a", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s",
}


def pattern(layout: str) -> str:
    """Date pattern of a layout written with the reference time; other letters are quoted."""
    out, i = "", 0
    while i < len(layout):
        token = next((k for k in LAYOUT if layout.startswith(k, i)), None)
        if token:
            out, i = out + LAYOUT[token], i + len(token)
        else:
            out, i = out + (f"'{layout[i]}'" if layout[i].isalpha() else layout[i]), i + 1
    return out


def is_rfc3339(text: str) -> str:
    return f"({text} RLIKE r'{RFC3339}' AND try_to_timestamp(substring({text}, 1, 19), \"yyyy-MM-dd'T'HH:mm:ss\") IS NOT NULL)"


def date_of(text: str) -> str:
    """Calendar date as written in the text's own zone; NULL when it is no RFC 3339 time."""
    return f"IF({is_rfc3339(text)}, substring({text}, 1, 10), NULL)"


def trunc(n: int, text: str) -> str:
    """The first ``n`` characters; a negative ``n`` changes nothing."""
    return text if n < 0 else f"substring({text}, 1, {n})"


def to_date(layout: str, text: str) -> str:
    return f'try_to_timestamp({text}, "{pattern(layout)}")'


def date(layout: str, ts: str) -> str:
    return f'date_format({ts}, "{pattern(layout)}")'


def unix_epoch(ts: str) -> str:
    return f"CAST(unix_seconds(CAST({ts} AS TIMESTAMP)) AS STRING)"


def with_date_modified(df: DataFrame, duration: str, ts: str, into: str) -> DataFrame:
    """Adds ``ts`` moved by a clock duration; an unreadable duration changes nothing."""
    step = df.selectExpr("*", f"{duration} AS __d").selectExpr("*", f"{durations.clock_micros('__d')} AS __u")
    return step.selectExpr(*df.columns, f"timestamp_micros(unix_micros(CAST({ts} AS TIMESTAMP)) + coalesce(__u, 0)) AS {into}")
