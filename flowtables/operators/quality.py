"""Profile of a loaded window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def profile(df: DataFrame, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """Per column (and group, NULL being one): rows, NULLs, distinct values, minimum, maximum, completeness.

    Values are counted per (column, value) before they are counted per column, so a value that most
    rows share costs no more than a rare one and the exact distinct counts need no wide expansion.
    """
    group_key = F.col(group) if group else F.lit("all")
    base = df.select(group_key.alias("group_value"), *columns)
    per_column = [f"'{c}', CAST(`{c}` AS STRING)" for c in columns]
    values = base.selectExpr("group_value", f"stack({len(columns)}, {', '.join(per_column)}) AS (column_name, v)")
    counts = (
        values.groupBy("group_value", "column_name", "v").agg(F.count("*").alias("n"))
        .groupBy("group_value", "column_name")
        .agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.count("v").alias("n_distinct"))
    )
    limits = base.groupBy("group_value").agg(*[f(c).alias(f"__{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    limits = limits.selectExpr(
        "group_value",
        f"stack({len(columns)}, {', '.join(f"'{c}', CAST(`__min_{c}` AS STRING), CAST(`__max_{c}` AS STRING)" for c in columns)}) AS (column_name, min_value, max_value)",
    )
    completeness = F.round((F.col("n_rows") - F.col("n_nulls")) / F.col("n_rows"), 6)
    limits = limits.withColumnsRenamed({"group_value": "__group", "column_name": "__column"})
    same = F.col("group_value").eqNullSafe(F.col("__group")) & (F.col("column_name") == F.col("__column"))
    return counts.join(limits, same).drop("__group", "__column").withColumn("completeness", completeness)


# --- profiles kept per window ---------------------------------------------------------

# 2^14 registers: about 12 KB and a standard error under 1% per sketch at most; up to some 1,500 values are counted exactly.
SKETCH_BITS = 14
_PARTS = {"n": F.sum, "min": F.min, "max": F.max}


def partials(df: DataFrame, columns: Sequence[str], group: str | None = None, window: Column | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per window (window_key) and group: the rows, and per column its values, limits and a sketch of distinct values.

    ``window`` is the window's name or start (one window without it); NULL is a group. The sizes of the rows do not depend on the data,
    and everything in them can be merged, so a window is read once, when it is loaded. Rows are combined before the shuffle.
    """
    kept = df.select((F.lit("all") if window is None else window).alias("window_key"), (F.col(group) if group else F.lit("all")).alias("group_value"), *columns)
    per_column = [
        a
        for c in columns
        for a in (F.count(c).alias(f"{c}__n"), F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"), F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(f"{c}__distinct"))
    ]
    return kept.groupBy("window_key", "group_value").agg(F.count("*").alias("n_rows"), *per_column)


def merge_partials(parts: DataFrame, per_window: bool = False) -> DataFrame:
    """Partials as one per group, over all windows or for each of them. A window that was loaded again replaces its partials first."""
    merged = [F.sum("n_rows").alias("n_rows")]
    for c in parts.columns[3:]:
        kind = c.rsplit("__", 1)[1]
        merged.append((_PARTS[kind](c) if kind in _PARTS else F.hll_union_agg(c)).alias(c))
    keys = ["window_key", "group_value"] if per_window else ["group_value"]
    return parts.groupBy(*keys).agg(*merged)


def distinct_values(df: DataFrame, columns: Sequence[str], group: str | None = None, window: Column | None = None) -> DataFrame:
    """The distinct values of every window and group in long form: what exact distinct counts over several windows need.

    They are kept and replaced per window like partials. NULL stands for itself, so every column of a group has a row.
    """
    kept = df.select((F.lit("all") if window is None else window).alias("window_key"), (F.col(group) if group else F.lit("all")).alias("group_value"), *columns)
    # Zero and minus zero are one value.
    text = lambda c: f"CAST(`{c}` + 0{'D' if isinstance(df.schema[c].dataType, T.DoubleType) else 'F'} AS STRING)" if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else f"CAST(`{c}` AS STRING)"
    per_column = ", ".join(f"'{c}', {text(c)}" for c in columns)
    return kept.selectExpr("window_key", "group_value", f"stack({len(columns)}, {per_column}) AS (column_name, v)").distinct()


def replace_window(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored partials, or distinct values, with those of the windows in ``fresh`` exchanged."""
    return stored.join(fresh.select("window_key").distinct(), "window_key", "left_anti").select(*fresh.columns).unionByName(fresh)


def report(parts: DataFrame, mode: str = "complete", values: DataFrame | None = None) -> DataFrame:
    """The profile from partials: of all windows together (complete) or of each window (incremental).

    One row per column (and group, and window): rows, NULLs, distinct values, minimum, maximum, completeness. Distinct values
    are counted exactly for the columns in ``values`` (see ``distinct_values``) and estimated for the others.
    """
    if mode not in ("complete", "incremental"):
        raise ValueError(f"not a profile mode: {mode!r}")
    merged = merge_partials(parts, per_window=mode == "incremental")
    keys = ["window_key", "group_value"] if mode == "incremental" else ["group_value"]
    columns = [c.removesuffix("__n") for c in parts.columns if c.endswith("__n")]
    cells = ", ".join(
        f"'{c}', n_rows - `{c}__n`, hll_sketch_estimate(`{c}__distinct`), CAST(`{c}__min` AS STRING), CAST(`{c}__max` AS STRING), round(`{c}__n` / n_rows, 6)" for c in columns
    )
    rows = merged.selectExpr(*keys, "n_rows", f"stack({len(columns)}, {cells}) AS (column_name, n_nulls, n_distinct, min_value, max_value, completeness)")
    if values is None:
        return rows
    exact = values.select(*keys, "column_name", "v").distinct().groupBy(*keys, "column_name").agg(F.count("v").alias("__exact"))
    exact = exact.withColumnsRenamed({k: f"__{k}" for k in (*keys, "column_name")})
    same = F.col("column_name") == F.col("__column_name")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(exact, same, "left").withColumn("n_distinct", F.coalesce("__exact", "n_distinct")).select(*rows.columns)
