"""Exact percentiles without gathering a group in one task.

Spark's ``percentile`` keeps all distinct values of a group in one buffer.  Here
a bounded sketch brackets the wanted rank, the rows below the bracket are only
counted, and just the rows inside it - a few in a thousand - are ordered.  The
sketch decides how much work is left, never the answer: a rank outside its
bracket raises an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wattgrid.session import checkpointed

GRID = 500
ACCURACY = 10_000
MARGIN = 2
# A bracket with more rows than this is narrowed once more before its rows are ordered.
BRACKET_ROWS = 1_000_000


def _wanted(n, p):
    """Zero-based neighbouring ranks of percentile ``p`` in ``n`` sorted values."""
    rank = p * (n - 1)
    return F.floor(rank), F.ceil(rank), rank - F.floor(rank)


def _sketch(value: Column) -> Column:
    """Approximate values at GRID + 1 evenly spaced ranks, in bounded memory."""
    # One text constant: five hundred separate literals would slow down planning.
    ranks = F.split(F.lit(" ".join(str(i / GRID) for i in range(GRID + 1))), " ").cast("array<double>")
    return F.call_function("percentile_approx", value, ranks, F.lit(ACCURACY))


def exact_percentiles(
    df: DataFrame,
    value: str,
    names: dict[str, float],
    keys: Sequence[str] = (),
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """One row per key with a column per ``names`` entry (name -> fraction).

    Linear interpolation between neighbouring ranks; nulls and NaN are left out.
    Every input goes the same way: brackets are narrowed until the rows counted in
    the largest are few enough to order.
    """
    keys = list(keys)
    group = keys or ["_all"]
    base = df.select(
        *[F.col(k) for k in keys],
        *([] if keys else [F.lit(0).alias("_all")]),
        F.col(value).cast("double").alias("_v"),
    ).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    fractions = F.array(*[F.lit(float(p)) for p in names.values()])

    first = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), _sketch(F.col("_v")).alias("_grid")
    )
    state = first.select(*group, "_n", "_grid", F.posexplode(fractions).alias("_i", "_p"))
    state = state.withColumns({"_below": F.lit(0), "_m": F.col("_n")})
    state = checkpointed(_narrow(state, group))
    before = None
    while True:
        widest = state.agg(F.max("_inside")).first()[0] or 0
        if widest <= bracket_rows or widest == before:
            break
        before = widest
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        again = (
            _attach(base, state, group, ["_lo", "_hi", "_n", "_p"])
            .groupBy(*group, "_i", "_n", "_p")
            .agg(
                F.count_if(F.col("_v") < F.col("_lo")).alias("_below"),
                F.count_if(inside).alias("_m"),
                _sketch(F.when(inside, F.col("_v"))).alias("_grid"),
            )
        )
        state = checkpointed(_narrow(again, group))

    # Everything below the bracket collapses to one null-valued group per map task.
    kept = (
        _attach(base, state, group, ["_lo", "_hi", "_n", "_p"])
        .filter(F.col("_v") <= F.col("_hi"))
        .withColumn("_w", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
        .groupBy(*group, "_i", "_n", "_p", "_w")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*group, "_i").orderBy(F.col("_w").asc_nulls_first())
    ranked = kept.withColumn("_cum", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low, high, share = _wanted(F.col("_n"), F.col("_p"))
    found = ranked.groupBy(*group, "_i", "_n", "_p").agg(
        F.max(F.when(F.col("_w").isNull(), F.col("_cum"))).alias("_under"),
        F.max("_cum").alias("_upto"),
        F.min(F.when(F.col("_cum") > low, F.col("_w"))).alias("_a"),
        F.min(F.when(F.col("_cum") > high, F.col("_w"))).alias("_b"),
    )
    sound = (F.coalesce(F.col("_under"), F.lit(0)) <= low) & (F.col("_upto") > high)
    answer = found.withColumn(
        "_x",
        F.when(sound, F.col("_a") + (F.col("_b") - F.col("_a")) * share).otherwise(
            F.raise_error(F.lit("percentile rank fell outside its bracket")).cast("double")
        ),
    )
    wide = answer.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)]
    )
    return wide


def _narrow(state: DataFrame, group: Sequence[str]) -> DataFrame:
    low, high, _ = _wanted(F.col("_n"), F.col("_p"))
    cell = lambda rank: (rank - F.col("_below")) * GRID / F.col("_m")
    left = F.greatest(F.floor(cell(low)).cast("int") - MARGIN, F.lit(0))
    right = F.least(F.ceil(cell(high + 1)).cast("int") + MARGIN, F.lit(GRID))
    return state.select(
        *group, "_i", "_n", "_p",
        F.get("_grid", left).alias("_lo"), F.get("_grid", right).alias("_hi"),
        F.ceil((right - left) * F.col("_m") / GRID).alias("_inside"),
    )


def _attach(base: DataFrame, state: DataFrame, group: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Pair each row with the brackets of its group, one output row per percentile."""
    if list(group) == ["_all"]:
        brackets = state.agg(F.collect_list(F.struct("_i", *fields)).alias("b")).scalar()
        return base.select("_all", "_v", F.explode(brackets).alias("_s")).select("_all", "_v", "_s.*")
    renamed = state.select(*[F.col(k).alias(f"_k_{k}") for k in group], "_i", *fields)
    on = None
    for k in group:
        same = base[k].eqNullSafe(renamed[f"_k_{k}"])
        on = same if on is None else on & same
    return base.join(renamed, on).drop(*[f"_k_{k}" for k in group])


def percentiles_by_column(df: DataFrame, columns: Sequence[str], names: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles of several columns, by group: one row per key and ``column``.

    The columns become (column, value) rows, so that all share the same few passes.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(*keys, F.inline(F.array(*cells)))
    return exact_percentiles(long, "value", names, [*keys, "column"])


def column_percentiles(df: DataFrame, columns: Sequence[str], names: dict[str, float]) -> dict[str, Row]:
    """Exact percentiles of several columns in one go, as one small row per column."""
    found = {r["column"]: r for r in percentiles_by_column(df, columns, names).collect()}
    return {c: Row(*names)(*[found[c][n] if c in found else None for n in names]) for c in columns}
