"""Ordered-series work that stays parallel inside one hot series.

A plain window over ``partitionBy(node)`` puts a whole node into one task.  Here
each series is cut along time into chunks of about ``rows_per_chunk`` rows:

1. count rows per (series, time slice) - a map-side combined aggregate, written as a small table - and
   once more by finer parts in the slices that hold more rows than a chunk should;
2. a prefix sum over those slice counts gives every slice its chunk number, and
   gives every chunk whatever it must know of the earlier ones (a *carry*);
3. rows join the slice table and are shuffled once, by (series, chunk).

Functions that look back ``k`` rows, or a span of time, get the rows before their chunk
as extra *halo* rows, which are removed after the window.  The slice table has
one row per series and slice, so it grows with the time span, not the row count; a crowded
slice adds at most ``PARTS`` rows for more than a chunk of rows. Rows of one instant stay together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattgrid.session import checkpointed

ROWS_PER_CHUNK = 20_000
# A slice of one series is an hour, so that the slice table is a small part of the rows; a slice of
# all rows together is a minute.
GRAIN_SECONDS = 3600
GRAIN_SECONDS_OF_ALL = 60

# Parts of a slice with more rows than a chunk: seconds of an hour.
PARTS = 3600

# Bits of ``monotonically_increasing_id`` that number the rows of one partition.
ROW_BITS = 33

CHUNK, HALO, SLICE, PART = "_chunk", "_halo", "_slice", "_part_of_slice"


@dataclass(frozen=True)
class Carry:
    """State handed from earlier chunks: ``partial`` per slice, ``combine`` over slices."""

    name: str
    partial: Column
    combine: Callable[[Column], Column] = F.sum
    backward: bool = False


def epoch_us(column: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1_000_000.0)


def _place(df: DataFrame, order: str, grain: float) -> tuple[Column, float]:
    """The order as a number, and the width of a slice in its unit."""
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)):
        return epoch_us(order), int(grain * 1_000_000)
    return F.col(order), grain


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_k_{c}"]) for c in columns))


def _slices(df: DataFrame, keys: Sequence[str], at: Column, width: float, sums: Sequence[Column], rows_per_chunk: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with the slice and part of each row, and the table of what each holds."""
    rows = df.withColumn(SLICE, F.floor(at / F.lit(width)))
    table = checkpointed(rows.groupBy(*keys, SLICE).agg(*sums))
    whole = F.lit(0).cast("bigint")
    crowded = F.col("_n") > F.lit(int(rows_per_chunk))
    if table.filter(crowded).isEmpty():
        return rows.withColumn(PART, whole), table.withColumn(PART, whole)
    split = table.filter(crowded).select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, SLICE)], F.lit(True).alias("_split"))
    part = F.floor((at - F.col(SLICE) * F.lit(width)) / F.lit(width) * PARTS).cast("bigint")
    part = F.greatest(F.lit(0), F.least(part, F.lit(PARTS - 1)))
    rows = rows.join(split, _same(rows, split, [*keys, SLICE]), "left").drop(*split.columns[:-1])
    rows = rows.withColumn(PART, F.coalesce(F.when(F.col("_split"), part), whole))
    fine = rows.filter("_split").groupBy(*keys, SLICE, PART).agg(*sums)
    table = checkpointed(table.filter(~crowded).withColumn(PART, whole).unionByName(fine))
    return rows.drop("_split"), table


def chunked(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    lookback_rows: int = 0,
    lookback: float = 0,
    carries: Sequence[Carry] = (),
    rows_per_chunk: int = ROWS_PER_CHUNK,
    grain: float | None = None,
) -> DataFrame:
    """Add ``_chunk``, ``_halo`` and one ``_carry_<name>`` column per carry.

    Halo rows are the ``lookback_rows`` rows before a chunk, or all rows up to ``lookback`` before it
    (seconds for times, else units of the order; whole slices, so some reach further back).
    """
    grain = grain or (GRAIN_SECONDS if keys else GRAIN_SECONDS_OF_ALL)
    if bool(lookback_rows) + bool(lookback) + bool(carries) > 1:
        raise ValueError("a carry counts each row once, so it cannot be used with halo rows, which go back by rows or by a span")
    at, width = _place(df, order, grain)
    sums = [F.count(F.lit(1)).alias("_n"), *[c.partial.alias(f"_p_{c.name}") for c in carries]]
    sliced, table = _slices(df, keys, at, width, sums, rows_per_chunk)
    series = Window.partitionBy(*keys)
    earlier = series.orderBy(SLICE, PART).rowsBetween(Window.unboundedPreceding, -1)
    # Later slices are the earlier ones of the reversed order: a growing frame, where one up to the end starts anew for each row.
    later = series.orderBy(F.desc(SLICE), F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    size = F.lit(int(rows_per_chunk))
    table = table.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    for c in carries:
        frame = later if c.backward else earlier
        table = table.withColumn(f"_q_{c.name}", c.combine(F.col(f"_p_{c.name}")).over(frame))
    table = table.withColumn(CHUNK, F.floor(F.col("_before") / size))
    within = Window.partitionBy(*keys, CHUNK)
    whole = within.orderBy(SLICE, PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in carries:
        pick = F.last if c.backward else F.first
        table = table.withColumn(f"_carry_{c.name}", pick(f"_q_{c.name}").over(whole))
    if lookback_rows or lookback:
        if lookback:
            last_chunk = F.max(CHUNK).over(series.orderBy(SLICE).rangeBetween(0, math.ceil(lookback / grain)))
        else:
            last_chunk = F.floor((F.col("_before") + F.col("_n") + F.lit(lookback_rows - 1)) / size)
        table = table.withColumn("_last", last_chunk)
        table = (
            table.withColumn("_own", F.col(CHUNK))
            .withColumn(CHUNK, F.explode(F.sequence("_own", F.greatest("_last", "_own"))))
            .withColumn(HALO, F.col(CHUNK) != F.col("_own"))
        )
    else:
        table = table.withColumn(HALO, F.lit(False))
    joined_on = [*keys, SLICE, PART]
    table = table.select(
        *[F.col(k).alias(f"_k_{k}") for k in joined_on],
        CHUNK,
        HALO,
        *[f"_carry_{c.name}" for c in carries],
    )
    joined = sliced.join(table, _same(sliced, table, joined_on), "inner")
    return joined.drop(SLICE, PART, *[f"_k_{k}" for k in joined_on])


def chunk_window(keys: Sequence[str], order: str, ties: Sequence[str] = ()) -> WindowSpec:
    """The window to use on a ``chunked`` frame."""
    return Window.partitionBy(*keys, CHUNK).orderBy(order, *ties)


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    lookback_rows: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    **chunking,
) -> DataFrame:
    """Add window columns that look at most ``lookback_rows`` rows back.

    ``build`` receives the ordered window and returns the columns to add.
    """
    cut = chunked(df, keys, order, lookback_rows=lookback_rows, **chunking)
    added = cut.withColumns(build(chunk_window(keys, order, ties)))
    return added.filter(~F.col(HALO)).drop(CHUNK, HALO)


def with_previous(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    **chunking,
) -> DataFrame:
    """Add the previous row's value of each column: ``{new name: column}``."""
    return over_rows(
        df, keys, order, ties, 1,
        lambda w: {new: F.lag(old).over(w) for new, old in columns.items()},
        **chunking,
    )


def running_sum(
    df: DataFrame,
    value: str,
    name: str,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    **chunking,
) -> DataFrame:
    """Sum of ``value`` over the series up to and including each row."""
    cut = chunked(df, keys, order, carries=[Carry("sum", F.sum(value))], **chunking)
    rows = chunk_window(keys, order, ties).rowsBetween(Window.unboundedPreceding, 0)
    before, here = F.col("_carry_sum"), F.sum(value).over(rows)
    total = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return cut.withColumn(name, F.when(before.isNotNull() | here.isNotNull(), total)).drop(CHUNK, HALO, "_carry_sum")


def fill_gaps(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    backward: bool = True,
    **chunking,
) -> DataFrame:
    """Forward fill, then backward fill, the nulls of ``columns`` within a series."""
    at = F.struct(order, *ties)
    carries = [Carry(f"f{i}", F.max_by(c, F.when(F.col(c).isNotNull(), at)),
                     lambda x: F.last(x, ignorenulls=True)) for i, c in enumerate(columns)]
    if backward:
        carries += [Carry(f"b{i}", F.min_by(c, F.when(F.col(c).isNotNull(), at)),
                          lambda x: F.last(x, ignorenulls=True), backward=True)
                    for i, c in enumerate(columns)]
    cut = chunked(df, keys, order, carries=carries, **chunking)
    window = chunk_window(keys, order, ties)
    seen = window.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in (order, *ties)]).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for i, c in enumerate(columns):
        choices = [F.last(c, ignorenulls=True).over(seen), F.col(f"_carry_f{i}")]
        if backward:
            choices += [F.last(c, ignorenulls=True).over(ahead), F.col(f"_carry_b{i}")]
        filled[c] = F.coalesce(*choices)
    return cut.withColumns(filled).drop(CHUNK, HALO, *[f"_carry_{c.name}" for c in carries])


def position_in_order(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "position",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Number all rows 1..n in a global order; optionally add running sums.

    Rows are range partitioned by the order, so no task holds more than its
    share.  The range partitioned rows are checkpointed because their partition
    number is read twice, and must be the same both times.  They are numbered as they
    are written, in order, so they are not shuffled again; only ``sums``, which maps a new
    column to the column whose running total it is, take a window.
    """
    sums = sums or {}
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_id", ROW_BITS), "_row": F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1}).drop("_id")
    totals = ranged.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    )
    # One row per partition: the only unpartitioned window, and of a fixed small size.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    rows = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ranged.join(F.broadcast(offsets), "_part").withColumns({
        name: F.col("_rows_before") + F.col("_row"),
        **{n: F.col(f"_before_{n}") + F.sum(c).over(rows) for n, c in sums.items()},
    })
    return numbered.drop("_part", "_row", "_rows_before", *[f"_before_{n}" for n in sums])
