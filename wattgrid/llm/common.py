"""What the training-data operators share: white space, column names, the hot-key helpers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that a result replaces, whatever their letter case."""
    replaced = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in replaced])


def packed(df: DataFrame, **columns: str) -> DataFrame:
    """Whole rows as one column ``row`` beside the named ones, so that no name can clash; ``row.*`` unpacks them."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[quoted(c).alias(name) for name, c in columns.items()])


def text_batches(df: DataFrame, rows: int = 2000) -> None:
    """Give Python fewer texts at a time than Spark's default of 10,000 rows, which suits short values.

    A session that has set a number of its own keeps it.
    """
    key, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(key) == usual:
        df.sparkSession.conf.set(key, rows)


def give_back() -> None:
    """Hand freed memory to the system: a Python worker lives on between tasks and would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, WHITE, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
