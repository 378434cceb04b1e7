"""Mixing sources to target weights by hash thresholds.

Every document has a hash. Words are summed by source and hash bucket; the running sum over the
buckets shows in which one the budget of the source ends, and only the rows of that bucket are
summed again, by finer buckets, until single hash values remain. The rows below the threshold are
taken: a filter, no sort of rows. A larger budget takes a superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.llm.common import fresh, packed, quoted, text_of, without, word_count
from wattgrid.session import checkpointed

#: Hash bits decided by one histogram, histograms to a threshold, thresholds to a budget.
LEVEL_BITS = 12
LEVELS = 3
PASSES = 3
MOST_COPIES = 3
SPACE = 1 << (LEVEL_BITS * LEVELS)
RESULTS = ("size", "source_size", "target", "copies", "taken")


def hash_place(doc_id: Column, seed: int) -> Column:
    """A number below ``SPACE`` that depends on the id and the seed alone."""
    digits = LEVEL_BITS * LEVELS // 4
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes
    by weight; none passes ``MOST_COPIES`` times its source, the excess is shared anew by weight.
    Sources ordered by limit over weight reach their limits one after another, so one pass over
    their running sums finds the level at which the rest share. One row per source is all that the
    two windows see.
    """
    totals = checkpointed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    named = totals.withColumn("weight", F.element_at(table, (place % len(weights) + 1).cast("int")))
    limit = F.lit(MOST_COPIES) * F.col("source_size")
    filling = Window.orderBy(F.col("source_size") * MOST_COPIES / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    every = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    shared = named.withColumns({"level": level, "full": limit < level * F.col("weight")})
    first_open = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every)
    return shared.select("source", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(
        first_open * F.col("weight")).alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` (source, budget, ...) with ``place``: the hash below which rows fit, and ``got``, their sum."""
    found = budgets.withColumns({"place": F.lit(0).cast("long"), "got": F.lit(0).cast("long"), "all": F.lit(False)})
    keep = budgets.columns
    for level in range(LEVELS):
        width = 1 << (LEVEL_BITS * (LEVELS - 1 - level))
        inside = rows.join(found.where("not `all`").select(F.col("source").alias("s"), "place"), F.col("s").eqNullSafe(F.col("source")))
        inside = inside.where((F.col("hash") >= F.col("place")) & (F.col("hash") < F.col("place") + width * (1 << LEVEL_BITS)))
        sums = inside.groupBy("source", F.floor(F.col("hash") / width).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        joined = running.join(found.select(F.col("source").alias("s"), "budget", "got"), F.col("s").eqNullSafe(F.col("source")))
        over = F.col("got") + F.col("upto") > F.col("budget")
        ends = joined.groupBy("source").agg(
            F.min(F.when(over, F.col("bucket"))).alias("bucket"),
            F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("more")).withColumnRenamed("source", "s")
        found = checkpointed(found.join(ends, F.col("s").eqNullSafe(F.col("source")), "left").select(
            *keep,
            F.when(F.col("all") | F.col("bucket").isNull(), F.lit(SPACE)).otherwise(F.col("bucket") * width).alias("place"),
            (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"),
            (F.col("all") | F.col("bucket").isNull()).alias("all")))
    return found.drop("all")


def mix_plan(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """One row per source of ``sizes`` (source, size, hash): its target and what to take.

    Every document is taken ``base`` times, and once more if its hash is below ``place0``, or below
    ``place1`` with at most ``room1`` words, and so on: each further threshold fills the room that
    the document at the last one left, with documents that fit.
    """
    plan = source_targets(sizes, weights).withColumn("base", F.when(F.col("source_size") > 0, F.least(
        F.lit(MOST_COPIES), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    plan = checkpointed(plan.withColumns({"room0": F.lit((1 << 62)).cast("long"), "budget": F.floor(F.col("target") - F.col("base") * F.col("source_size"))}))
    rows = sizes.where("size > 0")
    for k in range(PASSES):
        if k:
            last = plan.select(F.col("source").alias("s"), F.col(f"place{k - 1}").alias("from"), F.col(f"room{k}").alias("room"))
            open_rows = rows.join(last, F.col("s").eqNullSafe(F.col("source"))).where("hash >= `from` and size <= room").select("source", "size", "hash")
        else:
            open_rows = rows
        plan = _threshold(open_rows, plan).withColumnRenamed("place", f"place{k}")
        plan = plan.withColumns({"budget": F.col("budget") - F.col("got"), f"room{k + 1}": F.col("budget") - F.col("got")}).drop("got")
        plan = checkpointed(plan)
    return plan.drop("budget")


def sized(docs: DataFrame, seed: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` (words; null text: 0) and ``hash``."""
    return without(docs, "size", "hash").withColumns({"size": word_count(text_of(text)), "hash": hash_place(quoted(doc_id), seed)})


def apply_plan(rows: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """``rows`` (with size and hash) with source_size, target, copies and taken."""
    rows = without(rows, "source_size", "target", "copies", "taken")
    (key,) = fresh(rows, "plan_source")
    plan = plan.withColumnRenamed("source", key)
    names = dict(zip(plan.columns, fresh(rows, *plan.columns)))
    plan = plan.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    at = {a: F.col(b) for a, b in names.items()}
    extra = F.lit(False)
    for k in range(PASSES):
        extra = extra | ((F.col("hash") < at[f"place{k}"]) & (F.col("size") <= at[f"room{k}"]))
    copies = (at["base"] + F.when(extra & (at["base"] < MOST_COPIES), 1).otherwise(0)).cast("long")
    joined = rows.join(plan, at[key].eqNullSafe(quoted(source)), "left")
    return joined.select(*[quoted(c) for c in rows.columns], at["source_size"].alias("source_size"), at["target"].alias("target"),
                         copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), seed: int = 1, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: ``docs`` with each taken row as often as it is taken.

    A null source is a source of its own, the last. Documents without words weigh nothing and come
    once per whole copy of their source. Repeated ids share a hash and are taken together. Columns
    of any name are kept. Reruns take the same rows.
    """
    rows = sized(packed(docs, text=text, doc_id=doc_id, source=source), seed)
    slim = checkpointed(rows.select("source", "size", "hash"))
    taken = apply_plan(rows, mix_plan(slim, list(weights)))
    return taken.where("copies > 0").withColumn("number", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
