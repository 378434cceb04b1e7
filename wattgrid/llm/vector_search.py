"""Exact top-k search by inner product over sparse integer vectors.

Rows and queries are dealt into blocks; each two blocks meet in a group of their own. There the
candidates' components become postings by dimension, and each query scatters its weights times the
postings, one dimension after another, into a dense array of scores. The k best of a block are found
by partition selection; the blocks' lists are merged by a limited window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.llm.common import quoted
from wattgrid.session import checkpointed

#: Rows of a block of candidates and of queries.
CANDIDATES = 8192
QUERIES = 1024
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
TOP = (1 << 63) - 1


def scaled(vector: Column, scale: int) -> Column:
    """Components times ``scale``, as doubles, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def postings(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dimensions that occur, where the postings of each begin, and the rows and components of all, by dimension."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = np.flatnonzero(values)
    order = there[np.argsort(dims[there], kind="stable")]
    names, begins = np.unique(dims[order], return_index=True)
    return names, np.r_[begins, len(order)], rows[order], values[order]


def score_type(a: np.ndarray, b: np.ndarray, terms: int):
    """The narrowest integers that hold every sum of ``terms`` products; Python's own beyond 64 bits."""
    most = [max((abs(int(x)) for x in (v.min(), v.max())), default=0) if len(v) else 0 for v in (a, b)]
    bound = most[0] * most[1] * max(terms, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best candidates (row, id, vector) of each query, all if fewer; equal scores by id, null last."""
    ids, own = candidates.column("id").combine_chunks(), candidates.column("row").to_numpy()
    by_id = np.lexsort((own, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    candidates = candidates.take(pa.array(by_id)).combine_chunks()
    ids, own = candidates.column("id").combine_chunks(), candidates.column("row").to_numpy()
    dims, begins, rows, values = postings(candidates.column("vector").combine_chunks())
    asked = queries.column("vector").combine_chunks()
    weights = asked.flatten().to_numpy(zero_copy_only=False)
    lengths = asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    kind = score_type(weights, values, int(min(lengths.max(initial=0), (dims.max(initial=-1) + 1))))
    values = values.astype(kind)
    whole = [begins[t + 1] - begins[t] == len(own) for t in range(len(dims))]
    lists = [(slice(None) if w else rows[begins[t]:begins[t + 1]], values[begins[t]:begins[t + 1]]) for t, w in enumerate(whole)]
    place = {int(d): t for t, d in enumerate(dims)}
    starts = np.cumsum(lengths) - lengths
    place_of = np.argsort(own, kind="stable")
    sorted_own = own[place_of]
    out_q, out_c, out_s = [], [], []
    for q, (row, start, length) in enumerate(zip(queries.column("row").to_numpy(), starts, lengths)):
        scores = np.zeros(len(own), kind)
        vector = weights[start:start + length]
        for d in np.flatnonzero(vector).tolist():
            t = place.get(d)
            if t is not None:
                where, parts = lists[t]
                scores[where] += parts * kind(vector[d]) if kind is not object else parts * int(vector[d])
        if kind is object:
            scores = np.array([min(max(x, -TOP - 1), TOP) for x in scores], np.int64)
        at = np.searchsorted(sorted_own, row)
        valid = np.arange(len(own))
        if at < len(own) and sorted_own[at] == row:
            valid = np.delete(valid, place_of[at])
        if not len(valid):
            continue
        held = scores[valid]
        if len(valid) > k:
            least = np.partition(held, len(held) - k)[len(held) - k]
            above, equal = np.flatnonzero(held > least), np.flatnonzero(held == least)
            chosen = np.r_[above, equal[:k - len(above)]]  # places are in the order of ids
        else:
            chosen = np.arange(len(valid))
        out_q.append(np.full(len(chosen), q))
        out_c.append(valid[chosen])
        out_s.append(held[chosen])
    q, c, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))
    q, c = pa.array(q.astype(np.int64)), pa.array(c.astype(np.int64))
    return pa.table({"query_row": queries.column("row").combine_chunks().take(q), "query_id": queries.column("id").combine_chunks().take(q),
                     "vec_id": ids.take(c), "score": pa.array(s.astype(np.int64))})


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The ``k`` highest inner products of each query row with every other row: query_id, rank, vec_id, score.

    Components are first scaled and rounded down. Queries are the rows where ``queries`` holds. Vectors null or with a
    null or non-finite component take no part; vectors of unlike length are compared as far as both reach, and an empty
    one scores 0. Ties go to the smaller id, a null id last, then to the row read first. A query's own row is left
    out, other rows of its id are not; repeated query rows each get their own list. Scores beyond a long are held at its ends.
    Other columns are not looked at. An empty table gives no rows.
    """
    rows = vectors.where(usable(quoted(vector))).select(quoted(vec_id).cast("bigint").alias("id"), scaled(quoted(vector), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    c_blocks, q_blocks = -(-size["n"] // CANDIDATES) or 1, -(-size["q"] // QUERIES) or 1
    dealt = F.xxhash64("row")
    slim = [F.col(c).alias(c) for c in ("id", "row", "vector")]  # columns of their own on either side
    left = rows.where("asks").select(*slim, F.pmod(dealt, F.lit(q_blocks)).alias("q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(c_blocks - 1).cast("bigint"))).alias("c"))
    right = rows.select(*slim, F.pmod(dealt, F.lit(c_blocks)).alias("c"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))).alias("q"))

    def meet(_key: tuple, asked: pa.Table, given: pa.Table) -> pa.Table:
        return best_of_block(asked, given, k)

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(meet, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
