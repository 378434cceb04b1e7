"""Jaccard self-join of word-shingle sets, size-aware: subsets for small sets, inverted lists for large.

Texts with the same set are one class. Two classes are similar if their sets share enough of their union.

Small sets (up to a boundary) enumerate all their subsets of each size c that a partner may
have to share with them; a common subset is a similar pair. Larger sets are found by
scanning the inverted lists of their shingles: a similar pair shares one of the first
``n - ceil(t n) + 1`` shingles of either set in one order of all shingles, frequent ones last.
The boundary minimizes the two costs over the sizes that occur.

Lists of up to ``SHORT_LIST`` classes give all their pairs. In a longer list (many near copies of
one text) each class first meets one pivot a round; what these links leave apart is compared in blocks, but never
within the list's largest component. There a parity sketch, a lower bound of the difference of two sets, passes over
almost all pairs that are not similar; the others are verified there on the whole sets, and a link that joins nothing new is left out, so
a block tells fewer links than it has classes, however many pairs are similar. Every pair that is linked is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.common import fresh, give_back, quoted, text_batches, text_of, word_count
from wattgrid.llm.components import components
from wattgrid.llm.shingles import WIDTH, Powers, mixed, shingle_sets
from wattgrid.session import checkpointed, discard

SHORT_LIST = 32
#: Rounds in which a long list's classes meet one pivot. The first finds most of what pivots can; each costs its own joins and components.
PIVOT_ROUNDS = 1
#: Classes of a long list that are compared at once with as many.
BLOCK = 2048
#: Shingles of a block's sets together, beyond which it is a smaller one.
BLOCK_ITEMS = 4_000_000
#: A shingle that so many classes put first is frequent; the order puts at most ``MOST_FREQUENT`` such last.
FREQUENT = 48
MOST_FREQUENT = 500_000
#: Largest boundary considered: beyond, subsets outnumber any list.
LARGEST_SMALL = 16
#: Texts worked on at once.
PART = 256
#: Ids sent to every executor at most; beyond, the join is left to a shuffle.
SENT_IDS = 4_000_000


def shared_least(a: int, b: int, percent: int) -> int:
    """Shingles that sets of ``a`` and ``b`` share at least if 100 x intersection >= percent x union."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(a: int, percent: int) -> range:
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Subset sizes that a small set of ``n`` enumerates."""
    return sorted({shared_least(n, b, percent) for b in partner_sizes(n, percent) if b <= boundary})


def best_boundary(sizes: dict[int, int], scanned: float, percent: int) -> int:
    """The boundary of least cost; ``scanned`` is what one entry of an inverted list costs against one subset."""
    def cost(x: int) -> float:
        least = -(-percent * (x + 1) // 100)
        small = sum(k * comb(n, c) for n, k in sizes.items() if n <= x for c in subset_sizes(n, x, percent))
        return small + scanned * sum(k * prefix_length(n, percent) for n, k in sizes.items() if n >= least)

    return min(range(LARGEST_SMALL + 1), key=cost)


def keys_of(s: np.ndarray, boundary: int, percent: int, last: np.ndarray) -> np.ndarray:
    """What a set is found by: hashes of its subsets, or its first shingles, or (about the boundary) both."""
    n, keys = len(s), []
    if n <= boundary:
        for c in subset_sizes(n, boundary, percent):
            keys.append(mixed(np.array([int(np.bitwise_xor.reduce(mixed(s[list(pick)] + np.uint64(c)))) for pick in combinations(range(n), c)], np.uint64)))
    if n >= -(-percent * (boundary + 1) // 100):
        late = np.zeros(n, bool)
        if len(last):
            at = np.minimum(np.searchsorted(last, s), len(last) - 1)
            late = last[at] == s
        p = prefix_length(n, percent)
        keys.append(np.concatenate([s[~late], s[late]])[:p] if late[:p].any() else s[:p])
    return np.concatenate(keys)


def sketch_of(s: np.ndarray) -> bytes:
    """Parity of the set in each of a power of two of buckets; two sketches differ in at most as many bits as the sets do."""
    bits = 256
    while bits < 2 * len(s):
        bits *= 2
    return np.packbits(np.bincount((mixed(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        return int(signed(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True))[0]), int(signed(mixed(s + np.uint64(0x0F0F0F0F0F0F0F0F)).sum(keepdims=True))[0])


def lists_of(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)))


def in_parts(texts: pa.Array, some) -> pa.Array:
    """``some`` of a few texts at a time, so that a batch is never held in several forms at once."""
    found = pa.concat_arrays([some(texts.slice(k, PART).to_pylist()) for k in range(0, max(1, len(texts)), PART)])
    give_back()
    return found


FEATURES = "struct<n:bigint,d1:bigint,d2:bigint,sketch:binary,keys:array<bigint>>"


def features(text: Column, boundary: int, percent: int, last: np.ndarray, words: int) -> Column:
    """Size, digest, sketch and keys of each text's set."""
    powers = Powers()

    def some(texts: list[str]) -> pa.Array:
        n, one, two, sketches, keys = [], [], [], [], []
        for s in shingle_sets(texts, powers, words):
            d = digest_of(s) if len(s) else (0, 0)
            n.append(len(s))
            one.append(d[0])
            two.append(d[1])
            sketches.append(sketch_of(s) if len(s) else b"")
            keys.append(keys_of(s, boundary, percent, last) if len(s) else s)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary()), lists_of(keys)], ["n", "d1", "d2", "sketch", "keys"])

    @F.arrow_udf(FEATURES)
    def of(texts: pa.Array) -> pa.Array:
        return in_parts(texts, some)

    return of(text)


def first_keys(text: Column, percent: int, words: int) -> Column:
    """The shingles that each text's set puts first in plain order."""
    powers = Powers()

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        return in_parts(texts, lambda some: lists_of([s[:prefix_length(len(s), percent)] if len(s) else s for s in shingle_sets(some, powers, words)]))

    return of(text)


SETS = "struct<d1:bigint,d2:bigint,items:array<bigint>>"


def whole_sets(text: Column, words: int) -> Column:
    powers = Powers()

    def some(texts: list[str]) -> pa.Array:
        sets = list(shingle_sets(texts, powers, words))
        digests = [digest_of(s) if len(s) else (0, 0) for s in sets]
        return pa.StructArray.from_arrays([pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), lists_of(sets)], ["d1", "d2", "items"])

    @F.arrow_udf(SETS)
    def of(texts: pa.Array) -> pa.Array:
        return in_parts(texts, some)

    return of(text)


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def may_be_similar(percent: int):
    """Whether two sets may be similar, by their sizes and sketches."""
    @F.arrow_udf("boolean")
    def passes(n: pa.Array, m: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y, s, t in zip(n.to_pylist(), m.to_pylist(), a.to_pylist(), b.to_pylist()):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            size = min(len(s), len(t))
            differ = int(np.bitwise_count(folded(s, size) ^ folded(t, size)).sum())
            out.append(x + y - 2 * shared_least(x, y, percent) >= differ)
        give_back()
        return pa.array(out, pa.bool_())

    return passes


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= percent * F.greatest(n, m)


# ---------------------------------------------------------------- the join


def _frequent(docs: DataFrame, text: str, percent: int, words: int) -> tuple[np.ndarray, int]:
    """Shingles for the end of the order, and the boundary. Both steer the work only, never a result."""
    found = docs.select(F.explode(first_keys(text_of(text), percent, words)).alias("key"))
    counts = checkpointed(found.groupBy("key").count().where("count > 1"))
    grades = counts.where(F.col("count") > FREQUENT).groupBy(F.floor(F.log2("count")).alias("g")).count().orderBy(F.desc("g")).collect()
    least, sent = 64, 0  # of the power of two from which on the shingles are few enough to be sent
    for r in grades:
        sent += r["count"]
        if sent > MOST_FREQUENT:
            break
        least = r["g"]
    many = counts.where((F.col("count") > FREQUENT) & (F.floor(F.log2("count")) >= least)).select("key").toArrow()
    last = np.sort(many.column("key").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) if len(many) else np.zeros(0, np.uint64)
    discard(docs.sparkSession)
    usual = counts.where(F.col("count") <= FREQUENT).agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
    short = docs.select(F.greatest(word_count(text_of(text)) - (words - 1), F.lit(1)).alias("n")).where(F.col("n") <= LARGEST_SMALL * 100 // percent + 2)
    sizes = {r["n"]: r["count"] for r in short.groupBy("n").count().collect()}
    return last, best_boundary(sizes, (usual[0] or 0) / (usual[1] or 1) + 1, percent)


def _sets_of(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame, words: int) -> DataFrame:
    """``node``, ``items`` of the classes ``wanted`` (node, d1, d2, id), from their texts."""
    ids = checkpointed(wanted.select("id").distinct())
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(quoted(doc_id).alias("id"), text_of(text).alias("text"))
    texts = texts.join(ids, texts["id"].eqNullSafe(ids["id"]), "left_semi")
    found = texts.select(whole_sets(F.col("text"), words).alias("s")).select("s.*")
    joined = found.join(wanted.select("node", "d1", "d2"), ["d1", "d2"])
    return checkpointed(joined.groupBy("node").agg(F.first("items").alias("items")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def shared_with(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many items the sorted set ``s`` shares with each of the others."""
    found = np.concatenate(others)
    place = np.minimum(np.searchsorted(s, found), len(s) - 1)
    return np.add.reduceat(s[place] == found, np.r_[0, np.cumsum([len(x) for x in others])[:-1]], dtype=np.int64)


def _links_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the long lists that tie their components as all of their links do.

    ``members``: key, node, n, sketch, component; ``sets``: node, items. A list's largest component, by number, needs no comparison within
    itself. So its members ("major") are dealt to blocks, once, the others ("minor") to chunks, and each block meets each chunk, as does
    each chunk each other one. A list that is one component but for a few classes costs a row for each member. A pair
    that meets in several lists comes from the least of them only, as each member brings the keys of its lists. Of a group's links
    those stay that tie two components which earlier ones have left apart: fewer than the group has members.
    """
    of_node = members.groupBy("node").agg(F.collect_list("key").alias("in_lists"))
    members = members.join(of_node, "node")
    parts = members.groupBy("key", "component").agg(F.count("*").alias("size"), F.sum("n").alias("items"))
    major = parts.groupBy("key").agg(F.max_by(F.struct("component", "size", "items"), F.struct("size", "component")).alias("p"), F.sum("size").alias("all"), F.sum("items").alias("all_items"))
    major = major.select("key", "all", "all_items", F.col("p.component").alias("major"), F.col("p.size").alias("most"), F.col("p.items").alias("most_items"))
    placed = members.join(major, "key").withColumn("is_major", F.col("component") == F.col("major"))
    cut = lambda rows, items: F.greatest(F.ceil(rows / BLOCK), F.ceil(items / BLOCK_ITEMS), F.lit(1)).cast("int")
    blocks = cut(F.col("most"), F.col("most_items"))
    chunks = cut(F.col("all") - F.col("most"), F.col("all_items") - F.col("most_items"))
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), blocks).otherwise(chunks)).cast("int")
    placed = placed.withColumn("own", own)
    # Groups are (block, chunk) with i below 0, and (chunk, chunk) with i not below j.
    with_blocks = F.transform(spread(blocks), lambda b: F.struct((-1 - b).alias("i"), F.col("own").alias("j")))
    with_chunks = F.transform(spread(chunks), lambda c: F.struct(F.greatest("own", c).alias("i"), F.least("own", c).alias("j")))
    of_major = F.transform(spread(chunks), lambda c: F.struct((-1 - F.col("own")).alias("i"), c.alias("j")))
    dealt = placed.select("key", "node", "n", "sketch", "component", "own", "is_major", "in_lists", F.inline(F.when(F.col("is_major"), of_major).otherwise(F.concat(with_blocks, with_chunks))))

    def candidates(group: pd.DataFrame, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each member of a group, by size, the later ones of other ``parts`` that it may be similar to."""
        n, own, major = (group[c].to_numpy() for c in ("n", "own", "is_major"))
        sketches = [np.frombuffer(x, np.uint64) for x in group["sketch"]]
        lists = [frozenset(x.tolist()) for x in group["in_lists"]]
        here = int(group["key"].iloc[0])
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        side = major if i < 0 else own  # only pairs of unlike sides, but for a chunk with itself
        at = 0
        while at < len(n):  # members of like size share a sketch size after folding
            size = len(sketches[at])
            until = at
            while until < len(n) and len(sketches[until]) == size:
                until += 1
            reach = int(np.searchsorted(n, 100 * n[until - 1] // percent, side="right"))
            grid = np.stack([folded(s, size) for s in sketches[at:reach]])
            for k in range(at, until):
                end = int(np.searchsorted(n, 100 * n[k] // percent, side="right"))
                rest = np.arange(k + 1, end)
                rest = rest[(parts[rest] != parts[k]) & ((i == j) | (side[rest] != side[k]))]
                if len(rest):
                    differ = np.bitwise_count(grid[rest - at] ^ grid[k - at]).sum(1)
                    need = -(-percent * (n[k] + n[rest]) // (100 + percent))
                    good = rest[n[k] + n[rest] - 2 * need >= differ]
                    yield k, np.array([r for r in good.tolist() if min(lists[k] & lists[r]) == here], np.int64)
            at = until

    def involved(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", kind="stable")
        seen = np.zeros(len(group), bool)
        for k, good in candidates(group, group["component"].to_numpy()):
            seen[good] = True
            seen[k] |= len(good) > 0
        return group[seen]

    def tied(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", kind="stable")
        nodes, n = group["node"].to_numpy(), group["n"].to_numpy()
        items = [np.sort(x) for x in group["items"]]
        parts = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        a, b = [], []
        for k, good in candidates(group, parts):
            if len(good):
                common = shared_with(items[k], [items[r] for r in good.tolist()])
                for r in good[100 * common >= percent * (n[k] + n[good] - common)].tolist():
                    if parts[r] != parts[k]:
                        parts[parts == parts[r]] = parts[k]
                        a.append(nodes[k])
                        b.append(nodes[r])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    # Whole sets go to the groups of the classes that have a candidate there only.
    left = checkpointed(dealt.groupBy("key", "i", "j").applyInPandas(involved, dealt.schema))
    return left.join(sets, "node").groupBy("key", "i", "j").applyInPandas(tied, "a bigint, b bigint")


def _grouped(docs: DataFrame, percent: int, words: int, text: str, doc_id: str) -> DataFrame:
    """``id``, ``mark`` (a hash of the text), ``n`` and ``component_id`` of every row."""
    text_batches(docs)
    rows = docs.select(quoted(doc_id).alias("id"), text_of(text).alias("text"))
    last, boundary = _frequent(rows, "text", percent, words)
    found = rows.select("id", F.xxhash64("text").alias("mark"), features(F.col("text"), boundary, percent, last, words).alias("f"))
    staged = checkpointed(found.select("id", "mark", "f.*", F.monotonically_increasing_id().alias("row")))
    classes = checkpointed(staged.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("id").alias("id")))
    nodes = staged.withColumnRenamed("row", "node").join(classes.select("node"), "node", "left_semi")
    entries = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = checkpointed(entries.join(sizes, "key"))
    sketches = checkpointed(nodes.select("node", "n", "sketch").join(lists.select("node").distinct(), "node", "left_semi"))
    slim = checkpointed(staged.select("id", "mark", "n", "d1", "d2"))
    discard(docs.sparkSession, staged)

    def likely(pairs: DataFrame) -> DataFrame:
        one = sketches.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
        two = sketches.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
        return checkpointed(pairs.join(one, "a").join(two, "b").where(may_be_similar(percent)(F.col("n1"), F.col("n2"), F.col("s1"), F.col("s2"))).select("a", "b"))

    def ordered(one: Column, two: Column) -> list[Column]:
        return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]

    short = lists.where(F.col("size") <= SHORT_LIST)
    met = short.alias("l").join(short.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & sizes_fit(F.col("l.n"), F.col("r.n"), percent))
    pairs = likely(met.select(*ordered(F.col("l.node"), F.col("r.node"))).distinct())
    long = checkpointed(lists.where(F.col("size") > SHORT_LIST).select("key", "node", "n", "size"))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(long.select("node")).distinct()
    sets = _sets_of(rows, "text", "id", classes.join(needed, "node", "left_semi"), words)
    discard(docs.sparkSession, lists)
    links = checkpointed(_verified(pairs, sets, percent))
    labels = checkpointed(components(links))

    def open_lists() -> DataFrame:
        """Members of the long lists that still hold more than one component."""
        apart = long.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        return apart.join(split, "key", "left_semi")

    degrees = checkpointed(long.groupBy("node").agg(F.count("*").alias("degree")))
    for _ in range(PIVOT_ROUNDS):
        # Each class stands in its longest open list, where most of its likes stand too. The pivot is, outside the largest component, the class
        # that is in most lists: it has the fewest shingles of its own, so it is nearest to what the others have in common.
        stands = open_lists().groupBy("node").agg(F.max(F.struct("size", "key", "n", "component")).alias("at")).select("node", "at.key", "at.n", "at.component")
        entered = checkpointed(stands.join(degrees, "node"))
        if entered.isEmpty():
            break
        largest = entered.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("major"))
        chosen = entered.join(largest, "key").groupBy("key").agg(F.min_by(F.struct("node", "n", "component"), F.struct(F.col("component") == F.col("major"), -F.col("degree"), F.xxhash64("node"))).alias("p"))
        met = entered.join(chosen, "key").where((F.col("component") != F.col("p.component")) & sizes_fit(F.col("n"), F.col("p.n"), percent))
        found = checkpointed(_verified(likely(met.select(*ordered(F.col("node"), F.col("p.node"))).distinct()), sets, percent))
        if found.isEmpty():
            break
        links = checkpointed(links.union(found))
        labels = checkpointed(components(links))
    further = checkpointed(_links_in_blocks(open_lists().join(sketches.select("node", "sketch"), "node"), sets, percent))
    if not further.isEmpty():
        labels = checkpointed(components(links.union(further)))
    discard(docs.sparkSession, long, degrees, sets, sketches)

    placed = classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    joined = checkpointed(slim.join(placed, ["d1", "d2"], "left").select(
        "id", "mark", "n", F.when(F.col("n") > 0, F.col("component")).alias("component")))
    names = joined.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id"))
    return joined.join(names, "component", "left").select("id", "mark", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def similar_texts(docs: DataFrame, percent: int = 85, words: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every row.

    Null, empty and blank texts have no shingles and link with nothing: their component is their own
    id. Texts with the same set link, whatever their number. Rows of one id stay rows of their own, and
    a null id is nobody's smallest. Only id and text are looked at.
    """
    found = _grouped(docs, percent, words, text, doc_id)
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of every group of linked documents the one with the smallest id, with its own columns.

    Documents without shingles are no group and stay. Rows alike in id and text stay or go together.
    """
    found = _grouped(docs, percent, words, text, doc_id)
    one, two = fresh(docs, "gone_id", "gone_mark")
    gone = checkpointed(found.where(~F.col("component_id").eqNullSafe(F.col("id"))).select(F.col("id").alias(one), F.col("mark").alias(two)).distinct())
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[doc_id].eqNullSafe(gone[one]) & (F.xxhash64(text_of(text)) == gone[two]), "left_anti")
