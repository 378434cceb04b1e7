"""Exact deduplication that takes frequent digests out of the shuffle.

A mergeable frequent-items sketch of the Misra-Gries family finds the digests that many rows
share. Their groups are counted exactly with map-side partial sums, the winners (at most
``heavy_slots`` rows) are broadcast, and every row of such a group is decided where it is read.
The other digests, of which no one has a large share of the rows, meet in an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattgrid.llm.common import fresh, packed, quoted, squeezed, text_of, without
from wattgrid.session import checkpointed

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text_sha256`` (hex, of the text without white space) and ``text_chars`` (code points)."""
    return without(docs, "text_sha256", "text_chars").withColumns({
        "text_sha256": F.sha2(squeezed(text_of(text)).cast("binary"), 256), "text_chars": F.length(text_of(text))})


def mark_copies(rows: DataFrame, doc_id: str = "doc_id", heavy_slots: int = 1024, tracked: int = 16384) -> DataFrame:
    """Add ``keep_id``, ``group_size`` and ``kept`` to rows with ``text_sha256`` and ``text_chars``.

    Of equal digests the row with the most characters stays, then the smallest id (null ids last);
    of rows alike in these, exactly one. Null texts count as empty and so equal each other. Columns
    named like the results are replaced, other columns are kept. An empty table gives an empty one.
    The sketch bounds what is broadcast: ``heavy_slots`` winners. A digest that more than about one
    row in ``tracked`` has is certain to be among the tracked ones.
    """
    rows = without(rows, "keep_id", "group_size", "kept")
    digest, uid, share, first = fresh(rows, "digest", "uid", "share", "first")
    staged = checkpointed(rows.withColumns({
        digest: F.unhex("text_sha256"), uid: F.monotonically_increasing_id()}))
    order = F.struct((-F.col("text_chars")).alias("c"), quoted(doc_id).isNull().alias("n"), quoted(doc_id).alias("id"), F.col(uid).alias("u"))
    found = staged.agg(F.expr(f"approx_top_k(xxhash64(`{digest}`), {heavy_slots}, {tracked})").alias("top"))
    heavy = found.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("k"))
    suspects = staged.join(F.broadcast(heavy), F.xxhash64(digest) == heavy["k"], "left_semi")
    winners = checkpointed(suspects.groupBy(digest).agg(F.count("*").alias(share), F.min(order).alias(first)))
    group = Window.partitionBy(digest)
    rest = staged.join(F.broadcast(winners.select(digest)), digest, "left_anti").withColumns({
        share: F.count("*").over(group), first: F.min(order).over(group)})
    both = staged.join(F.broadcast(winners), digest).unionByName(rest)
    return both.select(*[quoted(c) for c in rows.columns], F.col(f"{first}.id").alias("keep_id"), F.col(share).alias("group_size"),
                       (F.col(f"{first}.u") == F.col(uid)).alias("kept"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with their own columns."""
    marked = mark_copies(digests(packed(docs, text=text, doc_id=doc_id)).drop("text"))
    return marked.where("kept").select("row.*")
