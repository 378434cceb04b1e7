"""The corpus pipeline: documents through five stages, each written and read again.

Language ID, exact dedup, near dedup by shingle sets, mixing to target weights, SentencePiece ids.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.llm import exact_dedup, langid, mixing, ngram_join, pieces
from wattgrid.session import discard, own_folder, written_so_far

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# What the last stage called has written on its way; the next one deletes it, as the last one's result is a table of its own by then.
_OF_LAST_STAGE: list[str] = []

WEIGHTS = (1.0, 2.0, 3.0)
#: Five models and a draw of rows by hash: no SQL for these.
ORACLE_SQL = None


def stage(work: Stage) -> Stage:
    """A stage that first frees what the stage before has written on its way."""

    @functools.wraps(work)
    def freeing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, *_OF_LAST_STAGE)
        before = set(written_so_far())
        out = work(spark, docs, sf_dir)
        _OF_LAST_STAGE[:] = [path for path in written_so_far() if path not in before]
        return out

    return freeing


@stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; null, empty and letterless texts are, repeated rows go or stay together."""
    return langid.identified(docs)


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest, then that of least id (null last). Null texts count as empty; very long ones are hashed whole."""
    return exact_dedup.exact_dedup(docs)


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: five-word shingles, similarity of 0.8 or more, over whole texts. Texts without words stay."""
    return ngram_join.one_of_each(docs, percent=80, words=5)


@stage
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is one of its own, documents without words weigh nothing."""
    return mixing.mix(docs, list(WEIGHTS))


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of a seeded segmentation of the whole text; null and empty texts have none."""
    return pieces.encode(docs, pieces.Vocabulary.load()).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage returns is written to the checkpoint folder and read again, then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, work in STAGES:
        path = own_folder(spark, "pipeline", f"{name.replace(' ', '-')}-{uuid.uuid4().hex}")
        work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            discard(spark, written)
        written = path
    return docs
