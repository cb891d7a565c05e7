"""Training-data pipeline over ``documents``: five stages, each calling one operator of ``tidemark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what it returns and reads it again as the next
stage's docs, and deletes what the stage has left in the shared folder. All stages but the last return the columns of ``docs``.

Every stage gives no rows for an empty table, takes texts of any length whole, and passes other columns on, whatever their names
(n_chars is made anew by ``lines``, if it is there; a column named ``_at``, ``_d``, ``_s`` or ``_other`` is taken for the stages' own).
What each does with nulls, ties and repeated rows stands with it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.linededup import dedup_lines
from tidemark.llm.mixing import BLOCK_ROWS, mix_sources
from tidemark.llm.neardup import drop_near_duplicates
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.quality import keep_good, train_quality
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.store import cut, discard, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on labelled rows of ``docs``.

    A null text scores like an empty one; rows with a null id are scored, not learnt from; rows with equal texts meet one fate.
    """
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of three lines go, and documents of which nothing is left; n_chars follows the text.

    A null text or id leaves a row as it is; the smallest id keeps a passage, and rows that share an id lose alike.
    """
    left = dedup_lines(docs)
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    Rows without words or id stay, and so do rows that repeat the id that is kept.
    """
    return drop_near_duplicates(docs)


#: Target weights of sources; None: the square root of a source's rows.
WEIGHTS: Mapping[str | None, float] | None = None


def with_places(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_at``, the number of each row's place in the mixture's schedule. It follows from the rows alone, in any order."""
    mixed = mix_sources(docs.select("doc_id", "source"), WEIGHTS).select("doc_id", "source", (F.col("slot") * BLOCK_ROWS + F.col("place")).alias("_at"))
    # rows that repeat an id of a source share its earliest place
    first = mixed.groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s")).agg(F.min("_at").alias("_at"))
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_d", "_s")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the mixture: files, and rows in them, follow the schedule's places. None goes.

    Rows read again may come in another order, so :func:`packing` makes the places anew from the same rows. Null is a source of its own;
    nulls among the ids come first in their source; rows that repeat an id of a source share a place.
    """
    return with_places(docs).repartitionByRange("_at").sortWithinPartitions("_at").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, numbered by the mixture's schedule, which also decides between documents of equal length.

    A null text has the closing id alone; every row is packed, also rows that repeat an id or have none.
    """
    return best_fit_pack(with_places(docs), tokenizer_path(), place_col="_at")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: The first stage is a fitted model and the last needs a tokenizer, so SQL cannot give the pipeline's rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope(spark) as tables:
            done = cut(stage(spark, docs, sf_dir))
            tables.keep(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
