"""Labelled rows for the classifiers: folds by checksum of the id, and a sample with a fixed bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolattice.llm.bytetext import columns


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, mod `folds`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, text, label of at most `most` labelled documents outside the held-out fold, in order of a hash of the id.

    Rows without id or label are left out; an id that is labelled more than once counts with its largest label. The
    sampled ids are at most `most` short rows, so they are broadcast.
    """
    rows = columns(labels, id_column, label).toDF("doc_id", "label").where("doc_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.where(fold("doc_id", folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = columns(docs, id_column, text).toDF("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id")
