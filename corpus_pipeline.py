"""Corpus pipeline over the documents table: toxic texts, copies, near copies and benchmark texts go, the rest is packed.

Each stage works on all that the stage before it kept and is judged on its own input. Stages but the last return the rows
that stay with all their columns; rows are taken out by doc_id, and rows without an id are kept wherever ids decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolattice.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from aerolattice.llm.bytetext import bound_batches
from aerolattice.llm.queries import byte_bpe
from aerolattice.runtime import pinned, release

#: No stage but exact dedup and decontamination can be said in SQL, so the whole cannot.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is not among the ids in `gone`."""
    ids = pinned(gone.select(F.col("doc_id").alias("_gone")).where("_gone IS NOT NULL").distinct())
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    return rows.join(ids, F.col(f"_c{names.index('doc_id')}") == F.col("_gone"), "left_anti").toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sentences' noisy-or is below 0.3."""
    bound_batches(spark)
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for case in A-Z, the one with the largest doc_id."""
    bound_batches(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links of 0.8 or more on five-word shingles, the one with the smallest doc_id."""
    found = jaccard_join.jaccard_components(docs, n=5, percent=80)
    return _without(docs, found.where("doc_id <> component_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in 13-word windows of the benchmark."""
    bound_batches(spark)
    judged = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, judged.where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences of 1024 tokens."""
    bound_batches(spark)
    return packing.best_fit_packing(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = pinned(stage(spark, docs, sf_dir))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
