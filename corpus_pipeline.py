"""The corpus pipeline: quality classifier, SimHash near-dedup, mixing to target weights, best-fit packing.

Each stage is one operator of the training-data subpackage over all that the stage before it kept. A stage's decisions take
effect: documents that the classifier rejects go; of each group of near-duplicates the row with the smallest doc_id stays
(of equal doc_ids the one with the smallest text; a null doc_id stays only where its group has no other); the mix repeats
or leaves out rows; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorebed.llm import mixing, packing, quality, simhash
from lorebed.llm.common import drop_written, durable, table, written
from lorebed.llm.tokens import default_vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled rows of ``docs``, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose shingles of five words are alike by about 0.8 or more."""
    return simhash.keep_one(docs, simhash.Similar(shingle=5, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as sources weighing 1, 2, 3 in turn take them, at most 3 times."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]
#: The first stage is a trained model, which SQL can't express; tests hold all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it kept, written and read again in between.

    Once a stage's result is written, the tables that led to it are removed.
    """
    docs = table(spark, sf_dir, "documents")
    mark = written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name)
            drop_written(mark, last=1)
    return docs
