"""Training-corpus pipeline: toxicity, quality rules, near-duplicates, packing. A stage works on all that the one before kept.

Cases: null and empty texts fail the quality rules; rows without a doc_id are never copies; repeated rows are copies of each other;
an empty table gives no places; other columns of the documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import minhash, packing, quality, toxicity
from inkwell.llm.common import cut, prepare, table, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; labels of the documents at hand are learnt from."""
    prepare(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    return quality.clean(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    prepare(spark)
    return minhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences."""
    prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("near-duplicates", drop_copies), ("packing", pack)]
#: SQL can express neither the scores nor the packing; a test compares the kept documents and pieces with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
