"""A training-data pipeline of five operators, each a stage from documents to documents.

run() writes each stage's rows to the shared folder and reads them again, so that lineage stays short and a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sediment.llm._common import Scratch, table, written
from sediment.llm.op2_mixing import mix_sources
from sediment.llm.op3_jaccard import keep_one_each
from sediment.llm.op7_sharding import shard_documents
from sediment.llm.op8_toxicity import keep_civil
from sediment.llm.op10_decontamination import clean_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on the labelled ones among them, rejects go.

    Null and empty texts stay; equal texts and repeated rows stay or go together; all columns are kept, whatever their names.
    Without labels all stay; an empty table stays empty.
    """
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents of similarity 0.8 or more, the one of the smallest doc_id stays.

    Texts without words stay; so do repeated rows of a document that stays, and components in which no row has an id. Rows of
    a null id go where their component has one. All columns are kept; an empty table stays empty.
    """
    return keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.

    Null and empty texts stay; repeated rows stay or go together; all columns are kept. An empty benchmark removes nothing,
    an empty table stays empty.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources take shares by the square root of their bytes; order is shuffled.

    Rows of one doc_id draw alike, so repeated rows repeat together; a null doc_id or source counts as ''. All columns are
    kept; an empty table stays empty.
    """
    return mix_sources(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 16 shards of nearly equal bytes, with their place in the shard.

    Equal texts share a shard; repeated rows each take a slot; null texts are empty ones. Columns named size, text_crc32, shard
    and slot are replaced, all others kept. An empty table gives no rows.
    """
    return shard_documents(docs, n_shards=16)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: The classifier of the first stage has no equivalent in SQL. tests/llm runs the whole pipeline on a small table beside a
#: plain version in Python: all pairs, all windows, drawn counts; of sharding it checks the law.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Tables that a stage has written go with it; its result goes when the next is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as kept:
        for name, stage in STAGES[:-1]:
            with Scratch(spark) as own:
                docs = own.keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        kept.keep(docs)
        with Scratch(spark) as own:
            out = STAGES[-1][1](spark, docs, sf_dir)
            return kept.keep(own.keep(written(out, "pipeline-shards")))
