"""The training-data pipeline: toxic documents, near-duplicates, repeated passages and leaked test items go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dendra.llm.common import checkpoint, removed, table, written
from dendra.llm.conflict_packing import pack_documents
from dendra.llm.decontaminate import drop_contaminated
from dendra.llm.simhash import keep_one_of_each
from dendra.llm.substring_dedup import drop_repeats
from dendra.llm.toxicity import drop_toxic


# Every stage takes its predecessor's rows as they are. All but the last return the columns that came, whatever their names, with null
# doc_ids and repeated rows kept as their operator states; an empty table gives an empty result.


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go.

    Null and empty texts are scored as empty ones, very long texts as a whole; a score of exactly the threshold goes, so ties have one
    result; repeated rows share their fate; rows with a null doc_id are scored like others; without labels the constant share of toxic ones decides.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates the document with the smallest doc_id stays.

    Null and empty texts are near-duplicates of each other; very long texts are fingerprinted as a whole; repeated rows of the
    smallest doc_id all stay; rows without a doc_id stay.
    """
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: repeated paragraphs and passages are cut out of all documents but the first.

    Null and empty texts stay as they are, very long texts are searched as a whole; rows without a doc_id stay whole; repeats within one
    document and between rows of one doc_id stay; documents that are left without a word go.
    """
    return drop_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a test item go.

    Null and empty texts and rows without a doc_id stay; every passage of a very long text is searched; all rows of a doc_id share
    their fate; without items all stay.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one row for each packed piece.

    Null and empty texts are pieces of length 0, very long texts are cut into pieces; ties in length go by id and piece; a null doc_id is
    returned as null; repeated rows are packed each.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and sequential packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and reread by the next one; a table is deleted when the next stage is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            removed(last)
        last = docs
    packed = checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    removed(last)
    return packed
