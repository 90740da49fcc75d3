"""Finds the passages that questions are answered from, in a growing table of documents.

    python -m jobs.evidence --documents DOCUMENTS --questions QUESTIONS --out OUT [--config jobs/evidence.yaml]

DOCUMENTS: Parquet (doc_id long, text string, …), QUESTIONS: Parquet (item_id long, text string). Documents are cut into passages and taken into an inverted
index in OUT/index. Its largest doc_id is the high-water mark: a run reads only documents beyond it, so doc_ids have to grow from run to run. All questions are
then searched, and OUT/evidence (item_id, rank, doc_id, place, score, text; partitioned by part) and OUT/contexts (JSON lines: item_id, question, context) are written anew.
A run that failed is simply run again: the batch that it didn't finish is replaced.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from dendra.operators import context
from dendra.operators.retrieval import QUERY_ROWS
from dendra.operators.shared import cut
from dendra.operators.stores import PostingsIndex
from jobs.common import command

log = logging.getLogger("jobs.evidence")
PATHS = {"documents": "documents, Parquet", "questions": "questions, Parquet", "out": "folder of the index and the evidence"}
DEFAULTS = {"passage_words": 100, "top_k": 5, "budget": 300, "buckets": 64, "parts": 8}
#: A passage's key is its document's id and its number in these many bits.
NUMBER_BITS = 20


def passages(docs: DataFrame, words: int) -> DataFrame:
    """(passage, doc_id, place, text): every `words` words of a text, joined by blanks; place counts from 0. Texts without words have none."""
    all_words = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    rows = docs.select("doc_id", all_words.alias("w")).where(F.size("w") > 0)
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.expr(f"(size(w) - 1) div {words}").cast("int"))).alias("place"))
    text = F.array_join(F.slice("w", F.col("place") * words + 1, words), " ")
    key = F.shiftleft("doc_id", NUMBER_BITS) + F.col("place")
    return rows.select(key.alias("passage"), "doc_id", "place", text.alias("text"))


def taken(index: PostingsIndex, docs: DataFrame, words: int) -> dict:
    """Takes the documents beyond the mark into the index. Rows without doc_id or text, and all rows of a doc_id that came more than once, are left out and counted."""
    mark = index.documents().agg(F.max("doc")).first()[0]
    mark = None if mark is None else mark >> NUMBER_BITS
    new = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    new = new if mark is None else new.where(F.col("doc_id").isNull() | (F.col("doc_id") > mark))
    ids = cut(new.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("bare")))
    counts = {"documents": F.sum("n"), "without_id": F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), "without_text": F.sum("bare"), "repeated_ids": F.count_if(F.col("doc_id").isNotNull() & (F.col("n") > 1))}
    seen = ids.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]).first().asDict()
    good = new.where("doc_id is not null and text is not null")
    if seen["repeated_ids"]:  # few ids are sent to the texts, so that these aren't shuffled
        again = ids.where("n > 1").select("doc_id")
        good = good.join(F.broadcast(again) if seen["repeated_ids"] <= QUERY_ROWS else again, "doc_id", "left_anti")
    if seen["documents"]:
        index.append(passages(good, words), batch=0 if mark is None else mark + 1, key="passage")
    return {"mark": mark, **seen}


def run(spark: SparkSession, documents: str, questions: str, out: str, passage_words: int = 100, top_k: int = 5, budget: int = 300, buckets: int = 64, parts: int = 8) -> dict:
    """Takes new documents into the index and writes the best passages of every question; returns what was read and written."""
    index = PostingsIndex(spark, f"{out}/index", buckets)
    docs, asked = spark.read.parquet(documents), spark.read.parquet(questions).select("item_id", "text")
    read = taken(index, docs, passage_words)
    log.info("read %s from %s", read, documents)
    hits = index.search(asked, k=top_k).withColumn("found", F.shiftright("doc_id", NUMBER_BITS))
    hits = cut(hits.select("item_id", "rank", "score", F.col("doc_id").alias("passage"), "found"))
    found = cut(hits.select(F.col("found").alias("doc_id")).distinct())
    held = docs.join(F.broadcast(found) if found.count() <= QUERY_ROWS else found, "doc_id", "left_semi")
    rows = hits.drop("found").join(passages(held, passage_words), "passage").select("item_id", "rank", "doc_id", "place", "score", "text")
    evidence = context.within_budget(rows, budget, key="item_id", order="rank").withColumn("part", F.pmod("item_id", F.lit(parts)).cast("int"))
    evidence.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{out}/evidence")
    written = spark.read.parquet(f"{out}/evidence")
    joined = asked.withColumnRenamed("text", "question").join(context.assembled(written, "item_id", "rank"), "item_id", "left")
    joined.select("item_id", "question", F.coalesce("context", F.lit("")).alias("context")).write.mode("overwrite").option("ignoreNullFields", False).json(f"{out}/contexts")
    report = {"read": read, "passages": index.documents().count(), "evidence": written.count(), "questions": spark.read.schema("item_id long").json(f"{out}/contexts").count()}
    log.info("%s holds %s", out, report)
    return report


if __name__ == "__main__":
    command("evidence", run, PATHS, DEFAULTS)
