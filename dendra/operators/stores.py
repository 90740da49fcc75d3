"""Tables that stay on disk between runs: a document graph that takes batches of changes, and an inverted index that takes batches of documents.

Both are Parquet tables in buckets of a hash, written by dynamic partition overwrite: a batch replaces the partitions that it touches and no others,
and a batch that is given again, after a failure or by mistake, leaves the same tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from dendra.operators.graph import symmetric
from dendra.operators.retrieval import QUERY_ROWS, BestSums, TermTable, top_k, word_tokens
from dendra.operators.shared import bound_batches, cut, parquet_or_empty

#: Documents of one posting list block at most.
BLOCK = 256
_ENTRY = "struct<doc:bigint,tf:int,length:int>"


def bucket_of(value: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def replaced(rows: DataFrame, path: str, *partitions: str) -> None:
    """Writes rows over the partitions that they belong to; a partition is one task, or several where it is large."""
    rows.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def buckets_in(*tables: DataFrame) -> list[int]:
    """The buckets that the tables have rows of; at most as many numbers as there are buckets."""
    found = [t.select("bucket") for t in tables]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return sorted(r.bucket for r in every.distinct().collect())


def _settled_buckets(spark: SparkSession, path: str, buckets: int) -> int:
    """The number of buckets that a store was made with; a new store takes the given one."""
    known = parquet_or_empty(spark, f"{path}/settings", "buckets int").first()
    if known is None:
        spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.mode("overwrite").parquet(f"{path}/settings")
        return buckets
    return known.buckets


class GraphStore:
    """Vertices (title, seq, attributes…, degree) and both directions of all edges (src, dst), each once, under a path.

    A vertex is in the bucket of its title and an edge in that of its source, so the degrees of a bucket's vertices need no other bucket.
    """

    def __init__(self, spark: SparkSession, path: str, attributes: str = "", buckets: int = 64):
        """attributes: columns of a vertex besides title and seq, as DDL. buckets: of a new store; an old one keeps its own."""
        self.spark, self.path = spark, path
        self.buckets = _settled_buckets(spark, path, buckets)
        self.attributes = [f.name for f in T.StructType.fromDDL(attributes)] if attributes else []
        middle = f"{attributes}, " if attributes else ""
        self.vertex_schema = f"title string, seq long, {middle}degree long, bucket int"

    def vertices(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/vertices", self.vertex_schema)

    def edges(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/edges", "src string, dst string, bucket int")

    def upsert(self, vertices: DataFrame, links: DataFrame) -> list[int]:
        """Takes in vertices (title, seq, attributes…) and links (src, dst), and returns the buckets that were written.

        Of several rows of a title, stored or new, the one with the largest seq stays (of equal ones the new one; new ones that are equal in seq too must be
        equal). A link's end without a vertex gets a bare row; a link of a title with itself is an edge. Rows without a title and links without an end are left out. Edges are written first and degrees counted from them, so a batch that failed between the two is made good when it is given again.
        """
        ends = links.where("src is not null and dst is not null")
        pairs = cut(symmetric(ends).withColumn("bucket", bucket_of("src", self.buckets)))
        given = vertices.where("title is not null").select("title", F.col("seq").cast("long").alias("seq"), *self.attributes).withColumn("bucket", bucket_of("title", self.buckets))
        touched = buckets_in(pairs, given)
        if not touched:
            return []
        near = F.col("bucket").isin(touched)
        replaced(self.edges().where(near).unionByName(pairs).distinct(), f"{self.path}/edges", "bucket")
        degree = self.edges().where(near).groupBy("bucket", F.col("src").alias("title")).agg(F.count("*").alias("degree"))
        attributes = F.struct("seq", *self.attributes)
        known = self.vertices().where(near).select("bucket", "title", attributes.alias("v"), F.lit(0).alias("new"))
        fresh = given.select("bucket", "title", attributes.alias("v"), F.lit(1).alias("new"))
        bare = pairs.select("bucket", F.col("src").alias("title"), F.lit(None).cast(fresh.schema["v"].dataType).alias("v"), F.lit(0).alias("new")).distinct()
        rows = known.unionByName(fresh).unionByName(bare).groupBy("bucket", "title")
        latest = rows.agg(F.max_by("v", F.when(F.col("v.seq").isNotNull(), F.struct("v.seq", "new"))).alias("v"))
        merged = latest.join(degree, ["bucket", "title"], "left").select("title", "v.*", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "bucket")
        replaced(merged, f"{self.path}/vertices", "bucket")
        return touched


class PostingsIndex:
    """An inverted index under a path: posting lists in blocks of up to 256 documents, with the bound of each block beside it, and document lengths.

    A block's bound is its largest term frequency and its smallest document length, from which a bound of its scores follows for any mean length.
    Postings are in buckets of their term's hash, within each batch; a search reads the buckets of its terms only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets: of a new index; an old one keeps its own."""
        self.spark, self.path = spark, path
        self.buckets = _settled_buckets(spark, path, buckets)

    def documents(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/documents", "doc long, length int, batch long")

    def postings(self) -> DataFrame:
        return parquet_or_empty(self.spark, f"{self.path}/postings", "term string, block long, n int, max_tf int, min_length int, entries array<struct<doc: bigint, tf: int, length: int>>, batch long, bucket int")

    def append(self, docs: DataFrame, batch: int, key: str = "doc_id", text: str = "text") -> None:
        """Takes in a batch of documents. Null texts are left out; of documents with one key those of a batch may count as one, those of several batches don't. A batch number that was given before is replaced.

        A block's documents are neighbours in one task, which makes its posting lists; so they are shuffled once, into their buckets, and what is gathered for a term never exceeds a block, however frequent the term is. Documents are
        written last: a batch that has none of them is not complete and must be given again.
        """
        rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), word_tokens(F.col(text)).alias("terms"))
        rows = rows.withColumn("length", F.size("terms"))
        bound_batches(self.spark)
        numbered = rows.select(F.monotonically_increasing_id().alias("at"), "doc", "length", "terms")
        blocks = numbered.mapInArrow(_posting_blocks, f"term string, block long, n int, max_tf int, min_length int, entries array<{_ENTRY}>")
        blocks = blocks.withColumn("batch", F.lit(batch).cast("long")).withColumn("bucket", bucket_of("term", self.buckets))
        spread = blocks.hint("rebalance", "bucket").sortWithinPartitions("batch", "bucket", "term")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{self.path}/postings")
        replaced(rows.select("doc", "length", F.lit(batch).cast("long").alias("batch")), f"{self.path}/documents", "batch")

    def terms(self, terms: DataFrame) -> DataFrame:
        """The posting blocks of the terms in column `term`; only their buckets are read."""
        wanted = terms.select("term").distinct().withColumn("bucket", bucket_of("term", self.buckets))
        found = buckets_in(wanted)
        wanted = F.broadcast(wanted) if wanted.count() <= QUERY_ROWS else wanted
        return self.postings().where(F.col("bucket").isin(found)).join(wanted, ["bucket", "term"], "left_semi")

    def search(self, queries: DataFrame, k: int = 100, k1: float = 0.9, b: float = 0.4, query_key: str = "item_id", text: str = "text", probes: int = 3) -> DataFrame:
        """(query_key, doc_id, score, rank): the k best documents of each query by BM25 over its distinct terms; ties by document.

        All blocks of the same documents meet in one task, which holds the queries' terms (in slices of a checked size), so a document's score is summed where its
        postings are, a bounded number at once, and only k rows a query and task are kept and shuffled, however frequent a word is. The k-th best sum over a query's `probes`
        strongest terms is a score that no result is below; blocks of a term whose bound, with all other terms at their best, can't reach it are not opened.
        """
        stats = self.documents().agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
        mean = float(stats.mean or 1.0)
        asked = queries.select(query_key, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term"))
        blocks = self.terms(asked)

        def weighted(tf: Column, length: Column) -> Column:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))

        bound = weighted(F.col("max_tf"), F.col("min_length"))
        frequency = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max(bound).alias("bound"))
        idf = F.log(1 + (F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        plan = asked.join(frequency.select("term", idf.alias("idf"), (idf * F.col("bound")).alias("upper")), "term")
        of_query = Window.partitionBy(query_key)
        plan = cut(plan.withColumns({"total": F.sum("upper").over(of_query), "strength": F.row_number().over(of_query.orderBy(F.desc("upper"), F.desc("term")))}))
        slices = max(1, -(-plan.count() // QUERY_ROWS))
        aligned = ["batch", "block"]

        order = [F.desc(F.round("score", 9)), F.col("doc_id")]
        schema = T.StructType([plan.schema[query_key], T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
        bound_batches(self.spark)

        def best(terms: DataFrame, pruned: bool = False) -> DataFrame:
            """The k best documents by the sums over the given (query, term) rows; pruned: without the blocks of a term that can't reach a query's least."""
            asked = self.spark.sparkContext.broadcast(TermTable(terms.toArrow(), query_key))
            opened = blocks.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").repartition(*aligned).sortWithinPartitions(*aligned)

            def summed(batches):
                found, rest = BestSums(asked.value, k), None
                for batch in (b for b in batches if b.num_rows):
                    rows = pa.Table.from_batches([batch])
                    rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
                    ids = np.column_stack([rows.column(c).to_numpy() for c in aligned])
                    last = np.flatnonzero((ids == ids[-1]).all(axis=1))[0]  # more of the last block may follow
                    rest = rows.slice(last)
                    _add_postings(found, rows.slice(0, last), ids[:last], weigh, pruned)
                if rest is not None:
                    _add_postings(found, rest, np.column_stack([rest.column(c).to_numpy() for c in aligned]), weigh, pruned)
                yield from found.batches(schema.names)

            return top_k(opened.select(*aligned, "term", "max_tf", "min_length", "entries").mapInArrow(summed, schema), [query_key], order, k)

        def weigh(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

        found = None
        for s in range(slices):
            some = plan.where(F.pmod(F.xxhash64(query_key), F.lit(slices)) == s)
            least = best(some.where(F.col("strength") <= probes)).where(F.col("rank") == k).select(query_key, (F.col("score") - 1e-6).alias("least"))
            some = cut(some.join(least, query_key, "left").withColumn("least", F.coalesce("least", F.lit(0.0))))
            result = best(some, pruned=True)
            found = result if found is None else found.unionByName(result)
        return found


def _posting_blocks(batches):
    """Posting lists of each BLOCK neighbouring documents (at, doc, length, terms); a block's name is its first document's number."""
    entry = pa.struct({"doc": pa.int64(), "tf": pa.int32(), "length": pa.int32()}.items())
    names = ["term", "block", "n", "max_tf", "min_length", "entries"]
    for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
        block = batch.column("at")[0].as_py()
        batch = batch.take(pc.sort_indices(batch.column("doc")))
        terms = batch.column("terms").flatten().dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        cell, tf = np.unique(terms.indices.to_numpy(zero_copy_only=False).astype(np.int64) * BLOCK + row, return_counts=True)
        if not len(cell):
            continue
        term, row = np.divmod(cell, BLOCK)
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        length = batch.column("length").to_numpy(zero_copy_only=False)[row]
        entries = pa.StructArray.from_arrays([batch.column("doc").take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length, pa.int32())], fields=list(entry))
        ends = np.append(first, len(cell))
        columns = [
            terms.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), block), pa.int64()), pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tf, first), pa.int32()),
            pa.array(np.minimum.reduceat(length, first), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


def _add_postings(found: BestSums, rows: pa.Table, ids: np.ndarray, weigh, pruned: bool) -> None:
    """Adds the posting lists of whole blocks (ids: their batch and block, in order)."""
    if not rows.num_rows:
        return
    new = np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1)))
    lists = rows.column("entries").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    block = np.repeat(np.cumsum(new) - 1, sizes)
    entry = lists.flatten()
    doc, tf, length = (entry.field(i) for i in range(3))
    codes = pc.dictionary_encode(doc, null_encoding="encode")
    cell, row = np.unique(block * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    by_row = np.argsort(row, kind="stable")
    keys = codes.dictionary.take(pa.array(cell % len(codes.dictionary)))
    term = np.repeat(found.asked.numbers(rows.column("term").combine_chunks()), sizes)
    bound = np.repeat(weigh(*(rows.column(c).to_numpy() for c in ("max_tf", "min_length"))), sizes)[by_row] if pruned else None
    found.add(keys, row[by_row], term[by_row], weigh(tf.to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False))[by_row], bound)
