"""Search: BM25, TF-IDF and exact dense top-k, each with the query side as the small, checked one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dendra.operators.shared import bound_batches, cut

TOKEN = r"[^\s.,;:!?|()\[\]\"]+"
#: Query sides of up to so many rows are sent to all tasks; larger ones are taken in slices or joined by shuffling.
QUERY_ROWS = 20_000
#: Pairs of query and vector that are multiplied at once.
STEP_CELLS = 1 << 22
#: Sums of a document and a query that a task holds at once, and (document, term, query) triples that are added to them at once.
SUM_CELLS = 1 << 20


def word_tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def term_counts(docs: DataFrame, key: str, text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """(key, term, tf, length) of each distinct term of a document."""
    rows = docs.select(key, word_tokens(F.col(text), pattern).alias("terms"))
    return rows.select(key, F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int = 100, k1: float = 0.9, b: float = 0.4, doc_key: str = "doc_id", query_key: str = "item_id", text: str = "text") -> DataFrame:
    """(query_key, doc_key, score, rank): the k best documents of each query by BM25 over distinct query terms.

    Every task holds the queries' terms (in slices of QUERY_ROWS), sums a bounded number of its documents' scores at once and keeps k rows a query; only these are shuffled, and
    for the frequencies one row a term and task. Rows of a doc_key that stands in several rows are one document; only these are brought together by joins.
    """
    terms = queries.select(query_key, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term"))
    words = terms.select("term").distinct()
    words = F.broadcast(words) if words.count() <= QUERY_ROWS else words
    bound_batches(docs.sparkSession)
    tokens = docs.select(doc_key, word_tokens(F.col(text)).alias("terms")).withColumn("length", F.size("terms"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    repeated = cut(docs.groupBy(F.col(doc_key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    many = repeated.count()
    again = F.broadcast(repeated) if many <= QUERY_ROWS else repeated
    twice = F.col(doc_key).eqNullSafe(F.col("again"))
    lone = tokens.join(again, twice, "left_anti") if many else tokens
    found_in = lone.select(F.explode(F.array_distinct("terms")).alias("term")).join(words, "term", "left_semi")
    postings = None
    if many:
        known = tokens.join(again, twice, "left_semi").select(doc_key, "length", F.explode("terms").alias("term")).join(words, "term", "left_semi")
        postings = cut(known.groupBy(doc_key, "length", "term").agg(F.count("*").alias("tf")))
        found_in = found_in.unionByName(postings.select("term"))
    frequency = found_in.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    plan = cut(terms.join(frequency, "term").select(query_key, "term", idf.alias("idf")))
    slices = max(1, -(-plan.count() // QUERY_ROWS))
    mean = float(stats.mean or 1.0)
    schema = T.StructType([plan.schema[query_key], docs.schema[doc_key], T.StructField("score", T.DoubleType())])
    order = [F.desc(F.round("score", 9)), F.col(doc_key)]
    found = None
    for s in range(slices):
        some = plan.where(F.pmod(F.xxhash64(query_key), F.lit(slices)) == s)
        asked = docs.sparkSession.sparkContext.broadcast(TermTable(some.toArrow(), query_key))

        def scored(batches, asked=asked):
            best = BestSums(asked.value, k)
            for batch in batches:
                lists, length = batch.column("terms"), batch.column("length").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                term = asked.value.numbers(lists.flatten())
                cell, tf = np.unique(row[term >= 0] * asked.value.n_terms + term[term >= 0], return_counts=True)
                row, term = np.divmod(cell, max(1, asked.value.n_terms))
                best.add(batch.column(doc_key), row, term, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean)))
            yield from best.batches(schema.names)

        best = top_k(lone.select(doc_key, "terms", "length").mapInArrow(scored, schema), [query_key], order, k)
        if many:
            weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
            sums = postings.repartition(doc_key).join(F.broadcast(some), "term").groupBy(doc_key, query_key).agg(F.sum(weight).alias("score")).select(query_key, doc_key, "score")
            best = top_k(best.drop("rank").unionByName(top_k(sums, [query_key], order, k).drop("rank")), [query_key], order, k)
        found = best if found is None else found.unionByName(best)
    return found


class TermTable:
    """The (query, term, idf, …) rows of some queries as arrays, by term: what each task of a search holds."""

    def __init__(self, rows: pa.Table, query_key: str):
        rows = rows.combine_chunks().sort_by("term")
        column = lambda name: rows.column(name).combine_chunks()
        self.terms = pc.unique(column("term"))
        self.n_terms = len(self.terms)
        self.start = np.searchsorted(self.numbers(column("term")), np.arange(self.n_terms + 1))
        queries = pc.dictionary_encode(column(query_key), null_encoding="encode")
        self.queries, self.query = queries.dictionary, queries.indices.to_numpy(zero_copy_only=False)
        self.of = {name: column(name).to_numpy(zero_copy_only=False) for name in rows.column_names if name not in (query_key, "term")}

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place of each word among the terms, -1 for others."""
        return pc.index_in(words, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class BestSums:
    """The k best documents of each query, from the terms of documents that a task has; ties by the document's key. Not more than about SUM_CELLS sums are held at once."""

    def __init__(self, asked: TermTable, k: int):
        self.asked, self.k = asked, k
        self.held: pa.Table | None = None
        self.least = np.zeros(len(asked.queries))

    def add(self, keys: pa.Array, row: np.ndarray, term: np.ndarray, weight: np.ndarray, bound: np.ndarray | None = None) -> None:
        """Document keys[row] (rows in order) has the term with this weight. bound: of the weights of the posting's block; queries whose k-th best it can't reach leave it."""
        width = len(self.asked.queries)
        step = max(1, SUM_CELLS // max(1, width))
        for at in range(0, len(keys) if width else 0, step):
            a, b = np.searchsorted(row, [at, at + step])
            n = min(step, len(keys) - at)
            if a < b:
                sums = self._sums(row[a:b] - at, term[a:b], weight[a:b], None if bound is None else bound[a:b], n * width).reshape(n, width)
                self._take(keys.slice(at, n), sums)

    def _sums(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, bound: np.ndarray | None, cells: int) -> np.ndarray:
        start, of = self.asked.start, self.asked.of
        sizes = start[term + 1] - start[term]
        upto, sums = np.cumsum(sizes), np.zeros(cells)
        at = 0
        while at < len(row):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SUM_CELLS, side="right")))
            posting = np.repeat(np.arange(at, end), sizes[at:end])
            pair = start[term[posting]] + np.arange(len(posting)) - (upto[posting] - sizes[posting] - (upto[at - 1] if at else 0))
            if bound is not None:
                able = of["idf"][pair] * bound[posting] + of["total"][pair] - of["upper"][pair] >= of["least"][pair]
                posting, pair = posting[able], pair[able]
            sums += np.bincount(row[posting] * len(self.asked.queries) + self.asked.query[pair], weights=of["idf"][pair] * weight[posting], minlength=cells)
            at = end
        return sums

    def _take(self, keys: pa.Array, sums: np.ndarray) -> None:
        order = np.round(sums, 9)
        least = np.partition(order, len(order) - self.k, axis=0)[len(order) - self.k] if len(order) >= self.k else np.zeros(sums.shape[1])
        row, query = np.nonzero((sums > 0) & (order >= np.maximum(least, self.least)))
        if not len(row):
            return
        new = pa.table({"query": query, "key": keys.take(pa.array(row)), "score": sums[row, query], "order": order[row, query]})
        rows = new if self.held is None else pa.concat_tables([self.held, new])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("order", "descending"), ("key", "ascending")], null_placement="at_start"))
        query = rows.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.held = rows.filter(pa.array(place < self.k)).combine_chunks()
        last = np.flatnonzero(place == self.k - 1)
        self.least[query[last]] = rows.column("order").to_numpy()[last]

    def batches(self, names: list[str]):
        """Record batches (query, key, score) of what is kept."""
        if self.held is not None:
            queries = self.asked.queries.take(self.held.column("query").combine_chunks())
            yield from pa.table([queries, self.held.column("key"), self.held.column("score")], names=names).to_batches()


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """rows with `rank` up to k in each group; Spark prunes each task's rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def tfidf_best(queries: DataFrame, docs: DataFrame, group: str, query_key: str, doc_key: str, text: str = "text") -> DataFrame:
    """(group, query_key, doc_key, score): of the documents of a query's group the most similar one by TF-IDF cosine; ties: the first.

    Weights are tf times ln((1 + n) / (1 + df)) + 1 within the group, lengths normalized; a query without known terms takes the first document with score 0.
    """
    counts = docs.select(group, doc_key, F.explode(word_tokens(F.col(text), r"[\p{L}\p{N}_]{2,}")).alias("term")).groupBy(group, doc_key, "term").agg(F.count("*").alias("tf"))
    frequency = counts.groupBy(group, "term").agg(F.count("*").alias("df"))
    sizes = docs.groupBy(group).agg(F.count("*").alias("n"))
    idf = frequency.join(sizes, group).select(group, "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(idf, [group, "term"]).select(group, doc_key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    lengths = weights.groupBy(group, doc_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    asked = queries.select(group, query_key, F.explode(word_tokens(F.col(text), r"[\p{L}\p{N}_]{2,}")).alias("term")).groupBy(group, query_key, "term").agg(F.count("*").alias("tf"))
    asked = asked.join(idf, [group, "term"]).select(group, query_key, "term", (F.col("tf") * F.col("idf")).alias("q"))
    asked_len = asked.groupBy(group, query_key).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qlen"))
    dots = asked.join(weights, [group, "term"]).groupBy(group, query_key, doc_key).agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    known = dots.join(lengths, [group, doc_key]).join(asked_len, [group, query_key]).select(group, query_key, doc_key, (F.col("dot") / F.col("len") / F.col("qlen")).alias("score"))
    first = docs.groupBy(group).agg(F.min(doc_key).alias(doc_key))
    unknown = queries.join(known.select(group, query_key).distinct(), [group, query_key], "left_anti").join(first, group).select(group, query_key, doc_key, F.lit(0.0).alias("score"))
    return top_k(known, [group, query_key], [F.desc(F.round("score", 9)), F.col(doc_key)], 1).drop("rank").unionByName(unknown)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Best:
    """The k best rows of each query so far: scores (rounded for the order), ties by the row's key."""

    def __init__(self, queries: int, k: int):
        self.scores, self.keys, self.k = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max), k

    def add(self, asked: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: (asked queries) x (rows of keys)."""
        scores = np.concatenate([self.scores[asked], scores], axis=1)
        keys = np.concatenate([self.keys[asked], np.broadcast_to(keys, (len(asked), len(keys)))], axis=1)
        order = np.lexsort((keys, -np.round(scores, 9)), axis=1)[:, : self.k]
        self.scores[asked], self.keys[asked] = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)

    def rows(self, ids: np.ndarray) -> list[pa.Array]:
        there = np.isfinite(self.scores)
        return [pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(self.keys[there]), pa.array(self.scores[there])]


def _scored_by_task(vectors: DataFrame, key: str, query_key: str, ids: np.ndarray, wanted: np.ndarray, k: int, normalized: bool, cells: np.ndarray | None = None) -> DataFrame:
    """(query_key, key, score): each task's k best of its vectors for each query. cells: (query, cell) pairs, sorted by cell; then a vector meets the queries of its cell only.

    A step multiplies at most STEP_CELLS pairs of query and vector.
    """
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast((ids, wanted, cells))

    def searched(batches):
        ids, wanted, cells = sent.value
        best = _Best(len(ids), k)
        for batch in batches:
            parts = [(np.arange(len(ids)), batch)]
            if cells is not None:
                cell = batch.column(2).to_numpy(zero_copy_only=False)
                parts = [(cells[slice(*np.searchsorted(cells[:, 1], [c, c + 1])), 0], batch.filter(pa.array(cell == c))) for c in np.unique(cell)]
            for asked, part in parts:
                step = max(1, STEP_CELLS // max(1, len(asked)))
                for at in range(0, part.num_rows if len(asked) else 0, step):
                    some = part.slice(at, step)
                    matrix = _matrix(some.column(1))
                    best.add(asked, wanted[asked] @ (_unit(matrix) if normalized else matrix).T, some.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays(best.rows(ids), [query_key, key, "score"])

    rows = vectors.where(F.size("embedding") == wanted.shape[1]).select(F.col(key).cast("long").alias(key), "embedding", *(["cell"] if cells is not None else []))
    return rows.mapInArrow(searched, f"{query_key} long, {key} long, score double")


def _query_slices(queries: DataFrame, query_key: str):
    """(ids, matrix) of slices of at most about QUERY_ROWS queries; those without a vector are left out."""
    known = queries.where("embedding is not null").select(query_key, F.col("embedding").cast("array<double>").alias("embedding"))
    slices = max(1, -(-known.count() // QUERY_ROWS))
    for s in range(slices):
        part = known.where(F.pmod(F.xxhash64(query_key), F.lit(slices)) == s).collect()
        if part:
            yield np.array([r[0] for r in part], dtype=np.int64), np.array([r[1] for r in part], dtype=np.float64)


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def dense_top(vectors: DataFrame, queries: DataFrame, k: int = 100, key: str = "vec_id", query_key: str = "query_id", normalized: bool = False) -> DataFrame:
    """(query_key, key, score, rank): exact top k by dot product (or cosine, with `normalized`), query vectors against all vectors.

    Queries are held by every task in slices of QUERY_ROWS; a task multiplies its batches with them, a bounded number of pairs at once, and keeps
    its own k best, so only k rows per query and task are shuffled. Vectors that are null or of another width are left out.
    """
    found = [_scored_by_task(vectors, key, query_key, ids, _unit(m) if normalized else m, k, normalized) for ids, m in _query_slices(queries, query_key)]
    rows = _union(found, vectors.sparkSession, f"{query_key} long, {key} long, score double")
    return top_k(rows, [query_key], [F.desc(F.round("score", 9)), F.col(key)], k)


def write_cells(vectors: DataFrame, path: str, cells: int, rounds: int = 5, key: str = "vec_id") -> None:
    """Writes vectors (key, embedding) in cells of their nearest centers, partitioned by cell, and the centers beside them.

    Centers are fitted by rounds over all vectors (see divergence.centers_of), every vector is written; those that are null or of another width than the first are left out.
    """
    from dendra.operators.divergence import cells_of, centers_of

    first = vectors.where("embedding is not null").agg(F.min_by(F.size("embedding"), key).alias("n")).first().n
    good = vectors.where((F.size("embedding") == (first or 0)) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).select(F.col(key).cast("long").alias(key), "embedding")
    centers = centers_of(good, cells, rounds, key)
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").write.mode("overwrite").parquet(f"{path}/centers")
    cells_of(good, centers, key).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


def cell_top(spark, path: str, queries: DataFrame, k: int = 100, probes: int = 8, key: str = "vec_id", query_key: str = "query_id", normalized: bool = False) -> DataFrame:
    """(query_key, key, score, rank): of the vectors in the `probes` cells nearest to each query, the exact top k.

    Only cells that some query probes are read. With as many probes as cells the result is dense_top's. The driver holds the centers, whose number the writer gave.
    """
    rows = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()
    schema, found = f"{query_key} long, {key} long, score double", []
    if rows:
        centers = np.array([r.center for r in rows])
        stored = spark.read.schema(f"{key} long, embedding array<float>, cell int").parquet(f"{path}/vectors")
        for ids, wanted in _query_slices(queries, query_key):
            far = (centers**2).sum(axis=1) / 2 - wanted @ centers.T
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            pairs = np.column_stack([np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()])
            pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
            read = stored.where(F.col("cell").isin(np.unique(near).tolist()))
            found.append(_scored_by_task(read, key, query_key, ids, _unit(wanted) if normalized else wanted, k, normalized, pairs))
    return top_k(_union(found, spark, schema), [query_key], [F.desc(F.round("score", 9)), F.col(key)], k)
