"""The document graph: vertices, edges, degrees, and query-focused expansion over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dendra.functions.vector import combined, cosine
from dendra.operators.shared import cut


def upsert_vertices(batches: DataFrame, key: str = "title", order: str = "seq") -> DataFrame:
    """One row per key: the one that came last."""
    columns = [c for c in batches.columns if c not in (key, order)]
    return batches.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("v")).select(key, "v.*")


def edges_from_lists(links: DataFrame, *lists: str) -> DataFrame:
    """(src, dst) for each entry of the named list columns; what kind of link it was is dropped."""
    return links.select(F.col("title").alias("src"), F.explode(F.concat(*lists)).alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def with_endpoints(vertices: DataFrame, edges: DataFrame, key: str = "title") -> DataFrame:
    """Vertices and a bare row for each edge end that has none."""
    ends = edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key))).distinct()
    return vertices.join(ends, key, "full_outer")


def degrees(vertices: DataFrame, edges: DataFrame, key: str = "title") -> DataFrame:
    """(key, degree): neighbours in a symmetric edge table, 0 without any."""
    counts = edges.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("degree"))
    return vertices.select(key).join(counts, key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_statistics(degree: DataFrame) -> DataFrame:
    return degree.where("degree is not null").agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.avg("degree").alias("mean"))


def neighbours(frontier: DataFrame, edges: DataFrame, vertices: DataFrame, key: str = "title") -> DataFrame:
    """The frontier's rows, once for each neighbour, with the neighbour's columns (its key as `key`)."""
    return frontier.join(edges.select("src", F.col("dst").alias(key)), F.col("source") == F.col("src")).drop("src").join(vertices, key)


def propagate(
    seeds: DataFrame,
    edges: DataFrame,
    vertices: DataFrame,
    hops: int = 5,
    top_k: int = 5,
    local_weight: float = 0.4,
    global_weight: float = 0.6,
    threshold: float = 0.1,
    degree_cap: int = 3000,
    key: str = "title",
) -> tuple[DataFrame, DataFrame]:
    """Beam expansion of all (qid, root) pairs at once: (reported rows of schema HOP, candidates per hop).

    seeds: (qid, root, query array<float>). edges: symmetric (src, dst). vertices: (key, embedding, degree).
    Per hop the candidates are the frontier's unvisited neighbours. A candidate's local score is the best
    product of cosines along a path to it (of equal ones the source ranked first), its global score the
    cosine with the query. All candidates are ranked by softmax of the weighted sum, ties by key; rows with
    rank up to top_k and a sum of at least the threshold are reported. Those of degree up to the cap are the next
    frontier and are visited from then on; a hub is reported but never expanded, and may be reported again. A vertex
    without embedding is no candidate; a root that isn't there has no hops.

    A hop is two equi joins, one grouped maximum and one window per pair; only the beam (top_k rows per pair) is
    carried to the next hop, which is cut from the plan by a checkpoint.
    """
    known = vertices.where("embedding is not null").select(key, "embedding", "degree")
    pair = ["qid", "root"]
    start = seeds.join(known.select(F.col(key).alias("root"), F.col("embedding").alias("own"), "degree"), "root").where(F.col("degree") <= degree_cap)
    frontier = cut(start.select(*pair, "query", F.col("root").alias("source"), "own", F.lit(1.0).alias("path_score"), F.lit(0).alias("source_rank")))
    visited = frontier.select(*pair, F.col("source").alias(key))
    reported, counted = [], []
    for hop in range(1, hops + 1):
        near = neighbours(frontier, edges, known, key).join(visited, [*pair, key], "left_anti")
        near = near.withColumn("adjacent_score", cosine(F.col("own"), F.col("embedding"))).where("adjacent_score is not null")
        near = near.withColumn("local_score", F.col("path_score") * F.col("adjacent_score"))
        best = F.max_by(F.struct("source", "adjacent_score", "local_score", "embedding", "degree", "query"), F.struct("local_score", -F.col("source_rank")))
        found = near.groupBy(*pair, key).agg(best.alias("b")).select(*pair, key, F.col("b.source").alias("source_title"), "b.adjacent_score", "b.local_score", "b.embedding", "b.degree", "b.query")
        found = found.withColumn("global_score", cosine(F.col("query"), F.col("embedding")))
        found = found.withColumn("total_score", combined(F.col("local_score"), F.col("global_score"), local_weight, global_weight))
        group = Window.partitionBy(*pair)
        found = found.withColumn("shifted", F.exp(F.col("total_score") - F.max("total_score").over(group)))
        found = found.withColumn("softmax_score", F.col("shifted") / F.sum("shifted").over(group))
        found = found.withColumn("rank", F.row_number().over(group.orderBy(F.desc("total_score"), key))).withColumn("candidates", F.count("*").over(group))
        counts = found.where("rank = 1").select(*pair, F.lit(hop).alias("hop"), "candidates")
        kept = cut(found.where((F.col("rank") <= top_k) & (F.col("total_score") >= threshold)).drop("shifted", "candidates"))
        reported.append(kept.select(*pair, F.lit(hop).alias("hop"), "rank", key, "source_title", "adjacent_score", "local_score", "global_score", "total_score", "softmax_score", "degree"))
        counted.append(counts)
        grown = kept.where(F.col("degree") <= degree_cap)
        frontier = grown.select(*pair, "query", F.col(key).alias("source"), F.col("embedding").alias("own"), F.col("local_score").alias("path_score"), F.col("rank").alias("source_rank"))
        visited = visited.unionByName(grown.select(*pair, key))
    out, counts = reported[0], counted[0]
    for more, c in zip(reported[1:], counted[1:]):
        out, counts = out.unionByName(more), counts.unionByName(c)
    return out, counts


def required_titles(hops: DataFrame, key: str = "title") -> DataFrame:
    """Every document that some root's expansion names, the roots included, each once."""
    return hops.select(F.col("root").alias(key)).unionByName(hops.select(key)).distinct()


def paths(hops: DataFrame, roots: DataFrame, max_hops: int = 5, key: str = "title") -> DataFrame:
    """(qid, root, path, place, key): the members of each path in reading order.

    Path 0 is the root alone. Path p > 0 belongs to the p-th document of the first hop: the root, the document,
    and all that hangs under it by source, in breadth-first order: by hop, then by the places of the
    sources, then by rank. A pair without a first hop has the root-only path a second time, as path 1.
    """
    pair, order = ["qid", "root"], "order"
    level = hops.where("hop = 1").select(*pair, F.col("rank").alias("path"), F.col(key), F.array("rank").alias(order))
    members = level
    for hop in range(2, max_hops + 1):
        below = hops.where(F.col("hop") == hop).select(*pair, key, "rank", F.col("source_title").alias("source"))
        above = level.select(*pair, "path", F.col(key).alias("source"), order)
        level = below.join(above, [*pair, "source"]).select(*pair, "path", key, F.concat(order, F.array("rank")).alias(order))
        members = members.unionByName(level)
    members = members.groupBy(*pair, "path", key).agg(F.min(F.struct(F.size(order).alias("n"), F.col(order).alias("o"))).alias(order))
    places = members.withColumn("place", F.row_number().over(Window.partitionBy(*pair, "path").orderBy(order))).select(*pair, "path", "place", key)
    lone = roots.select(*pair).join(hops.where("hop = 1").select(*pair).distinct(), pair, "left_anti").select(*pair, F.lit(1).alias("path"))
    every = places.select(*pair, "path").distinct().unionByName(lone).unionByName(roots.select(*pair, F.lit(0).alias("path")))
    return places.unionByName(every.select(*pair, "path", F.lit(0).alias("place"), F.col("root").alias(key)))


def path_texts(members: DataFrame, outlines: DataFrame, key: str = "title") -> DataFrame:
    """(qid, root, path, path_text, doc_titles, num_titles): outlines of a path's documents under [Root Doc], [Doc1], …"""
    rows = members.join(outlines.select(key, "outline"), key)
    name = F.when(F.col("place") == 0, F.lit("[Root Doc]")).otherwise(F.concat(F.lit("[Doc"), F.col("place").cast("string"), F.lit("]")))
    rows = rows.select("qid", "root", "path", F.struct("place", key, F.concat(name, F.lit("\n"), F.col("outline")).alias("text")).alias("d"))
    lists = rows.groupBy("qid", "root", "path").agg(F.array_sort(F.collect_list("d")).alias("d"))
    text: Column = F.array_join(F.transform("d", lambda x: x["text"]), "\n\n")
    return lists.select("qid", "root", "path", text.alias("path_text"), F.transform("d", lambda x: x[key]).alias("doc_titles"), F.size("d").alias("num_titles"))


def last_scores(hops: DataFrame, key: str = "title") -> DataFrame:
    """(qid, key, hop, scores) of each document's last occurrence in a question: later roots and hops win; roots score 100."""
    own = hops.select("qid", "root", key, "hop", "rank", "local_score", "global_score", "total_score")
    top = hops.select("qid", "root").distinct()
    top = top.select("qid", "root", F.col("root").alias(key), F.lit(0).alias("hop"), F.lit(0).alias("rank"), *[F.lit(100.0).alias(f"{s}_score") for s in ("local", "global", "total")])
    latest = F.max_by(F.struct("hop", "local_score", "global_score", "total_score"), F.struct("root", "hop", "rank"))
    return own.unionByName(top).groupBy("qid", key).agg(latest.alias("s")).select("qid", key, "s.*")
