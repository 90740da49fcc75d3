"""Whole runs: from a dump to the graph, from questions to answers, from answers to scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from dendra.functions.text import title_text
from dendra.operators import context, graph, links, models, tree


def document_graph(pages: DataFrame, embedder: Callable[[], models.Embedder]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trees, vertices, edges) of pages(title, text). One lazy plan from pages to edges; no index files."""
    docs = tree.trees(pages)
    found = links.page_links(pages.join(docs.select("title"), "title", "left_semi"))
    edges = graph.symmetric(graph.edges_from_lists(found, "see_also_docs", "external_docs", "intro_docs"))
    vertices = docs.select("title", tree.intro_of(F.col("nodes")).alias("intro"))
    vertices = vertices.withColumn("embedding", models.embedded(title_text(F.col("title"), F.col("intro"), "\n"), embedder))
    return docs, vertices.join(graph.degrees(vertices, edges), "title"), edges


def outlines_of(docs: DataFrame) -> DataFrame:
    return docs.select("title", tree.outline(F.col("title"), tree.intro_of(F.col("nodes")), tree.headings_of(F.col("nodes"))).alias("outline"))


def answer(
    questions: DataFrame,
    docs: DataFrame,
    vertices: DataFrame,
    edges: DataFrame,
    embedder: Callable[[], models.Embedder],
    generator: Callable[[], models.Generator],
    keep: Callable[[DataFrame, str], DataFrame],
    dataset: str = "generic",
    budget: int | None = 3800,
    mode: str = "tree",
    tokenizer: Callable[[], models.Tokenizer] | None = None,
    **beam,
) -> DataFrame:
    """questions(qid, question, pre_retrieved_passages) with context, prompt and output.

    mode, budget and tokenizer: see context.reader_contexts; items are in the order of their scores. keep(df, name) writes what a model stage made and returns it reread: model calls are never repeated.
    """
    asked = questions.withColumn("query", models.embedded(F.col("question"), embedder))
    seeds = keep(asked.select("qid", "query", F.explode("pre_retrieved_passages").alias("p")).select("qid", F.col("p.title").alias("root"), "query").dropDuplicates(["qid", "root"]), "seeds")
    hops, _ = graph.propagate(seeds, edges, vertices, **beam)
    roots = seeds.join(vertices.select(F.col("title").alias("root")), "root", "left_semi").select("qid", "root")
    outlines = outlines_of(docs)
    texts = graph.path_texts(graph.paths(hops, roots), outlines).join(questions.select("qid", "question"), "qid")
    routed = keep(models.route(texts, generator), "routed")
    chosen = models.chosen_headings(routed, outlines)
    subtrees = chosen.join(docs.select("title", "nodes"), "title").withColumn("document_tree", tree.rendered(F.col("nodes"), tree.lit_by_headings(F.col("nodes"), F.col("headings"))))
    subtrees = subtrees.where("document_tree <> ''").join(questions.select("qid", "question"), "qid")
    from dendra.functions import parsers, prompts

    prompted = subtrees.withColumn("_prompt", prompts.paragraph_prompt(F.col("document_tree"), F.col("question")))
    picked = keep(models.generated(prompted, "_prompt", "raw_output", generator).drop("_prompt"), "picked")
    valid = F.filter(F.array_sort(parsers.paragraph_ids(F.col("raw_output"))), lambda i: F.exists("nodes", lambda n: (n["id"] == i) & (n["type"] == "content")))
    picked = picked.withColumn("cleaned_output", valid).where(F.size("cleaned_output") > 0)
    picked = keep(picked.select("qid", "title", "cleaned_output", tree.rendered(F.col("nodes"), tree.lit_by_paragraphs(F.col("nodes"), F.col("cleaned_output"))).alias("text")), "evidence")
    scored = picked.join(graph.last_scores(hops), ["qid", "title"], "left").withColumn("total_score", F.coalesce("total_score", F.lit(100.0)))
    items = context.score_order(scored, tie="title").withColumnRenamed("place", "at")
    rows = questions.join(context.reader_contexts(questions, items, mode, budget, tokenizer), "qid")
    return keep(models.read(rows, generator, dataset), "answers")
