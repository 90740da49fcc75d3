"""What a reader sees: order of evidence, the token budget, and the assembled context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from dendra.functions.text import word_count
from dendra.operators import models
from dendra.operators.shared import running, unused

MODES = ("none", "passages", "tree", "matched", "interleaved")


def _placed(items: DataFrame, key: str, order: list[tuple[str, bool]]) -> DataFrame:
    return running(items, key, order, F.lit(1), lambda before, total: {"place": (before + 1).cast("int")})


def interleaved(items: DataFrame, key: str = "qid", score: str = "total_score", tie: str = "at") -> DataFrame:
    """items with `place`: by decreasing score the 1st, 3rd, 5th … come first and …, 6th, 4th, 2nd last."""

    def place(before: Column, total: Column) -> dict[str, Column]:
        half = F.floor(before / 2)
        return {"place": F.when(before % 2 == 0, half + 1).otherwise(total - half).cast("int")}

    return running(items, key, [(score, True), (tie, False)], F.lit(1), place)


def matched_first(items: DataFrame, passages: DataFrame, key: str = "qid", title: str = "title", order: str = "at") -> DataFrame:
    """items with `place`: those whose title was retrieved before, then the others, each in their order."""
    later, known_key, known_title = unused(items, "later"), unused(items, "known_key"), unused(items, "known_title")
    known = passages.select(F.col(key).alias(known_key), F.trim(F.col(title)).alias(known_title)).distinct()
    rows = items.join(known, (F.col(key) == F.col(known_key)) & (F.trim(F.col(title)) == F.col(known_title)), "left")
    rows = rows.withColumn(later, F.col(known_title).isNull().cast("int")).drop(known_key, known_title)
    return _placed(rows, key, [(later, False), (order, False)]).drop(later)


def score_order(items: DataFrame, key: str = "qid", score: str = "total_score", tie: str = "at") -> DataFrame:
    """items with `place`, by decreasing score."""
    return _placed(items, key, [(score, True), (tie, False)])


def within_budget(items: DataFrame, budget: int, key: str = "qid", order: str = "place", text: str = "text", length: Column | None = None, prefix: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The longest prefix of each group whose lengths sum to at most `budget`, and the next item cut to what remains; nothing after it.

    Lengths count blank-separated words, and prefix(text, n) takes the first n of them, unless others are given; models.token_count and models.token_prefix do both in tokens.
    Texts are measured once, then only their lengths are dealt out and summed, and the texts that stay are fetched; only the item that crosses the budget is cut.
    """
    size, left = unused(items, "size"), unused(items, "left")
    rows = items.withColumn(size, word_count(F.col(text)) if length is None else length)
    rows = running(rows, key, [(order, False)], F.col(size), lambda before, total: {left: F.lit(budget) - before}, keep=lambda before, total: before <= budget)
    some = F.greatest(F.lit(0), F.col(left)).cast("int")
    crosses = F.col(size) > F.col(left)
    fitted = first_words(F.col(text), some) if prefix is None else prefix(F.when(crosses, F.col(text)), some)
    return rows.withColumn(text, F.when(crosses, fitted).otherwise(F.col(text))).select(items.columns)


def first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def reader_contexts(
    questions: DataFrame, items: DataFrame, mode: str, budget: int | None = None, tokenizer: Callable[[], models.Tokenizer] | None = None, top_k: int = -1, key: str = "qid", text: str = "text", order: str = "at"
) -> DataFrame:
    """(key, context) of every question, by mode; an empty text where there is nothing to show.

    none: nothing. passages: the retrieved passages of questions.pre_retrieved_passages (array<struct<title, text>>), the first top_k or all. tree: the
    items' texts in their order, within the budget if there is one. matched: those of retrieved titles first. interleaved: by decreasing total_score from both ends.
    items: (key, order, title, total_score, text). A budget counts the tokenizer's tokens, or words without one; only `tree` has one. Items without text are left out.
    """
    if mode not in MODES:
        raise ValueError(f"mode is {mode}, not one of {MODES}")
    asked = questions.select(key)
    if mode == "none":
        return asked.withColumn("context", F.lit(""))
    if mode == "passages":
        shown = passages_context(F.col("pre_retrieved_passages"), top_k)
        return questions.select(key, F.coalesce(shown, F.lit("")).alias("context"))
    items = items.where(F.col(text).isNotNull() & (F.col(text) != ""))
    if mode == "matched":
        titles = questions.select(key, F.explode("pre_retrieved_passages").alias("p")).select(key, F.col("p.title").alias("title"))
        items, order = matched_first(items, titles, key, order=order), "place"
    elif mode == "interleaved":
        items, order = interleaved(items, key, tie=order), "place"
    elif budget is not None:
        length = None if tokenizer is None else models.token_count(F.col(text), tokenizer)
        prefix = None if tokenizer is None else lambda t, n: models.token_prefix(t, n, tokenizer)
        items = within_budget(items, budget, key, order, text, length, prefix)
    return asked.join(assembled(items, key, order, text), key, "left").withColumn("context", F.coalesce("context", F.lit("")))


def assembled(items: DataFrame, key: str = "qid", order: str = "place", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, context): the items' texts in their order."""
    rows = items.where((F.col(text).isNotNull()) & (F.col(text) != ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
    return rows.groupBy(key).agg(joined.alias("context"))


def passages_context(passages: Column, top_k: int = -1) -> Column:
    """Retrieved passages as `title`, line feed, text, joined by empty lines; top_k > 0 takes the first ones."""
    taken = F.slice(passages, 1, top_k) if top_k > 0 else passages
    return F.array_join(F.transform(taken, lambda p: F.concat(F.coalesce(p["title"], F.lit("")), F.lit("\n"), F.coalesce(p["text"], F.lit("")))), "\n\n")


def shortened(docs: Column, field: str, n: int) -> Column:
    """Up to n documents before the first that lacks the short form, those it calls irrelevant left out; if none stays, the first n in full."""
    gap = F.array_position(F.transform(docs, lambda d: d[field].isNull()), True)
    before = F.when(gap > 0, F.slice(docs, 1, F.greatest(F.lit(0), gap.cast("int") - 1))).otherwise(docs)
    good = F.slice(F.filter(before, lambda d: ~F.contains(d[field], F.lit("rrelevant"))), 1, n)
    return F.when(F.size(good) > 0, good).otherwise(F.slice(docs, 1, n))
