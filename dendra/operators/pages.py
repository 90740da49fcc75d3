"""Which pages of an encyclopedia dump are articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Titles and marks by which pages are left out.
EXCLUDED_TITLES = ("Stability and Growth Pact", "ROH World Television Championship")
DISAMBIGUATION = ("(disambiguation)", "(disambiguation page)")
NAMESPACES = ("wikipedia:", "category:", "template:", "file:")
COLLECTIONS = ("List", "Index", "Outline")
REDIRECTS = ("#REDIRECT", "#redirect", "#Redirect")


def _any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_article(title: Column, text: Column, excluded: Sequence[str] = EXCLUDED_TITLES) -> Column:
    """Neither a null, nor an excluded title, nor a disambiguation, namespace, collection or redirect page. Plain predicates, so they run in the scan."""
    lower = F.lower(title)
    return (
        title.isNotNull() & text.isNotNull() & ~title.isin(*excluded)
        & ~_any_of([F.contains(lower, F.lit(x)) for x in (*DISAMBIGUATION, *NAMESPACES)])
        & ~title.rlike(f"^({'|'.join(COLLECTIONS)}) of .+")
        & ~_any_of([F.startswith(text, F.lit(x)) for x in REDIRECTS])
    )


def articles(pages: DataFrame, excluded: Sequence[str] = EXCLUDED_TITLES) -> DataFrame:
    return pages.where(is_article(F.col("title"), F.col("text"), excluded))
