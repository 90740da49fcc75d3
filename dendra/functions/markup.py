"""Wiki markup: cleaning, headings and list items."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, functions as F, types as T

#: Possessive, as nothing that it takes could be given back for a match; so no state is kept for each character.
_BALANCED = regex.compile(r"\{\{(?:[^{}]++|(?R))*+\}\}")


def strip_edge_templates(text: str) -> str:
    """Without the balanced {{…}} that touch the start or end of a line; those inside a line stay."""
    out, at = [], 0
    for found in _BALANCED.finditer(text):
        a, b = found.span()
        if a == 0 or b == len(text) or text[a - 1] == "\n" or text[b] == "\n":
            out.append(text[at:a])
            at = b
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def edge_templates_removed(text: pd.Series) -> pd.Series:
    """Balanced braces can't be matched by Java's regular expressions, so this step runs in Arrow batches."""
    return text.map(lambda t: t if t is None or "{{" not in t else strip_edge_templates(t))


#: The rewrites that follow template removal, in their order: (pattern, replacement).
LINK = (r"\[\[([^|\]]+\|)?([^\]]+)\]\]", "$2")
REWRITES = (
    (r"(?s)\{\{[cC]ite ?.*?\}\}", ""),
    (r"(?s)\{\{[cC]itation.*?\}\}", ""),
    (r"(?s)\{\|(?:[^{}]|\{[^{}]*\})*\|\}", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"\[\[Category:.*?\]\]", ""),
    (r"(?s)<gallery>.*?</gallery>", ""),
    (r"(?s)<gallery[^>/]*?>.*?</gallery>", ""),
    (r"(?m)^\s*\[\[[Ff]ile:.*?\]\]\s*$", ""),
    (r"(?s)\[\[[Ff]ile:.*?\]\]", ""),
    (r"(?m)^\s*\[\[[Ii]mage:.*?\]\]\s*$", ""),
    (r"(?s)\[\[[Ii]mage:.*?\]\]", ""),
    LINK,
    (r"(?s)<ref>.*?</ref>", ""),
    (r"(?s)<ref[^>/]*?>.*?</ref>", ""),
    (r"(?s)&lt;ref&gt;.*?&lt;/ref&gt;", ""),
    (r"<.*?/>", ""),
    (r"(?s)<.*?>", ""),
    (r"(?s)&lt;.*?&gt;", ""),
    (r"&[a-zA-Z0-9#]+;", ""),
    (r"\[https?:\/\/[^\] ]+(?: ([^\]]+))?\]", "$1"),
    (r"(?m)^\s*[|!{}].*$", ""),
    (r"\n+", "\n"),
)

#: Java repeats a group by recursion, which overflows the stack (and ends the executor) within some thousand characters. This form of a table matches the same text in a
#: loop: its end is the first outer brace that closes, so nothing that was taken is ever given back.
IN_LOOPS = {r"(?s)\{\|(?:[^{}]|\{[^{}]*\})*\|\}": r"(?s)\{\|(?:[^{}|]++|\|(?!\})|\{[^{}]*+\})*+\|\}"}


def clean_markup(text: Column, keep_links: bool = False) -> Column:
    """Plain text of wiki markup; with keep_links the [[…]] stay for link extraction."""
    out = edge_templates_removed(text)
    for pattern, by in REWRITES:
        if not (keep_links and (pattern, by) == LINK):
            out = F.regexp_replace(out, IN_LOOPS.get(pattern, pattern), by)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


#: A heading is a run of = at a line's start, its text, and the same run; a list item is colons, * or #, and its text.
HEADING = r"^(={2,})\s*(.*?)\s*\1"
LIST_ITEM = r"^(:*)([*#]+)\s*(.*)"


def heading_level(line: Column) -> Column:
    """Number of = of a heading line, 0 for others."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, HEADING, 2))
