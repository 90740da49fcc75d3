"""Text expressions: answer normalization, citations and answer lists. All run as JVM expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The ASCII punctuation that normalization removes, and its articles.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
_WORD_EDGE = r"[\p{L}\p{N}_]"


def normalize_answer(text: Column) -> Column:
    """Lower case, then no punctuation, then no articles, then single blanks; null stays null."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    without = F.regexp_replace(bare, rf"(?<!{_WORD_EDGE})({'|'.join(ARTICLES)})(?!{_WORD_EDGE})", " ")
    return F.trim(F.regexp_replace(without, r"(?U)\s+", " "))


def tokens(normalized: Column) -> Column:
    """Blank-separated tokens; no token for an empty text."""
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(F.split(normalized, " "))


def strip_citations(text: Column) -> Column:
    """Without [n marks (and a blank before them), " |" and closing brackets."""
    marked = F.regexp_replace(F.regexp_replace(text, r" \[[0-9]+", ""), r"\[[0-9]+", "")
    return F.replace(F.replace(marked, F.lit(" |"), F.lit("")), F.lit("]"), F.lit(""))


def citation_ids(text: Column) -> Column:
    """Zero-based document numbers of the citations, in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)")), lambda n: n.cast("int") - 1)


def trim_output(text: Column) -> Column:
    """Without line feeds, full stops, commas and blanks at both ends."""
    return F.btrim(text, F.lit("\n., "))


def clean_output(text: Column) -> Column:
    """As evaluators read it: stripped, on one line, without the end-of-turn mark."""
    return F.replace(F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" ")), F.lit("<|im_end|>"), F.lit(""))


def after_reasoning(text: Column) -> Column:
    """What follows the first colon; empty without one."""
    at = F.instr(text, ":")
    return F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))


def list_answers(text: Column) -> Column:
    """Comma-separated answers without a final full stop or comma, each trimmed and normalized; empty ones are left out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), r"\.+$", ""), r",+$", "")
    return F.filter(F.transform(F.split(bare, ","), normalize_answer), lambda a: a != "")


def bullet_answers(output: Column, question: Column) -> Column:
    """Answers of bullet lines (*, + or a number), joined by ", ".

    A candidate with a capital Q, or that the question contains, is left out; quotes around an answer and
    parentheses in it are removed. No bullet line gives an empty text.
    """
    lines = F.transform(F.regexp_extract_all(output, F.lit(r"(?m)^\s*(?:[*+]|[0-9]+\.)\s+(.*)$")), lambda x: F.trim(x))
    kept = F.filter(lines, lambda c: ~F.contains(c, F.lit("Q")) & ~F.contains(question, c))
    unquoted = F.transform(kept, lambda c: F.trim(F.btrim(F.btrim(c, F.lit('"')), F.lit("'"))))
    bare = F.transform(unquoted, lambda c: F.trim(F.regexp_replace(c, r"\([^)]*\)", "")))
    return F.array_join(F.filter(bare, lambda c: c != ""), ", ")


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def head_words(text: Column, n: int = 100) -> Column:
    """The first n words joined by blanks, without punctuation at the end."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), r"[!-/:-@\[-`{-~]+$", "")


def title_text(title: Column, text: Column, separator: str = " ") -> Column:
    """Document as one text: " " for sparse search, ". " for dense search, a line feed for embedding."""
    return F.concat(title, F.lit(separator), text)


def evidence_text(title: Column, sentence: Column, text: Column) -> Column:
    """Premise for entailment: the title line, then the chosen sentence or else the whole text."""
    return F.concat(F.lit("Title: "), title, F.lit("\n"), F.coalesce(sentence, text))


def sentences(text: Column) -> Column:
    """Sentences by their final mark and the blank after it; the default where no model splits them."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def force_citations(text: Column, shown: Column) -> Column:
    """Each sentence without its own citations and with those of the shown documents (numbers from 0) in front."""
    marks = F.array_join(F.transform(shown, lambda n: F.concat(F.lit("["), (n + 1).cast("string"), F.lit("]"))), "")
    return F.array_join(F.transform(sentences(strip_citations(text)), lambda s: F.concat(marks, F.lit(" "), s)), " ")


def force_list_citations(text: Column, shown: Column) -> Column:
    """Each comma-separated answer without its own citations and with those of the shown documents (numbers from 0) in front; a comma and a blank end the list."""
    marks = F.array_join(F.transform(shown, lambda n: F.concat(F.lit("["), (n + 1).cast("string"), F.lit("]"))), "")
    bare = F.regexp_replace(F.rtrim(strip_citations(text)), ",+$", "")
    return F.concat(F.array_join(F.transform(F.split(bare, ","), lambda a: F.concat(marks, F.lit(" "), F.trim(a))), ", "), F.lit(", "))


def hit_fields(document_id: Column) -> Column:
    """struct(title, url) of search hits whose id is a JSON object."""
    return F.from_json(document_id, "title string, url string")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, applied to titles on both sides of a lookup."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
