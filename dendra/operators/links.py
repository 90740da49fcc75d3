"""Links of wiki pages to other pages: "see also" and "external links" sections, and the introduction; and links of raw web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dendra.functions.markup import clean_markup, heading_level, heading_text
from dendra.operators.shared import cut

#: A template line with one of these names no page.
NO_PAGE = ("Authority control", "DEFAULTSORT:", "commonscat-inline", "s-start", "s-off", "s-end", "|", "{", "}", "Commons category")
#: What a link of a list item, and a link of an introduction, looks like.
LIST_LINK, INTRO_LINK = r"\[\[([^\]]+)\]\]", r"\[\[([^|\]]+\|)?([^\]]+)\]\]"
#: A line feed before a heading line.
_BEFORE_HEADING = r"\n(?=[^\S\n]*(={2,})[^\S\n]*(.*?)[^\S\n]*\1)"
KINDS = ("see_also", "external", "intro")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _sections(text: Column) -> Column:
    """array<struct<heading, lines>>: the text cut before each heading line; lines are stripped and not empty, the heading is in lower case, null before the first."""

    def section(lines: Column) -> Column:
        headed = heading_level(lines[0]) > 0
        inside = F.when(headed, F.slice(lines, 2, F.size(lines))).otherwise(lines)
        return F.struct(F.when(headed, F.lower(heading_text(lines[0]))).alias("heading"), F.filter(inside, lambda x: x != "").alias("lines"))

    return F.transform(F.transform(F.split(text, _BEFORE_HEADING), lambda s: F.transform(F.split(s, "\n"), _stripped)), section)


def _lines_of(sections: Column, wanted) -> Column:
    return F.flatten(F.transform(F.filter(sections, wanted), lambda s: s["lines"]))


def section_links(text: Column) -> Column:
    """struct(see_also, external): raw link texts of a raw page, in their order. A section ends at the next heading of any level. Null without text.

    In "see also" sections the links of list items count, without those that hold brackets or braces; in "external links" sections the lines that are one template.
    """
    sections = _sections(text)
    is_external = lambda s: F.coalesce(F.contains(s["heading"], F.lit("external links")), F.lit(False))
    items = F.filter(_lines_of(sections, lambda s: ~is_external(s) & F.contains(s["heading"], F.lit("see also"))), lambda x: F.startswith(x, F.lit("*")))
    linked = F.filter(F.flatten(F.transform(items, lambda x: F.regexp_extract_all(x, F.lit(LIST_LINK)))), lambda x: ~x.rlike(r"[\[\]{}]"))
    shown = F.filter(F.transform(linked, lambda x: F.trim(F.element_at(F.split(x, r"\|"), -1))), lambda x: x != "")
    templates = F.filter(_lines_of(sections, is_external), lambda x: (F.length(x) >= 4) & F.startswith(x, F.lit("{{")) & F.endswith(x, F.lit("}}")))
    inner = F.transform(templates, lambda x: F.trim(F.substr(x, F.lit(3), F.length(x) - 4)))
    no_page = "|".join(f"\\Q{k.lower()}\\E" for k in NO_PAGE)
    named = F.transform(inner, lambda x: F.when(F.contains(x, F.lit("|state=")), F.trim(F.split(x, r"\|")[0])).when(~F.lower(x).rlike(no_page), x))
    return F.when(text.isNotNull(), F.struct(shown.alias("see_also"), F.filter(named, lambda x: x.isNotNull()).alias("external")))


def intro_links(cleaned: Column) -> Column:
    """Display texts of the links before the first heading of a page that was cleaned with its links kept."""
    lines = _lines_of(F.slice(_sections(cleaned), 1, 1), lambda s: s["heading"].isNull())
    found = F.flatten(F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(INTRO_LINK), 2), lambda x: F.trim(x))))
    return F.filter(found, lambda x: x != "")


def title_names(titles: DataFrame, order: str = "order") -> DataFrame:
    """(lower, target): the title that each lower-case spelling stands for; of several the last by `order` (ties: the last title)."""
    return titles.groupBy(F.lower("title").alias("lower")).agg(F.max_by("title", F.struct(order, "title")).alias("target"))


def resolve(links: DataFrame, names: DataFrame, key: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(key, <kind>_docs for each kind): link texts as titles, in order, each once; unresolved ones are left out. One row for each key that resolves any.

    links: (key, one list a kind) with distinct keys. names: title_names().
    """
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in kinds])
    rows = links.select(F.col(key).alias("row"), F.explode(every).alias("x")).select("row", "x.kind", F.posexplode("x.found").alias("at", "text"))
    rows = rows.join(names, F.lower("text") == F.col("lower"))
    first = rows.groupBy("row", "kind", "target").agg(F.min("at").alias("at"))
    ordered = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("at", "target")))), lambda x: x["target"])
    return first.groupBy(F.col("row").alias(key)).agg(*[ordered(k).alias(f"{k}_docs") for k in kinds])


def page_links(pages: DataFrame, order: str | None = None) -> DataFrame:
    """(title, three raw lists, three resolved lists), one row for each page of pages(title, text), repeated titles included.

    Link texts name titles whatever the case; of several spellings the page last by `order` wins, by default the one last in the source. Links are found in array
    expressions within a page; only lists are written to the checkpoint folder and shuffled, texts never. Pages without text have empty lists.
    """
    empty = F.array().cast("array<string>")
    found = pages.select("title", F.monotonically_increasing_id().alias("row"), *([F.col(order).alias("order")] if order else []), section_links(F.col("text")).alias("s"), intro_links(clean_markup(F.col("text"), keep_links=True)).alias("i"))
    raw = found.select("title", "row", F.col("order" if order else "row").alias("order"), F.coalesce("s.see_also", empty).alias("see_also"), F.coalesce("s.external", empty).alias("external"), F.coalesce("i", empty).alias("intro"))
    raw = cut(raw)
    resolved = raw.join(resolve(raw, title_names(raw), "row"), "row", "left")
    return resolved.select("title", *KINDS, *[F.coalesce(f"{k}_docs", empty).alias(f"{k}_docs") for k in KINDS])


def html_links(url: Column, html: Column) -> Column:
    """The pages that a web page links, each once, in order: quoted targets of its <a> elements without fragments.

    Targets with a leading slash belong to the page's host; fragments of the page itself and targets of other schemes (mail, scripts) are no pages. Null without html.
    """
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", 0)
    targets = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']+)["']"""), 1), lambda t: F.regexp_replace(F.trim(t), "#.*$", ""))
    pages = F.filter(targets, lambda t: (t != "") & (t.rlike("(?i)^https?://") | ~t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")))
    return F.array_distinct(F.transform(pages, lambda t: F.when(F.startswith(t, F.lit("/")) & ~F.startswith(t, F.lit("//")), F.concat(host, t)).otherwise(t)))
