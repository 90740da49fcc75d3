"""Documents as trees: from text to nodes, pruning, spans, lighting and rendering.

A tree is small and sequential, so it is built row by row inside Arrow batches. Its nodes carry the end of
their subtree (ids are in document order), which makes ancestors and descendants interval conditions: all later tree
operators are joins or array expressions without recursion.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dendra.functions.markup import HEADING, LIST_ITEM, clean_markup
from dendra.operators.pages import articles
from dendra.operators.shared import bound_batches
from dendra.schemas import NODE

#: A section whose heading contains one of these is left out with all below it.
BOILERPLATE = ("external links", "notes", "references", "see also", "gallery", "images", "pictures", "photographs", "sources", "citations")
_HEADING, _ITEM = re.compile(HEADING), re.compile(LIST_ITEM)
#: Documents whose nodes are Python objects at once; a batch of rows is taken in slices of so many, so a worker's memory doesn't grow with the table.
SLICE = 32
_INT, _STRING = pa.int32(), pa.string()
_NODES = pa.list_(pa.struct({"id": _INT, "text": _STRING, "type": _STRING, "up_id": _INT, "down_ids": pa.list_(_INT), "span_start": _INT, "span_end": _INT, "level": _INT, "subtree_end": _INT}.items()))


def _slices(*columns: pa.Array):
    """The columns as lists of Python objects, SLICE rows at a time."""
    for at in range(0, len(columns[0]), SLICE):
        yield [c.slice(at, SLICE).to_pylist() for c in columns]


def _classified(text: str, lists: bool):
    """(kind, level, text) of each line that counts; kind is title, item or content."""
    for line in text.split("\n"):
        if not line or line.lower().startswith(("[[file:", "file:")):
            continue
        if m := _HEADING.match(line):
            yield "title", len(m[1]), m[2].strip()
        elif lists and (m := _ITEM.match(line)):
            if m[3].strip():
                yield "item", len(m[1]) + len(m[2]), f"{m[1]}{m[2]} {m[3].strip()}"
        elif line.strip():
            yield "content", 0, line.strip()


def parse_nodes(title: str, text: str, lists: bool = True, boilerplate: tuple[str, ...] = BOILERPLATE) -> list[dict]:
    """Nodes in document order; the root has id 0 and level 1.

    A heading hangs under the nearest heading before it with a smaller level, a paragraph under the current
    heading, a list item under the nearest smaller item of its run or else under the node before the run.
    """
    nodes = [{"id": 0, "text": title, "type": "title", "up_id": None, "level": 1}]
    headings, run, before_run, skipped = [nodes[0]], [], None, None
    for kind, level, content in _classified(text, lists):
        if kind == "title":
            skipped = None if skipped is not None and level <= skipped else skipped
            if skipped is None and any(k in content.lower() for k in boilerplate):
                skipped = level
        if skipped is not None:
            continue
        if kind == "title":
            headings = [h for h in headings if h["level"] < level]
            up, content = headings[-1], "=" * level + content + "=" * level
        elif kind == "item":
            before_run = before_run or nodes[-1]
            run = [(n, v) for n, v in run if v < level]
            up = run[-1][0] if run else before_run
        else:
            up = headings[-1]
        nodes.append({"id": len(nodes), "text": content, "type": "title" if kind == "title" else "content", "up_id": up["id"], "level": level if kind == "title" else 0})
        if kind == "title":
            headings.append(nodes[-1])
        if kind == "item":
            run.append((nodes[-1], level))
        else:
            run, before_run = [], None
    return nodes


def finish(nodes: list[dict], prune: bool = True) -> tuple[list[dict], str]:
    """(nodes with ids, children, spans and subtree ends; full text). With prune, headings without content below go and ids close up."""
    parent = {n["id"]: n["up_id"] for n in nodes}
    if prune:
        alive = {0}
        for n in nodes:
            at = n["id"] if n["type"] == "content" else None
            while at is not None and at not in alive:
                alive.add(at)
                at = parent[at]
        nodes = [n for n in nodes if n["id"] in alive]
    number = {n["id"]: i for i, n in enumerate(nodes)}
    out, parts, at = [], [], 0
    for i, n in enumerate(nodes):
        start = end = None
        if i == 0 or n["type"] == "content":
            if n["type"] == "content":
                start, end = at, at + len(n["text"])
            parts.append(n["text"])
            at += len(n["text"]) + 1
        out.append({**n, "id": i, "up_id": None if n["up_id"] is None else number[n["up_id"]], "down_ids": [], "span_start": start, "span_end": end, "subtree_end": i})
    for n in reversed(out[1:]):
        up = out[n["up_id"]]
        up["down_ids"].insert(0, n["id"])
        up["subtree_end"] = max(up["subtree_end"], n["subtree_end"])
    return out, "\n".join(parts)


def trees(pages: DataFrame, clean: bool = True, lists: bool = True, prune: bool = True) -> DataFrame:
    """(title, num_nodes, nodes, full_text) of each article. Filters run before cleaning, cleaning before Python builds the trees."""
    kept = articles(pages).select("title", (clean_markup(F.col("text")) if clean else F.col("text")).alias("text"))
    bound_batches(pages.sparkSession)

    def built(batches):
        for batch in batches:
            for titles, texts in _slices(*batch.columns):
                made = [finish(parse_nodes(t, x, lists), prune) for t, x in zip(titles, texts)]
                columns = [pa.array(titles, _STRING), pa.array([len(n) for n, _ in made], _INT), pa.array([n for n, _ in made], _NODES), pa.array([f for _, f in made], _STRING)]
                yield pa.RecordBatch.from_arrays(columns, ["title", "num_nodes", "nodes", "full_text"])

    return kept.mapInArrow(built, f"title string, num_nodes int, nodes array<{NODE}>, full_text string")


def nodes_of(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per node."""
    return docs.select(*(keys or ("title",)), F.inline("nodes"))


def intro_of(nodes: Column) -> Column:
    """Content before the first heading, joined by line feeds; the root is not counted."""
    later = F.filter(nodes, lambda n: (n["type"] == "title") & (n["id"] > 0))
    first = F.coalesce(F.array_min(F.transform(later, lambda n: n["id"])), F.lit(2**31 - 1))
    return F.array_join(F.transform(F.filter(nodes, lambda n: (n["id"] > 0) & (n["id"] < first)), lambda n: n["text"]), "\n")


def headings_of(nodes: Column) -> Column:
    """(id, text) of the headings below the root."""
    return F.transform(F.filter(nodes, lambda n: (n["type"] == "title") & (n["id"] > 0)), lambda n: F.struct(n["id"].alias("id"), n["text"].alias("text")))


def outline(title: Column, intro: Column, headings: Column) -> Column:
    """Lines `id: text`: the title, the intro's lines numbered from 1, and the headings by their ids, indented by level."""
    lines = F.transform(F.split(F.regexp_replace(intro, r"^\s+|\s+$", ""), "\n"), lambda line, i: F.when(F.trim(line) != "", F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(": "), F.trim(line))))
    shown = F.transform(
        F.filter(headings, lambda h: F.trim(h["text"]) != ""),
        lambda h: F.concat(F.repeat(F.lit(" "), 4 * (F.length(F.regexp_extract(F.trim(h["text"]), "^(=*)", 1)) - 1)), h["id"].cast("string"), F.lit(": "), F.trim(h["text"])),
    )
    top = F.array(F.concat(F.lit("0: ="), title, F.lit("=")))
    return F.array_join(F.concat(top, F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.isNotNull()), shown), "\n")


def _lit(nodes, chosen: list[int], with_intro: bool, with_siblings: bool, below: bool) -> list[int]:
    known = {n["id"]: n for n in nodes}
    chosen = [c for c in chosen if c in known and (c or below)]
    lit, above = {0} if below else set(), set()
    for c in chosen:
        at = known[c]["up_id"]
        while at is not None and at not in above:
            above.add(at)
            at = known[at]["up_id"]
        if c:
            lit.update(range(c, (known[c]["subtree_end"] if below else c) + 1))
    lit |= above
    for n in nodes:
        if n["type"] == "content" and ((with_intro and n["up_id"] == 0) or (with_siblings and n["up_id"] in above)):
            lit.add(n["id"])
    return sorted(lit)


def lit_by_headings(nodes: Column, headings: Column, with_intro: bool = True, with_siblings: bool = True) -> Column:
    """Ids that the chosen headings light: the root, and each heading's subtree and ancestors; unknown ids light nothing.

    with_intro: also content directly under the root. with_siblings: also content directly under each ancestor of a chosen heading.
    """

    @F.arrow_udf("array<int>")
    def run(nodes: pa.Array, headings: pa.Array) -> pa.Array:
        return pa.array([_lit(n, h, with_intro, with_siblings, True) for some in _slices(nodes, headings) for n, h in zip(*some)], pa.list_(_INT))

    return run(nodes, headings)


def lit_by_paragraphs(nodes: Column, ids: Column) -> Column:
    """Ids of the chosen content nodes and of their ancestors."""

    def lit(nodes: list[dict], chosen: list[int]) -> list[int]:
        content = {n["id"] for n in nodes if n["type"] == "content"}
        return _lit(nodes, [i for i in chosen if i in content], False, False, False)

    @F.arrow_udf("array<int>")
    def run(nodes: pa.Array, ids: pa.Array) -> pa.Array:
        return pa.array([lit(n, chosen) for some in _slices(nodes, ids) for n, chosen in zip(*some)], pa.list_(_INT))

    return run(nodes, ids)


def rendered(nodes: Column, lit: Column) -> Column:
    """Lines `id: text` of lit nodes whose parents are shown too, indented by depth. Document order is the order of ids."""

    def shown(nodes: list[dict], ids: list[int]) -> str:
        ids, depth, lines = set(ids), {}, []
        for n in nodes:
            if n["id"] in ids and (n["up_id"] is None or n["up_id"] in depth):
                depth[n["id"]] = 0 if n["up_id"] is None else depth[n["up_id"]] + 1
                text = f"={n['text']}=" if n["id"] == 0 else n["text"]
                lines.append(f"{'    ' * depth[n['id']]}{n['id']}: {text}")
        return "\n".join(lines)

    @F.arrow_udf("string")
    def run(nodes: pa.Array, lit: pa.Array) -> pa.Array:
        return pa.array([shown(n, ids) for some in _slices(nodes, lit) for n, ids in zip(*some)], _STRING)

    return run(nodes, lit)


def plain_tree(nodes: Column) -> Column:
    """Two levels: the root and all content, numbered 1 to n."""
    content = F.transform(F.filter(nodes, lambda n: n["type"] == "content"), lambda n: n["text"])
    root = F.filter(nodes, lambda n: n["id"] == 0)[0]
    lines = F.transform(content, lambda t, i: F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(": "), t))
    return F.array_join(F.concat(F.array(F.concat(F.lit("0: ="), root["text"], F.lit("="))), lines), "\n")


def innermost_headings(selected: DataFrame, headings: DataFrame, key: str = "doc") -> DataFrame:
    """(key, headings): the selected ids that exist and have no selected direct child; 0 always stays, and stands in for a selected intro line.

    selected: (key, id). headings: (key, id, up_id, is_intro), the lines of each outline, 0 included.
    """
    valid = selected.select(key, "id").distinct().join(headings, [key, "id"])
    parents = valid.where(~F.col("is_intro")).select(key, F.col("up_id").alias("id")).distinct()
    inner = valid.where(~F.col("is_intro") & (F.col("id") > 0)).join(parents, [key, "id"], "left_anti").select(key, "id")
    zero = valid.where((F.col("id") == 0) | F.col("is_intro")).select(key, F.lit(0).alias("id"))
    return inner.unionByName(zero).distinct().groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("headings"))
