"""Parsers of model outputs, as array expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def paragraph_ids(output: Column) -> Column:
    """Ids of the lines `[paragraph] id: …`, in order, repeats included; none if the output says that nothing is relevant."""
    none = F.contains(F.lower(output), F.lit("no relevant paragraphs"))
    found = F.transform(_lines(output), lambda x: F.regexp_extract(x, r"^\[paragraph\]\s*([+-]?\d+)\s*:", 1))
    ids = F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int"))
    return F.when(output.isNull() | none, F.array().cast("array<int>")).otherwise(ids)


def heading_choices(output: Column) -> Column:
    """struct(title, id) of each line `[heading] id: …` under the last line `[title] …`; none if the output says that nothing is relevant.

    A title stands after the first colon, without = and blanks around; without a colon also without zeros around.
    """
    none = F.contains(F.lower(output), F.lit("no relevant headings"))
    start = F.struct(F.lit("").alias("title"), F.array().cast("array<struct<title:string,id:int>>").alias("found"))

    def step(state: Column, line: Column) -> Column:
        rest = F.substr(line, F.lit(8))
        colon = F.instr(line, ":")
        after = F.btrim(F.trim(F.substr(line, colon + 1)), F.lit("="))
        bare = F.btrim(F.trim(F.btrim(rest, F.lit("0"))), F.lit("="))
        title = F.when(F.startswith(line, F.lit("[title]")), F.trim(F.when(colon > 0, after).otherwise(bare))).otherwise(state["title"])
        number = F.regexp_extract(line, r"^\[heading\]\s*=*\s*([+-]?\d+)\s*=*\s*:", 1)
        taken = (number != "") & (state["title"] != "")
        item = F.array(F.struct(state["title"].alias("title"), number.try_cast("int").alias("id")))
        return F.struct(title.alias("title"), F.when(taken, F.concat(state["found"], item)).otherwise(state["found"]).alias("found"))

    return F.when(output.isNull() | none, start["found"]).otherwise(F.aggregate(_lines(output), start, step, lambda s: s["found"]))


_LINE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("up_id", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("is_intro", T.BooleanType())])


def _outline(text: str | None) -> list[dict]:
    out, open_headings = [], []
    for line in (text or "").split("\n"):
        number, colon, rest = line.strip().partition(":")
        if not colon or not number.isdigit():
            continue
        rest = rest.strip()
        level = len(rest) - len(rest.lstrip("=")) if len(rest) > 1 and rest[0] == rest[-1] == "=" else 0
        up = None
        if level:
            open_headings = [h for h in open_headings if h[1] < level]
            up = open_headings[-1][0] if open_headings else None
            open_headings.append((int(number), level))
        out.append({"id": int(number), "up_id": up, "level": level, "is_intro": not level})
    return out


@F.pandas_udf(T.ArrayType(_LINE))
def outline_headings(outline: pd.Series) -> pd.Series:
    """struct(id, up_id, level, is_intro) of each line `id: …` of an outline; lines that aren't =…= are intro lines, ids that aren't numbers are left out."""
    return pd.Series([_outline(t) for t in outline], dtype=object)
