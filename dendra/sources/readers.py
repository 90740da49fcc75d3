"""Readers: dumps, documents, questions, results and settings. Schemas are given wherever the format has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dendra.schemas import MEDIAWIKI


def mediawiki_pages(spark: SparkSession, path: str, glob: str = "*.xml*") -> DataFrame:
    """(title, text) of each page of XML dumps, by its last revision; pages without a revision are left out, the text may be null."""
    pages = spark.read.format("xml").option("rowTag", "page").option("pathGlobFilter", glob).schema(MEDIAWIKI).load(path)
    return pages.where(F.size("revision") > 0).select("title", F.element_at("revision", -1)["text"].alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, skip_malformed: bool = False) -> DataFrame:
    """One object per line. Malformed lines raise an error, or are left out."""
    return spark.read.option("mode", "DROPMALFORMED" if skip_malformed else "FAILFAST").schema(schema).json(path)


def json_lines_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the objects of the lines that fit the schema, and (file, n, malformed) of each file, so that what is left out is known.

    Malformed lines are those that Spark's reader marks as corrupt: no JSON object, or a value of another type. Both tables read the file once each, without a cache.
    """
    mark = "_corrupt_record"
    lines = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", mark).schema(f"{schema}, {mark} string").json(path)
    parsed = F.length(F.to_json(F.struct(*[c for c in lines.columns if c != mark])))  # a line is told to be corrupt only by parsing its fields
    counts = lines.select(F.col("_metadata.file_path").alias("file"), (F.col(mark).isNotNull() & (parsed > 0)).alias("bad"))
    counts = counts.groupBy("file").agg(F.count("*").alias("n"), F.count_if("bad").alias("malformed"))
    return lines.where(F.col(mark).isNull()).drop(mark), counts


def json_document(spark: SparkSession, path: str, schema: str, inside: str | None = None) -> DataFrame:
    """A JSON file that is an array or an object; with `inside` the rows are the array of that name in each object."""
    reader = spark.read.option("multiLine", True)
    if inside is None:
        return reader.schema(schema).json(path)
    return reader.schema(f"`{inside}` array<struct<{_as_struct(schema)}>>").json(path).select(F.inline(inside))


def _as_struct(schema: str) -> str:
    """A top-level DDL schema as the fields of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema))


def tab_separated(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(id, text, title) of passages; the header line is left out, quotes have no meaning."""
    return spark.read.option("sep", "\t").option("header", header).option("quote", "").schema("id string, text string, title string").csv(path)


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text, document) where document is title, line feed, text."""
    return tab_separated(spark, path).select("id", "title", "text", F.concat("title", F.lit("\n"), "text").alias("document"))


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .parquet, .jsonl, .json, .txt (column value); others raise an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".txt"):
        return spark.read.text(path)
    if path.endswith((".jsonl", ".json")):
        reader = spark.read.option("multiLine", path.endswith(".json"))
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"no reader for {path}")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of questions; other formats raise an error."""
    if not path.endswith(".parquet"):
        raise ValueError(f"Parquet is expected: {path}")
    return spark.read.parquet(path)


def first_of_each(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; a grouped minimum, so that no window sorts a frequent key."""
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("v")).select(key, "v.*")


def title_index(trees: DataFrame) -> DataFrame:
    """(title, file, row) of the first document of each title, by file name and place in the file."""
    rows = trees.select("title", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return first_of_each(rows, "title", ["file", "row"])


def by_titles(docs: DataFrame, titles: DataFrame, columns: Sequence[str], key: str = "title") -> DataFrame:
    """The named columns of the documents that are asked for; a title that isn't there raises an error."""
    from dendra.functions.text import nfc

    wanted = titles.select(nfc(F.col(key)).alias("wanted")).distinct()
    found = docs.select(*columns).withColumn("wanted", nfc(F.col(key))).join(wanted, "wanted", "left_semi")
    missing = wanted.join(found.select("wanted"), "wanted", "left_anti").limit(5).collect()
    if missing:
        raise LookupError(f"no documents for {[r.wanted for r in missing]}")
    return found.drop("wanted")


def settings(path: str, given: dict | None = None, defaults: dict | None = None) -> dict:
    """Defaults, overridden by a YAML file, overridden by what is given explicitly."""
    import yaml

    with open(path) as f:
        return {**(defaults or {}), **(yaml.safe_load(f) or {}), **{k: v for k, v in (given or {}).items() if v is not None}}
