"""Writers, resumed runs and reports. Spark's commit protocol makes each write whole or absent, so nothing is rewritten to append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Fixed values, USD per 1000 tokens: (prompt, completion) of each model.
PRICES = {"gpt-3.5-turbo": (0.0015, 0.002), "gpt-3.5-turbo-16k": (0.003, 0.004), "gpt-4": (0.03, 0.06), "gpt-4-32k": (0.06, 0.12)}


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_results(rows: DataFrame, path: str, dataset: str) -> None:
    """Final answers as one JSON document: a bare list for generic data, {"data": […], "config": {}} for others.

    The document is a single file by its format, so its rows pass one task as a stream of lines.
    """
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    opening, closing = ("[", "]") if dataset == "generic" else ('{"data": [', '], "config": {}}')

    def document(batches):
        import pyarrow as pa

        first = True
        yield pa.RecordBatch.from_pydict({"value": [opening]})
        for batch in batches:
            values = []
            for v in batch.column(0).to_pylist():
                values.append(v if first else "," + v)
                first = False
            yield pa.RecordBatch.from_pydict({"value": values}, schema=pa.schema([("value", pa.string())]))
        yield pa.RecordBatch.from_pydict({"value": [closing]})

    lines.coalesce(1).mapInArrow(document, "value string").write.text(path)


def remaining_by_key(rows: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Rows whose key, as text, isn't among the results yet."""
    known = done.select(F.col(done_key or key).cast("string").alias("_done")).distinct()
    return rows.join(known, rows[key].cast("string") == F.col("_done"), "left_anti")


def remaining_by_count(rows: DataFrame, done: int, order: str) -> DataFrame:
    """Rows after the first `done` ones in the order of a row number column that starts at 0."""
    return rows.where(F.col(order) >= done)


def seeded_draw(rows: DataFrame, n: int, seed: int, keys: list[str], group: str | None = None) -> DataFrame:
    """n rows (of each group) drawn without replacement, with their place in the draw as `drawn`; the same draw whatever the layout of the rows.

    A row's place follows from a hash of seed, group and keys (ties: the keys), so keys have to tell rows apart. A task keeps its n best rows of a group before anything is
    shuffled: Spark limits ranked rows in each task first.
    """
    number = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ([group] if group else []) + keys])), 1, 15)
    order = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy(number, *keys)
    return rows.withColumn("drawn", F.row_number().over(order)).where(F.col("drawn") <= n)


def some_rows(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """For trial runs: the first n rows, or with a seed n rows drawn without replacement."""
    return rows.limit(n) if seed is None else rows.orderBy(F.rand(seed)).limit(n)


def score_report(scores: DataFrame, path: str) -> None:
    """Aggregates as one JSON line."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def item_report(items: DataFrame, path: str) -> None:
    """Per-item scores as CSV with a header."""
    items.write.mode("overwrite").option("header", True).csv(path)


def short_form_items(rows: DataFrame) -> DataFrame:
    """(id, question, golden_answers, output) from rows with a reader struct; missing columns raise an error."""
    missing = {"id", "question", "golden_answers", "reader"} - set(rows.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    return rows.select("id", "question", "golden_answers", F.col("reader.answer").alias("output"))


def final_answers(rows: DataFrame, dataset: str) -> DataFrame:
    """The columns of each data set's result format."""
    if dataset == "asqa":
        first = F.get("annotations", F.lit(0))["long_answer"]
        return rows.select("sample_id", "question", "qa_pairs", "annotations", F.coalesce(first, F.lit("")).alias("answer"), "output", "prompt")
    if dataset == "eli5":
        best = F.array_max(F.transform("answers.score", lambda s, i: F.struct(s.alias("s"), (-i).alias("i"))))
        return rows.select(F.col("q_id").alias("id"), "question", F.get("answers.text", -best["i"]).alias("answer"), "output", "claims")
    if dataset == "qampari":
        aliases = F.transform("answer_list", lambda a: F.array_distinct(F.concat(a["aliases"], F.array(a["answer_text"]))))
        return rows.select(F.col("qid").alias("id"), "question", aliases.alias("answers"), "output")
    return rows.select("id", "question", "output", "golden_answers")


def token_cost(rows: DataFrame, model: str) -> DataFrame:
    """(prompt_tokens, completion_tokens, usd) over all calls."""
    prompt, completion = PRICES[model]
    sums = rows.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
    return sums.withColumn("usd", F.col("prompt_tokens") / 1000 * prompt + F.col("completion_tokens") / 1000 * completion)
