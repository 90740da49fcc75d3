"""Interactive answering, turn by turn: all open conversations take one turn together, and those that have ended leave."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from dendra.functions import prompts
from dendra.functions.text import force_citations, force_list_citations, strip_citations, word_count
from dendra.operators import models
from dendra.operators.retrieval import tfidf_best
from dendra.operators.shared import cut

PLAIN = prompts.PromptPack("", "", "Document [{ID}](Title: {T}): {P}\n")
_INTS = "array<int>"


def _starts(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found |= F.startswith(F.lower(F.trim(text)), F.lit(w))
    return found


def _kind(action: Column) -> Column:
    """end, abstain, look, output or unknown."""
    low = F.lower(action)
    sorry = F.contains(low, F.lit("sorry")) & (F.contains(low, F.lit("relevant document")) | F.contains(low, F.lit("relevant information")))
    abstains = sorry | F.contains(low, F.lit("none of the documents"))
    return F.when(_starts(action, "end"), "end").when(abstains, "abstain").when(_starts(action, "check", "search"), "look").when(_starts(action, "output"), "output").otherwise("unknown")


def _numbers(action: Column, n: Column, most: int) -> Column:
    """The documents (from 0) that an action names as [1], [2], …; at most so many, those out of range left out."""
    named = F.transform(F.regexp_extract_all(action, F.lit(r"\[(\d{1,9})")), lambda x: x.cast("int") - 1)
    return F.slice(F.filter(named, lambda x: (x >= 0) & (x < n)), 1, most)


def _searched(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shown): the document most similar to what each row asks for."""
    query = F.trim(F.replace(F.replace(F.col("action"), F.lit("Search:"), F.lit("")), F.lit("search:"), F.lit("")))
    asked = rows.select("id", F.lit(0).alias("at"), query.alias("text"))
    return tfidf_best(asked, docs.select("id", "doc", "text"), "id", "at", "doc").select("id", F.array("doc").alias("shown"))


def converse_in_turns(
    rows: DataFrame,
    docs: DataFrame,
    factory: Callable[[], models.Generator],
    search: bool = False,
    force: str | None = None,
    max_turns: int = 10,
    max_docs: int = 3,
    max_words: int | None = None,
    max_tokens: int = 300,
    pack: prompts.PromptPack = PLAIN,
) -> DataFrame:
    """(id, output, shown, prompt, turns, ended) of rows (id, prompt) with their documents docs (id, doc int from 0, title, text).

    A turn is one line of the model. `Check [n]…` shows the named documents, or `Search …` the most similar one, in the next prompt only, which then
    asks for an output; `Output …` adds to the answer; `End` ends. ended says why: end, abstain (the model finds no relevant document), unknown
    (no such action), turns (max_turns taken), budget (the prompt has max_words words or more) or error (the call failed). With `force`, each of the output's
    "sentences" or "list" entries loses its own citations and gets those of the documents shown last.

    Each turn calls the model once in batches for all open rows, joins only the documents that rows look at, and is written to the checkpoint folder, so
    no call is repeated; a row's transcript grows with its turns, the documents stay in their table. Rows without documents see none; a null prompt is empty.
    ids are distinct.
    """
    if force not in (None, "sentences", "list"):
        raise ValueError(f"force is {force}")
    docs = docs.select("id", F.col("doc").cast("int").alias("doc"), "title", "text", pack.document(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")), F.col("doc")).alias("line"))
    counts = docs.groupBy("id").agg(F.count("*").alias("n_docs"))
    first = rows.select("id", F.concat(F.rtrim(F.coalesce("prompt", F.lit(""))), F.lit("\n")).alias("prompt")).join(counts, "id", "left")
    state = {"inline": F.lit(""), "said": F.lit(""), "shown": F.array().cast(f"array<{_INTS}>"), "turns": F.lit(0), "n_docs": F.coalesce("n_docs", F.lit(0)), "ended": F.lit(None).cast("string")}
    now, done = cut(first.withColumns(state)), None
    columns = now.columns

    def with_done(some: DataFrame) -> DataFrame:
        return some if done is None else done.unionByName(some)

    for turn in range(1, max_turns + 1):
        asked = now.withColumn("asked", F.concat("prompt", "inline"))
        if max_words is not None:
            full = word_count(F.col("asked")) >= max_words
            done = with_done(asked.where(full).withColumn("ended", F.lit("budget")).select(columns))
            asked = asked.where(~full)
        made = cut(models.generated(asked, "asked", "made", factory, max_tokens))
        line = F.coalesce(F.split("made", "\n")[0], F.lit(""))
        made = made.withColumn("action", F.when(F.col("inline") != "", F.concat(F.lit("Output: "), line)).otherwise(line))
        made = made.withColumn("kind", F.when(F.col("made_error").isNotNull(), "error").otherwise(_kind(F.col("action"))))
        look = made.where("kind = 'look'")
        if search:
            seen = look.select("id").join(_searched(look.where("n_docs > 0"), docs), "id", "left").select("id", F.coalesce("shown", F.array().cast(_INTS)).alias("now_shown"))
        else:
            seen = look.select("id", _numbers(F.col("action"), F.col("n_docs"), max_docs).alias("now_shown"))
        lines = seen.select("id", F.posexplode("now_shown").alias("place", "doc")).join(docs.select("id", "doc", "line"), ["id", "doc"])
        lines = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "").alias("lines"))
        moved = made.join(seen, "id", "left").join(lines, "id", "left")
        text = F.trim(F.replace(F.trim("action"), F.lit("Output:"), F.lit("")))
        if force:
            last = F.coalesce(F.get("shown", F.size("shown") - 1), F.array().cast(_INTS))
            cited = F.concat(force_citations(text, last), F.lit(".")) if force == "sentences" else force_list_citations(text, last)
            text = F.when(F.size("shown") > 0, cited).otherwise(strip_citations(text))
        looked, output = F.col("kind") == "look", F.col("kind") == "output"
        ended = F.when(~(looked | output), F.col("kind")).when(F.lit(turn) >= max_turns, F.lit("turns"))
        after = {
            "prompt": F.when(F.col("kind") == "error", F.col("prompt")).otherwise(F.concat("prompt", "action", F.lit("\n"))),
            "inline": F.when(looked, F.concat(F.coalesce("lines", F.lit("")), F.lit("Output:"))).otherwise(F.lit("")),
            "said": F.when(output, F.concat("said", F.lit(" "), text)).otherwise(F.col("said")),
            "shown": F.when(looked, F.concat("shown", F.array("now_shown"))).otherwise(F.col("shown")),
            "turns": F.lit(turn),
            "ended": ended,
        }
        state_after = cut(moved.withColumns(after).select(columns))
        done = with_done(state_after.where("ended is not null"))
        now = state_after.where("ended is null")
        if now.isEmpty():
            break
    output = F.col("said") if force != "list" else F.regexp_replace(F.rtrim("said"), ",+$", "")
    output = F.rtrim(F.replace(output, F.lit("<|im_end|>"), F.lit("")))
    return with_done(now).select("id", F.regexp_replace(output, r"End\.$", "").alias("output"), "shown", "prompt", "turns", "ended")
