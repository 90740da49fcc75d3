"""Evaluation: every metric is a set of per-item columns, and a report is one aggregate over them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dendra.functions.stems import stem
from dendra.functions.text import after_reasoning, list_answers, normalize_answer, trim_output, word_count

#: Answers that count only if they are exactly equal.
EXACT_ONLY = ("yes", "no", "noanswer")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row: expressions inside array lambdas would repeat it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normal(golds: Column) -> Column:
    return F.filter(F.transform(golds, normalize_answer), lambda g: g != "")


def exact_match(output: Column, golds: Column) -> Column:
    """Whether the normalized output equals one of the normalized, non-empty golds."""
    return F.coalesce(F.array_contains(_normal(golds), normalize_answer(trim_output(output))), F.lit(False))


def containment(output: Column, golds: Column) -> Column:
    """Whether the normalized output holds one of the normalized, non-empty golds."""
    return F.coalesce(_let(normalize_answer(trim_output(output)), lambda text: F.exists(_normal(golds), lambda g: F.contains(text, g))), F.lit(False))


def _shared(a: list[str], b: list[str]) -> int:
    """Size of the multiset intersection."""
    return sum((Counter(a) & Counter(b)).values())


def _token_scores(said: str, golds: list[str]) -> tuple[float, float, float]:
    best = (0.0, 0.0, 0.0)
    for gold in golds:
        same = _shared(said.split(), gold.split())
        if not same or (said != gold and (said in EXACT_ONLY or gold in EXACT_ONLY)):
            continue
        p, r = same / len(said.split()), same / len(gold.split())
        best = tuple(map(max, best, (p, r, 2 * p * r / (p + r))))
    return best


@F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("precision", "recall", "f1")]))
def _scored(said: pd.Series, golds: pd.Series) -> pd.DataFrame:
    made = [_token_scores(s or "", [g for g in (() if gs is None else gs) if g is not None]) for s, gs in zip(said, golds)]
    return pd.DataFrame(made, columns=["precision", "recall", "f1"], dtype="float64")


def token_scores(output: Column, golds: Column) -> Column:
    """struct(precision, recall, f1): of each the largest over the golds; yes, no and noanswer match only as a whole.

    Texts are normalized in the JVM; counting tokens of both sides is quadratic in array expressions, so that part runs in Arrow batches.
    """
    return _scored(normalize_answer(trim_output(output)), F.transform(golds, normalize_answer))


@F.pandas_udf(T.DoubleType())
def _pair_f1(gold: pd.Series, said: pd.Series) -> pd.Series:
    def one(g: str, s: str) -> float:
        a, b = g.split(), s.split()
        return float(len(a) == len(b)) if not a or not b else 2.0 * _shared(a, b) / (len(a) + len(b))

    return pd.Series([one(g or "", s or "") for g, s in zip(gold, said)], dtype="float64")


def answer_f1(gold: Column, said: Column) -> Column:
    """Token F1 of two texts; if one has no tokens, 1 if and only if neither has."""
    return _pair_f1(normalize_answer(gold), normalize_answer(said))


def answer_exact(gold: Column, said: Column) -> Column:
    return (normalize_answer(gold) == normalize_answer(said)).cast("double")


def presence(answers: Column, text: Column) -> Column:
    """Whether the normalized text holds one of the normalized answers; an answer that normalizes to nothing is always there."""
    return F.coalesce(_let(normalize_answer(text), lambda inside: _present(answers, inside)), F.lit(False))


def _present(answers: Column, inside: Column) -> Column:
    return F.coalesce(F.exists(answers, lambda a: F.contains(inside, normalize_answer(a))), F.lit(False))


def presence_scores(pairs: Column, output: Column, field: str = "short_answers", top: int | None = None) -> Column:
    """struct(em, hit): the share of question-answer pairs whose answer is present (with `top`, out of at most so many), and whether all are."""
    found = _let(normalize_answer(output), lambda inside: F.size(F.filter(pairs, lambda p: _present(p[field], inside))))
    n, got = F.size(pairs), found
    if top is not None:
        n, got = F.least(F.lit(top), n), F.least(F.lit(top), found)
    share = F.when(n > 0, got / n).otherwise(F.lit(0.0))
    return F.struct(share.alias("em"), ((n > 0) & (got == n)).cast("double").alias("hit"))


def list_scores(output: Column, answers: Column, reasoning: bool = False) -> Column:
    """struct(num_preds, precision, recall, recall_top5, f1, f1_top5) of comma-separated answers against groups of aliases."""
    said = list_answers(after_reasoning(output) if reasoning else output)
    groups = F.transform(answers, lambda g: F.transform(g, normalize_answer))

    def counted(x: Column) -> Column:
        right = F.size(F.filter(x["said"], lambda s: F.exists(x["groups"], lambda g: F.array_contains(g, s))))
        found = F.size(F.filter(x["groups"], lambda g: F.arrays_overlap(g, x["said"])))
        return F.struct(F.size(x["said"]).alias("n"), F.size(x["groups"]).alias("total"), right.alias("right"), found.alias("found"))

    def scored(c: Column) -> Column:
        p = F.when(c["n"] > 0, c["right"] / c["n"]).otherwise(F.lit(0.0))
        r = F.when(c["total"] > 0, c["found"] / c["total"]).otherwise(F.lit(0.0))
        r5 = F.when(c["total"] > 0, F.least(F.lit(5), c["found"]) / F.least(F.lit(5), c["total"])).otherwise(F.lit(0.0))
        return F.struct(c["n"].alias("num_preds"), p.alias("precision"), r.alias("recall"), r5.alias("recall_top5"))

    def with_f1(s: Column) -> Column:
        f1 = lambda a, b: F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(F.lit(0.0))
        return F.struct(*[s[k].alias(k) for k in ("num_preds", "precision", "recall", "recall_top5")], f1(s["precision"], s["recall"]).alias("f1"), f1(s["precision"], s["recall_top5"]).alias("f1_top5"))

    return _let(_let(_let(F.struct(said.alias("said"), groups.alias("groups")), counted), scored), with_f1)


def short_form(items: DataFrame) -> DataFrame:
    """items(output, golden_answers, …) with exact (often called accuracy), contained (often called EM) and token scores."""
    both = F.col("output"), F.col("golden_answers")
    return items.withColumns({"exact": exact_match(*both).cast("double"), "contained": containment(*both).cast("double"), "token": token_scores(*both)})


def short_form_report(items: DataFrame) -> DataFrame:
    """One row (n, exact, contained, precision, recall, f1): means over the items, 0 without items."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    scored = short_form(items)
    return scored.agg(F.count("*").alias("n"), mean("exact").alias("exact"), mean("contained").alias("contained"), *[mean(f"token.{k}").alias(k) for k in ("precision", "recall", "f1")])


def special_cases(items: DataFrame) -> DataFrame:
    """Items whose output holds a gold but doesn't equal one."""
    return short_form(items).where("contained = 1 AND exact = 0").select(items.columns)


def mean_length(items: DataFrame) -> DataFrame:
    return items.agg(F.avg(word_count(F.col("output"))).alias("length"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in the memory of one row."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _union_lcs(reference: list[list[str]], said: list[list[str]]) -> int:
    """Words of the reference that stand in the union of the sentence-wise longest common subsequences, each counted as often as both sides have it."""
    left = {}
    for x in (w for s in said for w in s):
        left[x] = left.get(x, 0) + 1
    ref_left = {}
    for x in (w for s in reference for w in s):
        ref_left[x] = ref_left.get(x, 0) + 1
    hits = 0
    for sentence in reference:
        marked = set()
        for other in said:
            marked |= _lcs_places(sentence, other)
        for i in sorted(marked):
            w = sentence[i]
            if left.get(w, 0) > 0 and ref_left.get(w, 0) > 0:
                hits, left[w], ref_left[w] = hits + 1, left[w] - 1, ref_left[w] - 1
    return hits


def _lcs_places(a: list[str], b: list[str]) -> set[int]:
    table = [[0] * (len(b) + 1)]
    for x in a:
        above, row = table[-1], [0]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y else max(above[j], row[-1]))
        table.append(row)
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def summary_overlap(reference: str, said: str, stems: bool = True) -> float:
    """F-measure of the sentence-wise longest common subsequence: line feeds end sentences, words are in lower case and compared by their stems."""
    word = stem if stems else str
    split = lambda t: [[word(w) for w in re.findall(r"[a-z0-9]+", s.lower())] for s in (t or "").split("\n")]
    a, b = split(reference), split(said)
    n, m = sum(map(len, a)), sum(map(len, b))
    same = _union_lcs(a, b) if n and m else 0
    return 2.0 * same / (n + m) if same else 0.0


def best_summary_overlap(references: Column, said: Column, stems: bool = True) -> Column:
    """Largest summary_overlap over an array of references; 0 without any."""

    @F.pandas_udf(T.DoubleType())
    def run(references: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([max((summary_overlap(r, s, stems) for r in (() if rs is None else rs)), default=0.0) for rs, s in zip(references, said)], dtype="float64")

    return run(references, said)


#: The chance that a Poisson number of mean 1 is at most 0, 1, 2, …
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def resampled(scores: DataFrame, score: str, keys: list[str], replicates: int = 1000, confidence: float = 0.95) -> DataFrame:
    """(n, mean, low, high) of a score with its bootstrap interval, in one pass over the rows.

    In each replicate a row counts as often as a Poisson number of mean 1 says, which a hash of its keys and the replicate's number fixes; so no row is drawn from a list, any
    layout of the rows gives the same interval, and a task sends one row for each replicate. low and high are the replicates' means of the lowest and highest ranks
    within the confidence. Null scores are left out; without rows the mean is null; replicates that draw no row have no mean.
    """
    rows = scores.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("x"), F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("key"))
    rows = rows.select("x", "key", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    share = F.conv(F.substring(F.md5(F.concat_ws(":", "key", "replicate")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    weight = sum((F.when(share >= F.lit(p), 1).otherwise(0) for p in _POISSON), F.lit(0))
    sums = rows.select("replicate", "x", weight.alias("w")).groupBy("replicate").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    means = F.array_sort(F.collect_list(F.when(F.col("w") > 0, F.col("wx") / F.col("w"))))
    tail = (1 - confidence) / 2
    at = lambda share: F.get("means", F.least(F.size("means") - 1, F.floor(F.size("means") * F.lit(share)).cast("int")))
    interval = sums.agg(means.alias("means")).select(at(tail).alias("low"), at(1 - tail).alias("high"))
    whole = scores.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return whole.join(F.broadcast(interval))


def claim_recall(items: DataFrame, entails, key: str = "id") -> DataFrame:
    """(key, claim_recall): the share of claims that the output entails; entails is a column function (premise, claim) -> 0 or 1."""
    rows = items.select(key, "output", F.explode("claims").alias("claim"))
    scored = rows.withColumn("entailed", entails(F.col("output"), F.col("claim")))
    return items.select(key).join(scored.groupBy(key).agg(F.avg("entailed").alias("claim_recall")), key, "left").fillna(0.0, ["claim_recall"])


def citation_scores(items: DataFrame, entails, key: str = "id", at_most: int | None = None) -> DataFrame:
    """(key, citation_recall, citation_precision) from items(key, sentences array<struct<sentence, refs array<int>>>, docs array<string>).

    A sentence is recalled if its cited documents together entail it; without citations, or with one out of
    range (below 0 or past the end), it isn't. A citation is precise if its document alone entails the sentence, or the
    sentence is recalled and the others don't entail it without it; a lone citation is as precise as its sentence is recalled.
    """
    cut = F.col("s.refs") if at_most is None else F.slice("s.refs", 1, at_most)
    rows = items.select(key, "docs", F.posexplode("sentences").alias("at", "s")).select(key, "docs", "at", "s.sentence", F.col("s.refs").alias("all"), cut.alias("refs"))
    valid = (F.size("all") > 0) & ~F.exists("all", lambda r: (r < 0) | (r >= F.size("docs")))
    rows = rows.withColumn("refs", F.when(valid, F.col("refs")).otherwise(F.array().cast("array<int>")))
    premise = lambda refs: F.array_join(F.transform(refs, lambda r: F.get("docs", r)), "\n")
    joint = rows.withColumn("joint", F.when(F.size("refs") > 0, entails(premise(F.col("refs")), F.col("sentence"))).otherwise(0))
    each = joint.where("joint = 1 AND size(refs) > 1").select(key, "at", "docs", "sentence", "refs", F.posexplode("refs").alias("place", "r"))
    others = F.concat(F.slice("refs", 1, F.col("place")), F.slice("refs", F.col("place") + 2, F.size("refs")))
    each = each.withColumn("alone", entails(F.get("docs", F.col("r")), F.col("sentence"))).withColumn("without", entails(premise(others), F.col("sentence")))
    precise = each.groupBy(key, "at").agg(F.sum(F.when((F.col("alone") == 1) | (F.col("without") == 0), 1).otherwise(0)).alias("precise"))
    scored = joint.join(precise, [key, "at"], "left").withColumn("precise", F.coalesce("precise", F.when(F.size("refs") <= 1, F.col("joint")).otherwise(0)))
    totals = scored.groupBy(key).agg(F.avg("joint").alias("citation_recall"), F.sum("precise").alias("p"), F.sum(F.size("refs")).alias("cited"))
    return totals.select(key, "citation_recall", F.when(F.col("cited") > 0, F.col("p") / F.col("cited")).otherwise(0.0).alias("citation_precision"))


def best_output(outputs: DataFrame, key: str = "id", score: str = "score", order: str = "at") -> DataFrame:
    """(key, output): the output with the largest positive mean score, the first of equal ones; empty if none scores."""
    best = F.max_by("output", F.when(F.col(score) > 0, F.struct(F.col(score), -F.col(order))))
    return outputs.groupBy(key).agg(F.coalesce(best, F.lit("")).alias("output"))


def qa_scores(pairs: Column, said: Column, field: str = "short_answers") -> Column:
    """struct(em, f1, hit) of one model answer per sub-question: the best alias for each, then means; hit if all are exact.

    pairs: array of structs with an array of answers in `field`. said: array of the answers, in the same order.
    """

    @F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in ("em", "f1", "hit")]))
    def run(golds: pd.Series, answers: pd.Series) -> pd.DataFrame:
        out = []
        for gs, ans in zip(golds, answers):
            rows = []
            for aliases, a in zip(gs, ans):
                scores = [(float(g == a), _token_scores(a or "", [g])[2] if g and a else float(g == a)) for g in aliases]
                rows.append((max((s[0] for s in scores), default=0.0), max((s[1] for s in scores), default=0.0)))
            n = len(rows)
            out.append((sum(r[0] for r in rows) / n, sum(r[1] for r in rows) / n, float(all(r[0] for r in rows))) if n else (0.0, 0.0, 0.0))
        return pd.DataFrame(out, columns=["em", "f1", "hit"], dtype="float64")

    return run(F.transform(pairs, lambda p: F.transform(p[field], normalize_answer)), F.transform(said, normalize_answer))


def rerank(outputs: DataFrame, entails, key: str = "id") -> DataFrame:
    """(key, output): of several outputs the one whose sentences its item's documents together entail most; empty if none scores.

    outputs: (key, at, output, docs array<string>).
    """
    from dendra.functions.text import sentences, strip_citations

    rows = outputs.select(key, "at", F.array_join("docs", "\n").alias("premise"), F.explode(sentences(strip_citations(F.col("output")))).alias("claim"))
    scores = rows.select(key, "at", entails(F.col("premise"), F.col("claim")).alias("e")).groupBy(key, "at").agg(F.avg("e").alias("score"))
    return best_output(outputs.join(scores, [key, "at"], "left").fillna(0.0, ["score"]), key)
