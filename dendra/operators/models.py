"""Model stages behind small interfaces; models are loaded once per Python worker and called in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dendra.functions import parsers, prompts
from dendra.functions.vector import pooled


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TokenEmbedder(Protocol):
    """For each text the vectors of its tokens and the mask of those that count, at most so many."""

    def tokens(self, texts: list[str], max_tokens: int) -> list[tuple[list[list[float]], list[int]]]: ...


class Tokenizer(Protocol):
    """Token numbers of texts, without marks of beginning and end, and the text of token numbers."""

    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, tokens: list[int]) -> str: ...


class Generator(Protocol):
    def generate(self, prompts: list[str], max_tokens: int) -> list[str]: ...


class Entailment(Protocol):
    """Probability that each premise entails its claim."""

    def entail(self, premises: list[str], claims: list[str]) -> list[float]: ...


class BytePairTokenizer:
    """Byte-pair tokens of a vocabulary file: one base64 token and its number a line; pattern cuts a text into the pieces that are encoded each."""

    def __init__(self, path: str, pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]

    def decode(self, tokens: list[int]) -> str:
        return self.encoding.decode(tokens)


class HashEmbedder:
    """Bag of hashed words, length 1: deterministic, for tests and dry runs."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out


class EchoGenerator:
    """Answers by rule: chooses every heading or paragraph that shares a word with the question; otherwise repeats the question's words."""

    def generate(self, prompts: list[str], max_tokens: int) -> list[str]:
        return [self._one(p)[: 8 * max_tokens] for p in prompts]

    @staticmethod
    def _one(prompt: str) -> str:
        parts = {k: v for k, v in re.findall(r"## ([\w ]+)\n(.*?)(?=\n\n## |\Z)", prompt, flags=re.S)}
        asked = set(re.findall(r"\w{4,}", parts.get("Question", "").lower()))
        if "Document Tree" not in parts:
            return parts.get("Question", "").strip()
        out = []
        for line in parts["Document Tree"].split("\n"):
            m = re.match(r"\s*(\d+): (.*)", line)
            if not m:
                continue
            hit = asked & set(re.findall(r"\w{4,}", m[2].lower()))
            if "[paragraph]" in prompt:
                out += [f"[paragraph] {m[1]}: {m[2]}"] if hit else []
            elif m[1] == "0":
                out += [f"[title] 0: {m[2]}"] + ([f"[heading] 0: {m[2]}"] if hit else [])
            else:
                out += [f"[heading] {m[1]}: {m[2]}"] if hit else []
        return "\n".join(out)


class OverlapEntailment:
    """Share of the claim's words that the premise has."""

    def entail(self, premises: list[str], claims: list[str]) -> list[float]:
        words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
        return [len(words(c) & words(p)) / len(words(c)) if words(c) else 0.0 for p, c in zip(premises, claims)]


_loaded: dict[bytes, object] = {}


def _model(factory: Callable[[], object]):
    """The factory's model, made once per worker."""
    from pyspark.cloudpickle import dumps

    key = hashlib.sha256(dumps(factory)).digest()
    if key not in _loaded:
        _loaded[key] = factory()
    return _loaded[key]


def embedded(text: Column, factory: Callable[[], Embedder], batch: int = 1024) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        model, out = _model(factory), []
        given = texts.fillna("").tolist()
        for at in range(0, len(given), batch):
            out += model.embed(given[at : at + batch])
        return pd.Series(out, dtype=object)

    return run(text)


def token_count(text: Column, factory: Callable[[], Tokenizer]) -> Column:
    """Number of tokens; 0 for null."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(_model(factory).encode([t])[0]) if t else 0 for t in texts], dtype="int32")

    return run(text)


def token_prefix(text: Column, n: Column, factory: Callable[[], Tokenizer]) -> Column:
    """The text of the first n tokens; a character that the cut divides is replaced by the tokenizer's mark."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, counts: pd.Series) -> pd.Series:
        model = _model(factory)
        return pd.Series([None if t is None else model.decode(model.encode([t])[0][: max(0, int(k or 0))]) for t, k in zip(texts, counts)], dtype=object)

    return run(text, n)


def embedded_by_tokens(text: Column, factory: Callable[[], TokenEmbedder], max_tokens: int = 512, batch: int = 64) -> Column:
    """Embedding of a text by the masked mean of its token vectors; the model runs in Arrow batches, the mean is an array expression."""

    @F.pandas_udf("struct<tokens:array<array<float>>,mask:array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        model, out = _model(factory), []
        given = texts.fillna("").tolist()
        for at in range(0, len(given), batch):
            out += model.tokens(given[at : at + batch], max_tokens)
        return pd.DataFrame(out, columns=["tokens", "mask"])

    made = run(text)
    return F.get(F.transform(F.array(made), lambda m: pooled(m["tokens"], m["mask"])), F.lit(0))


def generated(rows: DataFrame, prompt: str, output: str, factory: Callable[[], Generator], max_tokens: int = 512, batch: int = 16) -> DataFrame:
    """rows with `output` and `<output>_error`: a failing batch is tried one by one, a failing row keeps its place with the error's text.

    Write the result before using it twice, since a model call is not to be repeated.
    """

    @F.pandas_udf("struct<text:string,error:string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        model, texts, errors = _model(factory), [], []
        given = prompts.tolist()
        for at in range(0, len(given), batch):
            some = given[at : at + batch]
            try:
                made = [(t, None) for t in model.generate([p or "" for p in some], max_tokens)]
            except Exception:
                made = []
                for p in some:
                    try:
                        made.append((model.generate([p or ""], max_tokens)[0], None))
                    except Exception as e:
                        made.append((None, f"{type(e).__name__}: {e}"))
            texts += [t for t, _ in made]
            errors += [e for _, e in made]
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "error": pd.Series(errors, dtype=object)})

    made = rows.withColumn("_made", run(F.col(prompt)))
    return made.withColumn(output, F.col("_made.text")).withColumn(f"{output}_error", F.col("_made.error")).drop("_made")


def entailment(factory: Callable[[], Entailment], threshold: float | None = 0.5):
    """A column function (premise, claim): 0 or 1 by the threshold, or the probability without one."""

    @F.pandas_udf("double")
    def run(premise: pd.Series, claim: pd.Series) -> pd.Series:
        p = pd.Series(_model(factory).entail(premise.fillna("").tolist(), claim.fillna("").tolist()), dtype="float64")
        return p if threshold is None else (p >= threshold).astype("float64")

    return run


def route(path_rows: DataFrame, factory: Callable[[], Generator], max_tokens: int = 512) -> DataFrame:
    """(…, raw_output): one router call for each path with text; path_rows has path_text and question."""
    asked = path_rows.where("path_text is not null and path_text <> ''").withColumn("_prompt", prompts.router_prompt(F.col("path_text"), F.col("question")))
    return generated(asked, "_prompt", "raw_output", factory, max_tokens).drop("_prompt")


def chosen_headings(routed: DataFrame, outlines: DataFrame, key: str = "title") -> DataFrame:
    """(qid, key, headings): what the router chose over all paths of a question, checked against path and outline, innermost only."""
    from dendra.operators.tree import innermost_headings

    picked = routed.select("qid", "doc_titles", F.inline(parsers.heading_choices(F.col("raw_output"))))
    picked = picked.where(F.array_contains("doc_titles", F.col("title"))).select("qid", F.col("title").alias(key), "id").distinct()
    lines = outlines.select(key, F.inline(parsers.outline_headings(F.col("outline"))))
    pairs = picked.select("qid", key).distinct().withColumn("doc", F.struct("qid", key))
    headings = pairs.join(lines, key).select("doc", "id", "up_id", "is_intro")
    selected = picked.select(F.struct("qid", key).alias("doc"), "id")
    return innermost_headings(selected, headings).select("doc.qid", f"doc.{key}", "headings")


def read(rows: DataFrame, factory: Callable[[], Generator], dataset: str = "generic", max_tokens: int = 256) -> DataFrame:
    """rows(question, context) with prompt and output."""
    asked = rows.withColumn("prompt", prompts.reader_prompt(F.col("context"), F.col("question"), dataset))
    return generated(asked, "prompt", "output", factory, max_tokens)


def summarized(items: DataFrame, factory: Callable[[], Generator], top: int = 5, field: str = "summary", max_tokens: int = 100) -> DataFrame:
    """items(id, question, docs) with `field` in each of the first `top` documents; documents that have it are not asked again.

    docs: array of structs with title, text and `field`.
    """
    rows = items.select("id", "question", F.posexplode(F.slice("docs", 1, top)).alias("at", "doc"))
    todo = rows.where(F.col("doc")[field].isNull())
    todo = todo.withColumn("_prompt", F.concat(F.lit("Summarize the document for the question in one sentence; answer irrelevant if it does not help.\n\n## Question\n"), "question", F.lit("\n\n## Document\n"), F.col("doc")["title"], F.lit("\n"), F.col("doc")["text"]))
    made = generated(todo, "_prompt", "made", factory, max_tokens).select("id", "at", "made")
    done = rows.join(made, ["id", "at"], "left").withColumn("doc", F.col("doc").withField(field, F.coalesce(F.col("doc")[field], "made")))
    lists = done.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc"))), lambda x: x["doc"]).alias("_docs"))
    rest = F.slice("docs", top + 1, F.greatest(F.lit(0), F.size("docs") - top))
    return items.join(lists, "id", "left").withColumn("docs", F.when(F.col("_docs").isNull(), F.col("docs")).otherwise(F.concat("_docs", rest))).drop("_docs")


def cite_best(sentences: DataFrame, docs: DataFrame, only_uncited: bool = True) -> DataFrame:
    """(id, at, sentence): sentences without a citation (or all) get `[n] ` of the most similar document of their item in front.

    sentences: (id, at, sentence). docs: (id, doc, text), doc from 0.
    """
    from dendra.functions.text import strip_citations
    from dendra.operators.retrieval import tfidf_best

    open_ones = sentences.where(~F.col("sentence").rlike(r"\[[0-9]+")) if only_uncited else sentences
    best = tfidf_best(open_ones.withColumn("text", F.col("sentence")), docs, "id", "at", "doc")
    joined = sentences.join(best.select("id", "at", "doc"), ["id", "at"], "left")
    cited = F.concat(F.lit("["), (F.col("doc") + 1).cast("string"), F.lit("] "), strip_citations(F.col("sentence")))
    return joined.select("id", "at", F.coalesce(cited, F.col("sentence")).alias("sentence"))


def converse(rows: DataFrame, factory: Callable[[], object], schema: str, max_turns: int = 10, max_docs: int = 3) -> DataFrame:
    """Interactive answering, a small state machine for each row(id, question, docs array<struct<title, text>>).

    The model's step(question, shown, said) gives one action: `check n,…` shows documents, `search query` shows the most
    similar one, `output text` adds a sentence, `end` stops. Turns are bounded by max_turns, shown documents by max_docs.
    """

    def run(batches):
        model = _model(factory)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                docs = [] if row.docs is None else list(row.docs)
                shown, said = [], []
                for _ in range(max_turns):
                    action, _, rest = model.step(row.question, [docs[i] for i in shown], said).partition(" ")
                    if action == "end":
                        break
                    if action == "check":
                        shown = [int(n) - 1 for n in rest.split(",") if n.strip().isdigit() and 0 < int(n) <= len(docs)][:max_docs]
                    elif action == "search" and docs:
                        asked = set(rest.lower().split())
                        shown = [max(range(len(docs)), key=lambda i: (len(asked & set(docs[i]["text"].lower().split())), -i))]
                    elif action == "output":
                        said.append(rest)
                out.append((row.id, " ".join(said), [i + 1 for i in shown]))
            yield pd.DataFrame(out, columns=["id", "output", "shown"])

    return rows.select("id", "question", "docs").mapInPandas(run, schema)
