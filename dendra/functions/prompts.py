"""Prompts: fixed instructions around columns, and few-shot packs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

ROUTER = (
    "You see documents as numbered outlines. Name every title and heading under which the answer to the question may stand.\n"
    "Write one line `[title] 0: =Title=` per document and below it one line `[heading] id: text` per heading; if nothing fits, write No relevant headings."
)
PARAGRAPHS = (
    "You see a part of a document as numbered paragraphs. Name every paragraph that helps to answer the question.\n"
    "Write one line `[paragraph] id: text` per paragraph; if nothing fits, write No relevant paragraphs."
)
READERS = {
    "long": "Answer the question in full sentences, with all readings of it, from the paragraphs where there are any.",
    "list": "List all answers to the question, separated by commas, from the paragraphs where there are any.",
    "short": "Answer the question in a few words, from the paragraphs where there are any.",
}
READER_OF = {"asqa": "long", "eli5": "long", "qampari": "list", "generic": "short"}


def _sections(instruction: str, *parts: tuple[str, Column]) -> Column:
    out = [F.lit(instruction)]
    for name, value in parts:
        out += [F.lit(f"\n\n## {name}\n"), value]
    return F.concat(*out, F.lit("\n\n## Response\n"))


def router_prompt(path_text: Column, question: Column) -> Column:
    return _sections(ROUTER, ("Document Tree", path_text), ("Question", question))


def paragraph_prompt(document_tree: Column, question: Column) -> Column:
    return _sections(PARAGRAPHS, ("Document Tree", document_tree), ("Question", question))


def reader_prompt(context: Column, question: Column, dataset: str = "generic") -> Column:
    """Without a context the paragraph section is left out."""
    instruction = READERS[READER_OF[dataset]]
    full = _sections(instruction, ("Paragraph", context), ("Question", question))
    return F.when(F.coalesce(context, F.lit("")) == "", _sections(instruction, ("Question", question))).otherwise(full)


@dataclass(frozen=True)
class PromptPack:
    """Few-shot pack. Marks: {INST}, {Q}, {D}, {A} in demo_prompt; {ID}, {T}, {P} in doc_prompt."""

    instruction: str
    demo_prompt: str
    doc_prompt: str
    demo_sep: str = "\n\n\n"
    demos: list[dict] = field(default_factory=list)

    def document(self, title: Column, text: Column, number: Column) -> Column:
        """One document; numbers start at 1 in the text and at 0 in the column."""
        out = F.lit(self.doc_prompt)
        for mark, value in (("{T}", title), ("{P}", text), ("{ID}", (number + 1).cast("string"))):
            out = F.replace(out, F.lit(mark), value)
        return out

    def shown(self, question: Column, docs: Column | None, answer: Column | None = None) -> Column:
        """One example: docs is an array of document texts or None; without an answer the prompt ends where it would stand."""
        out = F.replace(F.replace(F.lit(self.demo_prompt), F.lit("{INST}"), F.lit(self.instruction)), F.lit("{Q}"), question)
        if docs is None:
            out = F.replace(out, F.lit("{D}\n"), F.lit(""))
        else:
            out = F.replace(out, F.lit("{D}"), F.array_join(docs, ""))
        if answer is None:
            return F.rtrim(F.replace(out, F.lit("{A}"), F.lit("")))
        return F.replace(out, F.lit("{A}"), answer)

    def drawn(self, key: Column, shots: int, seed: int) -> Column:
        """The numbers of `shots` demonstrations drawn without replacement for the item of each key, in the order of their hashes."""
        chances = [F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(i)))).alias("h"), F.lit(i).alias("i")) for i in range(len(self.demos))]
        if not chances:
            return F.array().cast("array<int>")
        return F.transform(F.slice(F.array_sort(F.array(*chances)), 1, shots), lambda c: c["i"])

    def few_shot(self, question: Column, docs: Column | None, shots: int, key: Column | None = None, seed: int = 0) -> Column:
        """`shots` demonstrations, then the question: the first ones, or with a key those that drawn() gives the item."""
        made = []
        for demo in self.demos if key is not None else self.demos[:shots]:
            answer = demo["answer"]
            texts = None
            if docs is not None:
                texts = F.array(*[self.document(F.lit(d["title"]), F.lit(d["text"]), F.lit(i)) for i, d in enumerate(demo.get("docs", []))])
            made.append(F.concat(self.shown(F.lit(demo["question"]), texts, F.lit("\n".join(answer) if isinstance(answer, list) else answer)), F.lit(self.demo_sep)))
        if key is None or not made:
            return F.concat(*made, self.shown(question, docs))
        every = F.array(*made)
        return F.concat(F.array_join(F.transform(self.drawn(key, shots, seed), lambda i: F.get(every, i)), ""), self.shown(question, docs))
