"""Benchmark decontamination: every passage of the training texts queries a BM25 index of the test items.

The index is searched by block-max WAND with a threshold; an item's scores are divided by the score it gives
itself, so one threshold means the same share of any item. What is found is verified by the overlap of
word shingles with the item, its question and its answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, checkpoint, texts_of, without_ids

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
SHINGLE = 5
#: Items are searched in slices of at most so many bytes of text, since each task holds a slice's index.
SLICE_BYTES = 16 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last one; a single sentence is both."""
    parts = [w for s in SENTENCE_END.split(text) if (w := words_of(s))]
    whole = [w for p in parts for w in p]
    return ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (whole, whole)


class Bm25Index:
    """Inverted index of items with block maxima. Impacts are shares of an item's own score, so a score is at most 1."""

    def __init__(self, items: list[tuple[int, str]], frequencies: dict[str, int], total: int, mean: float, longest: int = 0, k1: float = 1.2, b: float = 0.75, block: int = 16):
        self.items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        self.block = block
        self.words = [words_of(t) for _, t in self.items]
        #: Words of the longest item, which may stand in another slice of the items.
        self.longest = max(longest, *map(len, self.words), 1)
        postings: dict[str, list[tuple[int, float]]] = {}
        for i, words in enumerate(self.words):
            norm = k1 * (1 - b + b * len(words) / max(mean, 1e-9))
            impact = {}
            for w in words:
                impact[w] = impact.get(w, 0) + 1
            for w, tf in impact.items():
                n = frequencies[w]
                impact[w] = math.log(1 + (total - n + 0.5) / (n + 0.5)) * tf * (k1 + 1) / (tf + norm)
            own = sum(impact.values())
            for w, x in impact.items():
                postings.setdefault(w, []).append((i, x / own))
        self.terms = {w: t for t, w in enumerate(sorted(postings))}
        ordered = [postings[w] for w in self.terms]
        self.ids = [np.array([i for i, _ in p], dtype=np.int64) for p in ordered]
        self.impacts = [np.array([x for _, x in p]) for p in ordered]
        self.best = np.array([x.max() for x in self.impacts])
        self.blocks = [self._blocks(t) for t in range(len(ordered))]

    def _blocks(self, t: int) -> dict[int, float]:
        found: dict[int, float] = {}
        for i, x in zip(self.ids[t].tolist(), self.impacts[t].tolist()):
            found[i // self.block] = max(found.get(i // self.block, 0.0), x)
        return found

    def essential(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start of each term's postings or -1, their items, impacts, the least essential score of each item).

        An item's rarest terms are essential, as many as make up more than its score less half the threshold;
        the others can't reach half the threshold, so a passage scores above the threshold only if its
        essential terms alone reach the rest.
        """
        per_item: list[list[tuple[int, int, float]]] = [[] for _ in self.items]
        for t, (ids, impacts) in enumerate(zip(self.ids, self.impacts)):
            for i, x in zip(ids.tolist(), impacts.tolist()):
                per_item[i].append((len(ids), t, x))
        least, chosen = np.zeros(len(self.items)), [[] for _ in self.ids]
        for i, terms in enumerate(per_item):
            rest = 1.0
            for _, t, x in sorted(terms):
                if rest < threshold / 2:
                    break
                chosen[t].append((i, x))
                rest -= x
            least[i] = threshold - max(rest, 0) - 1e-9
        starts = np.cumsum([0, *map(len, chosen)])
        flat = [p for c in chosen for p in c]
        return starts, np.array([i for i, _ in flat], dtype=np.int64), np.array([x for _, x in flat]), least

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every (item, score) with a score of `threshold` or more, by block-max WAND over distinct terms."""
        lists = [[self.ids[t], self.impacts[t], self.best[t], self.blocks[t], 0] for t in sorted(set(terms))]
        found = []
        threshold -= 1e-9
        while True:
            lists = [c for c in lists if c[4] < len(c[0])]
            lists.sort(key=lambda c: c[0][c[4]])
            bound, pivot = 0.0, None
            for k, c in enumerate(lists):
                bound += c[2]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = int(lists[pivot][0][lists[pivot][4]])
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][4]] == item:
                pivot += 1
            block = item // self.block
            if sum(c[3].get(block, 0.0) for c in lists[: pivot + 1]) < threshold:
                # nothing in this block, nor before the next list's item, can reach the threshold
                to = (block + 1) * self.block
                if pivot + 1 < len(lists):
                    to = min(to, int(lists[pivot + 1][0][lists[pivot + 1][4]]))
                for c in lists[: pivot + 1]:
                    c[4] = max(c[4], bisect_left(c[0], to))
            elif lists[0][0][lists[0][4]] == item:
                score = sum(float(c[1][c[4]]) for c in lists[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                for c in lists[: pivot + 1]:
                    c[4] += 1
            else:
                for c in lists[:pivot]:
                    c[4] = bisect_left(c[0], item)


class Searcher:
    """Searches whole texts: passages are windows of twice the longest item, each starting where the middle of the last one is."""

    def __init__(self, index: Bm25Index, threshold: float, overlap: float):
        self.index, self.threshold, self.overlap = index, threshold, overlap
        self.starts, self.posted, self.impacts, self.least = index.essential(threshold)
        self.parts = [(shingles(w), *map(shingles, question_and_answer(t or ""))) for (_, t), w in zip(index.items, index.words)]

    def passages(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """(starts of the passages that some item's essential terms allow, term of each word or -1)."""
        get = self.index.terms.get
        terms = np.array([get(w, -1) for w in words], dtype=np.int64)
        step = self.index.longest
        at = np.flatnonzero(terms >= 0)
        counts = self.starts[terms[at] + 1] - self.starts[terms[at]]
        at, counts = at[counts > 0], counts[counts > 0]
        if not len(at):
            return [], terms
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        entry = np.repeat(self.starts[terms[at]], counts) + inside
        chunk = np.repeat(at // step, counts)
        n = len(self.index.items)
        # a word of chunk c stands in the passages that start at chunks c - 1 and c; of repeats in a passage one counts
        passage = np.concatenate([chunk, chunk[chunk > 0] - 1])
        entry = np.concatenate([entry, entry[chunk > 0]])
        kinds = np.unique(passage * len(self.posted) + entry)
        passage, entry = np.divmod(kinds, len(self.posted))
        pairs, place = np.unique(passage * n + self.posted[entry], return_inverse=True)
        reached = np.bincount(place, weights=self.impacts[entry]) >= self.least[pairs % n]
        return np.unique(pairs[reached] // n * step).tolist(), terms

    def search(self, text: str | None) -> list[tuple]:
        """(item, passage start in words, score, overlap, question overlap, answer overlap), for each item the passage with most overlap."""
        words = words_of(text)
        starts, terms = self.passages(words)
        width, best = 2 * self.index.longest, {}
        for at in starts:
            here = [t for t in terms[at : at + width].tolist() if t >= 0]
            found = self.index.retrieve(here, self.threshold)
            if not found:
                continue
            own = shingles_any(words[at : at + width])
            for item, score in found:
                whole, question, answer = (len(p & own) / len(p) if p else 0.0 for p in self.parts[item])
                if whole >= self.overlap or (question >= self.overlap and answer >= self.overlap):
                    # scores that differ in their last bits only are ties, of which the first passage counts
                    best[item] = max(best.get(item, (-1.0,)), (whole, round(score, 9), -at, question, answer))
        return [(self.index.items[i][0], -at, score, whole, q, a) for i, (whole, score, at, q, a) in sorted(best.items())]


def shingles_any(words: list[str]) -> set[tuple[str, ...]]:
    """Shingles of SHINGLE words and all shorter runs, against which parts of few words are held."""
    return {tuple(words[i : i + n]) for n in range(1, SHINGLE + 1) for i in range(len(words) - n + 1)}


def _index_slices(items: DataFrame):
    """Bm25Index objects over slices of the items, with frequencies counted over all of them."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def terms(batches):
        for batch in batches:
            split = [words_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in split], pa.list_(pa.string())), pa.array([len(w) for w in split], pa.int64())], ["terms", "n"])

    split = checkpoint(arrow_map(items, terms, "terms array<string>, n long"))
    total, length, longest = split.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    if not length:
        return
    counts = split.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    slices = -(-size // SLICE_BYTES)
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = [(r.item_id, r.text) for r in part.collect() if words_of(r.text)]
        if not rows:
            continue
        used = counts if slices == 1 else counts.join(arrow_map(part, terms, "terms array<string>, n long").select(F.explode("terms").alias("word")).distinct(), "word", "left_semi")
        yield Bm25Index(rows, dict(map(tuple, used.collect())), total, length / total, longest), slices


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """(doc_id, item_id, passage_start, score, overlap, question_overlap, answer_overlap) of each document that holds a test item.

    Every passage of every whole text is a query; all items with a BM25 share of `threshold` are retrieved,
    and those stay of whose word shingles (5 words; fewer in a shorter part) the passage holds a share of
    `overlap`, or so of both the question and the answer. An item in several passages is reported once, by the
    passage with most overlap. Null and empty texts match nothing; items without words are left out; a null
    doc_id is returned as null; repeated rows are each reported; empty tables give an empty result; only
    doc_id, item_id and text are read, so other names can't clash. Very long texts are searched passage by passage. Of passages with equal overlap
    the one with the higher score (to 9 digits) counts, then the first. Item tables over SLICE_BYTES are searched slice by slice with the same results; passages are as wide as the longest item of all slices asks for.
    """
    schema = "doc_id long, item_id long, passage_start long, score double, overlap double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    narrow = texts_of(docs)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.float64()] * 4

    def searching(sent):
        def searched(batches):
            searcher = Searcher(sent.value, threshold, overlap)
            for batch in batches:
                rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for r in searcher.search(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        return searched

    found = None
    for index, slices in _index_slices(items):
        sent = spark.sparkContext.broadcast(index)
        part = arrow_map(narrow, searching(sent), schema)
        if slices > 1:  # one slice's index at a time is held
            part = checkpoint(part)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold a test item (see find_leaks); columns as they came, whatever their names.

    Rows without a doc_id stay, and so do null and empty texts; a very long text goes as a whole if any passage of it holds an item; all rows
    of a doc_id go together, repeated or not, so no ties arise; empty tables drop nothing.
    """
    return without_ids(docs, find_leaks(docs, items, **options).select("doc_id"))
