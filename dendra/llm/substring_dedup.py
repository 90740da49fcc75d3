"""Repeated paragraphs and passages: MinHash banding with exact checks, removals clustered by components.

Paragraphs are lines of enough words and, since a passage may repeat inside lines that differ otherwise, the
overlapping blocks of BLOCK words at every word of a text (see blocks). Both are banded by MinHash; what collides in a
band is verified by the exact Jaccard similarity of word shingles, and clustered by components. Of each cluster
the smallest doc_id keeps its text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import BLOCK, SHINGLE, block_entries, repeated_blocks, similar_blocks
from .common import arrow_map, bound_batches, checkpoint, chunks, give_back_memory, removed, settled, small, small_checkpoint, texts_of, texts_with, unused, written
from .components import connected_components
from .words import POWERS, RUN_BASE, Words, mixed, words_of_groups

PIVOTS = 3
#: MinHash values in a band of a line, and bands of the overlapping blocks (two values each).
ROWS, BLOCK_BANDS = 3, 2
#: Shingles of lines whose minima are taken at once, and lines or entries in a row of units.
PIECE, LISTED = 1 << 15, 1 << 13


def paragraphs_of(text: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each line of `min_words` words or more, and the word after its last."""
    lines = text.lines
    if not len(lines):
        return lines, lines
    first = np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1])))
    last = np.append(first[1:], len(lines))
    keep = last - first >= min_words
    return first[keep], last[keep]


def tune_bands(similarity: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands of `rows` values that finds a pair of this similarity with this chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def minhash_bands(words: Words, first: np.ndarray, last: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """One 64-bit value for each paragraph and band; paragraphs follow each other and don't overlap."""
    rng = np.random.default_rng(29)
    scale = rng.integers(1 << 63, size=(bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shingles, end = words.shingles(SHINGLE), last - SHINGLE + 1
    least = np.full((bands * rows, len(first)), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), PIECE):
        some = shingles[at : at + PIECE]
        k = slice(np.searchsorted(end, at, "right"), np.searchsorted(first, at + len(some)))
        # from each paragraph's first shingle here to behind its last, and on to the next paragraph's
        cuts = np.stack([np.maximum(first[k] - at, 0), np.minimum(end[k] - at, len(some))], axis=1).ravel()
        cuts = cuts[: np.searchsorted(cuts, len(some))]
        if len(cuts):
            for own, by in zip(least, scale):
                # the product's high bits are well mixed, its low bits aren't; the minimum is decided by the high ones
                own[k] = np.minimum(own[k], np.minimum.reduceat(some * by, cuts)[::2])
    out = mixed(least.T.reshape(-1, bands, rows) * POWERS[RUN_BASE].upto(rows)[0]).sum(axis=2, dtype=np.uint64)
    return mixed(out + np.arange(bands, dtype=np.uint64))


def _text_keys(words: Words, first: np.ndarray, last: np.ndarray) -> list[int]:
    """128-bit hashes of the paragraphs' words, A-Z in lower case, joined by blanks."""
    return [xxhash.xxh3_128_intdigest(b" ".join(words.raw[words.starts[a] : words.ends[b - 1]].lower().split())) for a, b in zip(first, last)]


def _two_parts(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A long and an int of each 128-bit hash."""
    return np.array([k >> 64 for k in keys], dtype=np.uint64).view(np.int64), np.array([k & 0x7FFFFFFF for k in keys], dtype=np.int32)


def units(docs: DataFrame, min_words: int, bands: int) -> DataFrame:
    """(lines, entries), two arrays for each few documents: (doc_id, word, words, fp, check, bands) of lines, equal fp and check meaning equal text; and (bucket, doc_id, word, run) of block entries."""
    line = [("doc_id", pa.int64()), ("word", pa.int32()), ("words", pa.int32()), ("fp", pa.int64()), ("check", pa.int32()), ("bands", pa.list_(pa.int64()))]
    entry = [("bucket", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int32()), ("run", pa.int32())]

    def structs(columns: list, kinds: list, at: int) -> pa.Array:
        """Those from row `at` on as a list; so many at once that no row grows with a text."""
        held = pa.StructArray.from_arrays([c[at : at + LISTED] if isinstance(c, pa.Array) else pa.array(c[at : at + LISTED], kind) for c, (_, kind) in zip(columns, kinds)], fields=[pa.field(*k) for k in kinds])
        return pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)

    def found(batches):
        for batch in (part for b in batches for part in chunks([b], 256)):
            for rows, words in words_of_groups(batch.column(1)):
                ids, text = batch.column(0)[rows].to_numpy(), words.text
                first, last = paragraphs_of(words, max(min_words, SHINGLE))
                banded = minhash_bands(words, first, last, bands).view(np.int64)
                banded = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * bands, pa.int32()), pa.array(banded.ravel()))
                lines = [ids[text[first]], first - words.first[text[first]], last - first, *_two_parts(_text_keys(words, first, last)), banded]
                bucket, anchor, run = block_entries(words, BLOCK_BANDS)
                entries = [bucket, ids[text[anchor]], anchor - words.first[text[anchor]], run]
                for at in range(0, max(len(first), len(bucket)), LISTED):
                    yield pa.RecordBatch.from_arrays([structs(lines, line, at), structs(entries, entry, at)], ["lines", "entries"])

    return arrow_map(texts_of(docs), found, "lines array<struct<doc_id: long, word: int, words: int, fp: long, check: int, bands: array<long>>>, entries array<struct<bucket: long, doc_id: long, word: int, run: int>>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the wanted paragraphs (doc_id, word, words, key), read from their documents."""

    def cut(batches):
        for batch in (part for b in batches for part in chunks([b], 256)):
            keys, sets = [], []
            for rows, words in words_of_groups(batch.column(0)):
                hashes = words.shingles(SHINGLE).view(np.int64)
                for start, end, spans in zip(words.first[:-1], words.first[1:], batch.column(1)[rows].to_pylist()):
                    for span in spans:
                        a, b = start + span["word"], start + span["word"] + span["words"]
                        if b <= end and _two_parts(_text_keys(words, [a], [b]))[0][0] == span["key"]:
                            keys.append(span["key"])
                            sets.append(np.unique(hashes[a : b - SHINGLE + 1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("word", "words", "key")).alias("spans"))
    return arrow_map(texts_with(docs, lists, "spans").select("text", "spans"), cut, "key long, shingles array<long>")


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether the exact Jaccard similarity of two arrays of distinct values reaches the bound, which sizes too far apart can't; the shared values are counted once."""
    bound = similarity - 1e-9
    near = F.least(F.size(a), F.size(b)) >= F.lit(bound) * F.greatest(F.size(a), F.size(b))
    return near & (F.size(F.array_intersect(a, b)) >= F.lit(bound / (1 + bound)) * (F.size(a) + F.size(b)))


@settled
def similar_paragraphs(docs: DataFrame, paragraphs: DataFrame, similarity: float) -> DataFrame:
    """(key, root) of each paragraph text that is linked to another one; root names its component.

    paragraphs: (doc_id, word, words, key, bands). Equal texts are one key from the start. A bucket of two is a pair to be verified. In a larger bucket each text is first verified against up to PIVOTS others drawn by hash, and what these links join is not
    paired any more; then every text outside the first pivot's component is verified against the bucket's others.
    So a group of very many near copies gives links in proportion to its size and no verified link between components is lost.
    """
    kinds = checkpoint(paragraphs.groupBy("key").agg(F.min(F.struct("doc_id", "word", "words")).alias("at"), F.first("bands").alias("bands")))
    entries = kinds.select("key", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("u"), F.max("key").alias("v"))
    shared = checkpoint(shared.where("n > 1"))
    placed = checkpoint(entries.join(small(shared.where("n > 2").select("bucket")), "bucket"))
    pivots = [F.min_by("key", F.xxhash64("key", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = placed.groupBy("bucket").agg(*pivots).select("bucket", F.col("p0").alias("pivot"), F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots"))
    crowded = checkpoint(placed.join(small_checkpoint(pivots), "bucket"))
    lone = shared.where("n = 2").select("u", "v")
    pairs = crowded.select("key", F.explode("pivots").alias("other")).where("key <> other").select(F.least("key", "other").alias("u"), F.greatest("key", "other").alias("v"))
    pairs = checkpoint(lone.unionByName(pairs).distinct())
    wanted = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
    sets = checkpoint(_shingle_sets(docs, kinds.join(wanted, "key", "left_semi").select("at.*", "key")))

    left = sets.select(F.col("key").alias("u"), F.col("shingles").alias("us"))
    right = sets.select(F.col("key").alias("v"), F.col("shingles").alias("vs"))
    first = pairs.join(left, "u").join(right, "v").where(_alike(F.col("us"), F.col("vs"), similarity)).select("u", "v")
    labels = connected_components(first).select(F.col("node").alias("key"), F.col("root").alias("label"))

    named = checkpoint(sets.select("key").join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label")))
    lead = named.select(F.col("key").alias("pivot"), F.col("label").alias("lead"))
    members = checkpoint(crowded.select("bucket", "key", "pivot").join(named, "key").join(lead, "pivot").select("bucket", "key", "label", "lead"))
    outside = members.where("label <> lead")
    open_buckets = members.join(outside.select("bucket").distinct(), "bucket", "left_semi")
    full = sets.join(kinds.select("key", "bands"), "key")
    a = outside.join(full, "key").select("bucket", F.col("key").alias("u"), F.col("label").alias("ul"), F.col("shingles").alias("us"), F.col("bands").alias("ub"))
    b = open_buckets.join(full, "key").select(F.col("bucket").alias("vb0"), F.col("key").alias("v"), F.col("label").alias("vl"), "lead", F.col("shingles").alias("vs"), F.col("bands").alias("vb"))
    earliest = F.element_at(F.array_intersect("ub", "vb"), 1) == F.col("bucket")
    once = (F.col("vl") == F.col("lead")) | (F.col("u") < F.col("v"))
    match = (F.col("bucket") == F.col("vb0")) & (F.col("ul") != F.col("vl")) & once & earliest & _alike(F.col("us"), F.col("vs"), similarity)
    second = a.join(b, match).select(F.col("ul").alias("u"), F.col("vl").alias("v"))
    roots = connected_components(second).select(F.col("node").alias("label"), "root")
    joined = named.join(roots, "label", "left").select("key", F.coalesce("root", "label").alias("root"))
    crowd = joined.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    return joined.join(crowd, "root", "left_semi").select("key", "root")


@settled
def whole_copies(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(copies, odd): (doc_id, words, kept_doc_id, component) of documents of `min_words` words or more whose whole text an earlier document has too, and (doc_id, mixed) of ids that stand in several rows, mixed if their texts differ."""
    keys = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("fp"), F.xxhash64(F.lit(1), "text").alias("check")))
    odd = checkpoint(keys.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("fp") < F.max("fp")).alias("mixed")).where("n > 1").drop("n"))
    keys = keys.join(small(odd.where("mixed").select("doc_id")), "doc_id", "left_anti")
    kept = keys.groupBy("fp", "check").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("most")).where("kept_doc_id < most").drop("most")
    copies = keys.join(small_checkpoint(kept), ["fp", "check"]).where("doc_id > kept_doc_id").select("doc_id", "kept_doc_id", F.xxhash64("fp", "check").alias("component"))
    words = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).alias("words")
    # written before it is filtered: the condition would be pushed below the join and count the words of all texts
    copies = checkpoint(docs.join(small_checkpoint(copies.distinct()), "doc_id").select("doc_id", words, "kept_doc_id", "component"))
    return copies.where(F.col("words") >= min_words).distinct(), odd


@settled
def repeated_spans(docs: DataFrame, min_words: int = BLOCK, similarity: float = 0.8, recall: float = 0.999) -> DataFrame:
    """(doc_id, word, words, kind, kept_doc_id, component) of all text that repeats text of a document of smaller id.

    word, words: the span in words of the document. kind: `document` (the whole text of `min_words` words or more is equal),
    `paragraph` (a line of at least `min_words` words, equal or similar to the kept one) or `block` (the words of BLOCK-word blocks at any place
    that are similar, which also covers stretches of shorter lines). component: a hash that all spans of a cluster share.
    A pair of lines at the threshold is found with the chance `recall`; a pair of blocks of similarity s with 1 - (1 - s * s) ** BLOCK_BANDS, so equal ones always.

    Nulls: a null text has no spans, documents with a null doc_id take no part. Empty and blank texts have no spans; very long texts are
    taken whole, in pieces of bounded size. Ties: of equal doc_ids none is earlier, so repeats within one document stay, and so do
    repeated rows of one doc_id; rows of a doc_id that names different texts take no part. An empty table gives an empty result; other columns are not read, so their names can't clash.
    Two lines whose 64-bit hashes are equal though the texts are not (told by a second hash) are left alone as lines, and still found as blocks.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copies, odd = whole_copies(docs, min_words)
    docs = docs.join(small(copies.select("doc_id").unionByName(odd.where("mixed").select("doc_id"))), "doc_id", "left_anti")
    again = odd.where("not mixed").select("doc_id")
    if not again.isEmpty():  # each document once
        docs = docs.join(small(again), "doc_id", "left_anti").unionByName(docs.join(small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    made = written(units(docs, min_words, tune_bands(similarity, recall)), "units")
    listed = made.select(F.inline("lines"))
    lone = listed.groupBy("fp").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("fp")
    paragraphs = listed.join(small_checkpoint(lone), "fp", "left_anti").select("doc_id", "word", "words", F.col("fp").alias("key"), "bands")

    roots = similar_paragraphs(docs, paragraphs, similarity)
    kinds = paragraphs.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    kinds = checkpoint(kinds.join(roots, "key", "left").select("key", "least", "most", F.coalesce("root", "key").alias("root")))
    kept = checkpoint(kinds.groupBy("root").agg(F.min("least").alias("kept_doc_id"), F.max("most").alias("most")).where("kept_doc_id < most").drop("most"))
    known = checkpoint(kinds.join(small(kept), "root").select("key", "root", "kept_doc_id"))
    lines = paragraphs.drop("bands").join(small(known), "key").where("doc_id > kept_doc_id")
    lines = checkpoint(lines.select("doc_id", "word", "words", F.lit("paragraph").alias("kind"), "kept_doc_id", F.xxhash64("root").alias("component")))

    links, block_roots = similar_blocks(docs, made.select(F.inline("entries")), similarity)
    blocks = repeated_blocks(links, block_roots)
    removed(made)
    removed(links)
    whole = copies.select("doc_id", F.lit(0).alias("word"), "words", F.lit("document").alias("kind"), "kept_doc_id", "component")
    return whole.unionByName(lines).unionByName(blocks.withColumn("kind", F.lit("block")))


def removals(spans: DataFrame) -> DataFrame:
    """(doc_id, word, words, kinds, kept_doc_ids, component): overlapping and adjacent spans of a document merged into one removal."""
    order = Window.partitionBy("doc_id").orderBy("word", "words", "kind", "kept_doc_id")
    reach = F.max(F.col("word") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("word") <= F.col("reach"), 0).otherwise(1)).over(order)
    merged = spans.withColumn("reach", reach).withColumn("island", island).groupBy("doc_id", "island").agg(
        F.min("word").alias("word"), F.max(F.col("word") + F.col("words")).alias("end"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set("kept_doc_id")).alias("kept_doc_ids"), F.min("component").alias("component"),
    )
    return merged.select("doc_id", "word", (F.col("end") - F.col("word")).alias("words"), F.concat_ws("+", "kinds").alias("kinds"), "kept_doc_ids", "component")


def find_repeats(docs: DataFrame, **options) -> DataFrame:
    """removals() of docs; see repeated_spans."""
    return removals(repeated_spans(docs, **options))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of each span (first word, number); of the blanks around a span those with a line's end stay, else those before it."""
    words, raw = Words.of(text), text.encode("utf-8", "surrogatepass")
    n, out, at = len(words.starts), [], 0
    for a, size in sorted(spans):
        if a >= n:
            continue
        b = min(a + size, n)
        before = raw[words.ends[a - 1] if a else 0 : words.starts[a]]
        after = raw[words.ends[b - 1] : words.starts[b]] if b < n else b""
        out += [raw[at : words.ends[a - 1] if a else 0], after if b"\n" in after and b"\n" not in before and a else before]
        at = int(words.starts[b]) if b < n else len(raw)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated paragraphs and passages cut out of `text` (see repeated_spans); `n_chars`, if there, follows the text; other columns as they came, whatever their names.

    Documents that are left without any word go; those that came without words, null texts among them, stay. Rows with a null doc_id stay as they are, and so
    do repeated rows of one doc_id as far as their text isn't repeated elsewhere; ties and very long texts as there; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    name, spans, cut = (unused(docs, n) for n in ("repeat_id", "repeat_spans", "repeat_free"))
    lists = find_repeats(docs, **options).groupBy(F.col("doc_id").alias(name)).agg(F.sort_array(F.collect_list(F.struct("word", "words"))).alias(spans))

    @F.pandas_udf("string")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        give_back_memory()
        return pd.Series([t if s is None else without_words(t, [(x["word"], x["words"]) for x in s]) for t, s in zip(texts, spans)], dtype=object)

    marked = docs.join(small_checkpoint(lists, spans), F.col("doc_id") == F.col(name), "left")
    same = F.col(spans).isNull()
    marked = marked.withColumn(cut, F.when(same, F.col("text")).otherwise(left("text", spans)))
    out = marked.where(same | F.col(cut).rlike(r"[^ \t\n\x0B\f\r]")).withColumn("text", F.col(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
