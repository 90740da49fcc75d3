"""Spelling variants: words one edit apart, found by self-joins of tries with active-node sets, and the form that each word stands for.

The vocabulary is dealt to tries by what two words an edit apart must share. With l code points in the shorter one and h = l div 2, they either share
their first h code points, and the edit lies behind this prefix, or the edit lies in the prefix and they share the last l - h. So a word stands in the trie
of its prefix and in that of its suffix, once for partners of its own length and longer and once for shorter ones. A trie with too many words is dealt
again by halving the range in which the edit may lie; ranges of one code point hold a number of words that the alphabet bounds.

A pair belongs to the range that holds its first difference, so it is found in one trie only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, bound_batches, checkpoint, settled, small

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_POINTS, LEAST_COUNT, CHANGED = 5, 3, 97
#: Words that a trie holds before it is dealt again, rows and bytes that a task joins at once.
TRIE_WORDS, ROWS, BYTES = 20_000, 1 << 16, 8 << 20


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least LEAST_POINTS code points that occur LEAST_COUNT times or more.

    Words are the runs of letters of whole texts, A-Z in lower case; of one run in CHANGED, picked by a checksum of document and run, a code point
    is deleted. Null and empty texts have no words, a null doc_id counts as an empty one; repeated rows count each.
    """
    lower = F.translate(F.col("text").cast("string"), ascii_uppercase, ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), 0)).alias("run"))
    long = F.char_length("run") >= LEAST_POINTS
    hashed = runs.where(long).withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % CHANGED == 0, F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= LEAST_POINTS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(entries: DataFrame) -> DataFrame:
    """entries (word, n, l, lo, hi) with the trie that each stands in: `key`, and the code points before the edit's range, in it and behind it."""
    inside = F.least("hi", "l") - F.col("lo")
    behind = F.col("l") - F.least("hi", "l")
    shared = F.concat_ws(":", "l", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substr("word", F.char_length("word") - behind + 1))
    return entries.withColumns({"inside": inside, "key": shared})


def _entries(words: DataFrame) -> DataFrame:
    """Each word for its own and the next smaller length, in the trie of its prefix and in that of its suffix."""
    sizes = F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda x: x >= LEAST_POINTS)
    rows = words.select("word", "n", F.explode(sizes).alias("l")).withColumn("h", F.expr("l div 2").cast("int"))
    ranges = F.array(F.struct(F.lit(0).alias("lo"), F.col("h").alias("hi")), F.struct(F.col("h").alias("lo"), (F.col("l") + 1).alias("hi")))
    return rows.select("word", "n", "l", F.inline(ranges))


def _dealt(words: DataFrame, trie_words: int) -> DataFrame:
    """All entries with their tries, of which only those of one code point may have more than trie_words words."""
    now, done = _keyed(_entries(words)), None
    while True:
        crowded = checkpoint(now.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > trie_words).select("key"))
        if crowded.isEmpty():
            return now if done is None else done.unionByName(now)
        crowded = small(crowded)
        kept = now.join(crowded, "key", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        half = F.expr("(lo + hi) div 2").cast("int")
        halves = F.array(F.struct(F.col("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi")))
        split = now.join(crowded, "key", "left_semi").select("word", "n", "l", F.inline(halves))
        now = checkpoint(_keyed(split))


@dataclass
class _Level:
    """Nodes of one depth of all tries: their first rows, their children in the next level, and whether shorter and longer words end below."""

    first: np.ndarray
    of_row: np.ndarray
    parent: np.ndarray
    char: np.ndarray
    short: np.ndarray
    long: np.ndarray
    begin: np.ndarray  # first child of each node of the level above

    @property
    def key(self) -> np.ndarray:
        return self.parent * 256 + self.char


def _level(depth: int, above: _Level | None, lcp: np.ndarray, points: np.ndarray, short: np.ndarray) -> _Level:
    deepest = points.shape[1]
    first = np.flatnonzero(lcp < depth) if depth < deepest else np.flatnonzero(~short)
    if depth < deepest:
        of_row = np.cumsum(lcp < depth) - 1
        has_short, has_long = np.logical_or.reduceat(short, first), np.logical_or.reduceat(~short, first)
    else:
        of_row, has_short, has_long = np.empty(0, dtype=np.int64), np.zeros(len(first), dtype=bool), np.ones(len(first), dtype=bool)
    parent = above.of_row[first] if above else np.zeros(len(first), dtype=np.int64)
    char = points[first, depth - 1].astype(np.int64) if depth else np.zeros(len(first), dtype=np.int64)
    begin = np.searchsorted(parent, np.arange(len(above.first) + 1)) if above else np.zeros(1, dtype=np.int64)
    return _Level(first, of_row, parent, char, has_short, has_long, begin)


def _spread(begin: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in nodes, child) for each child of each of the nodes."""
    count = begin[nodes + 1] - begin[nodes]
    of = np.repeat(np.arange(len(nodes)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + begin[nodes][of]


def _together(u: np.ndarray, v: np.ndarray, below_u: _Level, below_v: _Level, banned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The active pairs one code point deeper: children of u and v with equal code points; not the banned one of each pair."""
    of, child = _spread(below_u.begin, u)
    wanted, keys = v[of] * 256 + below_u.char[child], below_v.key
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    found = keys[at] == wanted if len(keys) else np.zeros(len(of), dtype=bool)
    if banned is not None:
        found &= below_u.char[child] != banned[of]
    return child[found], at[found]


def near_rows(lcp: np.ndarray, points: np.ndarray, short: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are one edit apart.

    points: rows by trie, then by word: the code points in the edit's range, one more for longer words than for shorter ones (where it is 0).
    lcp: code points shared with the row before, -1 at the start of a trie. last: tries whose range reaches behind the shorter word.

    All tries go down together. An active set holds the pairs of nodes at distance one; that of a child comes from its parent's: by equal code points on both
    sides, by two different children of one node (replacement), and by a node and its child (insertion in the longer word). An insertion is made as far right
    as it can stand, so its next code point differs from the inserted one and every pair comes up once.
    """
    width = points.shape[1] - 1
    none = np.empty(0, dtype=np.int64)
    replaced, inserted = (none, none), (none, none)
    here = _level(0, None, lcp, points, short)
    below = _level(1, here, lcp, points, short)
    for depth in range(width + 1):
        child = np.flatnonzero(below.long & here.short[below.parent])
        if depth == width:
            child = child[last[here.first[below.parent[child]]]]
        banned = np.concatenate((np.zeros(len(inserted[0]), dtype=np.int64), below.char[child]))
        inserted = np.concatenate((inserted[0], below.parent[child])), np.concatenate((inserted[1], child))
        if depth == width:
            break
        next_below = _level(depth + 2, below, lcp, points, short)
        siblings = np.arange(len(below.first))
        count = below.begin[below.parent + 1] - siblings - 1
        one = np.repeat(siblings, count)
        other = one + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count) + 1
        deeper = _together(*replaced, below, below)
        replaced = np.concatenate((deeper[0], one)), np.concatenate((deeper[1], other))
        kept = below.short[replaced[0]] & below.short[replaced[1]]
        replaced = replaced[0][kept], replaced[1][kept]
        inserted = _together(*inserted, below, next_below, banned)
        kept = below.short[inserted[0]] & next_below.long[inserted[1]]
        inserted = inserted[0][kept], inserted[1][kept]
        here, below = below, next_below
    ends = np.full(len(here.first), -1, dtype=np.int64)
    ends[here.of_row[short]] = np.flatnonzero(short)
    return np.concatenate((ends[replaced[0]], ends[inserted[0]])), np.concatenate((ends[replaced[1]], below.first[inserted[1]]))


def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, n, n_near, best) of words with partners, from whole tries (inside, key, l, lo, hi, word, n), sorted by inside, key and word."""
    key = rows.column("key").combine_chunks()
    new = np.concatenate(([True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)))
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    rows, new = rows.filter(pa.array(np.repeat(size > 1, size))), new[np.repeat(size > 1, size)]
    if not rows.num_rows:
        return
    inside, l, lo, hi, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("inside", "l", "lo", "hi", "n"))
    words = rows.column("word").combine_chunks()
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    letters = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), dtype=np.uint8)
    start = np.cumsum(length) - length + lo
    pairs = []
    for a, b in zip(edges := np.flatnonzero(np.concatenate(([True], np.diff(inside) != 0))), [*edges[1:], len(inside)]):
        width, short = int(inside[a]), length[a:b] == l[a:b]
        points = letters[np.minimum(start[a:b, None] + np.arange(width + 1), len(letters) - 1)]
        points[short, width] = 0
        differs = np.argmax(points[1:] != points[:-1], axis=1)
        lcp = np.where(new[a:b], -1, np.concatenate(([-1], differs)))
        found = near_rows(lcp, points, short, hi[a:b] > l[a:b])
        pairs.append((found[0] + a, found[1] + a))
    one, other = (np.concatenate(x) for x in zip(*pairs))
    one, other = np.concatenate((one, other)), np.concatenate((other, one))
    if not len(one):
        return
    order = np.lexsort((np.arange(len(n)), -n))  # rows of one trie are in the order of words
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    count, best = np.bincount(one, minlength=len(n)), np.full(len(n), len(n))
    np.minimum.at(best, one, rank[other])
    at = np.flatnonzero(count)
    form = order[best[at]]
    best = pa.StructArray.from_arrays([pa.array(-n[form]), words.take(pa.array(form))], ["minus_n", "word"])
    yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(n[at]), pa.array(count[at].astype(np.int64)), best], ["word", "n", "n_near", "best"])


def _whole_tries(batches) -> Iterator[pa.RecordBatch]:
    """joined() over pieces of about ROWS rows or BYTES bytes that end where a trie ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS and sum(b.nbytes for b in held) < BYTES:
            continue
        rows = pa.Table.from_batches(held)
        key = rows.column("key").combine_chunks()
        changes = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield from joined(rows.slice(0, cut))
        held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield from joined(pa.Table.from_batches(held))


def near_words(words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, n, n_near, best): for each word (word, n) the number of words one edit apart and the most frequent of them as struct(minus_n, word).

    Words without partners have 0 and null; of equally frequent partners the first in code-point order is the best. Words are distinct, over U+0001 to U+00FF.
    """
    bound_batches(words.sparkSession)
    kind = "word string, n long, n_near long, best struct<minus_n long, word string>"
    entries = _dealt(words, trie_words).select("inside", "key", "l", "lo", "hi", "word", "n")
    found = arrow_map(entries.repartition("key").sortWithinPartitions("inside", "key", "word"), _whole_tries, kind)
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus_n:bigint,word:string>").alias("best"))
    return found.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form) by pointer doubling: after each round every pointer reaches twice as far."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("at"), F.col("root").alias("far"))
        moved = checkpoint(now.join(far, F.col("root") == F.col("at"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


@settled
def spelling_forms(docs: DataFrame, factor: int = 2, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of vocabulary().

    n_near counts the words that differ by one inserted, deleted or replaced code point. form is the most frequent of them (ties: the first in code-point
    order) if it is at least `factor` times as frequent, else null; root is reached by following forms, the word itself without one.

    Null and empty texts have no words; very long texts are read whole, and words of any length are compared; repeated rows count each; an empty table gives
    an empty result; only doc_id and text are read, whatever else the columns are named. A frequent word is counted before the shuffle, a frequent prefix
    is dealt again (see above), and what a task sends on is one row a word and trie, not pairs.
    """
    words = checkpoint(vocabulary(docs))
    near = near_words(words, trie_words)
    found: Column = -F.col("best.minus_n") >= factor * F.col("n")
    named = checkpoint(near.select("word", "n", "n_near", F.when(found, F.col("best.word")).alias("form"), F.when(found, -F.col("best.minus_n")).alias("form_n")))
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
