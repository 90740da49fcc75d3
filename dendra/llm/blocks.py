"""Overlapping word blocks: MinHash banding of every BLOCK words of a text, verified by exact Jaccard similarity.

A passage may repeat inside paragraphs that differ otherwise, at any place. So the BLOCK words from each word on
are a paragraph of their own. Neighbouring blocks share most of their shingles and so their band values: one
entry stands for a run of blocks with one value, which makes 4 / (BLOCK - 2) entries a word and band. An entry
is anchored at the shingle that gives its first minimum; two entries of a bucket are compared at all places
relative to the anchor that both runs hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, checkpoint, chunks, settled, small, texts_with, written
from .components import connected_components, joined
from .words import Words, mixed, words_of_groups

SHINGLE = 5
BLOCK = 50
#: Shingles of a block, words around an anchor that its blocks can hold, and shingles there.
SPAN = BLOCK - SHINGLE + 1
BEFORE, AROUND = SPAN - 1, SPAN + BLOCK - 1
PLACES = AROUND - SHINGLE + 1
#: Words of a document whose hashes are sent together.
TILE = 256
#: Tiles are broadcast up to so many (1.4 kB each); more are joined by shuffling.
BROADCAST_TILES = 8192
PIVOTS = 3
#: Entries of a part of a crowded bucket, entries compared at once (whole cells, so twice CELL_ROWS may be added), and pairs of them that are listed at once.
CELL_ROWS, ROWS_AT_ONCE, PAIRS_AT_ONCE = 8192, 4096, 1 << 18
#: Places of blocks that share what they look up.
STRIDE = 8
#: Windows handled at once in a very long text.
PIECE = 1 << 18
_LOW = np.uint64(63)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    held = 1
    while 2 * held <= width:
        values, held = np.minimum(values[:-held], values[held:]), 2 * held
    rest = width - held
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def block_entries(words: Words, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, anchor, run) of each run of a text's blocks with one value in a band of two MinHash values; anchors count the words of all texts.

    run holds how many words before the anchor the first and the last block start, as 64 * first + last.
    """
    rng = np.random.default_rng(31)
    scale = rng.integers(1 << 63, size=(bands, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shingles, text = words.shingles(SHINGLE), words.text
    found: list[tuple] = []
    for at in range(0, max(0, len(shingles) - SPAN + 1), PIECE):
        some = shingles[at : at + PIECE + SPAN - 1]
        of = text[at : at + len(some) - SPAN + BLOCK]
        place = (np.arange(at, at + len(some)) - words.first[of[: len(some)]]).astype(np.uint64)
        whole = np.flatnonzero(of[: len(some) - SPAN + 1] == of[BLOCK - 1 :])
        if not len(whole):
            continue
        of = of[whole]
        for band in range(bands):
            # the last bits name the place, so that the minimum tells where it stands
            least = sliding_minimum((some * scale[band, 0]) & ~_LOW | place & _LOW, SPAN)[whole]
            value = mixed((least & ~_LOW) + mixed(sliding_minimum(some * scale[band, 1], SPAN)[whole]) + np.uint64(band))
            first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1]))))
            last = np.append(first[1:], len(value)) - 1
            start = whole[first]
            before = (least[first] - place[start]) & _LOW
            after = before.astype(np.int64) - (last - first)
            keep = np.maximum(after, 0)  # a repeated shingle may stand for the blocks beyond it
            found.append((value[first].view(np.int64), at + start + before.astype(np.int64), before.astype(np.int64) * 64 + keep))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _node(doc: str, word: str):
    return F.xxhash64(F.col(doc), F.col(word))


def _short_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """4-byte hashes of the words of each text."""
    for _, words in words_of_groups(texts):
        yield from np.split((words.hashes >> np.uint64(32)).astype("<u4"), words.first[1:-1])


def _tiles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tile, hashes): 4-byte hashes of the words around the anchors of the wanted tiles (doc_id, tile); cut off at the text's ends."""

    def cut(batches):
        for batch in (part for b in batches for part in chunks([b], 64)):
            ids, tiles, held = [], [], []
            for i, hashes, wants in zip(batch.column(0).to_pylist(), _short_hashes(batch.column(1)), batch.column(2).to_pylist()):
                # what stands in for words before the text differs, so that it doesn't count as repeats
                padded = np.concatenate([np.arange(BEFORE, dtype="<u4"), hashes, np.arange(BLOCK, dtype="<u4")])
                for tile in wants:
                    ids.append(i)
                    tiles.append(tile)
                    held.append(padded[tile * TILE : (tile + 1) * TILE + AROUND - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tiles, pa.int32()), pa.array(held, pa.binary())], ["doc_id", "tile", "hashes"])

    lists = wanted.distinct().groupBy("doc_id").agg(F.collect_list("tile").alias("tiles"))
    return arrow_map(texts_with(docs, lists, "tiles"), cut, "doc_id long, tile int, hashes binary")


def _shingles_of(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each SHINGLE neighbouring words."""
    wide, out = hashes.astype(np.uint64), np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        out = (out ^ wide[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _least_shared(similarity: float) -> int:
    """Shingles that two blocks of distinct shingles must share to be similar."""
    return int(np.ceil(2 * SPAN * similarity / (1 + similarity) - 1e-6))


def similar_places(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of rows of PLACES shingles: whether the blocks from each place on are similar, and which shingles of either the other has.

    low, high: the first and last place to be compared. The sets' exact Jaccard similarity decides. Similar
    blocks of distinct shingles lack few of each other's, so that a shared shingle stands at most so many places
    apart and sums over these diagonals are exact; rows with repeated shingles are compared as sets.
    """
    least, n, place = _least_shared(similarity), len(a), np.arange(PLACES)
    inside = (place[:SPAN] >= low[:, None]) & (place[:SPAN] <= high[:, None])
    seen = (place >= low[:, None]) & (place < high[:, None] + SPAN)
    # what no compared block holds counts as distinct
    repeated = [(lambda x: (x[:, 1:] == x[:, :-1]).any(axis=1))(np.sort(np.where(seen, x, place.astype(np.uint64)), axis=1)) for x in (a, b)]
    # text moved within a block breaks it at two places, which costs 2 * (SHINGLE - 1) shingles; if so many may be lacking, diagonals don't suffice
    as_sets = repeated[0] | repeated[1] if SPAN - least < 2 * (SHINGLE - 1) else np.ones(n, dtype=bool)
    out = np.zeros((n, SPAN), dtype=bool)
    in_b, in_a = np.zeros((n, PLACES), dtype=bool), np.zeros((n, PLACES), dtype=bool)

    def diagonals(rows: np.ndarray, shifts: range) -> np.ndarray:
        """Shingles that the blocks from each place on share on these diagonals: pairs that end within the block, less those that begin before it."""
        own, other, own_in, other_in = a[rows], b[rows], np.zeros((len(rows), PLACES), dtype=bool), np.zeros((len(rows), PLACES), dtype=bool)
        begin, end = np.zeros((2, len(rows), PLACES), dtype=np.uint8)
        for shift in shifts:
            i, j = slice(max(0, -shift), PLACES - max(0, shift)), slice(max(0, shift), PLACES + min(0, shift))
            same = own[:, i] == other[:, j]
            own_in[:, i] |= same
            other_in[:, j] |= same
            begin[:, i if shift > 0 else j] += same.view(np.uint8)
            end[:, j if shift > 0 else i] += same.view(np.uint8)
        in_b[rows], in_a[rows] = own_in, other_in
        begun = np.zeros((len(rows), SPAN), dtype=np.int16)
        np.cumsum(begin[:, : SPAN - 1], axis=1, dtype=np.int16, out=begun[:, 1:])
        return np.cumsum(end, axis=1, dtype=np.int16)[:, SPAN - 1 :] - begun

    plain = np.flatnonzero(~as_sets)
    shared = diagonals(plain, range(1))
    out[plain] = shared >= least
    rest = np.flatnonzero((inside[plain] & (shared < least)).any(axis=1))
    out[plain[rest]] = diagonals(plain[rest], range(least - SPAN, SPAN - least + 1)) >= least
    out &= inside
    as_sets = np.flatnonzero(as_sets)
    for at in range(0, len(as_sets), 32):
        some = as_sets[at : at + 32]
        same = a[some][:, :, None] == b[some][:, None, :]
        in_b[some], in_a[some] = same.any(axis=2), same.any(axis=1)
        sizes = [_distinct(x[some]) for x in (a, b)]
        upto = np.zeros((len(some), PLACES, PLACES + 1), dtype=np.uint8)
        np.cumsum(same, axis=2, dtype=np.uint8, out=upto[:, :, 1:])
        held = upto[:, :, SPAN:] != upto[:, :, :SPAN]  # by the other's block from each place on
        both = (held & sizes[0]).sum(axis=1, dtype=np.int16)
        total = sizes[0].sum(axis=1, dtype=np.int16) + sizes[1].sum(axis=1, dtype=np.int16)
        out[some] = (both >= (similarity - 1e-9) * (total - both)) & inside[some]
    return out, in_b, in_a


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Whether each shingle stands in the block from each place on and no equal one before it there."""
    place = np.arange(PLACES)
    by = np.argsort(rows, axis=1, kind="stable")
    ordered, before = np.take_along_axis(rows, by, axis=1), np.full(rows.shape, -1)
    np.put_along_axis(before, by[:, 1:], np.where(ordered[:, 1:] == ordered[:, :-1], by[:, :-1], -1), axis=1)
    block = (place[:, None] >= place[:SPAN]) & (place[:, None] < place[:SPAN] + SPAN)
    return block & (before[:, :, None] < place[:SPAN])


def shared_bounds(shared: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first shared shingle from `first` on, and after the last one's words, in blocks that start at `first` to `last`."""
    place = np.arange(PLACES)
    some = shared & (place >= first[:, None]) & (place < last[:, None] + SPAN)
    return some.argmax(axis=1), PLACES - some[:, ::-1].argmax(axis=1) + SHINGLE - 1


LINK = "u long, up int, v long, vp int, us int, ue int, vs int, ve int, uc int, ud int"
LINK_NAMES = [c.split()[0] for c in LINK.split(", ")]
LINK_KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 7]
CELL = "cell long, doc_id long, word int, run int, hashes binary"
CELL_NAMES = [c.split()[0] for c in CELL.split(", ")]


def _compared(a: np.ndarray, b: np.ndarray, up: np.ndarray, ur: np.ndarray, vp: np.ndarray, vr: np.ndarray, similarity: float) -> tuple[np.ndarray, tuple]:
    """Which pairs of entries have similar blocks, given the shingles around both, and the columns us to ud of their links."""
    low, high = BEFORE - np.minimum(ur >> 6, vr >> 6), BEFORE - np.maximum(ur & 63, vr & 63)
    alike, in_v, in_u = similar_places(a, b, low, high, similarity)
    kept = np.flatnonzero(alike.any(axis=1))
    first, last = alike[kept].argmax(axis=1), SPAN - 1 - alike[kept][:, ::-1].argmax(axis=1)
    p, q, r = up[kept], vp[kept], ur[kept]
    (us, ue), (vs, ve) = ([p0 - BEFORE + x for x in shared_bounds(of[kept], first, last)] for of, p0 in ((in_v, p), (in_u, q)))
    return kept, (us, ue, vs, ve, np.maximum(us, p - (r & 63)), np.minimum(ue, p - (r >> 6) + BLOCK))


@settled
def verified(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Columns LINK of each pair (u, up, ur, v, vp, vr; u < v) of entries that has similar blocks.

    us to ue, vs to ve: the words of all similar blocks in both documents, from the first shared shingle to the last; uc to ud: those that all blocks of u's entry hold.
    """
    tiled = pairs.select("u", (F.col("up") / TILE).cast("int").alias("ut"), "v", (F.col("vp") / TILE).cast("int").alias("vt"), F.struct("up", "ur", "vp", "vr").alias("places"))
    bounds = [f(f"places.{c}p").alias(f"{c}{n}") for c in "uv" for f, n in ((F.min, "0"), (F.max, "1"))]
    tiled = checkpoint(tiled.groupBy("u", "ut", "v", "vt").agg(F.collect_set("places").alias("places"), *bounds))
    wanted = tiled.select(F.col("u").alias("doc_id"), F.col("ut").alias("tile")).unionByName(tiled.select(F.col("v").alias("doc_id"), F.col("vt").alias("tile")))
    tiles = checkpoint(_tiles(docs, wanted))
    tiles = F.broadcast(tiles) if tiles.count() <= BROADCAST_TILES else tiles
    left = tiles.select(F.col("doc_id").alias("u"), F.col("tile").alias("ut"), F.col("hashes").alias("uh"))
    right = tiles.select(F.col("doc_id").alias("v"), F.col("tile").alias("vt"), F.col("hashes").alias("vh"))

    def side(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of all rows of a column one after another, and where each row starts."""
        raw = [x.as_buffer() for x in batch.column(column)]
        sizes = np.array([x.size // 4 for x in raw], dtype=np.int64)
        flat = np.concatenate([np.frombuffer(x, dtype="<u4") for x in raw])
        # behind a row that a text's end cuts off the next one's words may follow; no compared block reaches there
        return _shingles_of(np.concatenate([flat, np.arange(AROUND + TILE, dtype="<u4")])), np.cumsum(sizes) - sizes

    def compared(batches):
        for batch in (part for b in batches for part in chunks([b], 512)):
            (ush, ustart), (vsh, vstart) = side(batch, "uh"), side(batch, "vh")
            places = batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            flat = places.flatten()
            up, ur, vp, vr = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            u, v, u0, v0 = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("u", "v", "u0", "v0"))
            for at in range(0, len(row), 256):
                k = slice(at, at + 256)
                around = np.arange(PLACES)
                a = ush[(ustart[row[k]] + up[k] - u0[k])[:, None] + around]
                b = vsh[(vstart[row[k]] + vp[k] - v0[k])[:, None] + around]
                kept, made = _compared(a, b, up[k], ur[k], vp[k], vr[k], similarity)
                made = (u[k][kept], up[k][kept], v[k][kept], vp[k][kept], *made)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, LINK_KINDS)], LINK_NAMES)

    # only the words around the pair's own anchors are sent on
    own = {c: F.expr(f"substring({c}h, cast(4 * ({c}0 % {TILE}) + 1 as int), cast(4 * ({c}1 - {c}0 + {AROUND}) as int))").alias(f"{c}h") for c in "uv"}
    halves = tiled.join(left, ["u", "ut"]).select("u", "v", "vt", "places", "u0", "v0", "v1", own["u"])
    return arrow_map(halves.join(right, ["v", "vt"]).select("u", "v", "places", "uh", own["v"], "u0", "v0"), compared, LINK)


def _around(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns CELL of the wanted entries (cell, doc_id, word, run), read from their documents; hashes: 4 bytes of each of the AROUND words around the anchor."""

    def cut(batches):
        for batch in (part for b in batches for part in chunks([b], 64)):
            for i, hashes, wants in zip(batch.column(0).to_pylist(), _short_hashes(batch.column(1)), batch.column(2)):
                cell, word, run = (wants.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                padded = np.concatenate([np.arange(BEFORE, dtype="<u4"), hashes, np.arange(TILE, TILE + BLOCK, dtype="<u4")])
                for at in range(0, len(word), 4096):
                    k = slice(at, at + 4096)
                    near = padded[word[k].astype(np.int64)[:, None] + np.arange(AROUND)]
                    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * AROUND), len(near), [None, pa.py_buffer(near.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cell[k], pa.int64()), pa.array(np.full(len(near), i), pa.int64()), pa.array(word[k], pa.int32()), pa.array(run[k], pa.int32()), held], CELL_NAMES)

    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("cell", "word", "run")).alias("wants"))
    return arrow_map(texts_with(docs, lists, "wants"), cut, CELL)


def _first_of_each(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """For each row, the first row of its group (ascending numbers without gaps) in this order."""
    by = np.lexsort((*reversed(order), group))
    return by[np.searchsorted(group[by], np.arange(group.max() + 1))][group]


def _probes(keys: np.ndarray, low: np.ndarray, high: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of what each row of PLACES shingles looks up in `holders`, and holders: rows by shingle.

    Similar blocks hold all but few of each other's shingles, so of more than these few at least one is shared. Each row
    looks up its rarest ones: for every STRIDE places of blocks those among the shingles that all of these blocks hold.
    A row with repeated shingles looks up all of its shingles.
    """
    n, place = len(keys), np.arange(PLACES)
    inside = (place >= low[:, None]) & (place < high[:, None] + SPAN)
    names, ids = np.unique(keys[inside], return_inverse=True)
    row = np.broadcast_to(np.arange(n)[:, None], keys.shape)[inside]
    held = np.unique(ids.astype(np.int64) * n + row)
    bounds = np.searchsorted(held, np.arange(len(names) + 1) * n)
    numbers = np.full(keys.shape, -1, dtype=np.int64)
    numbers[inside] = ids
    ordered = np.sort(numbers, axis=1)
    plain = ~((ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)).any(axis=1)
    common = np.diff(bounds)[numbers]
    few = int((1 - similarity) * SPAN + 1e-6) + 1
    plain &= few <= SPAN - STRIDE
    found = [(ids * n + row)[~plain[row]]]
    for first in range(0, SPAN, STRIDE):
        some = np.flatnonzero(plain & (low + first <= high))
        start = low[some] + first
        last = np.minimum(start + STRIDE - 1, high[some])
        at = last[:, None] + np.arange(SPAN)
        count = np.where(at < start[:, None] + SPAN, np.take_along_axis(common[some], np.minimum(at, PLACES - 1), axis=1), n + 1)
        if len(some):
            rarest = np.take_along_axis(at, np.argpartition(count, few - 1, axis=1)[:, :few], axis=1)
            found.append((numbers[some[:, None], rarest] * n + some[:, None]).ravel())
    probes = np.unique(np.concatenate(found))
    by, name = probes % n, probes // n
    keep = np.flatnonzero(bounds[name + 1] - bounds[name] > 1)
    keep = keep[np.argsort(by[keep], kind="stable")]
    return by[keep], bounds[name[keep]], bounds[name[keep] + 1], held % n


def linked_in_cells(cell: np.ndarray, doc: np.ndarray, word: np.ndarray, run: np.ndarray, hashes: np.ndarray, similarity: float) -> list[tuple]:
    """Columns LINK of similar entries of a cell, for whole cells: no two components of them are left that a similar pair of a cell would join.

    Rows are sorted by cell; hashes: AROUND words a row. Each entry is compared with its cell's smallest document's and up to PIVOTS others, drawn by a
    hash of the document; then with all entries of other components that share one of its rare shingles (see _probes).
    """
    n = len(cell)
    flat = _shingles_of(np.concatenate([hashes.ravel(), np.zeros(SHINGLE - 1, dtype="<u4")]))
    shingles = flat.reshape(n, AROUND)[:, :PLACES]
    low, high = BEFORE - (run >> 6), BEFORE - (run & 63)
    group = np.unique(cell, return_inverse=True)[1]
    label, made = np.arange(n), []

    def compare(a: np.ndarray, b: np.ndarray, prune: bool) -> None:
        nonlocal label
        swap = doc[a] > doc[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        for at in range(0, len(a), 256):
            i, j = a[at : at + 256], b[at : at + 256]
            if prune:
                i, j = (x[label[i] != label[j]] for x in (i, j))
            if not len(i):
                continue
            kept, columns = _compared(shingles[i], shingles[j], word[i], run[i], word[j], run[j], similarity)
            if len(kept):
                u, v = i[kept], j[kept]
                made.append((doc[u], word[u], doc[v], word[v], *columns))
                nodes, roots = joined(label[u], label[v])
                to = np.arange(n)
                to[nodes] = roots
                label = to[label]

    leads = [_first_of_each(group, doc, word, run), *(_first_of_each(group, mixed(doc.view(np.uint64) + np.uint64(k)), doc, word, run) for k in range(1, PIVOTS + 1))]
    pairs = np.unique(np.concatenate([np.minimum(x, np.arange(n)) * n + np.maximum(x, np.arange(n)) for x in leads]))
    pairs = pairs[doc[pairs // n] != doc[pairs % n]]
    compare(pairs // n, pairs % n, False)

    several = np.zeros(group.max() + 1, dtype=bool)
    several[group[label != label[np.searchsorted(group, group)]]] = True
    rest = np.flatnonzero(several[group])
    if not len(rest):
        return made
    keys = mixed(shingles[rest] + mixed(cell[rest].view(np.uint64))[:, None])
    by, start, end, holders = _probes(keys, low[rest], high[rest], similarity)
    upto = np.cumsum(end - start)
    at = 0
    while at < len(by):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        size = end[at:to] - start[at:to]
        i = np.repeat(by[at:to], size)
        j = holders[np.arange(len(i)) + np.repeat(start[at:to] - (np.cumsum(size) - size), size)]
        i, j = rest[i[i < j]], rest[j[i < j]]
        open_pairs = (label[i] != label[j]) & (doc[i] != doc[j])
        pairs = np.unique(i[open_pairs] * n + j[open_pairs])
        compare(pairs // n, pairs % n, True)
        at = to
    return made


def _linked(cells: DataFrame, similarity: float) -> DataFrame:
    """Columns LINK of the similar entries of each cell of rows CELL; see linked_in_cells."""

    def run(batches):
        def links(held: pa.RecordBatch):
            numbers = [held.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            hashes = np.frombuffer(b"".join(x.as_buffer() for x in held.column(4)), dtype="<u4").reshape(-1, AROUND)
            for made in linked_in_cells(*numbers, hashes, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(made, LINK_KINDS)], LINK_NAMES)

        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            if rest.num_rows >= ROWS_AT_ONCE:
                cell = rest.column(0).to_numpy()
                n = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if n:
                    yield from links(rest.slice(0, n))
                    rest = rest.slice(n)
        if rest is not None and rest.num_rows:
            yield from links(rest)

    return arrow_map(cells.repartition("cell").sortWithinPartitions("cell", "doc_id", "word", "run"), run, LINK)


@partial(settled, keep=partial(written, name="links"))
def block_links(docs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Columns LINK of verified pairs of entries (bucket, doc_id, word, run), as a table of written().

    A bucket of two documents' entries is a pair to be verified. The entries of a larger bucket are brought together with the
    words around them and compared there: each with the smallest document's and up to PIVOTS others, then with all of other components that share
    a shingle which similar blocks must share. So no similar pair of a bucket is left in two components, and a group
    of copies isn't paired with itself. A bucket of more than CELL_ROWS entries is cut into parts of about that many, and every two parts
    meet in a cell of their own: a task holds no more, but the cells of such a bucket grow with its square.
    """
    # longs only, so that the counts are made by hashing and not by sorting
    at = F.shiftleft(F.col("word").cast("long"), 12) + F.col("run")
    ends = [F.min("doc_id").alias("u"), F.min_by(at, "doc_id").alias("ua"), F.max("doc_id").alias("v"), F.max_by(at, "doc_id").alias("va")]
    shared = checkpoint(entries.groupBy("bucket").agg(F.count("*").alias("n"), *ends).where("u < v"))
    lone = [x for c in "uv" for x in (F.col(c), F.shiftright(f"{c}a", 12).cast("int").alias(f"{c}p"), F.col(f"{c}a").bitwiseAND(4095).cast("int").alias(f"{c}r"))]
    found = verified(docs, shared.where("n = 2").select(*lone), similarity)
    crowded = small(shared.where("n > 2").select("bucket", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts")))
    crowded = entries.join(crowded, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id", "word"), "parts").cast("int"))
    met = F.expr("transform(sequence(0, parts - 1), p -> xxhash64(bucket, least(part, p), greatest(part, p)))")
    cells = _around(docs, crowded.select(F.explode(met).alias("cell"), "doc_id", "word", "run"))
    return found.unionByName(_linked(cells, similarity))


def similar_blocks(docs: DataFrame, entries: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links, roots): block_links(), for the caller to remove, and (node, root) of the components they form."""
    links = block_links(docs, entries, similarity)
    return links, connected_components(links.select(_node("u", "up").alias("u"), _node("v", "vp").alias("v")))


@settled
def repeated_blocks(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, word, words, kept_doc_id, component) of the words that repeat text of a smaller document.

    Of each link the larger document's similar blocks go, so that their text stays in the smaller one. An entry that has no
    link to a smaller document, but whose component has one, loses the words that all its blocks hold.
    """
    links = links.withColumns({"un": _node("u", "up"), "vn": _node("v", "vp")})
    direct = links.select(F.col("v").alias("doc_id"), F.col("vs").alias("word"), (F.col("ve") - F.col("vs")).alias("words"), F.col("u").alias("kept_doc_id"), F.col("vn").alias("node"))
    ends = links.select(F.col("un").alias("node"), F.col("u").alias("doc_id")).unionByName(links.select(F.col("vn").alias("node"), F.col("v").alias("doc_id")))
    kept = checkpoint(ends.distinct().join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("least")))
    tops = links.join(links.select(F.col("vn").alias("un")).distinct(), "un", "left_anti").select(F.col("u").alias("doc_id"), F.col("uc").alias("word"), (F.col("ud") - F.col("uc")).alias("words"), F.col("un").alias("node"))
    tops = tops.distinct().join(roots, "node").join(kept, "root").where("least < doc_id")
    direct = direct.distinct().join(roots, "node")
    columns = ["doc_id", "word", "words", "kept_doc_id", F.xxhash64("root").alias("component")]
    return direct.select(*columns).unionByName(tops.withColumnRenamed("least", "kept_doc_id").select(*columns))
