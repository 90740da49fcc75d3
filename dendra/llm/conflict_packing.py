"""Best-fit packing under conflicts: a bin never holds two documents of one source or one duplicate cluster.

Bins are ordered by residual capacity and carry a bitmap of the sources and clusters inside. A document
goes to the tightest bin that has room and shares no bit with it; the successor search walks up the residuals
in a tree whose nodes hold the bits that all bins below them share, and so skips bins that can't fit.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, bound_batches, checkpoint, chunks
from .simhash import clustered, fingerprint

CAPACITY = 2048
#: Documents that are packed together: a task packs whole groups of about so many pieces.
GROUP_PIECES = 2048
_EMPTY = -1  # all bits set: no bin below this node


class ResidualTree:
    """Open bins by residual. Node values are the intersection of the bitmaps of the bins below."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.shared = [_EMPTY] * (2 * self.size)
        self.bins: dict[int, dict[int, list[int]]] = {}

    def _refresh(self, residual: int) -> None:
        shared = _EMPTY
        for bits in self.bins.get(residual, ()):
            shared &= bits
        at = residual + self.size
        self.shared[at] = shared
        at >>= 1
        while at:
            both = self.shared[2 * at] & self.shared[2 * at + 1]
            if self.shared[at] == both:
                break
            self.shared[at] = both
            at >>= 1

    def add(self, residual: int, bits: int, number: int) -> None:
        if residual:
            self.bins.setdefault(residual, {}).setdefault(bits, []).append(number)
            self._refresh(residual)

    def take(self, length: int, bits: int) -> tuple[int, int, int] | None:
        """Removes and returns (residual, bitmap, number) of the tightest compatible bin; of equals the first opened."""
        residual, found = self._successor(1, 0, self.size, length, bits)
        if found is None:
            return None
        alike = self.bins[residual]
        number = min(alike[found])
        alike[found].remove(number)
        if not alike[found]:
            del alike[found]
            if not alike:
                del self.bins[residual]
            self._refresh(residual)
        return residual, found, number

    def _successor(self, node: int, low: int, width: int, length: int, bits: int) -> tuple[int, int | None]:
        if low + width <= length or self.shared[node] & bits:
            return 0, None
        if width == 1:
            fits = [(min(numbers), b) for b, numbers in self.bins.get(low, {}).items() if not b & bits]
            return (low, min(fits)[1]) if fits else (0, None)
        half = width >> 1
        residual, found = self._successor(2 * node, low, half, length, bits)
        return (residual, found) if found is not None else self._successor(2 * node + 1, low + half, half, length, bits)


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each (length, source, cluster), in the order given; None as source or cluster conflicts with nothing.

    Lengths are 0 to capacity. A length of 0 is put like any other. Bins are numbered as they are opened.
    """
    pieces = list(pieces)
    kinds: dict[tuple, int] = {}
    for _, source, cluster in pieces:
        for key in (("s", source), ("c", cluster)):
            if key[1] is not None:
                kinds[key] = kinds.get(key, 0) + 1
    # what occurs once can't conflict and needs no bit
    places = {k: 1 << i for i, k in enumerate(k for k, n in kinds.items() if n > 1)}
    tree, chosen, opened = ResidualTree(capacity), [], 0
    for length, source, cluster in pieces:
        bits = places.get(("s", source), 0) | places.get(("c", cluster), 0)
        fit = tree.take(max(1, length), bits)
        if fit is None:
            fit, opened = (capacity, 0, opened), opened + 1
        residual, held, number = fit
        chosen.append(number)
        tree.add(residual - length, held | bits, number)
    return chosen


def pack(records: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(id, piece, start, length, source, cluster, pack_group, bin, offset) from records(id, length, source, cluster).

    A record longer than the capacity is cut into pieces at multiples of the capacity: full pieces fill a bin each,
    the remainder is packed. `start` and `length` give the piece's part of the record. Pieces are dealt by a hash
    to groups of about `group_pieces`, whose number grows with the input, and each group is packed by itself in
    decreasing length; a group is what one task holds. A bin is (pack_group, bin). Sources and clusters that hold
    a large part of all rows are spread over all groups.
    Nulls: a null length counts as 0; a null source or cluster conflicts with nothing; null ids are packed like others and dealt by their place. Ties in
    length go by id, piece, cluster and source, so repeated rows stand beside each other. An empty table gives an empty result; only these four columns are read.
    """
    narrow = checkpoint(records.select("id", F.coalesce("length", F.lit(0)).cast("long").alias("length"), "source", "cluster"))
    cut = F.greatest(F.lit(1), F.expr(f"(length + {capacity - 1}) div {capacity}"))
    n = narrow.agg(F.coalesce(F.sum(cut), F.lit(0))).first()[0]
    groups = max(1, -(-n // group_pieces))
    pieces = (
        narrow.select("*", F.posexplode(F.sequence(F.lit(0), cut - 1)).alias("piece", "_n"))
        .withColumn("start", F.col("piece").cast("long") * capacity)
        .withColumn("length", F.least(F.lit(capacity), F.col("length") - F.col("start")).cast("int"))
        .withColumn("pack_group", F.pmod(F.xxhash64(F.coalesce("id", F.monotonically_increasing_id()), "piece", "source", "cluster"), F.lit(groups)).cast("int"))
        .drop("_n")
    )

    names = [*pieces.columns, "bin", "offset"]

    def packed(table: pa.Table) -> pa.Table:
        # Arrow columns, so that longs beside nulls stay exact
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("id", "piece", "cluster", "source"))])
        lengths = table.column("length").to_numpy()
        bins = np.array(best_fit(zip(lengths.tolist(), table.column("source").to_pylist(), table.column("cluster").to_pylist()), capacity), dtype=np.int64)
        order = np.argsort(bins, kind="stable")
        upto = np.cumsum(lengths[order]) - lengths[order]
        first = np.flatnonzero(np.concatenate(([True], np.diff(bins[order]) != 0)))
        offsets = np.empty(len(bins), dtype=np.int64)
        offsets[order] = upto - np.repeat(upto[first], np.diff(np.append(first, len(bins))))
        return pa.Table.from_arrays([*table.columns, pa.array(bins), pa.array(offsets)], names)

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in pieces.columns) + ", bin long, offset long"
    return pieces.groupBy("pack_group").applyInArrow(packed, schema)


def _lengths_and_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, source, length, fp): words and SimHash fingerprint of each whole text."""

    def read(batches):
        for batch in (part for b in batches for part in chunks([b], 1024)):
            texts = [t.as_py() for t in batch.column(2)]
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            sizes = pa.array([len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(fps, pa.int64())], ["doc_id", "source", "length", "fp"])

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return arrow_map(narrow, read, "doc_id long, source string, length long, fp long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece of a document: doc_id, piece, start and length in words, source, cluster, pack_group, bin, and its offset in the bin.

    The length is the text's words, the source the column `source`, the cluster the component of near-duplicates: texts whose
    SimHash fingerprints (see simhash) are linked at 4 or fewer differing bits, equal texts among them. No two rows of a bin share a source or a cluster;
    a bin holds at most `capacity` words. Null and empty texts have length 0 and are packed as well, as near-duplicates of each other. Very long
    texts are cut into pieces, which conflict with each other. Ties in length go by id, piece, cluster and source. A null doc_id is returned as null;
    repeated rows are duplicates and so land in different bins; an empty table gives an empty result; other columns are not read, so their names can't clash.
    """
    found = clustered(_lengths_and_fingerprints(docs))
    placed = pack(found.select(F.col("doc_id").alias("id"), "length", "source", F.col("root").alias("cluster")), capacity, group_pieces)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "source", "cluster", "pack_group", "bin", "offset")
