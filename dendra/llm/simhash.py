"""SimHash fingerprints and their links by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius agree, in at least one segment, up
to a small Hamming ball (pigeonhole), so enumerating these balls and fetching the table rows of each
segment value finds every pair; the complete distance is part of the join's condition.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, checkpoint, chunks, settled, small, texts_of, without_ids
from .components import connected_components

BITS = 64
#: A segment value shared by more fingerprints than this is first linked through pivots.
HOT_BUCKET = 64
PIVOTS = 8


def fingerprint(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a whole text; 0 without words.

    A-Z are lower-cased, words are runs of non-space bytes, shingles (repeats included) are joined by a
    space and hashed by XXH64; fewer words than a shingle has give one shingle of all of them.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words_per_shingle, len(words)) - 1 :]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : min(n, at + (1 << 15))].tolist(), last[at : min(n, at + (1 << 15))].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) for each document; fp is the fingerprint as a signed long."""

    def hashed(batches):
        for batch in (part for b in batches for part in chunks([b], 1024)):
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    narrow = texts_of(docs, id_column, text_column)
    return arrow_map(narrow, hashed, "doc_id long, fp long")


def segments(radius: int, n: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball) of each segment that has to be searched for all pairs within the radius."""
    widths = [BITS // n + (i >= n - BITS % n) for i in range(n)]
    ball, rest = divmod(radius, n)
    shifts = np.cumsum([0, *widths[:-1]]).tolist()
    return [(s, w, b) for i, (s, w) in enumerate(zip(shifts, widths)) if (b := ball if i <= rest else ball - 1) >= 0]


def _ball(value: Column, masks: Column, base: Column) -> Column:
    """(bucket, flipped) for each mask whose highest bit is 0 in value: of a pair, only the lower side is flipped."""
    upward = F.filter(masks, lambda m: value.bitwiseXOR(m) >= value)
    return F.transform(upward, lambda m: F.struct((value.bitwiseXOR(m) + base).alias("bucket"), (m != 0).alias("flipped")))


def _keys(cut: list[tuple[int, int, int]], probes: bool):
    """An array of (bucket, flipped) of column fp; with probes the ball around each segment, one direction of each flip."""
    arrays = []
    for i, (shift, width, ball) in enumerate(cut):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << b for b in bits) for k in range((ball if probes else 0) + 1) for bits in combinations(range(width), k)]
        arrays.append(_ball(value, F.array(*[F.lit(m).cast("long") for m in masks]), F.lit(i << 58)))
    return F.concat(*arrays)


@settled
def link_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root) of every fingerprint that has another within `radius` bits; root names its component.

    fps: a column fp of distinct longs. Groups of thousands of near fingerprints are not paired out: in a
    crowded segment value each member is compared with PIVOTS members drawn by hash. In the exact search that
    follows, members of the component that leads a crowded value (its first pivot's) meet only the others there, so a
    value whose fingerprints are joined already costs nothing. Every candidate pair of different components is covered, so no
    link is lost. Segments get longer as the table grows, which keeps buckets small.
    """
    n = fps.count()
    cut = segments(radius, 3 if n < 1 << 24 else 2)
    entries = fps.select("fp", F.inline(_keys(cut, probes=False))).select("fp", "bucket")
    hot = (
        entries.groupBy("bucket").agg(F.count("*").alias("n"), *[F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
        .where(F.col("n") > HOT_BUCKET).select("bucket", F.col("p0").alias("pivot"), F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots"))
    )
    hot = checkpoint(hot)
    near = F.filter("pivots", lambda p: (F.bit_count(p.bitwiseXOR(F.col("fp"))) <= radius) & (p != F.col("fp")))
    first = entries.join(small(hot), "bucket").select(F.col("fp").alias("u"), F.explode(near).alias("v"))
    labels = checkpoint(connected_components(first).select(F.col("node").alias("fp"), F.col("root").alias("label")))
    known = checkpoint(fps.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))

    lead = small(checkpoint(hot.join(known.withColumnRenamed("fp", "pivot"), "pivot").select("bucket", F.col("label").alias("lead"))))
    table = known.select("fp", "label", F.inline(_keys(cut, probes=False))).join(lead, "bucket", "left").select("bucket", F.col("fp").alias("fp2"), F.col("label").alias("label2"), "lead")
    probes = known.select("fp", "label", F.inline(_keys(cut, probes=True)))
    match = (
        (F.col("label") != F.col("label2"))
        & (F.col("flipped") | (F.col("fp") < F.col("fp2")))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    )
    leading = F.col("label2") == F.col("lead")  # false or null: not of the component that leads the value
    others = table.where(~F.coalesce(leading, F.lit(False))).drop("lead")
    links = probes.join(others, (probes.bucket == others.bucket) & match).select(F.col("label").alias("u"), F.col("label2").alias("v"))
    own = table.where(leading).drop("lead")
    # the other direction: only probes from outside the leading component meet its members
    outside = probes.join(lead, "bucket").where("label <> lead").select(F.col("bucket").alias("at"), "fp", "label", "flipped")
    links = links.unionByName(outside.join(own, (F.col("at") == F.col("bucket")) & match).select(F.col("label").alias("u"), F.col("label2").alias("v")))
    joined = connected_components(links).select(F.col("node").alias("label"), "root")
    linked = known.join(joined, "label", "left").select("fp", F.coalesce("root", "label").alias("root"), "label")
    return linked.where("root <> fp or label <> fp").select("fp", "root").unionByName(
        linked.where("root = fp and label = fp").join(linked.where("root <> fp").select("root").distinct(), "root", "left_semi").select("fp", "root")
    )


def near_duplicates(docs: DataFrame, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document.

    fingerprint: 16 hex digits. component_id: the smallest doc_id that can be reached over links of at most
    `radius` differing bits, its own included. A null text counts as empty: fingerprint 0, linked like any
    other. A null doc_id is returned as null and gets the component_id of its group (null if the group has
    no id at all). Very long texts are fingerprinted whole, in pieces; of equally small doc_ids there is nothing to choose, since a
    component is named by the number. Repeated rows are returned as often as they come; an empty table gives an empty result;
    other columns are not read, whatever their names.
    """
    found = clustered(fingerprints(docs, id_column, text_column), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def clustered(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Rows (doc_id, fp, ...) with component_id, the smallest doc_id that can be reached, and root, a number of the component that is never null.

    A null doc_id names no component; repeated rows are all returned; an empty table gives an empty result. Further columns are kept, but those named component_id
    or root would clash. Texts aren't read.
    """
    fps = checkpoint(fps)
    return fps.join(_named(fps, radius), "fp")


@settled
def _named(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id, root) of each fingerprint."""
    kinds = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = link_fingerprints(kinds.select("fp"), radius)
    known = checkpoint(kinds.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # written before they are joined, so that the adaptive skew join can split a hot component and a hot fingerprint
    names = checkpoint(known.groupBy("root").agg(F.min("least").alias("component_id")))
    return known.join(names, "root").select("fp", "component_id", "root")


def keep_one_of_each(docs: DataFrame, radius: int = 4) -> DataFrame:
    """docs without the documents that have a near-duplicate of smaller doc_id; columns as they came.

    Of each component the document with the smallest doc_id stays (as often as its row is repeated); rows
    without a doc_id can't be named and all stay. Null and empty texts are near-duplicates of each other; very long texts are
    compared whole; an empty table stays empty; other columns are carried along, whatever their names.
    """
    return without_ids(docs, near_duplicates(docs, radius).where("doc_id <> component_id").select("doc_id"))
