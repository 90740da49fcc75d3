"""Token ids packed into rows of one length by best fit decreasing, as binary matrices.

Texts are encoded by a public byte-level BPE vocabulary, cut losslessly where they are longer than a row,
and packed in blocks: a block is a bounded run of a task's documents, so nothing is shuffled, and only a
block's last rows are not filled as well as they could be.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, chunks, texts_of

#: Default vocabulary, its pattern and a free id that ends each document.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
ROW = 2048
#: A block is closed when it holds so many pieces or tokens.
BLOCK_PIECES, BLOCK_TOKENS = 8192, 8 << 20
#: Characters that are encoded at once.
PIECE = 1 << 20


class Encoder:
    """Encodes whole texts to little-endian ids.

    A space between two non-space characters always starts a token of the pattern, so a very long text is
    encoded in pieces that are cut there.
    """

    _lone = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN, end: int | None = END):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(max(ranks.values()), end or 0) < 1 << 16 else "<u4")
        self.end = b"" if end is None else np.array([end], dtype=self.kind).tobytes()
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def _ids(self, text: str) -> bytes:
        found = array(self.code, self.encoding.encode_ordinary(text))
        if sys.byteorder != "little":
            found.byteswap()
        return found.tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text, then the end id."""
        text, out, at = text or "", [], 0
        while len(text) - at > PIECE and (cut := self._lone.search(text, at + PIECE)):
            out.append(self._ids(text[at : cut.start()]))
            at = cut.start()
        return np.frombuffer(b"".join([*out, self._ids(text[at:]), self.end]), dtype=self.kind)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")


class Residuals:
    """Open rows by free capacity, with a segment tree of counts to find the least capacity that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, at: int, n: int) -> None:
        at += self.size
        while at:
            self.counts[at] += n
            at >>= 1

    def put(self, free: int, row: int) -> None:
        if free:
            self.rows[free].append(row)
            self._add(free, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the tightest row with room; of equals the one put last."""
        at = length + self.size
        if not self.counts[at]:
            while at > 1 and (at & 1 or not self.counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.counts[2 * at] else 2 * at + 1
        free = at - self.size
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers. Pieces go in decreasing length (ties: as they came) to the tightest row that has room."""
    open_rows, rows = Residuals(capacity), []
    for piece in sorted(range(len(lengths)), key=lambda p: -lengths[p]):
        fit = open_rows.take(lengths[piece])
        if fit is None:
            fit = capacity, len(rows)
            rows.append([])
        rows[fit[1]].append(piece)
        open_rows.put(fit[0] - lengths[piece], fit[1])
    return rows


SCHEMA = (
    "part int, block int, row int, tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<long>, piece_starts array<int>"
)


def _blocks(batches: Iterable[pa.RecordBatch], encoder: Encoder, row: int) -> Iterator[list[tuple]]:
    """Lists of pieces (doc_id, start, ids)."""
    pieces, held = [], 0
    for batch in (part for b in batches for part in chunks([b], 256)):
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encoder.encode(text.as_py())
            for start in range(0, len(ids), row):
                pieces.append((i, start, ids[start : start + row]))
                held += len(pieces[-1][2])
                if len(pieces) >= BLOCK_PIECES or held >= BLOCK_TOKENS:
                    yield pieces
                    pieces, held = [], 0
    if pieces:
        yield pieces


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _batch(pieces: list[tuple], rows: list[list[int]], place: tuple[int, int, int], row: int, fill: np.unsignedinteger) -> pa.RecordBatch:
    """Columns SCHEMA of some packed rows; place: part, block and the first row's number."""
    members, counts = [pieces[p] for r in rows for p in r], np.array([len(r) for r in rows])
    lengths, after = np.array([len(ids) for _, _, ids in members]), np.cumsum(counts)
    ends = np.cumsum(lengths)
    tokens = np.diff(ends[after - 1], prepend=0)
    starts = ends - lengths - np.repeat(ends[after - 1] - tokens, counts)
    matrix = np.full((len(rows), row), fill)
    matrix[np.arange(row) < tokens[:, None]] = np.concatenate([ids for _, _, ids in members])
    width = row * matrix.itemsize
    binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(matrix)])
    columns = [pa.array(np.full(len(rows), x), pa.int32()) for x in place[:2]] + [pa.array(np.arange(len(rows)) + place[2], pa.int32()), pa.array(tokens, pa.int32()), binary]
    columns += [_lists(np.insert(starts, after, tokens), counts + 1, pa.int32()), _lists(starts, counts, pa.int32())]
    columns += [_lists([i for i, _, _ in members], counts, pa.int64()), _lists([s for _, s, _ in members], counts, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int | None = END, row: int = ROW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per packed row, with columns SCHEMA.

    input_ids: `row` little-endian ids (2 bytes each if all ids fit, else 4), filled up with the end id (0
    without one); the first `tokens` count. cu_seqlens: the bounds of the segments, 0 and `tokens` included.
    position_resets: where positions start again at 0, once for each segment. doc_ids and piece_starts: each
    segment's document and its first token's place in that document; the pieces of a document, in order of
    their starts, are its ids without loss or repeat.

    A null or empty text is its end id alone (no segment without an end id); a null doc_id is carried as
    null; repeated rows are packed each; an empty table gives an empty result; other columns are not read.
    Very long texts are encoded in pieces and cut into rows without loss; pieces of equal length go in the order they came; names of other columns can't clash.
    `vocabulary` is a file of base64 tokens with their ids, one to a line; the default is the one that this machine's public tokenizers come with. It is
    read by the driver, which raises FileNotFoundError without it, and sent to the tasks (about 1 MB).
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def packed(batches):
        encoder = Encoder(sent.value, pattern, end)
        part = TaskContext.get().partitionId()
        for block, pieces in enumerate(_blocks(batches, encoder, row)):
            rows = best_fit_decreasing([len(p[2]) for p in pieces], row)
            for at in range(0, len(rows), 256):
                yield _batch(pieces, rows[at : at + 256], (part, block, at), row, encoder.kind.type(end or 0))

    narrow = texts_of(docs, id_column, text_column)
    return arrow_map(narrow, packed, SCHEMA)


def id_matrix(input_ids: list[bytes], row: int = ROW) -> np.ndarray:
    """The packed rows as a matrix of ids, one row each."""
    width = len(input_ids[0]) // row if input_ids else 2
    return np.frombuffer(b"".join(input_ids), dtype=f"<u{width}").reshape(-1, row)


def positions(cu_seqlens: list[int], row: int = ROW) -> np.ndarray:
    """Position of each place of a packed row in its segment; 0 in the filling."""
    out = np.zeros(row, dtype=np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out
