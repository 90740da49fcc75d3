"""Words of whole texts as numpy arrays: bounds and hashes without a Python step for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACES

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[ord(c) for c in SPACES]] = True
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
#: Bytes of texts that are taken together.
GROUP = 1 << 18
WORD_BASE, RUN_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.pair = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, dtype=np.uint64)] * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            steps = [np.full(max(n, 1 << 14), b, dtype=np.uint64) for b in self.pair]
            for s in steps:
                s[0] = 1
            self.tables = [np.cumprod(s, dtype=np.uint64) for s in steps]
        return self.tables[0][:n], self.tables[1][:n]


POWERS = {b: _Powers(b) for b in (WORD_BASE, RUN_BASE, CHECK_BASE)}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[s:e] for each s, e, by differences of one running sum."""
    power, inverse = POWERS[base].upto(len(values) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)))
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of whole texts, one text after another: byte bounds and hashes (A-Z in lower case). sizes: bytes of each text."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    sizes: list[int]

    @classmethod
    def of(cls, *texts: str | bytes | None) -> Words:
        parts = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in texts]
        raw = b"\n".join(parts)
        data = np.frombuffer(raw.lower(), dtype=np.uint8)
        inked = np.concatenate(([False], ~_SPACES[data], [False]))
        starts, ends = np.flatnonzero(inked[1:] & ~inked[:-1]), np.flatnonzero(inked[:-1] & ~inked[1:])
        hashes, at = np.empty(len(starts), dtype=np.uint64), 0
        while at < len(starts):  # by pieces of whole words, so that a very long text isn't widened to 8 bytes a character at once
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
            first = starts[at]
            hashes[at:to] = run_hashes(data[first : ends[to - 1]].astype(np.uint64) + np.uint64(1), starts[at:to] - first, ends[at:to] - first, WORD_BASE)
            at = to
        return cls(raw, starts, ends, hashes, [len(x) for x in parts])

    @cached_property
    def first(self) -> np.ndarray:
        """Each text's first word, then the number of words."""
        return np.searchsorted(self.starts, np.cumsum([0, *(n + 1 for n in self.sizes)]))

    @property
    def lines(self) -> np.ndarray:
        """The number of the line that each word stands in."""
        return np.searchsorted(np.flatnonzero(np.frombuffer(self.raw, dtype=np.uint8) == 10), self.starts)

    @property
    def text(self) -> np.ndarray:
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, size: int, base: int = RUN_BASE) -> np.ndarray:
        """Hash of each run of `size` words, whatever texts they stand in; empty if there are fewer."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        return run_hashes(self.hashes, at, at + size, base)


def words_of_groups(texts: pa.Array) -> Iterator[tuple[slice, Words]]:
    """The words of texts, some short ones or a long one at a time, and which these are: most of the time for a short text is that of the steps, not of its words."""
    sizes, at = np.array([0, *(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))], dtype=np.int64).cumsum(), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + GROUP, "right")) - 1)
        yield slice(at, to), Words.of(*texts[at:to].cast(pa.binary()).to_pylist())
        at = to
