"""One deterministic automaton for many byte rules: subset construction, minimisation, transition arrays and one pass over the bytes.

A rule is a regular expression over ASCII bytes. Its matches are those of a leftmost, greedy, non-overlapping search, each rule by itself.
The automaton's state holds, for each rule, the ordered threads of that search, so one transition a byte advances all rules; a state also tells
which rules' matches have ended just before its byte. The start of a match is found by running the rule's mirrored automaton backwards from its end.

This needs rules that never read on past a match in vain: after a match every further byte either makes it longer or ends it.
Rules of another form raise an error when they are compiled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K, _parser

import numpy as np

#: Bytes that one lane of the pass covers, lanes that advance together, and bytes that are widened at once.
LANE, LANES, PIECE = 1 << 10, 1 << 10, 1 << 20
#: The input after the last byte of a text; no rule accepts it.
END = 256


class _Threads:
    """A nondeterministic automaton: each state reads one of a set of bytes, or forks (preferred branch first), or is the match."""

    def __init__(self, parsed, mirrored: bool = False):
        self.reads: list[frozenset[int] | None] = []
        self.next: list[list[int]] = []
        self.mirrored = mirrored
        self.match = self._state(None, [])
        self.start = self._sequence(parsed, self.match)

    def _state(self, reads, to: list[int]) -> int:
        self.reads.append(reads)
        self.next.append(to)
        return len(self.next) - 1

    def _sequence(self, items, after: int) -> int:
        for item in items if self.mirrored else reversed(items):
            after = self._item(*item, after)
        return after

    def _item(self, kind, value, after: int) -> int:
        if kind is K.LITERAL:
            return self._state(frozenset([value]), [after])
        if kind is K.IN:
            return self._state(_byte_set(value), [after])
        if kind is K.SUBPATTERN:
            return self._sequence(value[3], after)
        if kind is K.BRANCH:
            return self._state(None, [self._sequence(x, after) for x in value[1]])
        if kind is K.MAX_REPEAT:
            least, most, inner = value
            if most is K.MAXREPEAT:
                loop = self._state(None, [])
                self.next[loop] = [self._sequence(inner, loop), after]
                after = loop
            else:
                for _ in range(most - least):
                    after = self._state(None, [self._sequence(inner, after), after])
            for _ in range(least):
                after = self._sequence(inner, after)
            return after
        raise ValueError(f"a rule can't have {kind}")

    def closure(self, states) -> tuple[int, ...]:
        """The reading states that follow, most preferred first; what comes after a match is cut off."""
        out: dict[int, None] = {}
        seen, stack = set(), list(reversed(list(states)))
        while stack:
            s = stack.pop()
            if s in seen:
                continue
            seen.add(s)
            if s == self.match or self.reads[s] is not None:
                out[s] = None
                if s == self.match and not self.mirrored:
                    break
            else:
                stack.extend(reversed(self.next[s]))
        return tuple(out)

    def step(self, states: tuple[int, ...], byte: int) -> list[int]:
        return [t for s in states if self.reads[s] is not None and byte in self.reads[s] for t in self.next[s]]


def _byte_set(items) -> frozenset[int]:
    found = set()
    for kind, value in items:
        found |= set(range(value[0], value[1] + 1)) if kind is K.RANGE else {value} if kind is K.LITERAL else set()
        if kind not in (K.RANGE, K.LITERAL):
            raise ValueError(f"a set can't have {kind}")
    return frozenset(found)


def _minimal(table: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, block of each old state): states of one kind whose transitions never tell them apart become one; blocks are numbered by kind.

    A block is split by its states' rows of blocks, compared by 64-bit sums with random weights.
    """
    kinds = np.unique(kinds, return_inverse=True)[1]
    weights = np.random.default_rng(0).integers(1, 1 << 63, table.shape[1], dtype=np.uint64)
    block, count = kinds, 0
    while block.max() + 1 > count:
        count = block.max() + 1
        sums = (block[table].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((sums, block, kinds))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(block[order]) != 0) | (sums[order][1:] != sums[order][:-1])
        block = np.empty_like(block)
        block[order] = np.cumsum(new) - 1
    first = np.unique(block, return_index=True)[1]
    return block[table[first]].astype(np.int32), block


@dataclass
class _Mirror:
    """A rule's mirrored automaton: read backwards from a match's end it accepts at each place where a match of that end could start."""

    table: list[list[int]]
    accepts: list[bool]
    dead: int
    start: int

    @classmethod
    def of(cls, parsed, samples: list[int], classes: np.ndarray) -> _Mirror:
        threads = _Threads(parsed, mirrored=True)
        start = tuple(sorted(threads.closure([threads.start])))
        number, states, table = {start: 0}, [start], []
        for states_now in states:
            row = []
            for b in samples:
                to = tuple(sorted(threads.closure(threads.step(states_now, b))))
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append(number[to])
            table.append(row)
        if () not in number:
            raise ValueError("a rule can't accept everything")
        small, block = _minimal(np.array(table, dtype=np.int32), np.array([threads.match in s for s in states]))
        accepts = np.zeros(len(small), dtype=bool)
        accepts[block] = [threads.match in s for s in states]
        return cls(small[:, classes].tolist(), accepts.tolist(), int(block[number[()]]), int(block[0]))

    def start_of(self, raw: bytes, least: int, end: int) -> int:
        """The first place from `least` on where a match that ends at `end` starts."""
        state, found = self.start, end
        for at in range(end - 1, least - 1, -1):
            state = self.table[state][raw[at]]
            if self.accepts[state]:
                found = at
            elif state == self.dead:
                break
        return found


@dataclass
class Automaton:
    """Transition arrays of all rules together; see matches()."""

    classes: np.ndarray  # class of each byte and of END
    width: int
    table: np.ndarray  # next state, both times `width`, at state * width + class
    ended: np.ndarray  # bits of the rules whose match ended before the byte that led to a state
    first: int  # states from this on have such bits
    start: int
    calm: np.ndarray  # pairs of classes after which every state is the start, but for bits
    mirrors: list[_Mirror]

    @classmethod
    def of(cls, patterns: list[str]) -> Automaton:
        parsed = [_parser.parse(p) for p in patterns]
        rules = [_Threads(p) for p in parsed]
        sets = sorted({s for r in rules for s in r.reads if s is not None}, key=sorted)
        if any(b > 127 for s in sets for b in s):
            raise ValueError("rules are over ASCII bytes")
        signature = np.array([[b in s for s in sets] for b in range(257)])
        rows, samples, classes = np.unique(signature, axis=0, return_index=True, return_inverse=True)
        classes = classes.reshape(-1)
        steps = [_rule_table(r, samples.tolist()) for r in rules]
        state = tuple(0 for _ in rules)
        number, states, table = {(state, 0): 0}, [(state, 0)], []
        for held, _ in states:
            row = []
            for c in range(len(samples)):
                moved = [s[q][c] for s, q in zip(steps, held)]
                key = (tuple(m[0] for m in moved), sum(m[1] << i for i, m in enumerate(moved)))
                if key not in number:
                    number[key] = len(states)
                    states.append(key)
                row.append(number[key])
            table.append(row)
        bits = np.array([s[1] for s in states], dtype=np.int64)
        small, block = _minimal(np.array(table, dtype=np.int32), bits)
        ended = np.zeros(len(small), dtype=np.int64)
        ended[block] = bits
        width, start = len(samples), int(block[0])
        core = np.unique(small, axis=0, return_inverse=True)[1].reshape(-1)  # states that differ in bits only have equal rows
        two = core[small[small]]
        calm = (two == core[start]).all(axis=0)
        return cls(classes.astype(np.uint8), width, (small * width).reshape(-1), ended, int(np.argmax(ended > 0)) * width, start * width, calm, [_Mirror.of(p, samples.tolist(), classes) for p in parsed])

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, rule, start, end) of each match in the texts data[starts[i]:ends[i]], by text, then end; places count from the text's start.

        The bytes are read once, in lanes that advance together. A lane begins where a text does, or behind two bytes that lead
        every state to the start; a stretch without such a place is one lane, whatever its length.
        """
        classes = self.classes[data]
        begin, stop, text = self._lanes(classes, starts, ends)
        size = stop - begin
        long = size > 4 * LANE
        at, state = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        order = np.flatnonzero(~long)[np.argsort(-size[~long], kind="stable")]
        for group in np.split(order, range(LANES, len(order), LANES)):
            if len(group):
                found = self._advance(classes, begin[group], size[group])
                at.append(found[0])
                state.append(found[1])
        for lane in np.flatnonzero(long):
            found = self._walk(classes, int(begin[lane]), int(stop[lane]))
            at.append(found[0])
            state.append(found[1])
        at, state = np.concatenate(at), np.concatenate(state)
        order = np.argsort(at, kind="stable")
        at, state = at[order], state[order] // self.width
        # a lane's last step reads END at the place of the next lane's first byte: only the last lane of a text has matches there
        owner = np.searchsorted(starts, at - 1, side="right") - 1
        done: dict[int, int] = {}
        last = -1
        for place, s, i in zip(at.tolist(), state.tolist(), owner.tolist()):
            if i != last:
                done, last, base = {}, i, int(starts[i])
                raw = data[base : ends[i]].tobytes()
            bits = int(self.ended[s])
            for rule, mirror in enumerate(self.mirrors):
                if bits >> rule & 1:
                    yield i, rule, mirror.start_of(raw, done.get(rule, 0), place - base), place - base
                    done[rule] = place - base

    def _lanes(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(begin, stop, text) of each lane."""
        text = np.arange(len(starts))
        size = ends - starts
        cuts, owners = [starts[size > 0]], [text[size > 0]]
        for i in np.flatnonzero(size > 2 * LANE):
            for at in range(starts[i], ends[i], PIECE):
                piece = classes[at : min(at + PIECE + 1, ends[i])]
                calm = np.flatnonzero(self.calm[piece[:-1], piece[1:]]) + at + 2
                found = np.searchsorted(calm, np.arange(at + LANE, at + len(piece), LANE))
                found = np.unique(calm[found[found < len(calm)]])
                found = found[found < ends[i]]
                cuts.append(found)
                owners.append(np.full(len(found), i))
        begin, text = np.concatenate(cuts), np.concatenate(owners)
        order = np.argsort(begin, kind="stable")
        begin, text = begin[order], text[order]
        stop = np.minimum(ends[text], np.append(begin[1:], len(classes)))
        return begin, stop, text

    def _advance(self, classes: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Places and states of all match ends in lanes, the longest first; every lane reads END after its last byte."""
        steps = int(size[0]) + 1
        place = begin + np.arange(steps)[:, None]
        read = np.where(np.arange(steps)[:, None] < size, classes[np.minimum(place, len(classes) - 1)], self.classes[END])
        states = np.empty((steps, len(begin)), dtype=np.int32)
        now = np.full(len(begin), self.start, dtype=np.int32)
        for k in range(steps):
            now = np.take(self.table, now + read[k], out=states[k])
        row, lane = np.divmod(np.flatnonzero(states >= self.first), len(begin))
        keep = row <= size[lane]
        row, lane = row[keep], lane[keep]
        return begin[lane] + row, states[row, lane].astype(np.int64)

    def _walk(self, classes: np.ndarray, begin: int, stop: int):
        """As _advance for one long lane."""
        table, now, first = self.table.tolist(), self.start, self.first
        at, state = [], []
        for piece in range(begin, stop, PIECE):
            to = min(stop, piece + PIECE)
            for k, c in enumerate(classes[piece:to].tobytes() + (bytes([self.classes[END]]) if to == stop else b""), piece):
                now = table[now + c]
                if now >= first:
                    at.append(k)
                    state.append(now)
        return np.array(at, dtype=np.int64), np.array(state, dtype=np.int64)


def _rule_table(threads: _Threads, samples: list[int]) -> list[list[tuple[int, int]]]:
    """For each state of one rule's search and each class: the next state, and whether a match ended before the byte."""
    fresh = threads.closure([threads.start])
    if threads.match in fresh:
        raise ValueError("a rule can't match nothing")
    number, states, table = {fresh: 0}, [fresh], []
    for held in states:
        row, matched = [], threads.match in held
        for b in samples:
            to = threads.closure(threads.step(held, b))
            ended = matched and not to
            if ended:
                to = threads.closure(threads.step(fresh, b))
            elif matched and threads.match not in to:
                raise ValueError("a rule can't read on past a match in vain")
            if threads.match not in to:
                to = tuple(dict.fromkeys([*to, *fresh]))
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append((number[to], int(ended)))
        table.append(row)
    return table
