"""Secrets in texts: all rules in one pass of a combined automaton, see automaton.py."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .automaton import Automaton
from .common import arrow_map, chunks, texts_of


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` with at least `least` characters; with `value` they are counted behind the first : or =, blanks and a quote."""

    kind: str
    pattern: str
    least: int
    value: bool = False

    def keeps(self, match: bytes) -> bool:
        if self.value:
            match = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
            match = match[match[:1] in (b'"', b"'") :]
        return len(match) >= self.least


_KEYS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
#: Fixed values. The first three are the base rules. A run of 24 hexadecimal digits or more is the same as a run that is dropped when shorter.
BASE = (
    Rule("assign", rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, value=True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
#: Public formats of code host and chat tokens, signed web tokens and key files.
RULES = (
    *BASE,
    Rule("codehost", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 36),
    Rule("keyfile", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)


@lru_cache
def automaton(rules: tuple[Rule, ...]) -> Automaton:
    return Automaton.of([r.pattern for r in rules])


def scanned(batch: pa.RecordBatch, rules: tuple[Rule, ...], machine: Automaton) -> pa.RecordBatch:
    """(doc_id, secrets) of a batch (doc_id, text)."""
    text = batch.column(1).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    starts = offsets[:-1]
    ends = np.where(np.asarray(text.is_valid()), offsets[1:], starts)
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(text))]
    for i, rule, start, end in machine.matches(data, starts, ends):
        if rules[rule].keeps(data[starts[i] + start : starts[i] + end].tobytes()):
            found[i].append((start, rule, end))
    rows = []
    for i, spans in enumerate(found):
        raw = data[starts[i] : ends[i]] if spans else data[:0]
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))
        rows.append([{"kind": rules[r].kind, "start": int(points[s]), "end": int(points[e]), "secret": raw[s:e].tobytes().decode()} for s, r, e in sorted(spans)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=kind)], ["doc_id", "secrets"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id long, secrets array<struct<kind, start, end, secret>>) of each row, by start, then by the order of the rules.

    Matches of one rule are leftmost, greedy and don't overlap; those that are too short are dropped afterwards, so that what they cover is not
    searched again. Matches of different rules may overlap. Places are code points, the end is exclusive. Each task reads its texts once and nothing is shuffled.

    Null and empty texts have no secrets; very long texts are scanned whole, in pieces of bounded size; spans that start together keep the order of the rules;
    repeated rows and rows with a null doc_id give a row each; an empty table gives an empty result; only doc_id and text are read, whatever else the columns are named.
    """
    sent = docs.sparkSession.sparkContext.broadcast(automaton(rules))

    def scan(batches):
        for batch in chunks(batches):
            yield scanned(batch, rules, sent.value)

    return arrow_map(texts_of(docs), scan, "doc_id long, secrets array<struct<kind string, start long, end long, secret string>>")


def listed(secrets: Column) -> Column:
    """kind:start:end of each secret, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """(doc_id, n_<kind> of each base rule, base_sha256, spans) of each row; odd rows as find_secrets states."""
    found = find_secrets(docs, rules)
    of_base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in base]))

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in base]
    return found.select("doc_id", *counts, F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
