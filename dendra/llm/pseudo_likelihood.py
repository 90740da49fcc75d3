"""Documents scored by masked pseudo-likelihood under a small bidirectional network trained in numpy.

The network predicts each token from the RADIUS tokens on both of its sides; the sum of the tokens'
conditional log-probabilities is the document's pseudo-log-likelihood. Counts and training cover the whole
corpus. The vocabulary grows with the corpus. Documents are dealt to rounds and, within a round, to training groups by
a hash, so that the result doesn't depend on how a table is laid out in files or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, checkpoint, chunks, texts_of
from .words import Words

#: The vocabulary has side * side tokens; a token is predicted by its class first, then within the class. A quarter of the classes is for words that aren't frequent.
LEAST_SIDE, MOST_SIDE = 16, 160
WIDTH, RADIUS = 16, 3
#: Tokens gathered at once, tokens of a training step, and tokens scored in a step.
PIECE = 1 << 15
BATCH = 4096
STEP = 4096
FAN_IN = 16
#: Bytes of text of a training group, and rounds after which the groups' networks are averaged.
GROUP_BYTES, ROUNDS = 8 << 20, 4


def side_for(words: int) -> int:
    """Side of the vocabulary for a corpus of so many words: the sixth root of their number, doubled, in steps of 4; so tokens grow as the cube root."""
    return int(min(MOST_SIDE, max(LEAST_SIDE, 4 * round(words ** (1 / 6) / 2))))


OFFSETS = [o for o in range(-RADIUS, RADIUS + 1) if o]


class Network:
    """Parameters are views of one flat vector."""

    def __init__(self, flat: np.ndarray, side: int):
        self.flat, self.side, self.pad, at = flat, side, side * side, 0
        for name, shape in self.shapes(side):
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(side: int) -> list[tuple[str, tuple[int, ...]]]:
        return [
            ("embed", (side * side + 1, WIDTH)), ("place", (2 * RADIUS, WIDTH)), ("bias", (WIDTH,)),
            ("to_class", (side, WIDTH)), ("class_bias", (side,)), ("to_token", (side * side, WIDTH)), ("token_bias", (side * side,)),
        ]

    @classmethod
    def size(cls, side: int) -> int:
        return sum(int(np.prod(s)) for _, s in cls.shapes(side))

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random weights; biases that give the counts' frequencies without any context."""
        side = int(round(len(counts) ** 0.5))
        made = cls(np.random.default_rng(13).normal(0, 0.1, cls.size(side)).astype(np.float32), side)
        made.embed[made.pad], made.place[:], made.bias[:] = 0, 1 / np.sqrt(2 * RADIUS), 0
        share = (counts + 0.5).reshape(side, side)
        made.class_bias[:] = np.log(share.sum(axis=1) / share.sum())
        made.token_bias[:] = np.log(share / share.sum(axis=1, keepdims=True)).ravel()
        return made

    def hidden(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = at[-1] - at[0] + 1  # slices over the gaps between documents cost less than picking places
        near, total = self.embed[padded[at[0] - RADIUS : at[-1] + RADIUS + 1]], np.tile(self.bias, (n, 1))
        for k, offset in enumerate(OFFSETS):
            total += near[RADIUS + offset : RADIUS + offset + n] * self.place[k]
        total = total if n == len(at) else total[at - at[0]]
        return np.tanh(total, out=total)

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Conditional log-probability of the token at each place, given its neighbours."""
        hidden, target = self.hidden(padded, at), padded[at]
        logits = self.to_class @ hidden.T
        logits += self.class_bias[:, None]
        out = _log_softmax_at(logits, target // self.side)
        order, classes = self._by_class(target)
        hidden, within, inner = hidden[order], target[order] % self.side, np.empty(len(at), dtype=out.dtype)
        for rows, part in classes:
            logits = self.to_token[part] @ hidden[rows].T
            logits += self.token_bias[part, None]
            inner[rows] = _log_softmax_at(logits, within[rows])
        out[order] += inner
        return out

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The order of targets by class, and the slices of that order and of the tokens for each class that occurs."""
        order = np.argsort((target // self.side).astype(np.int16), kind="stable")
        bounds = np.searchsorted(target[order] // self.side, np.arange(self.side + 1)).tolist()
        return order, [(slice(a, b), slice(c * self.side, (c + 1) * self.side)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]

    def gradient(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Gradient of the mean negative log-probability at these places."""
        hidden, target, n = self.hidden(padded, at), padded[at], len(at)
        slope = Network(np.zeros(len(self.flat), dtype=np.float32), self.side)
        logits = self.to_class @ hidden.T
        logits += self.class_bias[:, None]
        error = _softmax_error(logits, target // self.side)
        error /= n
        slope.to_class[:], slope.class_bias[:] = error @ hidden, error.sum(axis=1)
        back = error.T @ self.to_class
        order, classes = self._by_class(target)
        by_class, within, inner = hidden[order], target[order] % self.side, np.empty_like(back)
        for rows, part in classes:
            own, weights = by_class[rows], self.to_token[part]
            logits = weights @ own.T
            logits += self.token_bias[part, None]
            error = _softmax_error(logits, within[rows])
            error /= n
            slope.to_token[part], slope.token_bias[part] = error @ own, error.sum(axis=1)
            np.matmul(error.T, weights, out=inner[rows])
        back[order] += inner
        back *= 1 - hidden * hidden
        slope.bias[:] = back.sum(axis=0)
        # what each place in the text gets from all targets around it, then summed by its token
        tokens, n = padded[at[0] - RADIUS : at[-1] + RADIUS + 1], at[-1] - at[0] + 1
        near, pull = self.embed[tokens], np.zeros((len(tokens), WIDTH), dtype=back.dtype)
        if n > len(at):  # nothing comes from the gaps between documents
            spread = np.zeros((n, WIDTH), dtype=back.dtype)
            spread[at - at[0]] = back
            back = spread
        for k, offset in enumerate(OFFSETS):
            beside = slice(RADIUS + offset, RADIUS + offset + n)
            slope.place[k] = np.einsum("ij,ij->j", near[beside], back)
            pull[beside] += back * self.place[k]
        cell = tokens[:, None].astype(np.int64) * WIDTH + np.arange(WIDTH)
        slope.embed[:] = np.bincount(cell.ravel(), weights=pull.ravel(), minlength=(self.pad + 1) * WIDTH).reshape(-1, WIDTH)
        slope.embed[self.pad] = 0
        return slope.flat


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Uses up logits: a row a choice and a column a place, so that sums and maxima run along memory."""
    logits -= logits.max(axis=0)
    chosen = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(axis=0))


def _softmax_error(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Uses up logits, laid out as for _log_softmax_at."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    logits[at, np.arange(len(at))] -= 1
    return logits


def hashes_of(text: str | None) -> np.ndarray:
    return Words.of(text).hashes


class Vocabulary:
    """Tokens of words: the most frequent ones in order of their counts, the others shared by their hash."""

    def __init__(self, frequent: np.ndarray, side: int):
        """frequent: hashes of the frequent words, the most frequent first."""
        self.side, self.frequent = side, side * (side - side // 4)
        order = np.argsort(frequent)
        self.sorted, self.rank = frequent[order], order.astype(np.int32)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        shared = (self.frequent + (hashes >> np.uint64(33)) % np.uint64(self.side * (self.side // 4))).astype(np.int32)
        if not len(self.sorted):
            return shared
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], shared)


def _padded(documents: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, RADIUS pads around each, and the places of their tokens."""
    gap = np.full(RADIUS, pad, dtype=np.int32)
    padded = np.concatenate([gap, *(x for d in documents for x in (d, gap))])
    return padded, np.flatnonzero(padded != pad)


def _gathered(rows, vocabulary: Vocabulary) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, token arrays) of runs of documents (id, text) of about PIECE tokens."""
    ids, held, n = [], [], 0
    for i, text in rows:
        ids.append(i)
        held.append(vocabulary.tokens(hashes_of(text.as_py())))
        n += len(held[-1])
        if n >= PIECE:
            yield ids, held
            ids, held, n = [], [], 0
    if ids:
        yield ids, held


PART = "part int, weight double, vector binary"


def _part(part: int, weight: float, vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(weight)], pa.float64()), pa.array([vector.astype("<f8").tobytes()], pa.binary())], ["part", "weight", "vector"])


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((p, w, v) for b in batches for p, w, v in zip(*(b.column(k).to_pylist() for k in range(3))))
    total = sum(np.frombuffer(v, dtype="<f8") for _, _, v in rows)
    yield _part(key[0].as_py(), sum(w for _, w, _ in rows), total)


def tree_sum(parts: DataFrame) -> tuple[float, np.ndarray] | None:
    """Sums of the weights and of the vectors of rows PART; a task adds up to FAN_IN vectors, and so does the driver."""
    parts = checkpoint(parts)
    while parts.count() > FAN_IN:
        group = F.expr(f"part div {FAN_IN}").cast("int")
        parts = checkpoint(parts.withColumn("group", group).select("part", "weight", "vector", "group").groupBy("group").applyInArrow(_merged, PART))
    rows = sorted((r.part, r.weight, bytes(r.vector)) for r in parts.collect())
    return (sum(w for _, w, _ in rows), sum(np.frombuffer(v, dtype="<f8") for _, _, v in rows)) if rows else None


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, named by its 64-bit hash, occurs in all texts."""

    def counted(batches):
        for batch in batches:
            found = np.concatenate([np.empty(0, dtype=np.uint64), *(hashes_of(t.as_py()) for t in batch.column(1))])
            words, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return arrow_map(texts_of(docs), counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """(vocabulary, occurrences of each token) of all texts."""
    counts = checkpoint(count_words(docs))
    side = side_for(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    most = side * (side - side // 4)
    top = counts.orderBy(F.desc("n"), "word").limit(most).collect()
    vocabulary = Vocabulary(np.array([r.word for r in top], dtype=np.int64).view(np.uint64), side)
    occurrences = np.zeros(side * side)
    occurrences[: len(top)] = [r.n for r in top]
    # what isn't frequent, by the tokens that it shares
    shared = side * (side // 4)
    remainder = (F.shiftrightunsigned("word", 33) % shared).cast("int")
    for r in counts.groupBy(remainder.alias("token")).agg(F.sum("n").alias("n")).collect():
        occurrences[vocabulary.frequent + r.token] = r.n
    for r in top:
        occurrences[vocabulary.frequent + (r.word % 2**64 >> 33) % shared] -= r.n
    return vocabulary, occurrences


def _dealt(docs: DataFrame, rounds: int, groups: int) -> DataFrame:
    """(doc_id, text, round, group, place) by a hash of the row, whatever the layout; the order within a group is that of place, doc_id and text."""
    narrow = texts_of(docs).withColumn("place", F.xxhash64("doc_id", "text"))
    return narrow.withColumns({"round": F.pmod("place", F.lit(rounds)), "group": F.pmod(F.shiftrightunsigned("place", 20), F.lit(groups)).cast("int")})


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = 0.01) -> tuple[Vocabulary, Network]:
    """(vocabulary, network), learned from all documents: every token is masked and predicted in one of the rounds.

    In a round the documents that it is dealt go to groups of about GROUP_BYTES. Each group starts from the same network
    and follows the Adam rule over BATCH tokens at a time, in the order of a hash; the groups' networks are averaged by their tokens.
    """
    vocabulary, counts = learn_vocabulary(docs)
    network, side = Network.fresh(counts), vocabulary.side
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // (GROUP_BYTES * rounds)))
    dealt = _dealt(docs, rounds, groups)
    context = docs.sparkSession.sparkContext
    for number in range(rounds):
        sent = context.broadcast((vocabulary, network.flat))

        def learned(batches, number=number, sent=sent):
            vocabulary, flat = sent.value
            for group, rows in _by_group(batches):
                own, steps, seen = Network(flat.copy(), vocabulary.side), 0, 0
                first, second = np.zeros(len(flat), dtype=np.float32), np.zeros(len(flat), dtype=np.float32)
                for _, held in _gathered(rows, vocabulary):
                    padded, places = _padded(held, own.pad)
                    for at in range(0, len(places), BATCH):
                        some = places[at : at + BATCH]
                        slope = own.gradient(padded, some)
                        steps, seen = steps + 1, seen + len(some)
                        first += np.float32(0.1) * (slope - first)
                        second += np.float32(0.01) * (slope * slope - second)
                        own.flat -= (rate / (1 + number) / (1 - 0.9**steps)) * first / (np.sqrt(second / np.float32(1 - 0.99**steps)) + np.float32(1e-6))
                if seen:
                    yield _part(group, seen, own.flat.astype(np.float64) * seen)

        share = dealt.where(F.col("round") == number).select("group", "place", "doc_id", "text")
        # the shuffle deals by groups and a sort puts their rows together; a task may get several groups
        share = share.repartitionById(groups, "group").sortWithinPartitions("group", "place", "doc_id", "text")
        found = tree_sum(arrow_map(share.select("group", "text"), learned, PART))
        sent.unpersist()
        if found is not None:
            network = Network((found[1] / found[0]).astype(np.float32), side)
    return vocabulary, network


def _by_group(batches):
    """(group, its rows as (None, text)) of batches (group, text) that are sorted by group."""
    held: dict = {"batches": iter(batches), "rest": None}

    def advance() -> None:
        if held["rest"] is None or not held["rest"].num_rows:
            held["rest"] = next((b for b in held["batches"] if b.num_rows), None)

    def rows(group):
        while True:
            advance()
            batch = held["rest"]
            if batch is None:
                return
            n = int(np.searchsorted(batch.column(0).to_numpy(), group, side="right"))
            if not n:
                return
            held["rest"] = batch.slice(n)
            for text in batch.slice(0, n).column(1):
                yield None, text

    while True:
        advance()
        if held["rest"] is None:
            return
        group = held["rest"].column(0)[0].as_py()
        yield group, rows(group)


SCHEMA = "doc_id long, tokens long, pseudo_log_likelihood double, per_token double"


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Columns SCHEMA: the summed conditional log-probabilities of each whole text, and their mean.

    A text without words (null, empty, blank) has the sum 0 and a null mean; very long texts are scored as a whole, in pieces of documents' runs; a null doc_id is returned as
    null; equal texts score equally up to float rounding (values are rounded to 4 and 6 places), so there are no other ties; repeated rows are scored each; an
    empty table gives an empty result; other columns are not read, so their names can't clash. Scores don't depend on the layout of docs but for float rounding.
    """
    vocabulary, network = train(docs, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, network.flat))

    def scored(batches):
        vocabulary, flat = sent.value
        network = Network(flat, vocabulary.side)
        rows = ((i, t) for b in batches for part in chunks([b], 256) for i, t in zip(part.column(0).to_pylist(), part.column(1)))
        for ids, held in _gathered(rows, vocabulary):
            padded, places = _padded(held, network.pad)
            found = np.concatenate([network.log_probabilities(padded, places[at : at + STEP]).astype(np.float64) for at in range(0, len(places), STEP)] or [np.empty(0)])
            sizes = np.array([len(d) for d in held])
            sums = np.diff(np.concatenate(([0.0], np.cumsum(found)))[np.concatenate(([0], np.cumsum(sizes)))])
            means = [round(s / n, 6) if n else None for s, n in zip(sums.tolist(), sizes.tolist())]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.round(sums, 4), pa.float64()), pa.array(means, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "pseudo_log_likelihood", "per_token"])

    return arrow_map(texts_of(docs), scored, SCHEMA)
