"""Media columns: texts stored as WAV, read back, transformed and fingerprinted by pairs of spectral peaks."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, chunks, texts_of

UNIT = 192
SAMPLE_RATE = 8000
WINDOW = 256
HOP = 128
#: A frame keeps at most so many peaks; each is paired with so many following peaks, at most MAX_GAP frames on.
PEAKS = 4
FAN_OUT = 3
MAX_GAP = 15
#: Frames transformed at once, which bounds the memory for very long recordings.
FRAMES_AT_ONCE = 4096


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(bytes padded by 32 to a positive multiple of UNIT, bytes before padding); null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def write_wav(payload: bytes) -> bytes:
    """A mono WAV file whose unsigned 8-bit samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return r.readframes(r.getnframes())


def spectrogram_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each peak, in order of frame and bin.

    Frames of WINDOW samples every HOP (the last one filled with silence) are Hann-weighted and transformed.
    A peak is larger than its neighbours in frequency and than the same bin in both neighbouring frames;
    of each frame the PEAKS largest stay. Magnitudes are rounded, so that the last bits of a float decide nothing.
    """
    signal = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    n = max(1, -(-max(0, len(signal) - WINDOW) // HOP) + 1)
    signal = np.concatenate([signal, np.zeros((n - 1) * HOP + WINDOW - len(signal), dtype=np.float32)]) if (n - 1) * HOP + WINDOW > len(signal) else signal
    frames = np.lib.stride_tricks.sliding_window_view(signal, WINDOW)[::HOP][:n]
    hann = np.hanning(WINDOW).astype(np.float32)
    times, bins = [], []
    for at in range(0, n, FRAMES_AT_ONCE):
        low, high = max(0, at - 1), min(n, at + FRAMES_AT_ONCE + 1)
        power = np.rint(np.abs(np.fft.rfft(frames[low:high] * hann, axis=1)) * 64).astype(np.int32)
        edge = np.zeros((1, power.shape[1]), dtype=np.int32)
        before = power[:-1] if low < at else np.concatenate([edge, power[:-1]])
        own = power[at - low : min(n, at + FRAMES_AT_ONCE) - low]
        before = before[: len(own)]
        after = np.concatenate([power[at - low + 1 :], edge])[: len(own)]
        inner = own[:, 1:-1]
        peak = (inner > own[:, :-2]) & (inner >= own[:, 2:]) & (inner >= before[:, 1:-1]) & (inner > after[:, 1:-1])
        ranked = np.where(peak, inner.astype(np.int64) * 1024 + np.arange(inner.shape[1])[::-1], -1)
        top = np.argpartition(ranked, -PEAKS, axis=1)[:, -PEAKS:]
        kept = np.take_along_axis(ranked, top, axis=1) >= 0
        t, k = np.nonzero(kept)
        found = np.stack([t + at, top[t, k] + 1])
        found = found[:, np.lexsort((found[1], found[0]))]
        times.append(found[0])
        bins.append(found[1])
    return np.concatenate(times), np.concatenate(bins)


def peak_pairs(times: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of each pair of a peak and one of its FAN_OUT followers in later frames: code = bin, bin, gap in 8, 8 and 8 bits."""
    first_later = np.searchsorted(times, times, side="right")
    at, codes, order = [], [], []
    for k in range(FAN_OUT):
        partner = first_later + k
        source = np.flatnonzero(partner < len(times))
        gap = times[partner[source]] - times[source]
        source, gap = source[gap <= MAX_GAP], gap[gap <= MAX_GAP]
        at.append(times[source])
        codes.append(bins[source] << 16 | bins[first_later[source] + k] << 8 | gap)
        order.append(source * FAN_OUT + k)
    rank = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(at)[rank].astype(np.int32), np.concatenate(codes)[rank].astype(np.int32)


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as a WAV file in a binary column. A null text counts as empty; a null id stays null."""

    def stored(batches):
        for batch in (part for b in batches for part in chunks([b], 512)):
            made = [payload_of(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_wav(p) for p, _ in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    narrow = texts_of(docs, id_column, text_column)
    return arrow_map(narrow, stored, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
    " media_sha256 string, frames int, peak_times array<int>, peak_codes array<int>"
)


def media_features(stored: DataFrame) -> DataFrame:
    """Columns FEATURES from (doc_id, n_bytes, media): the samples are read back by the wave module and fingerprinted.

    peak_times and peak_codes are parallel arrays, one entry for each pair of peaks, in order of time. A null doc_id stays null, repeated rows
    are each returned, an empty table gives an empty result; media as encode_media() makes it is never null.
    """
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def featured(batches):
        for batch in (part for b in batches for part in chunks([b], 512)):
            rows = []
            for i, n, media in zip(*(batch.column(k) for k in range(3))):
                media = media.as_py()
                payload = read_wav(media)
                times, codes = peak_pairs(*spectrogram_peaks(payload))
                frames = max(1, -(-max(0, len(payload) - WINDOW) // HOP) + 1)
                rows.append((i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), frames, times, codes))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return arrow_map(stored, featured, FEATURES)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: the digest columns of the stored and reread form, feature, and the fingerprint arrays.

    feature: frames, pairs and the hash of the time-coded arrays as text. Equal texts give equal values; null
    and empty texts are 192 blanks; a very long text is one recording, held whole by the task that encodes it; peaks of equal
    strength go by their frequency; a null doc_id stays null; repeated rows are each returned; an empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    made = media_features(encode_media(docs))
    code = F.sha2(F.concat_ws(";", F.array_join("peak_times", ","), F.array_join("peak_codes", ",")), 256)
    feature = F.concat_ws(":", "frames", F.size("peak_codes"), code)
    return made.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"), "peak_times", "peak_codes",
    )
