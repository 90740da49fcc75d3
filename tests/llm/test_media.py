import hashlib
import zlib

import numpy as np
import pytest
from dendra.llm import media as M


def plain_peaks(samples):
    """Peaks frame by frame, bin by bin."""
    signal = [(b - 128) / 128 for b in samples]
    n = max(1, -(-max(0, len(signal) - M.WINDOW) // M.HOP) + 1)
    signal += [0.0] * ((n - 1) * M.HOP + M.WINDOW - len(signal))
    hann = np.hanning(M.WINDOW).astype(np.float32)
    power = [np.rint(np.abs(np.fft.rfft(np.array(signal[i * M.HOP : i * M.HOP + M.WINDOW], dtype=np.float32) * hann)) * 64).astype(int).tolist() for i in range(n)]
    found = []
    for t in range(n):
        frame = []
        for k in range(1, M.WINDOW // 2):
            x = power[t][k]
            before = power[t - 1][k] if t else 0
            after = power[t + 1][k] if t + 1 < n else 0
            if x > power[t][k - 1] and x >= power[t][k + 1] and x >= before and x > after:
                frame.append((-x, k))
        found += [(t, k) for _, k in sorted(frame)[: M.PEAKS]]
    return sorted(found)


def plain_pairs(peaks):
    out = []
    for t, k in peaks:
        later = [p for p in peaks if p[0] > t][: M.FAN_OUT]
        out += [(t, k << 16 | b << 8 | u - t) for u, b in later if u - t <= M.MAX_GAP]
    return out


@pytest.mark.parametrize("text", ["", "short", "some longer text, more than a frame " * 30, "é ü " * 200])
def test_fingerprint_matches_brute_force(text, monkeypatch):
    payload, _ = M.payload_of(text)
    want = plain_peaks(payload)
    for frames in (4096, 3):
        monkeypatch.setattr(M, "FRAMES_AT_ONCE", frames)
        times, bins = M.spectrogram_peaks(M.read_wav(M.write_wav(payload)))
        assert list(zip(times.tolist(), bins.tolist())) == want
        at, codes = M.peak_pairs(times, bins)
        assert list(zip(at.tolist(), codes.tolist())) == plain_pairs(want)


def test_a_tone_is_found():
    wave = np.rint(128 + 100 * np.sin(2 * np.pi * 20 * np.arange(4000) / M.WINDOW)).astype(np.uint8).tobytes()
    times, bins = M.spectrogram_peaks(wave)
    assert 20 in bins.tolist()


def test_odd_rows(docs, rows):
    got = M.fingerprint_documents(docs).collect()
    key = lambda x: str(x[:4])
    want = []
    for i, text, *_ in rows[0]:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, (len(raw) + 191) // 192 * 192) - len(raw))
        media = M.write_wav(payload)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest()))
        assert M.read_wav(media) == payload
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.payload_sha256, r.feature) == r.feature
        assert len(r.peak_times) == len(r.peak_codes) and list(r.peak_times) == sorted(r.peak_times)
    assert len(set(by_text.values())) > 10


def test_empty_table(no_docs):
    assert M.fingerprint_documents(no_docs).collect() == []


def test_other_formats_are_refused():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"abcd")
    with pytest.raises(ValueError):
        M.read_wav(out.getvalue())
