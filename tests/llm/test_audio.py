import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import audio


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def test_round_trip_and_digests(spark):
    texts = ["héllo", None, "", "x" * 64, "y" * 65, "long words " * 5000, "héllo"]
    df = spark.createDataFrame([(i, t, b"0") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in audio.audio_digests(df).collect()}
    media = {r.doc_id: bytes(r.media) for r in audio.encode_media(df).collect()}
    for i, t in enumerate(texts):
        p, r = payload(t), rows[i]
        with wave.open(io.BytesIO(media[i])) as w:  # another reader of the format
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.RATE) and w.readframes(1 << 30) == p
        assert audio.read_wav(media[i]).tobytes() == p
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len((t or "").encode()), len(p), len(p) + 44)
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.media_sha256 == hashlib.sha256(media[i]).hexdigest()
        assert r.tail_crc32 == zlib.crc32(p[-64:])
    assert rows[0].feature == rows[6].feature and rows[1].feature == rows[2].feature
    assert audio.audio_digests(df.limit(0)).count() == 0


def test_resampling_keeps_a_tone_and_chunks_agree(monkeypatch):
    t = np.arange(30_000) / audio.RATE
    x = np.sin(2 * np.pi * 440 * t)
    y = np.concatenate(list(audio.resample(x)))
    assert len(y) == 20_000
    spectrum = np.abs(np.fft.rfft(y[4000:12000] * np.hanning(8000)))
    assert abs(np.argmax(spectrum) * audio.TARGET / 8000 - 440) < 2
    assert 0.8 < np.abs(y[4000:12000]).max() < 1.2
    plain = np.convolve(np.stack([x, np.zeros_like(x)], 1).ravel(), audio._phases()[:, ::-1].T.ravel())[: 3 * len(y) : 3]
    assert np.allclose(plain[: len(y)], y, atol=1e-4)
    monkeypatch.setattr(audio, "CHUNK", 512)
    assert np.allclose(np.concatenate(list(audio.resample(x))), y, atol=1e-6)


def test_segments_have_hysteresis():
    level = np.array([-40, -12, -5, -12, -14, -40, -12, -12, -40, 0, -40], float)
    assert audio.segments(np.repeat(level[:, None], audio.MELS, 1)) == [(1, 5), (9, 10)]


def test_tensors(spark):
    df = spark.createDataFrame([(1, "words and more words " * 2000)], "doc_id long, text string")
    raw = audio.audio_features(audio.encode_media(df)).first().tensors
    table = pa.ipc.open_stream(bytes(raw)).read_all()
    col = table.column("log_mel").combine_chunks()
    assert tuple(col.type.shape) == (audio.BLOCK_FRAMES, audio.MELS)
    e = audio.log_mel(np.frombuffer(payload("words and more words " * 2000), np.uint8))
    assert np.allclose(col.to_numpy_ndarray().reshape(-1, audio.MELS)[: len(e)], e, atol=1e-3)
    assert table.column("start_s").to_pylist()[0] == 0 and table.column("end_s").to_pylist()[-1] <= 42_048 / audio.RATE


def test_log_mel_against_the_plain_sums(monkeypatch):
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 2_000).astype(np.uint8)
    y = np.concatenate(list(audio.resample(samples / 128.0 - 1)))
    frames = [y[i : i + audio.FRAME] for i in range(0, len(y) - audio.FRAME + 1, audio.HOP)]
    k, t = np.arange(audio.FRAME // 2 + 1)[:, None], np.arange(audio.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * t / (audio.FRAME - 1))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    want = []
    for f in frames:
        power = np.abs((np.exp(-2j * np.pi * k * t / audio.FRAME) * (f * hann)).sum(axis=1)) ** 2
        edges = np.linspace(mel(50.0), mel(audio.TARGET / 2), audio.MELS + 2)
        hz = 700 * (10 ** (edges / 2595) - 1)
        row = []
        for i in range(audio.MELS):
            e = sum(p * max(0, min((q - hz[i]) / (hz[i + 1] - hz[i]), (hz[i + 2] - q) / (hz[i + 2] - hz[i + 1]))) for p, q in zip(power, k[:, 0] * audio.TARGET / audio.FRAME))
            row.append(10 * np.log10(e + 1e-6))
        want.append(row)
    got = audio.log_mel(samples)
    assert got.shape == (len(want), audio.MELS) and np.allclose(got, want, atol=1e-3)
    for chunk in (128, 256, 700):
        monkeypatch.setattr(audio, "CHUNK", chunk)
        assert np.allclose(audio.log_mel(samples), want, atol=1e-3)


def test_null_media_long_texts_and_the_stored_stream(spark):
    import hashlib

    media = spark.createDataFrame([(1, None, "a")], "doc_id long, media binary, feature string")
    out = audio.audio_features(media)
    assert out.columns == ["doc_id", "media", "feature", "tensors"] and tuple(out.first())[1:] == (None, None, None)
    long = "no word of it twice " * 100_000
    df = spark.createDataFrame([(1, long), (None, long), (2, "")], "doc_id long, text string")
    rows = audio.audio_digests(df).collect()
    assert rows[0].feature == rows[1].feature and rows[1].doc_id is None
    for r, t in zip(audio.audio_features(audio.encode_media(df)).collect(), rows):
        assert t.feature.endswith(hashlib.sha256(bytes(r.tensors)).hexdigest()) and t.tensor_bytes == len(r.tensors)
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert all(a < b for a, b in zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist()))
