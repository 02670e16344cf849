import hashlib
import zlib

import numpy as np
import pytest

from pageloom.llm import telephony as A


def test_tables():
    mu, a = A.mulaw_table().astype(int), A.alaw_table().astype(int)
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF], mu[0x0F]) == (-32124, 0, 32124, 0, -16764)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all()


def decode_one(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(A.STEPS[index])
            diff = step >> 3
            diff += (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            sample = max(-32768, min(32767, sample - diff if nibble & 8 else sample + diff))
            index = max(0, min(88, index + (-1 if nibble & 7 < 4 else 2 * (nibble & 7) - 6)))
            out.append(sample)
    return out


def test_adpcm_is_that_of_one_block_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert A.adpcm_decode(blocks).tolist() == [decode_one(bytes(b)) for b in blocks]


def test_resample_keeps_to_each_signal():
    x = np.array([0, 10, 20, 1000, 2000], np.int16)
    y, first = A.resample(x, np.array([0, 3, 5]), 8000, 16000)
    assert (y.tolist(), first.tolist()) == ([0, 5, 10, 15, 20, 20, 1000, 1500, 2000, 2000], [0, 6, 10])


def test_wav_round_trip():
    for n in (0, 1, 64):
        assert A.read_wav(A.wav(bytes(range(n)), A.MULAW, 8000)) == (A.MULAW, 8000, bytes(range(n)))
    for bad in (b"", b"RIFFxxxxWAVE", A.wav(b"abcd", A.MULAW, 8000)[:-2]):
        with pytest.raises(ValueError):
            A.read_wav(bad)


def test_stored(spark):
    texts = [None, "", "a", "é" * 32, "x" * 65, "x" * 65, "long " * 60000]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, media string").select("doc_id", "text")
    got = {r.doc_id: r for r in A.store_media(frame).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, bytes(got[i].payload)) == (len(raw), payload)
        assert A.read_wav(bytes(got[i].media))[2] == payload and A.read_wav(bytes(got[i].pcm))[:2] == (A.PCM, 16000)
    assert got[4].feature == got[5].feature and got[4].media == got[5].media and got[0].feature == got[1].feature
    assert A.store_media(frame.limit(0)).count() == 0


def expand(code, law):
    """One G.711 sample, from its sign, exponent and mantissa."""
    code ^= 0xFF if law == "mu" else 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    if law == "mu":
        size = ((2 * mantissa + 33) << exponent + 2) - 132
        return -size if code & 128 else size
    size = (2 * mantissa + 1) * 8 if exponent == 0 else (2 * mantissa + 33) << exponent + 2
    return size if code & 128 else -size


def test_feature_and_pcm_sample_by_sample(spark, tmp_path):
    texts = [None, "é" * 40, "hello world", "x" * 64, "Mixed Ünïcode 123 " * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in A.op3_telephony(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        mu, a = ([expand(c, law) for c in payload] for law in ("mu", "a"))
        decoded = [x for i in range(0, len(payload), 64) for x in decode_one(payload[i : i + 64])]
        n = len(payload)
        crossings = sum((x < 0) != (y < 0) for x, y in zip(mu, mu[1:], strict=False))
        power = lambda xs: sum(x * x for x in xs) // len(xs)
        assert r.feature == f"n={n};mulaw={power(mu)};crossings={crossings};alaw={power(a)};adpcm={power(decoded)};peak={max(map(abs, decoded))}"
        pcm = [x for i, m in enumerate(mu) for x in (m, m + (mu[min(i + 1, n - 1)] - m) // 2)]
        assert r.pcm_sha256 == hashlib.sha256(A.wav(b"".join(x.to_bytes(2, "little", signed=True) for x in pcm), A.PCM, 16000)).hexdigest()


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "hello"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    r = A.op3_telephony(spark, str(tmp_path)).orderBy("doc_id").first()
    payload = b"hello" + bytes(59)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (5, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))
    assert r.media_sha256 == hashlib.sha256(A.wav(payload, A.MULAW, 8000)).hexdigest()
