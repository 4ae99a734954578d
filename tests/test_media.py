"""Audio windows, features and files against plain reads."""

import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vodlens.functions import audio
from vodlens.operators import sound
from vodlens.sources import media


def wav(path, x, rate=100, channels=1, width=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(x)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    rng = np.random.default_rng(3)
    long = (rng.normal(size=100 * 333 + 17) * 8000).clip(-32767, 32767).astype("<i2")
    wav(root / "long.wav", long.tobytes())
    (root / "sub").mkdir()
    stereo = rng.integers(-30000, 30000, (450, 2)).astype("<i2")
    wav(root / "sub" / "stereo.wav", stereo.tobytes(), channels=2)
    wav(root / "empty.wav", b"")
    (root / "broken.wav").write_bytes(b"RIFFxxxxWAVE")
    (root / "other.wav").write_bytes(b"no audio")
    return root, long / 32768, stereo / 32768


def test_files_and_problems(spark, folder):
    rows = {r.path.rpartition("/")[2]: r for r in media.wav_files(spark, str(folder[0])).collect()}
    assert (rows["long.wav"].rate, rows["long.wav"].channels, rows["long.wav"].frames) == (100, 1, 33317) and rows["stereo.wav"].duration_sec == 4.5
    assert rows["broken.wav"].problem and rows["other.wav"].problem and rows["empty.wav"].frames == 0 and rows["empty.wav"].problem is None


@pytest.mark.parametrize("window,hop", [(30.0, None), (7.0, 2.5)])
def test_windows_equal_a_plain_read(spark, folder, window, hop):
    root, long, stereo = folder
    got = {(r.path.rpartition("/")[2], r.window): r for r in media.wav_windows(spark, str(root), window, hop).collect()}
    for name, x in (("long.wav", long), ("stereo.wav", stereo[:, 0])):
        k = 0
        while k * (hop or window) * 100 < len(x):
            a = round(k * (hop or window) * 100)
            r = got.pop((name, k))
            part = x[a : round((k * (hop or window) + window) * 100)]
            assert np.array_equal(r.samples, part) and (r.start_sec, r.end_sec) == (a / 100, (a + len(part)) / 100)
            k += 1
    assert not got


def test_one_file_in_many_tasks_of_one_window_each(spark, folder):
    seen = media.map_windows(spark, str(folder[0]), lambda uri, n, a, b, rate, x: [(n, len(x))], "n long, size long", 0.5, pattern="long.wav").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = seen.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 667 and max(r["size"] for r in rows) == 50 and len({r.task for r in rows}) == 4


def test_sample_kinds():
    def chunked(fmt, data, head=b"RIFF", more=b"", size=None):
        body = b"WAVE" + more + struct.pack("<4sI", b"fmt ", len(fmt)) + fmt + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + struct.pack("<4sI", b"data", len(data) if size is None else size) + data
        return pa.BufferReader(head + struct.pack("<I", 0xFFFFFFFF) + body)

    x = np.array([0.0, 0.5, -0.5, -1.0])
    fmt = lambda code, bits, channels=1: struct.pack("<HHIIHH", code, channels, 8, 0, 0, bits)
    three = b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x)
    cases = [(fmt(1, 8), (x * 128 + 128).astype(np.uint8).tobytes()), (fmt(1, 16), (x * 32768).astype("<i2").tobytes()), (fmt(1, 24), three), (fmt(1, 32), (x * (1 << 31)).astype("<i4").tobytes()), (fmt(3, 32), x.astype("<f4").tobytes())]
    extensible = fmt(0xFFFE, 16) + struct.pack("<HHI", 22, 16, 0) + struct.pack("<H", 1) + bytes(14)
    for f, data in [*cases, (extensible, cases[1][1])]:
        for size in (None, 0, 0xFFFFFFFF):
            file = chunked(f, data, size=size)
            h = media.header(file)
            assert h.frames == 4 and np.allclose(media.samples(file, h, 0, 9), x) and np.allclose(media.samples(file, h, 1, 2), x[1:3])
    file = chunked(fmt(1, 16), cases[1][1], b"RF64", struct.pack("<4sIQQQI", b"ds64", 28, 0, 6, 3, 0), 0xFFFFFFFF)
    assert media.header(file).frames == 3
    with pytest.raises(ValueError):
        media.header(chunked(fmt(85, 16), b""))
    both = chunked(fmt(1, 16, 2), (np.array([[0.5, -0.5], [0.25, 0.75]]) * 32768).astype("<i2").tobytes())
    assert media.samples(both, media.header(both), 0, 2, None).tolist() == [0.0, 0.5]


def test_features_equal_their_plain_form(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=n) / 4).tolist()) for k, n in enumerate((256, 100, 31, 0))] + [(9, None), (None, [1.0] * 64), (10, [0.0] * 64)]
    df = spark.createDataFrame(rows, "i long, x array<double>")
    got = {(r.item, r.frame): r for r in sound.frame_features(df, "i", "x", 16_000, 32, 16).collect()}
    assert len(got) == 15 + 5 + 3
    for (i, f), r in got.items():
        x = np.array(dict(rows)[i])[16 * f : 16 * f + 32]
        size = [abs(sum(v * np.exp(-2j * np.pi * k * n / 32) for n, v in enumerate(x))) for k in range(17)]
        assert np.isclose(r.rms, (sum(v * v for v in x) / 32) ** 0.5) and np.isclose(r.zero_crossing_rate, sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / 31)
        assert np.isclose(r.spectral_centroid, sum(s * k * 500 for k, s in enumerate(size)) / (sum(size) + 1e-8))


def test_voiceprints(spark):
    t = np.arange(1_600) / 16_000
    rows = [(1, (0.5 * np.sin(2 * np.pi * 440 * t)).tolist()), (2, [1.0] * 100), (3, []), (4, None), (5, [0.0] * 400), (6, [1.0] * 9_000)]
    got = {r.item: r for r in sound.voiceprints(spark.createDataFrame(rows, "i long, x array<double>"), "i", "x", 16_000, 24).collect()}
    assert got[1].is_clean and got[1].snr_db > 12 and np.isclose(np.linalg.norm(got[1].embedding), 1) and int(np.argmax(got[1].embedding)) == 1
    assert got[2].embedding is None and not got[2].is_clean and got[3].embedding is None and got[4].embedding is None
    assert got[5].embedding == [1.0] + [0.0] * 23 and got[5].snr_db == 40.0 and got[6].embedding is not None
    loud = spark.createDataFrame([(1, 1.0), (1, 0.5), (1, 0.7), (2, 3.0)], "s long, rms double")
    assert sorted((r.s, r.rms, r.speaker_label) for r in sound.near_microphone(loud, ["s"]).collect()) == [(1, 0.5, "EXTERNAL_VIDEO"), (1, 0.7, "STREAMER"), (1, 1.0, "STREAMER"), (2, 3.0, "STREAMER")]


def test_written_files(spark, tmp_path):
    rows = [("a b", k, [k / 100, -k / 100, 2.0]) for k in range(50)] + [("c", 0, [0.5, float("nan")]), (None, 0, [1.0]), ("d", 0, None)]
    df = spark.createDataFrame(rows, "name string, k long, x array<double>").repartition(3)
    done = {r.key: r for r in media.write_wav(df, "name", ["k"], "x", f"file://{tmp_path}/out", 8_000).collect()}
    assert set(done) == {"a b", "c"} and done["a b"].n_samples == 150
    with wave.open(io.BytesIO((tmp_path / "out" / "a_b.wav").read_bytes())) as f:
        assert (f.getframerate(), f.getnframes()) == (8_000, 150)
        x = np.frombuffer(f.readframes(150), "<i2")
    assert x.tolist() == [int(np.floor(min(1, v) * 32767 + 0.5)) for k in range(50) for v in (k / 100, -k / 100, 2.0)]


def test_quality_and_framing():
    assert audio.quality(np.empty(0)) == (False, 0.0) and audio.framed(np.arange(3.0), 5).shape == (0, 5)
    assert audio.framed(np.arange(10.0), 4, 3).tolist() == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
