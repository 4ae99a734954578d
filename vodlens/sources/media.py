"""PCM audio files as windows: files are listed by Spark, cut into windows, and read window by window in the tasks.

A file of any length is spread over many tasks: its header gives where which window lies, a task opens
the file at that place and holds one window at a time; what it has worked on goes before the next is
read. WAV files with 8 to 32 bits or 32-bit floats, of any number of channels, of known or (streamed)
unknown length, and RF64 files are understood. Other containers need a converter before.

Files lie in a store that pyarrow opens (a mounted folder, HDFS, S3, GCS).
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vodlens.functions import audio
from vodlens.plans.session import ship_package
from vodlens.sources.connectors import opened

UNKNOWN_LENGTH = (0, 0xFFFFFFFF)
#: Windows that a task takes in a row.
RUN = 32


@dataclass
class Header:
    """What a WAV file says of itself: samples a second, channels, bytes of a sample, floats or not, where the samples begin and how many frames there are."""

    rate: int
    channels: int
    width: int
    floats: bool
    at: int
    frames: int


def open_media(uri: str) -> pa.NativeFile:
    path = uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri
    files, name = opened(path)
    return files.open_input_file(name)


def header(f: pa.NativeFile) -> Header:
    """Reads the chunks before the samples."""
    size = f.size()
    f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, long_size = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"ds64":
            long_size = struct.unpack("<Q", f.read(16)[8:])[0]
        elif name == b"fmt ":
            raw = f.read(min(length, 40))
            kind = struct.unpack("<HHIIHH", raw[:16])
            code = struct.unpack("<H", raw[24:26])[0] if kind[0] == 0xFFFE else kind[0]
        elif name == b"data":
            if kind is None or code not in (1, 3) or kind[5] not in (8, 16, 24, 32) or (code == 3 and kind[5] != 32):
                raise ValueError("no PCM samples that can be read")
            there = size - at - 8
            length = long_size if long_size is not None and length == 0xFFFFFFFF else there if length in UNKNOWN_LENGTH else length
            frame = kind[1] * kind[5] // 8
            return Header(kind[2], kind[1], kind[5] // 8, code == 3, at + 8, min(length, there) // frame)
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def samples(f: pa.NativeFile, h: Header, first: int, count: int, channel: int | None = 0) -> np.ndarray:
    """Frames first..first+count-1 as floats in -1..1: of one channel, or the mean of all (None)."""
    f.seek(h.at + first * h.channels * h.width)
    raw = f.read(max(0, min(count, h.frames - first)) * h.channels * h.width)
    if h.floats:
        x = np.frombuffer(raw, "<f4").astype(np.float64)
    elif h.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif h.width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{h.width}").astype(np.float64) / float(1 << (8 * h.width - 1))
    x = x.reshape(-1, h.channels)
    return x.mean(1) if channel is None else x[:, channel]


FILES = "path string, rate int, channels int, frames long, duration_sec double, problem string"


def wav_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """path, rate, channels, frames, duration_sec of each file; problem instead of these where it can't be read."""
    ship_package(spark)
    schema = to_arrow_schema(T.StructType.fromDDL(FILES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                try:
                    with open_media(uri) as f:
                        h = header(f)
                    rows.append((uri, h.rate, h.channels, h.frames, h.frames / h.rate, None))
                except (ValueError, OSError, struct.error) as e:
                    rows.append((uri, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema.names)

    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return listed.select("path").mapInArrow(run, FILES)


def map_windows(spark: SparkSession, path: str, work: Callable[[str, int, float, float, int, np.ndarray], list[tuple]], schema: str, window_sec: float = 30.0, hop_sec: float | None = None, channel: int | None = 0, pattern: str = "*.wav") -> DataFrame:
    """The rows that `work` gives for each window: it gets path, number, start, end, rate and the window's samples.

    Windows begin every hop_sec (side by side by default) from 0 to the end; the last one may be short.
    """
    hop = hop_sec or window_sec
    good = wav_files(spark, path, pattern).where("problem IS NULL AND frames > 0")
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("duration_sec") / F.lit(hop)).cast("long") - 1)
    windows = good.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("n")).withColumn("run", F.floor(F.col("n") / RUN))
    dealt = windows.repartition("path", "run").sortWithinPartitions("path", "n").select("path", "n")
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, f, h = None, None, None

        def full() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), out.types)], out.names)
            held.clear()
            return batch

        try:
            for batch in batches:
                for uri, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if uri != now:
                        if f is not None:
                            f.close()
                        now, f = uri, open_media(uri)
                        h = header(f)
                    first = round(n * hop * h.rate)
                    x = samples(f, h, first, round((n * hop + window_sec) * h.rate) - first, channel)
                    if len(x):
                        held += work(uri, n, first / h.rate, (first + len(x)) / h.rate, h.rate, x)
                    if len(held) >= 256:
                        yield full()
            if held:
                yield full()
        finally:
            if f is not None:
                f.close()

    return dealt.mapInArrow(run, schema)


def wav_windows(spark: SparkSession, path: str, window_sec: float = 30.0, hop_sec: float | None = None, channel: int | None = 0) -> DataFrame:
    """path, window, start_sec, end_sec and samples of each window."""
    return map_windows(spark, path, lambda uri, n, a, b, _, x: [(uri, n, a, b, x.tolist())], "path string, window long, start_sec double, end_sec double, samples array<double>", window_sec, hop_sec, channel)


def acoustic_profile(spark: SparkSession, path: str, window_sec: float = 30.0, hop_sec: float | None = None, channel: int | None = 0) -> DataFrame:
    """rms, zero_crossing_rate and spectral_centroid of each window, and whether it would make a voiceprint (snr_db)."""

    def work(uri: str, n: int, a: float, b: float, rate: int, x: np.ndarray) -> list[tuple]:
        one = x[None, :]
        good, db = audio.quality(x)
        return [(uri, n, a, b, float(audio.rms(one)[0]), float(audio.zero_crossing_rate(one)[0]), float(audio.spectral_centroid(one, rate)[0]), good, db)]

    return map_windows(spark, path, work, "path string, window long, start_sec double, end_sec double, rms double, zero_crossing_rate double, spectral_centroid double, is_clean boolean, snr_db double", window_sec, hop_sec, channel)


def write_wav(rows: DataFrame, key: str, order: list[str], pcm: str, path: str, rate: int) -> DataFrame:
    """A 16-bit mono file for each key from its arrays of floats in -1..1, in order; key, path and n_samples of what was written.

    A task writes a key's arrays one after another, whatever their number, and a file appears when it is complete.
    """
    ship_package(rows.sparkSession)
    held = rows.select(F.col(key).cast("string").alias("key"), F.col(pcm).cast("array<double>").alias("pcm"), *order).where("key IS NOT NULL AND pcm IS NOT NULL")
    dealt = held.repartition("key").sortWithinPartitions("key", *order).select("key", "pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        files.create_dir(root, recursive=True)
        done: list[tuple] = []
        with tempfile.TemporaryDirectory() as folder:
            local, now, f, n = os.path.join(folder, "wav"), None, None, 0

            def begin() -> None:
                nonlocal f, n
                f, n = open(local, "wb"), 0
                f.write(bytes(44))

            def end() -> None:
                f.seek(0)
                f.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * n))
                f.close()
                name = f"{root.rstrip('/')}/{''.join(c if c.isalnum() or c in '-_' else '_' for c in now)}"
                fs.copy_files(local, f"{name}.part", source_filesystem=fs.LocalFileSystem(), destination_filesystem=files)
                files.move(f"{name}.part", f"{name}.wav")
                done.append((now, f"{name}.wav", n))

            for batch in batches:
                for k, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if k != now:
                        if now is not None:
                            end()
                        now = k
                        begin()
                    x = np.nan_to_num(row.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    f.write(np.floor(np.clip(x, -1, 1) * 32767 + 0.5).astype("<i2").tobytes())
                    n += len(x)
            if now is not None:
                end()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], ["key", "path", "n_samples"])

    return dealt.mapInArrow(run, "key string, path string, n_samples long")
