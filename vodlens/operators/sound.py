"""Acoustic operators over arrays of samples: framed features, voiceprints and relative loudness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.functions import audio
from vodlens.plans.session import ship_package


def frame_features(rows: DataFrame, item: str, pcm: str, rate: float, size: int, hop: int | None = None) -> DataFrame:
    """item, frame, rms, zero_crossing_rate and spectral_centroid of each whole frame of each row's samples.

    A row without samples, or with fewer than a frame, gives none; nulls in the samples count as zero.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = audio.framed(np.nan_to_num(row.values.to_numpy(zero_copy_only=False).astype(np.float64)), size, hop)
                if len(x):
                    cells = [pa.array([i] * len(x), pa.int64()), pa.array(np.arange(len(x))), pa.array(audio.rms(x)), pa.array(audio.zero_crossing_rate(x)), pa.array(audio.spectral_centroid(x, rate))]
                    yield pa.RecordBatch.from_arrays(cells, ["item", "frame", "rms", "zero_crossing_rate", "spectral_centroid"])

    held = rows.select(F.col(item).cast("long"), F.col(pcm).cast("array<double>")).where(F.col(item).isNotNull() & F.col(pcm).isNotNull())
    return held.mapInArrow(run, "item long, frame long, rms double, zero_crossing_rate double, spectral_centroid double")


def voiceprints(rows: DataFrame, item: str, pcm: str, rate: float, dim: int = 192) -> DataFrame:
    """item, snr_db, is_clean and embedding (null for clipped samples of under half a second, and for none)."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.nan_to_num(row.values.to_numpy(zero_copy_only=False).astype(np.float64)) if row.is_valid else np.empty(0)
                good, db = audio.quality(x)
                clipped = len(x) and np.abs(x).max() >= audio.CLIPPED
                usable = len(x) and not (clipped and len(x) < rate / 2)
                out.append((i, db, bool(good), audio.subbands(x, dim).tolist() if usable else None))
            kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["item", "snr_db", "is_clean", "embedding"])

    held = rows.select(F.col(item).cast("long"), F.col(pcm).cast("array<double>")).where(F.col(item).isNotNull())
    return held.mapInArrow(run, "item long, snr_db double, is_clean boolean, embedding array<double>")


def near_microphone(profiles: DataFrame, keys: list[str], rms: str = "rms", share: float = 0.9) -> DataFrame:
    """speaker_label: STREAMER where the rms is at least `share` of its key's mean, else EXTERNAL_VIDEO."""
    mean = profiles.groupBy(*keys).agg(F.avg(rms).alias("mean_rms"))
    return profiles.join(mean, keys).withColumn("speaker_label", F.when(F.col(rms) >= F.col("mean_rms") * share, "STREAMER").otherwise("EXTERNAL_VIDEO")).drop("mean_rms")
