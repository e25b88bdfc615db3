"""PCM WAV files as sample arrays: what can't be read becomes a row with an error, never a failed job."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest clip, in seconds.
MOST_SECONDS = 600
CLIP = "samples array<float>, rate int, channels int, bits int, backend string, error string"


def is_wav(content: Column) -> Column:
    """Whether a file starts as a RIFF file that holds WAVE."""
    return (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 9, 4) == F.lit(b"WAVE"))


def decode(content: bytes) -> tuple:
    """(samples from -1 to 1, mean of the channels; rate, channels, bits, backend, error) of a PCM file of 8 to 32 bits."""
    try:
        with wave.open(io.BytesIO(content)) as file:
            channels, width, rate, n = file.getnchannels(), file.getsampwidth(), file.getframerate(), file.getnframes()
            if n > MOST_SECONDS * rate:
                return None, rate, channels, 8 * width, "wave", "too_long"
            raw = np.frombuffer(file.readframes(n), np.uint8)
    except (wave.Error, EOFError, ValueError) as error:
        return None, None, None, None, None, str(error) or "unreadable"
    if width not in (1, 2, 3, 4):
        return None, rate, channels, 8 * width, "wave", "unsupported_width"
    raw = raw[: len(raw) - len(raw) % (width * channels)]
    if width == 1:
        x = raw.astype(np.float64) - 128.0  # eight bits are unsigned
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)  # the sign is the highest byte's
        x = (wide.view("<i4").ravel() >> (32 - 8 * width)).astype(np.float64)
    x = (x / 2.0 ** (8 * width - 1)).reshape(-1, channels).mean(axis=1)
    return x.astype(np.float32), rate, channels, 8 * width, "wave", None


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with samples, rate, channels, bits, backend and error in place of ``content``.

    Files of another kind (an external decoder's work) have the error ``not_wav``.
    """
    plain = files.withColumn("_wav", F.coalesce(is_wav(F.col(content)), F.lit(False)))
    kept = [c for c in files.columns if c != content]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [decode(bytes(c)) if ok else (None, None, None, None, None, "not_wav") for c, ok in zip(batch[content], batch["_wav"], strict=True)]
            clips = pd.DataFrame(rows, columns=["samples", "rate", "channels", "bits", "backend", "error"])
            for c in ("rate", "channels", "bits"):
                clips[c] = clips[c].astype("Int32")
            yield pd.concat([batch[kept].reset_index(drop=True), clips], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != content), CLIP])
    return plain.mapInPandas(run, schema)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, samples, ...) of the files of a folder."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "length", "content"))


def encoded(samples: Column, rate: int) -> Column:
    """A mono file of 16 bits of the samples; for exports and tests."""

    @F.pandas_udf("binary")
    def write(col: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            body = io.BytesIO()
            with wave.open(body, "wb") as file:
                file.setnchannels(1)
                file.setsampwidth(2)
                file.setframerate(rate)
                file.writeframes(np.clip(np.floor(np.asarray(v, float) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes())
            return body.getvalue()

        return col.map(one, na_action=None)

    return write(samples)
