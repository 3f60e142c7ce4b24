"""A batch data source for archives of ragged matrices (``.npz``)."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_number(name: str) -> int:
    """The integer after the last underscore of a key (-1 without one)."""
    tail = name.rsplit("_", 1)[-1]
    return int(tail) if tail.isdigit() else -1


def read_npz(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """``pair_index, key, pos, vec`` of each matrix of the archives;
    pairs are numbered by the keys' integer suffix. Archives are read through
    Spark's own file reader, so any store it knows will do; one archive is
    opened by one task. ``longest`` cuts a matrix after so many rows (P06)."""
    return npz_matrices(spark.read.format("binaryFile").load(path), longest)


def npz_matrices(archives: DataFrame, longest: int | None = None) -> DataFrame:
    """The same from archives held in the column ``content``."""

    def run(it):
        import pyarrow as pa

        for b in it:
            for data in b.column("content").to_pylist():
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    for k in z.files:
                        m = np.atleast_2d(np.asarray(z[k], float))[:longest]
                        n = len(m)
                        yield pa.RecordBatch.from_arrays([pa.array([key_number(k)] * n, pa.int64()), pa.array([k] * n), pa.array(range(n), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["pair_index", "key", "pos", "vec"])

    return archives.select("content").mapInArrow(run, "pair_index long, key string, pos long, vec array<double>")


def read_wav(spark: SparkSession, path: str, begin_ms: int = 0, end_ms: int | None = None) -> DataFrame:
    """``path, rate, samples`` of PCM WAV files, cut by milliseconds."""
    return wav_samples(spark.read.format("binaryFile").load(path), begin_ms, end_ms)


def wav_samples(files: DataFrame, begin_ms: int = 0, end_ms: int | None = None) -> DataFrame:
    """The same from files held in the columns ``path, content``."""

    def run(it):
        import wave

        import pyarrow as pa

        for b in it:
            out = [[], [], []]
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with wave.open(io.BytesIO(data)) as w:
                    rate, kind = w.getframerate(), {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
                    x = np.frombuffer(w.readframes(w.getnframes()), kind).reshape(-1, w.getnchannels())[:, 0]
                lo, hi = begin_ms * rate // 1000, len(x) if end_ms is None else end_ms * rate // 1000
                for c, v in zip(out, (name, rate, x[lo:hi].astype(float).tolist()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], ["path", "rate", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, rate long, samples array<double>")


def write_wav(df: DataFrame, path: str = "path", samples: str = "samples", rate: int = 16_000) -> DataFrame:
    """``path, content``: 16-bit mono PCM files of arrays of samples."""

    def run(it):
        import wave

        import pyarrow as pa

        for b in it:
            out = []
            for x in b.column("samples").to_pylist():
                buf = io.BytesIO()
                with wave.open(buf, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(rate)
                    w.writeframes(np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes())
                out.append(buf.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return df.select(F.col(path).cast("string").alias("path"), F.col(samples).cast("array<double>").alias("samples")).mapInArrow(run, "path string, content binary")


def write_npz(df: DataFrame, key: str = "key", vec: str = "vec") -> DataFrame:
    """One row per matrix: ``key, content`` with an archive of that matrix."""

    def run(it):
        import pyarrow as pa

        for b in it:
            out = []
            for k, m in zip(b.column("key").to_pylist(), b.column("m").to_pylist(), strict=True):
                buf = io.BytesIO()
                np.savez(buf, **{k: np.array([r["vec"] for r in m], float)})
                out.append(buf.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], ["key", "content"])

    g = df.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(vec).alias("vec")))).alias("m"))
    return g.mapInArrow(run, "key string, content binary")
