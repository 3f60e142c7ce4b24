"""Matrices of MATLAB files, rows of SQLite files, PNG images, HTML reports."""

from __future__ import annotations

import sqlite3
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the MAT 5 format: element types that hold numbers.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_NUMERIC_CLASSES = 14, 15, range(6, 16)


def _elements(data: bytes, order: str):
    """(type, bytes) of each data element; short ones keep their data in the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + (size if kind == MAT_COMPRESSED else -(-size // 8) * 8)


def parse_mat(data: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a MAT 5 file by name; cells, structures,
    text and sparse matrices are passed over."""
    if len(data) < 128:
        raise ValueError("no MAT 5 file")
    order = "<" if data[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray] = {}
    for kind, body in _elements(data[128:], order):
        if kind == MAT_COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != MAT_MATRIX:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 4 or parts[0][1][0 if order == "<" else 3] not in MAT_NUMERIC_CLASSES:
            continue
        shape = np.frombuffer(parts[1][1], f"{order}i4")
        values = np.frombuffer(parts[3][1], order + MAT_TYPES[parts[3][0]])
        out[parts[2][1].decode("latin-1")] = values.astype(float).reshape(shape, order="F")
    return out


def make_mat(matrices: dict[str, np.ndarray]) -> bytes:
    """A MAT 5 file (little-endian, not compressed) of two-dimensional matrices."""
    element = lambda kind, body: struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, m in matrices.items():
        m = np.atleast_2d(np.asarray(m, "<f8"))
        out += element(MAT_MATRIX, element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *m.shape)) + element(1, name.encode("latin-1")) + element(9, m.tobytes(order="F")))
    return out


def mat_matrices(files: DataFrame) -> DataFrame:
    """``path, name, pos, vec`` of the rows of each matrix of files held in
    ``path, content`` (as ``binaryFile`` reads them)."""

    def run(it):
        for b in it:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for name, m in parse_mat(data).items():
                    m = m.reshape(len(m), -1)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(m), pa.string()), pa.array([name] * len(m), pa.string()), pa.array(range(len(m)), pa.int64()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["path", "name", "pos", "vec"])

    return files.select("path", "content").mapInArrow(run, "path string, name string, pos long, vec array<double>")


def features_to_wave(mel: np.ndarray, size: int, hop: int, rounds: int = 20) -> np.ndarray:
    """A waveform whose magnitude spectrogram (frames x size / 2 + 1) comes
    near the given one: phases by alternating projections (Griffin and Lim)."""
    window = np.hanning(size + 1)[:size]
    n = len(mel)
    phase = np.exp(2j * np.pi * np.random.default_rng(0).random(mel.shape))
    wave = np.zeros(hop * (n - 1) + size)
    for _ in range(rounds):
        total, weight = np.zeros_like(wave), np.zeros_like(wave)
        for t, frame in enumerate(np.fft.irfft(mel * phase, size, axis=1)):
            total[t * hop : t * hop + size] += frame * window
            weight[t * hop : t * hop + size] += window**2
        wave = total / np.maximum(weight, 1e-8)
        spec = np.fft.rfft(np.stack([wave[t * hop : t * hop + size] * window for t in range(n)]), axis=1)
        phase = spec / np.maximum(np.abs(spec), 1e-12)
    return wave


def sqlite_rows(files: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """Rows of ``table`` of SQLite files held in ``path, content``, with the
    given columns and types; a file is opened in memory by one task."""
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    wanted = f"SELECT {', '.join(map(quote, columns))} FROM {quote(table)}"

    def run(it):
        for b in it:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(data)
                cursor = db.execute(wanted)
                while rows := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(columns.values())]], ["path", *columns])
                db.close()

    return files.select("path", "content").mapInArrow(run, f"path string, {schema}")


def write_sqlite(df: DataFrame, key: str, table: str) -> DataFrame:
    """``path, content``: a SQLite file for each value of ``key`` with the other
    columns (long, double or string) of its rows."""
    columns = [c for c in df.columns if c != key]

    def run(rows: pa.Table) -> pa.Table:
        db = sqlite3.connect(":memory:")
        db.execute(f"CREATE TABLE {table} ({', '.join(columns)})")
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", zip(*(rows.column(c).to_pylist() for c in columns), strict=True))
        db.commit()
        data = db.serialize()
        db.close()
        return pa.table({"path": [str(rows.column(key)[0].as_py())], "content": pa.array([data], pa.binary())})

    return df.groupBy(key).applyInArrow(run, "path string, content binary")


def png(pixels: np.ndarray) -> bytes:
    """A PNG of an array (rows, columns) of grey values 0 to 255 or (rows,
    columns, 3) of colours."""
    pixels = np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    h, w = pixels.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def html_escape(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def html_report(df: DataFrame, columns: list[str], key: str = "pair_index", order: str = "pos") -> DataFrame:
    """``key, html``: a table per key with a row for each of its rows, in
    order, values escaped."""
    cells = F.concat(*[F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns])
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("r")))), lambda x: x["r"])
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    return df.groupBy(key).agg(F.concat(F.lit("<table>" + head), F.array_join(rows, ""), F.lit("</table>")).alias("html"))
