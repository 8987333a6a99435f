"""Quantized rows under a shared calibration pair.

A row's codes are a function of the row, the pair, the dimension and the bit width alone, so shards can be moved
without touching a code. Two encoders: ``scalar`` (shift and scale per coordinate, expressible in SQL) and ``rotated``
(unit direction, seeded rotation, Gaussian codebook, one correcting scale per row).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CollectionError, InvalidArgument


def check_shape(dim: int, bits: int) -> None:
    if dim <= 0 or dim % 8:
        raise InvalidArgument(f"the dimension must be a positive multiple of 8, not {dim}")
    if bits not in (2, 3, 4):
        raise InvalidArgument(f"the bit width must be 2, 3 or 4, not {bits}")


def stride_sample(rows: DataFrame, take: int, *, slot: str = "slot", n: int | None = None) -> DataFrame:
    """take rows evenly spaced by slot: numbers i * n div take (F8)."""
    n = rows.count() if n is None else n
    take = min(take, n)
    picked = rows.sparkSession.range(take).select(F.expr(f"id * {n} div {max(take, 1)}").alias(slot))
    return rows.join(picked, slot, "left_semi")


def fit_pair(sample: DataFrame, bits: int) -> DataFrame:
    """pos, shift, scale per coordinate: the least value, and the steps per unit of its range (1 for a constant)."""
    x = F.col("x").cast("double")
    stats = sample.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.min(x).alias("low"), F.max(x).alias("high"))
    steps = float(2**bits - 1)
    return stats.select("pos", F.col("low").alias("shift"), F.when(F.col("high") == F.col("low"), 1.0).otherwise(steps / (F.col("high") - F.col("low"))).alias("scale"))


def collect_pair(pair: DataFrame) -> tuple[list[float], list[float]]:
    """The pair's two arrays: one number each per coordinate."""
    rows = pair.orderBy("pos").collect()
    return [r.shift for r in rows], [r.scale for r in rows]


def check_pair(shift: Sequence[float], scale: Sequence[float], dim: int) -> None:
    """Both arrays empty (no calibration), or dim finite shifts and dim finite positive scales (K3)."""
    if not len(shift) and not len(scale):
        return
    if len(shift) != dim or len(scale) != dim:
        raise CollectionError("invalid_calibration", f"a pair needs {dim} shifts and scales")
    if not all(np.isfinite(shift)) or not all(np.isfinite(scale)) or min(scale) <= 0:
        raise CollectionError("invalid_calibration", "shifts must be finite, scales finite and positive")


def _array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def scalar_encode(rows: DataFrame, pair: tuple[Sequence[float], Sequence[float]], bits: int) -> DataFrame:
    """rows with codes: round((x - shift) * scale), held within 0 and 2**bits - 1."""
    shift, scale = _array(pair[0]), _array(pair[1])
    code = lambda x, i: F.least(F.greatest(F.floor((x.cast("double") - F.get(shift, i)) * F.get(scale, i) + 0.5), F.lit(0)), F.lit(2**bits - 1)).cast("int")
    return rows.withColumn("codes", F.transform("embedding", code))


def scalar_decode(rows: DataFrame, pair: tuple[Sequence[float], Sequence[float]]) -> DataFrame:
    """rows with decoded: code / scale + shift."""
    shift, scale = _array(pair[0]), _array(pair[1])
    return rows.withColumn("decoded", F.transform("codes", lambda c, i: c / F.get(scale, i) + F.get(shift, i)))


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix that depends on dim only."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def gaussian_codebook(bits: int) -> np.ndarray:
    """Levels that minimise the mean square error for a standard normal (Lloyd-Max), by iteration on a fine grid."""
    x = np.linspace(-6, 6, 24001)
    w = np.exp(-(x**2) / 2)
    levels = np.linspace(-2, 2, 2**bits)
    for _ in range(500):
        at = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        levels = np.array([np.average(x[at == i], weights=w[at == i]) for i in range(2**bits)])
    return levels


def rotated_encode(rows: DataFrame, bits: int, dim: int, pair: tuple[Sequence[float], Sequence[float]] | None = None) -> DataFrame:
    """rows with codes and scale: the decoded row is scale * codebook[codes], rotated back; a zero row has scale 0."""
    check_shape(dim, bits)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", codes array<int>, scale double"
    shift, gain = (np.array(pair[0]), np.array(pair[1])) if pair and len(pair[0]) else (np.zeros(dim), np.ones(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, book = rotation(dim), gaussian_codebook(bits)
        edges = (book[1:] + book[:-1]) / 2
        for b in batches:
            x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
            size = np.sqrt((x**2).sum(axis=1))
            y = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0) @ turn.T * np.sqrt(dim)
            codes = np.searchsorted(edges, (y - shift) * gain)
            near = book[codes] / gain + shift
            along = (near * y).sum(axis=1) / dim
            scale = np.where(size > 0, size / np.where(along > 0, along, 1) / np.sqrt(dim), 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, dim), pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], lists, pa.array(scale)], names=[*names, "codes", "scale"])

    return rows.mapInArrow(run, schema)


def rotated_queries(queries: Sequence[tuple[int, Sequence[float]]], dim: int) -> list[tuple[int, list[float]]]:
    """Queries turned as the rows are, so that scores need no rotating back."""
    return [(i, (np.asarray(q, dtype=np.float64) @ rotation(dim).T).tolist()) for i, q in queries]


def rotated_decode(rows: DataFrame, bits: int, dim: int) -> DataFrame:
    """rows with embedding replaced by scale * codebook[codes], in the turned space (see rotated_queries)."""
    book = _array(gaussian_codebook(bits).tolist())
    return rows.withColumn("embedding", F.transform("codes", lambda c: (F.get(book, c) * F.col("scale")).cast("float")))


def pack_bits(codes: Sequence[int], bits: int) -> bytes:
    """Bit planes of a row's codes, least significant bit first: bits * len / 8 bytes."""
    planes = ((np.asarray(codes, dtype=np.uint8)[None, :] >> np.arange(bits, dtype=np.uint8)[:, None]) & 1).astype(np.uint8)
    return np.packbits(planes, axis=1, bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, dim: int) -> list[int]:
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(bits, -1), axis=1, bitorder="little")[:, :dim]
    return (planes.astype(int) << np.arange(bits)[:, None]).sum(axis=0).tolist()


def packed_codes(rows: DataFrame, bits: int, dim: int) -> DataFrame:
    """rows with codes as packed bytes, the form in which encoded rows are stored and moved."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'codes' else f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([pack_bits(c, bits) for c in b.column("codes").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([data if c == "codes" else b.column(c) for c in names], names=names)

    return rows.mapInArrow(run, schema)


def fit_turned_pair(sample: DataFrame, dim: int) -> tuple[list[float], list[float]]:
    """The pair of the rotated encoder: each turned coordinate's mean, and one over its deviation (1 for a constant), so that the codebook fits.

    Tasks give three sums per coordinate; the driver adds these up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, total = rotation(dim), np.zeros((2, dim))
        n = 0
        for b in batches:
            y = turned(b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim), turn)[0]
            n, total = n + len(y), total + np.array([y.sum(axis=0), (y**2).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [total[0].tolist()], "q": [total[1].tolist()]})

    got = sample.select("embedding").mapInArrow(run, "n long, s array<double>, q array<double>").collect()
    n = max(1, sum(r.n for r in got))
    mean = np.sum([r.s for r in got], axis=0) / n
    spread = np.sqrt(np.maximum(np.sum([r.q for r in got], axis=0) / n - mean**2, 0))
    return mean.tolist(), np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 1.0).tolist()


def turned(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, rotated and brought to unit variance; and the rows' lengths."""
    size = np.sqrt((x**2).sum(axis=1))
    return np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0) @ turn.T * np.sqrt(x.shape[1]), size


ENCODINGS = ("rotated", "scalar", "raw")


@dataclass(frozen=True)
class Coding:
    """How an index keeps its rows: packed codes and one scale a row (or raw floats), under a pair that all of its rows share."""

    encoding: str
    bits: int
    dim: int
    shift: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return ("embedding",) if self.encoding == "raw" else ("codes", "scale")

    def _pair(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.array(self.shift), np.array(self.scale)) if self.shift else (np.zeros(self.dim), np.ones(self.dim))

    def codes_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rows of x, and their scales."""
        shift, gain = self._pair()
        if self.encoding == "scalar":
            return np.clip(np.floor((x - shift) * gain + 0.5), 0, 2**self.bits - 1).astype(np.uint8), np.ones(len(x))
        book = gaussian_codebook(self.bits)
        y, size = turned(x, rotation(self.dim))
        codes = np.searchsorted((book[1:] + book[:-1]) / 2, (y - shift) * gain).astype(np.uint8)
        along = ((book[codes] / gain + shift) * y).sum(axis=1) / self.dim
        return codes, np.where(size > 0, size / np.where(along > 0, along, 1) / np.sqrt(self.dim), 0.0)

    def rows_of(self, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The rows that the codes stand for, in the space of queries()."""
        shift, gain = self._pair()
        if self.encoding == "scalar":
            return codes / gain + shift
        return (gaussian_codebook(self.bits)[codes] / gain + shift) * scale[:, None]

    def queries(self, queries: Sequence[tuple[int, Sequence[float]]]) -> list[tuple[int, list[float]]]:
        return rotated_queries(queries, self.dim) if self.encoding == "rotated" else list(queries)

    def encode(self, rows: DataFrame) -> DataFrame:
        """rows with codes and scale in place of embedding; a row without dim finite coordinates has no codes."""
        if self.encoding == "raw":
            return rows
        names = [c for c in rows.columns if c != "embedding"]
        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", codes binary, scale double"

        width = self.bits * self.dim // 8

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                e = b.column("embedding")
                if "ok" in names:  # whether the row has dim finite coordinates, where the plan has told already
                    good = np.flatnonzero(b.column("ok").to_numpy(zero_copy_only=False))
                else:
                    good = np.array([i for i, v in enumerate(e.to_pylist()) if v is not None and len(v) == self.dim and None not in v and np.isfinite(v).all()], dtype=np.int64)
                x = (e if len(good) == len(e) else e.take(pa.array(good))).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), self.dim)
                codes, scale = self.codes_of(x)
                planes = (codes[:, None, :] >> np.arange(self.bits, dtype=np.uint8)[None, :, None]) & 1
                data, scales = np.zeros((len(e), width), dtype=np.uint8), np.zeros(len(e))
                data[good], scales[good] = np.packbits(planes, axis=2, bitorder="little").reshape(len(good), width), scale
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(e), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())
                if len(good) < len(e):
                    bad = np.ones(len(e), dtype=bool)
                    bad[good] = False
                    packed = pa.array(packed.to_pylist(), pa.binary(), mask=bad)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], packed, pa.array(scales)], names=[*names, "codes", "scale"])

        return rows.mapInArrow(run, schema)

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """The rows of a batch as floats or doubles."""
        if self.encoding == "raw":
            e = batch.column("embedding")
            if e.null_count or e.values.null_count or len(e.flatten()) != batch.num_rows * self.dim:
                raise ValueError(f"a row doesn't have {self.dim} coordinates")
            return e.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.dim)
        width = self.bits * self.dim // 8
        fixed = batch.column("codes").cast(pa.binary(width))
        data = np.frombuffer(fixed.buffers()[1], dtype=np.uint8, count=len(fixed) * width, offset=fixed.offset * width) if len(fixed) else np.zeros(0, np.uint8)
        data = data.reshape(batch.num_rows, self.bits, self.dim // 8)
        planes = np.unpackbits(data, axis=2, bitorder="little")
        codes = np.zeros((batch.num_rows, self.dim), dtype=np.uint8)
        for i in range(self.bits):
            codes |= planes[:, i] << i
        return self.rows_of(codes, batch.column("scale").to_numpy(zero_copy_only=False))


def fingerprint(dim: int, bits: int, shift: Sequence[float], scale: Sequence[float]) -> str:
    """SHA-256 over a tag, the shape and the float32 bits of the pair, in lower hex: equal where scores are equal (H5)."""
    h = hashlib.sha256(b"vectide-scoring-1")
    h.update(struct.pack("<IIB", dim, bits, int(bool(len(shift)))))
    for values in (shift, scale):
        h.update(struct.pack("<Q", len(values)) + np.asarray(values, dtype="<f4").tobytes())
    return h.hexdigest()
