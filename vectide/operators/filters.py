"""Row filters. All of them act before a row is scored, so what they exclude costs no arithmetic."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument

Bitmap = tuple[int, int, bytes]


def signed(x: int) -> int:
    """The 64 bits of a label or id, which have no sign, as a column of Spark holds them."""
    if not -(1 << 63) <= x < 1 << 64:
        raise InvalidArgument(f"{x} has more than 64 bits")
    return x - (1 << 64) if x >= 1 << 63 else x


def unsigned(x: int) -> int:
    return x & (1 << 64) - 1


def _one_column(rows: DataFrame, name: str, values: Sequence[int] | DataFrame) -> DataFrame:
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).cast("long").alias(name)).distinct()
    return rows.sparkSession.createDataFrame([(signed(int(v)),) for v in sorted(set(values))], f"{name} long")


def admit_slots(rows: DataFrame, slots: Sequence[int] | DataFrame | None, n: int) -> DataFrame:
    """Rows at these positions (B3). None and no positions mean no filter; a position outside 0..n is refused."""
    if slots is None or not isinstance(slots, DataFrame) and not len(slots):
        return rows
    s = _one_column(rows, "slot", slots)
    if bad := s.where((F.col("slot") < 0) | (F.col("slot") >= n)).head():
        raise InvalidArgument(f"slot {bad.slot} is out of range for {n} rows")
    return rows.join(s, "slot", "left_semi")


def admit_ids(rows: DataFrame, ids: Sequence[int] | DataFrame | None) -> DataFrame:
    """Rows with these ids (B4). None and no ids mean no filter; an id that no row has is refused."""
    if ids is None or not isinstance(ids, DataFrame) and not len(ids):
        return rows
    s = _one_column(rows, "id", ids)
    if bad := s.join(rows, "id", "left_anti").head():
        raise InvalidArgument(f"id {bad.id} is not in the index")
    return rows.join(s, "id", "left_semi")


def admit_labels(rows: DataFrame, labels: Sequence[int] | DataFrame | None) -> DataFrame:
    """Rows with these labels (B5). None means no filter, no labels mean no row; labels that no row has admit nothing."""
    return rows if labels is None else rows.join(_one_column(rows, "label", labels), "label", "left_semi")


def check_bitmaps(bitmaps: Sequence[Bitmap]) -> None:
    """Refuses empty, wrongly sized, overflowing, unordered, overlapping and untidy bitmaps."""
    end = -1
    for base, count, bits in bitmaps:
        if count <= 0:
            raise InvalidArgument("a label bitmap needs a positive label count")
        if len(bits) != -(-count // 8):
            raise InvalidArgument(f"a label bitmap of {count} labels needs {-(-count // 8)} bytes, not {len(bits)}")
        if base < 0 or base + count > 1 << 64:
            raise InvalidArgument("a label bitmap's range overflows")
        if base < end:
            raise InvalidArgument("label bitmaps must ascend and not overlap")
        if count % 8 and bits[-1] >> (count % 8):
            raise InvalidArgument("a label bitmap has bits beyond its labels")
        end = base + count


def bitmap_faults(bitmaps: DataFrame) -> DataFrame:
    """seq, fault (null for none) of ranges (seq, base, cnt, n_bytes, tail), tail being the last byte (B7, in the plan)."""
    before = F.lag(F.col("base") + F.col("cnt")).over(Window.orderBy("seq"))
    spare = F.pmod(F.col("cnt"), F.lit(8)).cast("int")
    return bitmaps.select(
        "seq",
        F.when(F.col("cnt") <= 0, "empty")
        .when(F.col("n_bytes") != F.ceil(F.col("cnt") / 8), "size")
        .when(F.col("base") < before, "order")
        .when((spare > 0) & (F.col("tail") >= F.pow(F.lit(2), spare)), "tail")
        .alias("fault"),
    )


def admit_bitmap(rows: DataFrame, bitmaps: Sequence[Bitmap] | None) -> DataFrame:
    """Rows whose label's bit is set in some range (B6). None means no filter.

    Ranges don't overlap, so each label is looked up among their sorted bounds by halving. The bitmaps are part of a request and go
    to every task.
    """
    if bitmaps is None:
        return rows
    check_bitmaps(bitmaps)
    if not bitmaps:
        return rows.where(F.lit(False))
    data = [(b, c, bytes(x)) for b, c, x in bitmaps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, counts = (np.array([x[i] for x in data], dtype=np.uint64) for i in (0, 1))
        starts = np.cumsum([0, *(len(x[2]) for x in data)])[:-1]
        bits = np.frombuffer(b"".join(x[2] for x in data), dtype=np.uint8)
        for b in batches:
            label = b.column("label").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.searchsorted(bases, label, side="right") - 1
            offset = label - bases[np.maximum(at, 0)]
            ok = (at >= 0) & (offset < counts[np.maximum(at, 0)]) & ~b.column("label").is_null().to_numpy(zero_copy_only=False)
            place = np.where(ok, starts[np.maximum(at, 0)] + (offset >> np.uint64(3)).astype(np.int64), 0)
            ok &= (bits[place] >> (offset & np.uint64(7)).astype(np.uint8)) & 1 == 1
            yield b.filter(pa.array(ok))

    return rows.withColumn("label", F.col("label").cast("long")).mapInArrow(run, rows.withColumn("label", F.col("label").cast("long")).schema)
