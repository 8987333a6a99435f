"""Label files: little-endian u64 values, and the CRC-32 that a manifest holds of them."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CollectionError, InvalidArgument


def encode_labels(labels: list[int]) -> tuple[bytes, int]:
    if any(not 0 <= x < 1 << 64 for x in labels):
        raise InvalidArgument("a label is a whole number from 0 to 2**64 - 1")
    data = np.array(labels, dtype="<u8").tobytes()
    return data, zlib.crc32(data)


def decode_labels(data: bytes, rows: int, crc: int) -> list[int]:
    """The labels, refused unless there is one for each row and the checksum fits."""
    if len(data) != 8 * rows:
        raise CollectionError("row_count_mismatch", f"{len(data)} bytes of labels for {rows} rows")
    if zlib.crc32(data) != crc:
        raise CollectionError("node_unreachable", "the labels aren't those of their checksum")
    return np.frombuffer(data, dtype="<u8").tolist()


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """slot, label of a file of labels, in the plan; labels of 2**63 and more as decimals keep their value."""
    record = spark.read.format("binaryFile").load(path).select("content")
    hexed = record.select(F.hex("content").alias("h"), (F.octet_length("content") / 8).cast("int").alias("n"))
    slots = hexed.where("n > 0").select("h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
    piece = F.substr(F.col("h"), F.col("slot") * 16 + 1, F.lit(16))
    turned = F.concat(*[F.substring(piece, 15 - 2 * i, 2) for i in range(8)])
    return slots.select(F.col("slot").cast("long").alias("slot"), F.conv(turned, 16, 10).cast("decimal(20,0)").alias("label"))
