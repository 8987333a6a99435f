"""Benchmark sets: vectors, queries and the true neighbours of each query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions.vectors import unit


@dataclass(frozen=True)
class BenchmarkSet:
    """train: slot, embedding; test: query_id, q; neighbors: query_id, neighbors (slots, best first)."""

    train: DataFrame
    test: DataFrame
    neighbors: DataFrame

    def recall_truth(self, r: int) -> DataFrame:
        """query_id, slot of the first r true neighbours."""
        return self.neighbors.select("query_id", F.explode(F.slice("neighbors", 1, r)).alias("slot"))


def load(spark: SparkSession, path: str, *, metric: str = "ip") -> BenchmarkSet:
    """A set from Parquet folders train, test and neighbors, or from one HDF5 file where h5py is installed.

    metric: ip as it is, cosine with both sides scaled to length 1 (zero vectors stay); others are refused, as
    the engine ranks by inner product.
    """
    if metric not in ("ip", "cosine"):
        raise InvalidArgument(f"the engine ranks by inner product or cosine, not {metric}")
    if path.endswith((".h5", ".hdf5")):
        train, test, neighbors = _hdf5(spark, path)
    else:
        train, test, neighbors = (spark.read.parquet(f"{path}/{n}") for n in ("train", "test", "neighbors"))
    if metric == "cosine":
        train = train.withColumn("embedding", unit(F.col("embedding")).cast("array<float>"))
        test = test.withColumn("q", unit(F.col("q")))
    return BenchmarkSet(train, test, neighbors)


def _hdf5(spark: SparkSession, path: str) -> tuple[DataFrame, ...]:
    try:
        import h5py
    except ImportError as e:
        raise InvalidArgument("HDF5 files need h5py; write the set as Parquet instead") from e
    rows = 100_000

    def part(name: str, column: str, key: str, kind: str) -> DataFrame:
        with h5py.File(path) as f:
            n = f[name].shape[0]

        def read(batches):
            import pyarrow as pa

            for b in batches:
                for a in b.column(0).to_pylist():
                    with h5py.File(path) as f:
                        x = f[name][a : a + rows]
                    yield pa.RecordBatch.from_pydict({key: list(range(a, a + len(x))), column: x.tolist()})

        return spark.range(0, n, rows).mapInArrow(read, f"{key} long, {column} array<{kind}>")

    return part("train", "embedding", "slot", "float"), part("test", "q", "query_id", "float"), part("neighbors", "neighbors", "query_id", "long")
