"""The candidate feed with a floor that rises while rows are scanned, and its certificate."""

from __future__ import annotations

import heapq
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..errors import InvalidArgument
from ..operators.codes import Coding
from ..operators.measures import Metrics
from ..operators.search import check_floor, check_queries, require_labels, scan


@dataclass
class Certificate:
    """What a feed has done. completed is true only if every block of every shard was scanned; each shard is completed once."""

    completed: bool = False
    completed_shards: list[int] = field(default_factory=list)
    emitted: int = 0
    blocks: int = 0
    floor_raises: int = 0
    shards: int = 0


class Feed:
    """One query's rows at or above a live floor, block by block of ascending slots; iterate it, then read certificate.

    raise_floor() counts from the next block on: a lower value than the present floor changes nothing (I1, I2). stop() ends the feed
    after the present block, and its certificate says so (I3). A failed task raises; rows are never left out. A shard is listed as
    completed after the block that holds its last slot (I4). Candidates are named by their labels, so all rows need one (I5).
    """

    def __init__(
        self,
        rows: DataFrame,
        query: Sequence[float],
        *,
        floor: float | None = None,
        block_rows: int = 1 << 20,
        coding: Coding | None = None,
        metrics: Metrics | None = None,
    ):
        check_floor(floor)
        check_queries([(0, list(query))], len(query))
        if block_rows < 1:
            raise InvalidArgument("a block holds a row at least")
        self.rows, self.query, self.block_rows = rows, [float(x) for x in query], block_rows
        self.floor = float("-inf") if floor is None else float(floor)
        self.certificate, self._stopped = Certificate(), False
        self.coding, self.metrics = coding, metrics or Metrics()

    def raise_floor(self, floor: float) -> None:
        check_floor(floor)
        if floor > self.floor:
            self.floor = floor
            self.certificate.floor_raises += 1

    def stop(self) -> None:
        self._stopped = True

    def __iter__(self) -> Iterator:
        with self.metrics.scan(node_searches=1):
            yield from self._blocks()

    def _blocks(self) -> Iterator:
        require_labels(self.rows)
        ends = {r.shard: (r.a, r.b) for r in self.rows.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b")).collect()}
        self.certificate.shards = len(ends)
        at, last = min((a for a, _ in ends.values()), default=0), max((b for _, b in ends.values()), default=-1)
        while at <= last:
            if self._stopped:
                return
            block = self.rows.where((F.col("slot") >= at) & (F.col("slot") < at + self.block_rows))
            for r in scan(block, [(0, self.query)], None, floor=self.floor, coding=self.coding).select("score", "shard", "slot", "label").toLocalIterator():
                self.certificate.emitted += 1
                self.metrics.add(candidates_emitted=1)
                yield r
            self.certificate.blocks += 1
            self.metrics.add(blocks_scanned=1)
            at += self.block_rows
            self.certificate.completed_shards += sorted(s for s, (_, b) in ends.items() if at - self.block_rows <= b < at)
        self.certificate.completed = not self._stopped


def top_k_by_feed(rows: DataFrame, query: Sequence[float], k: int, **options) -> tuple[list, Certificate]:
    """The best k rows through a feed whose floor follows the k-th best score so far; the same rows as search()."""
    feed, heap = Feed(rows, query, **options), []
    for r in feed:
        item = (r.score, -r.shard, -r.slot, r)
        if len(heap) < k:
            heapq.heappush(heap, item)
        else:
            heapq.heappushpop(heap, item)
        if len(heap) == k:
            feed.raise_floor(heap[0][0])
    return [x[3] for x in sorted(heap, key=lambda x: x[:3], reverse=True)], feed.certificate


def numbered_batches(candidates: DataFrame, batch_bytes: int = Limits().batch_bytes) -> DataFrame:
    """candidates with batch: records of 12 bytes in score order, as many as fit into a batch; never an empty one."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "shard", "slot")
    return candidates.withColumn("batch", F.floor((F.row_number().over(w) - 1) * 12 / batch_bytes).cast("long"))


def packed_records(candidates: DataFrame) -> DataFrame:
    """query_id, record: label as little-endian u64, score as little-endian f32 (H7)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros(b.num_rows, dtype=[("l", "<u8"), ("s", "<f4")])
            rows["l"], rows["s"] = b.column("label").to_numpy(zero_copy_only=False), b.column("score").to_numpy(zero_copy_only=False)
            records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), b.num_rows, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("query_id"), records], names=["query_id", "record"])

    return candidates.select("query_id", "label", "score").mapInArrow(run, "query_id long, record binary")


def with_deadline(spark: SparkSession, seconds: float, action: Callable):
    """action() under a job group that is cancelled when the time is up (I7); its error is then a TimeoutError."""
    group, late = uuid.uuid4().hex, threading.Event()
    spark.sparkContext.setJobGroup(group, "request", interruptOnCancel=True)

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"not done after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
