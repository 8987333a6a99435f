"""Recall, latency and state figures."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """One row, recall: the mean over the truth's queries of hits among r true neighbours (D5, C7). Both: query_id, slot.

    Hits are summed as whole numbers and divided once, so the order of the queries doesn't show in the last digit.
    """
    hits = truth.join(found.select("query_id", "slot", F.lit(1).alias("hit")), ["query_id", "slot"], "left")
    per = hits.groupBy("query_id").agg(F.count("hit").alias("hits"))
    return per.agg((F.sum("hits") / (F.lit(float(r)) * F.count("*"))).alias("recall"))


def ground_truth_subset(queries: DataFrame, cut: int) -> DataFrame:
    """Queries (query_id, neighbors) of which every true neighbour lies below the cut."""
    return queries.where(~F.exists("neighbors", lambda x: x >= cut))


def nearest_rank(values: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """One row, p50 and so on: the value at rank min(n * p div 100, n - 1) of the ascending order.

    Distinct values are dealt by range, whatever their scale; a task's values are numbered on from the counts of those before it, so no task
    holds all of them.
    """
    x = values.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    counts = x.groupBy("v").agg(F.count("*").alias("c")).repartitionByRange("v").withColumn("part", F.spark_partition_id())
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    sums = counts.groupBy("part").agg(F.sum("c").alias("c"), F.min("v").alias("first"))
    before = F.sum("c").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", F.coalesce(before, F.lit(0)).alias("below"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    placed = counts.withColumn("upto", upto).join(F.broadcast(sums), "part").withColumn("upto", F.col("upto") + F.col("below"))
    placed = placed.join(F.broadcast(total))
    rank = lambda p: F.least(F.expr(f"n * {p} div 100"), F.col("n") - 1)
    return placed.agg(*[F.min(F.when(F.col("upto") > rank(p), F.col("v"))).alias(f"p{p}") for p in percents])


def mean_qps(values: DataFrame, column: str, wall_s: float) -> DataFrame:
    """One row, mean and qps (D7). Values count in whole thousandths, so the order of rows doesn't show in the last digit."""
    thousandths = F.sum(F.round(F.col(column) * 1000).cast("long"))
    return values.agg((thousandths / F.count(column)).alias("mean"), (F.count("*") / F.lit(float(wall_s))).alias("qps"))


def snapshot(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """metric, value: rows, shards, the largest shard and the queries."""
    sizes = rows.groupBy("shard").agg(F.count("*").alias("rows"))
    got = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("shards"), F.max("rows").alias("largest_shard"))
    got = got.selectExpr("stack(3, 'rows', rows, 'shards', shards, 'largest_shard', largest_shard) AS (metric, value)")
    return got.union(queries.agg(F.lit("queries"), F.count("*")))


def running_floor(updates: DataFrame, query: str, seq: str, floor: str) -> DataFrame:
    """query, seq, floor, current, raised: a query's newest floor never falls, and only a strict rise counts."""
    w = Window.partitionBy(query).orderBy(seq)
    current = F.max(floor).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = updates.select(query, seq, floor, current.alias("current"))
    before = F.lag("current").over(w)
    return out.withColumn("raised", F.coalesce(F.col("current") > before, F.lit(True)))


def certificate(candidates: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """One row: emitted, shards_total (those that have rows), completed (all of the expected shards have); a scan that fails raises."""
    emitted = candidates.agg(F.count("*").alias("emitted"))
    seen = rows.agg(F.count_distinct("shard").cast("int").alias("shards_total"))
    return emitted.join(F.broadcast(seen)).withColumn("completed", F.col("shards_total") == F.lit(shards))


def open_metrics(values: dict[str, tuple[str, str, int]]) -> str:
    """OpenMetrics text of name -> (counter or gauge, help, value)."""
    out = []
    for name, (kind, text, value) in values.items():
        out += [f"# TYPE {name} {kind}", f"# HELP {name} {text}", f"{name}{'_total' if kind == 'counter' else ''} {value}"]
    return "\n".join([*out, "# EOF", ""])


#: What each figure of Metrics says.
_HELP = {
    "node_searches": "Scans of one shard that ended well.",
    "coordinator_searches": "Searches of a collection that ended well.",
    "search_errors": "Searches and feeds that raised.",
    "active_scans": "Scans that run now.",
    "candidates_emitted": "Candidates that feeds have given.",
    "blocks_scanned": "Blocks that feeds have scanned.",
    "rows_ingested": "Rows appended.",
    "topology_generation": "Generation of the topology in force.",
}
_GAUGES = ("active_scans", "topology_generation")


@dataclass
class Metrics:
    """The eight figures that a store keeps of what is done with it in this process."""

    node_searches: int = 0
    coordinator_searches: int = 0
    search_errors: int = 0
    active_scans: int = 0
    candidates_emitted: int = 0
    blocks_scanned: int = 0
    rows_ingested: int = 0
    topology_generation: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False, compare=False)

    def add(self, **more: int) -> None:
        with self._lock:
            for name, n in more.items():
                setattr(self, name, getattr(self, name) + n)

    @contextmanager
    def scan(self, **when_done: int) -> Iterator[None]:
        """Counts a scan as running, then what it was; one that raises is an error instead."""
        self.add(active_scans=1)
        try:
            yield
        except Exception:
            self.add(search_errors=1)
            raise
        else:
            self.add(**when_done)
        finally:
            self.add(active_scans=-1)

    def render(self, prefix: str = "vectide_") -> str:
        names = [f.name for f in fields(self) if f.name in _HELP]
        return open_metrics({prefix + n: ("gauge" if n in _GAUGES else "counter", _HELP[n], getattr(self, n)) for n in names})
