"""The benchmark report: recall, latency and throughput as one row, as JSON and as a table."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.measures import nearest_rank, recall


def report(found: DataFrame, truth: DataFrame, latencies: DataFrame, *, column: str = "ms", r: int = 10, wall_s: float) -> DataFrame:
    """One row: recall, queries, mean, p50, p95, p99 and qps. found and truth: query_id, slot."""
    times = latencies.agg(F.count(column).alias("queries"), F.avg(column).alias("mean"))
    one = recall(found, truth, r).join(F.broadcast(times)).join(F.broadcast(nearest_rank(latencies, column)))
    return one.withColumn("qps", F.col("queries") / F.lit(float(wall_s)))


def emit(one: DataFrame, path: str | None = None) -> str:
    """The report's row as a table; as JSON in a file of the driver, if a path is given."""
    row = one.first().asDict()
    if path:
        Path(path).write_text(json.dumps(row))
    width = max(map(len, row))
    return "\n".join(f"{k:<{width}}  {v:.6g}" if isinstance(v, float) else f"{k:<{width}}  {v}" for k, v in row.items())
