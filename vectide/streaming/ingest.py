"""Streams into an index, and running top-k over a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import dot
from ..sources.store import Index


def ingest(stream: DataFrame, index: Index, checkpoint: str, *, name: str = "ingest") -> StreamingQuery:
    """Appends each micro-batch (position, embedding[, id]) exactly once.

    A batch's number is its operation id, and the append and the record of it are one commit. A batch that runs again
    after a restart, because its commit was not yet noted, replays and adds nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        last = index.manifest.operation
        again = last is not None and last.operation_id == f"{name}-{number}"
        index.add(batch, operation_id=f"{name}-{number}", expected_len=last.expected_len if again else len(index))

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_top_k(stream: DataFrame, query: Sequence[float], k: int, *, by: str) -> DataFrame:
    """by, slot, score: the best k rows so far of each key of a stream (by, slot, embedding), whenever they change.

    The state of a key is k scores and slots. Ties are broken by slot. Write it in update mode.
    """
    scored = stream.select(by, "slot", dot(F.array(*[F.lit(float(x)) for x in query]), F.col("embedding")).alias("score"))
    key = stream.schema[by].dataType.simpleString()

    def update(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        slots, scores = state.get if state.exists else ([], [])
        for b in batches:
            slots, scores = list(slots) + b["slot"].tolist(), list(scores) + b["score"].tolist()
        best = sorted(zip(scores, slots, strict=True), key=lambda x: (-x[0], x[1]))[:k]
        state.update(([s for _, s in best], [x for x, _ in best]))
        yield pd.DataFrame({by: [group[0]] * len(best), "slot": [s for _, s in best], "score": [x for x, _ in best]})

    return scored.groupBy(by).applyInPandasWithState(
        update, f"{by} {key}, slot long, score double", "slots array<long>, scores array<double>", "update", "NoTimeout"
    )
