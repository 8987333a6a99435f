"""Exact top-k by inner product over a batch of queries.

The queries of a request are bounded (``Limits.max_queries``) and sent to every task. A task scans its rows in
Arrow batches: one matrix product gives approximate scores, whose error bound decides which rows can still be among
the best k; only these are scored again, summed from the left in double. So a task keeps k rows per query (all ties,
if asked for), the shuffle moves k rows per task and query, and no result depends on how rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..errors import FailedPrecondition, InvalidArgument, ResourceExhausted
from .codes import Coding

Query = tuple[int, list[float]]

#: Numbers that a task holds at once in a matrix of scores or of products, of which there are up to six: 4 MB each, however many queries a block has.
_CELLS = 1 << 19


def collect_queries(queries: DataFrame | Sequence, limits: Limits = Limits()) -> list[Query]:
    """(query_id, coordinates) of a DataFrame (query_id, q), a list of vectors, or a flat vector; refused above the limit."""
    if isinstance(queries, DataFrame):
        rows = [(r[0], list(r[1]) if r[1] is not None else []) for r in queries.limit(limits.max_queries + 1).collect()]
    else:
        vectors = [queries] if len(queries) and not hasattr(queries[0], "__len__") else queries
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    if len(rows) > limits.max_queries:
        raise ResourceExhausted(f"a request holds at most {limits.max_queries} queries")
    return sorted(rows, key=lambda r: r[0])


def check_queries(queries: Sequence[Query], dim: int) -> None:
    """Each query has dim finite coordinates within float32's range."""
    for qid, q in queries:
        if len(q) != dim:
            raise InvalidArgument(f"query {qid} has {len(q)} coordinates; the index has {dim}")
        if not all(math.isfinite(x) and abs(x) <= 3.4028234663852886e38 for x in q):
            raise InvalidArgument(f"query {qid} has a coordinate that is not finite or out of range")


def check_k(k: int, limits: Limits = Limits()) -> None:
    if not 1 <= k <= limits.max_k:
        raise InvalidArgument(f"k must be between 1 and {limits.max_k}, not {k}")


def check_floor(floor: float | None) -> None:
    if floor is not None and math.isnan(floor):
        raise InvalidArgument("the floor is not a number")


def left_sums(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products summed from the left in double, as dot() does."""
    return np.cumsum(x * q, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def scan(
    rows: DataFrame, queries: Sequence[Query], k: int | None, *, floor: float | None = None, ties: bool = False, by_label: bool = False, coding: Coding | None = None
) -> DataFrame:
    """query_id, score, shard, slot, label: each task's best k rows per query (all at or above the floor if k is None).

    rows: shard, slot, label, embedding (floats, or doubles as decoded codes are), or what coding keeps in place of it. ties keeps
    every row that equals the task's k-th score. Labels are 64 bits without a sign; columns of Spark hold the same bits with one.
    """
    coding = coding or Coding("raw", 4, len(queries[0][1]) if queries else 0)
    queries = coding.queries(queries)
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.array([v for _, v in queries], dtype=np.float64).reshape(len(ids), -1)
    dim = matrix.shape[1]
    schema = "query_id long, score double, shard int, slot long, label long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_queries, lengths = len(ids), np.sqrt((matrix**2).sum(axis=1))
        cuts = np.full(n_queries, -np.inf if floor is None else floor)
        pool: list[np.ndarray] = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.uint64, bool)]
        waiting: list[list[np.ndarray]] = []

        def batch_of(p: list[np.ndarray]) -> pa.RecordBatch:
            label = pa.array(p[4].view(np.int64), pa.int64(), mask=p[5])
            columns = [pa.array(ids[p[0]]), pa.array(p[1]), pa.array(p[2].astype(np.int32)), pa.array(p[3]), label]
            return pa.RecordBatch.from_arrays(columns, names=["query_id", "score", "shard", "slot", "label"])

        def waited() -> list[np.ndarray]:
            """The pool and what waits in one; nothing waits then."""
            out = [np.concatenate(c) for c in zip(pool, *waiting, strict=True)]
            waiting.clear()
            return out

        def merge() -> None:
            """The best k of the pool and what waits, per query; the k-th score becomes the query's cut."""
            nonlocal pool
            q, score, shard, slot, label, bare = waited()
            order = np.lexsort((slot, shard, *([label] if by_label else []), -score, q))
            q, score, shard, slot, label, bare = (c[order] for c in (q, score, shard, slot, label, bare))
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            size = np.diff(np.r_[first, len(q)])
            full = size >= k
            last = first[full] + k - 1
            cuts[q[last]] = np.maximum(cuts[q[last]], score[last])
            keep = np.arange(len(q)) - np.repeat(first, size) < k
            if ties:
                keep |= score >= cuts[q]
            pool = [c[keep] for c in (q, score, shard, slot, label, bare)]

        for b in batches:
            if not b.num_rows:
                continue
            all_x = coding.matrix(b)
            own = [b.column("shard").to_numpy(zero_copy_only=False).astype(np.int64), b.column("slot").to_numpy(zero_copy_only=False)]
            own.append(b.column("label").fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            own.append(b.column("label").is_null().to_numpy(zero_copy_only=False))
            step = max(1, _CELLS // n_queries)
            for start in range(0, b.num_rows, step):
                x = all_x[start : start + step].astype(np.float64)
                rough = x @ matrix.T
                slack = 4 * (dim + 2) * np.finfo(np.float64).eps * lengths * math.sqrt((x**2).sum(axis=1).max())
                low = cuts - slack
                if k is not None and len(x) > k:
                    low = np.maximum(low, np.partition(rough, len(x) - k, axis=0)[len(x) - k] - 2 * slack)
                at, j = np.nonzero(rough >= low)
                part = max(1, _CELLS // dim)
                for a in range(0, len(at), part):
                    r, q = at[a : a + part], j[a : a + part]
                    exact = left_sums(x[r], matrix[q])
                    good = exact >= cuts[q]
                    r, q, exact = r[good], q[good], exact[good]
                    new = [q, exact, *(c[start + r] for c in own)]
                    waiting.append(new)
                    if k is None and sum(len(w[0]) for w in waiting) >= 1 << 16:
                        yield batch_of(waited())
                if k is not None and sum(len(w[0]) for w in waiting) > max(len(pool[0]), 1 << 16):
                    merge()
        if waiting and k is None:
            yield batch_of(waited())
        elif waiting:
            merge()
        if len(pool[0]):
            yield batch_of(pool)

    raw = coding.encoding == "raw"
    kind = rows.schema["embedding"].dataType.simpleString() if raw else ""
    data = [F.col("embedding").cast(kind if kind == "array<double>" else "array<float>").alias("embedding")] if raw else ["codes", "scale"]
    src = rows.select(
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.col("label").cast("long").alias("label"),
        *data,
    )
    return src.mapInArrow(run, schema)


def order_of(by_label: bool) -> list:
    """Best score first; then shard and slot, or label, shard and slot (F2, F3). Labels from 2**63 on are negative columns and come last."""
    return [F.desc("score"), *([F.col("label") < 0, "label"] if by_label else []), "shard", "slot"]


def ranked(candidates: DataFrame, k: int, *, ties: bool = False, by_label: bool = False, lots: int | None = None) -> DataFrame:
    """Global top-k of candidates with rank; ties keeps every row at the k-th score.

    Where many tasks give candidates, these are first ranked in ``lots`` per query, so that no task gets those of all tasks.
    """
    lots = max(1, int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32) if lots is None else lots

    def best(df: DataFrame, *by: str) -> DataFrame:
        per = Window.partitionBy("query_id", *by)
        out = df.withColumn("rank", F.row_number().over(per.orderBy(*order_of(by_label))))
        if ties:
            return out.withColumn("place", F.rank().over(per.orderBy(F.desc("score")))).where(F.col("place") <= k).drop("place")
        return out.where(F.col("rank") <= k)

    if lots > 1:
        candidates = best(candidates.withColumn("lot", F.pmod(F.xxhash64("shard", "slot"), F.lit(lots)).cast("int")), "lot").drop("lot", "rank")
    return best(candidates)


def search(
    rows: DataFrame,
    queries: DataFrame | Sequence,
    k: int,
    *,
    dim: int | None = None,
    floor: float | None = None,
    ties: bool = False,
    by_label: bool = False,
    limits: Limits = Limits(),
    coding: Coding | None = None,
) -> DataFrame:
    """query_id, rank, score, label, shard, slot: the best k rows of each query, at or above the inclusive floor.

    rows (shard, slot, label, embedding) are what the filters have left. An index without rows gives no result
    rows. NaN never occurs among scores, as queries and rows are finite.
    """
    check_k(k, limits)
    check_floor(floor)
    qs = collect_queries(queries, limits)
    if not qs:
        raise InvalidArgument("a request needs a query")
    check_queries(qs, len(qs[0][1]) if dim is None else dim)
    got = ranked(scan(rows, qs, k, floor=floor, ties=ties, by_label=by_label, coding=coding), k, ties=ties, by_label=by_label)
    return got.select("query_id", "rank", "score", "label", "shard", "slot")


def query_blocks(queries: DataFrame | Sequence, size: int = 4096) -> Iterator[list[Query]]:
    """A query set of any size in blocks that a task can hold; the driver holds one block, and one partition of queries, at a time."""
    if not isinstance(queries, DataFrame):
        queries = collect_queries(queries, Limits(max_queries=len(queries) or 1))
        yield from (queries[i : i + size] for i in range(0, len(queries), size))
        return
    block: list[Query] = []
    for r in queries.toLocalIterator():
        block.append((r[0], list(r[1]) if r[1] is not None else []))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def scan_many(rows: DataFrame, queries: DataFrame | Sequence, k: int | None, **how) -> DataFrame:
    """scan() for a query set of any size, block by block."""
    out = None
    for block in query_blocks(queries):
        check_queries(block, len(block[0][1]))
        got = scan(rows, block, k, **how)
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise InvalidArgument("a request needs a query")
    return out


def search_many(
    rows: DataFrame, queries: DataFrame | Sequence, k: int, *, floor: float | None = None, ties: bool = False, by_label: bool = False, coding: Coding | None = None
) -> DataFrame:
    """search() for a query set of any size."""
    check_k(k)
    check_floor(floor)
    got = ranked(scan_many(rows, queries, k, floor=floor, ties=ties, by_label=by_label, coding=coding), k, ties=ties, by_label=by_label)
    return got.select("query_id", "rank", "score", "label", "shard", "slot")


def candidates_many(rows: DataFrame, queries: DataFrame | Sequence, *, floor: float | None = None) -> DataFrame:
    """candidates() for a query set of any size."""
    check_floor(floor)
    return scan_many(rows, queries, None, floor=floor)


def search_in_order(result: DataFrame) -> Iterator:
    """The results one query after the other, best first (A2, F7); the driver holds one partition at a time."""
    return result.orderBy("query_id", "rank").toLocalIterator()


def candidates(rows: DataFrame, queries: DataFrame | Sequence, *, floor: float | None = None, limits: Limits = Limits()) -> DataFrame:
    """query_id, score, shard, slot, label of every row at or above the floor: the candidate feed, without k."""
    check_floor(floor)
    qs = collect_queries(queries, limits)
    return scan(rows, qs, None, floor=floor)


def require_labels(rows: DataFrame) -> None:
    if rows.where(F.col("label").isNull()).head() is not None:
        raise FailedPrecondition("this request needs labelled rows")
