from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from helpers import vectors
from pyspark.sql import functions as F

from vectide.config import Limits
from vectide.errors import FailedPrecondition, InvalidArgument, ResourceExhausted
from vectide.operators import codes, filters, measures, search, shards
from vectide.streaming.candidates import Feed, top_k_by_feed, with_deadline


@pytest.fixture(scope="module")
def corpus(spark):
    data = vectors(600, 64, 99)
    rows = spark.createDataFrame([(0, i, i, v) for i, v in enumerate(data)], "shard int, slot long, label long, embedding array<float>")
    return rows.repartition(5).cache(), np.array(data, dtype=np.float32).astype(float)


def brute(x: np.ndarray, q, k: int) -> list[tuple[int, float]]:
    s = np.cumsum(x * np.asarray(q, dtype=float), axis=1)[:, -1]
    order = sorted(range(len(s)), key=lambda i: (-s[i], i))[:k]
    return [(i, s[i]) for i in order]


def got(df) -> dict:
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.label, r.score))
    return out


def test_top_k_equals_brute_force_bit_by_bit(corpus):
    rows, x = corpus
    qs = vectors(4, 64, 4242)
    assert got(search.search(rows, qs, 10)) == {i: brute(x, q, 10) for i, q in enumerate(qs)}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_results_do_not_depend_on_partitions(corpus, parts):
    rows, x = corpus
    qs = vectors(3, 64, 7)
    assert got(search.search(rows.repartition(parts), qs, 17)) == {i: brute(x, q, 17) for i, q in enumerate(qs)}


def test_zero_query_ties(corpus):
    rows, _ = corpus
    zero = [0.0] * 64
    assert [r.label for r in search.search(rows, zero, 12).orderBy("rank").collect()] == list(range(12))
    assert search.search(rows, zero, 12, ties=True).count() == 600
    three = rows.withColumn("shard", (F.col("label") % 3).cast("int")).withColumn("slot", F.floor(F.col("label") / 3))
    assert [r.label for r in search.search(three, zero, 12).orderBy("rank").collect()] == list(range(0, 36, 3))
    assert [r.label for r in search.search(three, zero, 12, by_label=True).orderBy("rank").collect()] == list(range(12))


def test_floor_is_inclusive(corpus):
    rows, x = corpus
    q = vectors(1, 64, 5)[0]
    want = brute(x, q, 10)
    assert got(search.search(rows, q, 100, floor=want[9][1]))[0] == want
    assert search.search(rows, q, 10, floor=float("inf")).count() == 0
    with pytest.raises(InvalidArgument):
        search.search(rows, q, 10, floor=float("nan"))


def test_refusals(corpus):
    rows, _ = corpus
    for q, k in (([1.0] * 63, 1), ([float("nan")] + [0.0] * 63, 1), ([1e39] + [0.0] * 63, 1), ([0.0] * 64, 0), ([0.0] * 64, 1001)):
        with pytest.raises(InvalidArgument):
            search.search(rows, q, k, dim=64)
    with pytest.raises(ResourceExhausted):
        search.search(rows, vectors(65, 64, 1), 1)
    with pytest.raises(InvalidArgument):
        search.search(rows, [], 1)
    with pytest.raises(FailedPrecondition):
        search.require_labels(rows.withColumn("label", F.lit(None).cast("long")))
    assert Limits.from_env({"VECTIDE_MAX_K": "5"}).max_k == 5
    with pytest.raises(InvalidArgument):
        Limits.from_env({"VECTIDE_MAX_K": "0"})


def test_empty_index(spark, corpus):
    rows, _ = corpus
    assert search.search(rows.where("false"), [0.0] * 64, 3).count() == 0


def test_filters(corpus):
    rows, x = corpus
    q = vectors(1, 64, 11)[0]
    want = [r for r in brute(x, q, 600) if r[0] in (5, 137, 599)]
    assert got(search.search(filters.admit_labels(rows, [5, 137, 599, 10**9]), q, 10))[0] == want
    assert filters.admit_labels(rows, []).count() == 0 and filters.admit_labels(rows, None).count() == 600
    assert filters.admit_slots(rows, [], 600).count() == 600
    assert filters.admit_slots(rows, [1, 599], 600).count() == 2
    with pytest.raises(InvalidArgument):
        filters.admit_slots(rows, [600], 600)
    with pytest.raises(InvalidArgument):
        filters.admit_ids(rows.withColumn("id", F.col("label")), [1, 600])

    def bits(base, n):
        b = bytearray(-(-n // 8))
        for v in (5, 137, 599):
            if base <= v < base + n:
                b[(v - base) // 8] |= 1 << (v - base) % 8
        return base, n, bytes(b)

    maps = [bits(0, 129), bits(129, 391), bits(520, 80)]
    assert got(search.search(filters.admit_bitmap(rows, maps), q, 10))[0] == want
    assert filters.admit_bitmap(rows, []).count() == 0
    for bad in ([(0, 0, b"")], [(0, 9, b"\0")], [(0, 4, b"\xf0")], [(8, 8, b"\0"), (0, 8, b"\0")], [(0, 9, b"\0\0"), (8, 8, b"\0")], [(2**64 - 1, 8, b"\0")]):
        with pytest.raises(InvalidArgument):
            filters.check_bitmaps(bad)


def test_split_search_equals_single_search(corpus):
    rows, x = corpus
    q = vectors(2, 64, 21)
    parts = shards.split_rows(rows, shards.split_plan(600, 3, (137, 251, 212)))
    assert [(r.shard, r.rows) for r in shards.shard_sizes(parts).orderBy("shard").collect()] == [(0, 137), (1, 251), (2, 212)]
    assert got(search.search(parts, q, 10)) == {i: brute(x, v, 10) for i, v in enumerate(q)}
    joined = shards.join_shards(parts)
    assert joined.where("slot <> label").count() == 0 and joined.count() == 600


def test_feed_matches_search_and_certifies(corpus):
    rows, x = corpus
    q = vectors(1, 64, 31)[0]
    best, done = top_k_by_feed(rows, q, 10, block_rows=100)
    assert [(r.label, r.score) for r in best] == brute(x, q, 10)
    assert done.completed and done.blocks == 6 and done.floor_raises and done.emitted < 600
    feed = Feed(rows, q, block_rows=100)
    for _ in feed:
        feed.stop()
    assert not feed.certificate.completed and feed.certificate.blocks == 1


def test_deadline(spark):
    assert with_deadline(spark, 60, lambda: spark.range(5).count()) == 5


def test_codes(spark, corpus):
    rows, x = corpus
    assert codes.unpack_bits(codes.pack_bits([1, 15, 7, 0, 3, 2, 9, 8], 4), 4, 8) == [1, 15, 7, 0, 3, 2, 9, 8]
    coded = codes.rotated_encode(rows, 4, 64)
    again = codes.rotated_encode(rows.repartition(3), 4, 64)
    key = lambda d: {r.label: (tuple(r.codes), r.scale) for r in d.collect()}
    assert key(coded) == key(again)
    qs = [(i, v) for i, v in enumerate(x[:20].tolist())]
    found = search.ranked(search.scan(codes.rotated_decode(coded, 4, 64), codes.rotated_queries(qs, 64), 10), 10)
    first = {r.query_id: r.label for r in found.where("rank = 1").collect()}
    assert first == {i: i for i in range(20)}
    truth = search.search(rows, x[:20].tolist(), 10)
    assert measures.recall(found, truth, 10).first().recall > 0.8
    zero = spark.createDataFrame([(0, 0, 0, [0.0] * 64)], rows.schema)
    assert codes.rotated_encode(zero, 4, 64).first().scale == 0.0
    assert codes.packed_codes(coded, 4, 64).where("octet_length(codes) <> 32").count() == 0
    for dim, bits in ((7, 4), (0, 4), (8, 5)):
        with pytest.raises(InvalidArgument):
            codes.check_shape(dim, bits)


def test_open_metrics():
    text = measures.open_metrics({"rows": ("gauge", "Rows.", 3), "searches": ("counter", "Searches.", 2)})
    assert "rows 3" in text and "searches_total 2" in text and text.endswith("# EOF\n")


@pytest.mark.parametrize("k", [10, None])
def test_a_scan_stays_small_with_many_queries(spark, monkeypatch, k):
    """Scores of 4,000 rows and a whole block of queries: matrices of these took some 200 MB in each task."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    rows = spark.createDataFrame([(0, 0, 0, x[0].tolist())], "shard int, slot long, label long, embedding array<float>")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
    run = search.scan(rows, [(i, q.tolist()) for i, q in enumerate(np.r_[x, x[:96]])], k, floor=0.2)
    at, lists = np.arange(4000), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64), pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(4000, np.int32)), pa.array(at), pa.array(at), lists], names=["shard", "slot", "label", "embedding"])
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    score = x.astype(np.float64) @ np.r_[x, x[:96]].T.astype(np.float64)
    assert found == (np.minimum((score >= 0.2).sum(axis=0), k) if k else score >= 0.2).sum()
    assert most < 80e6
