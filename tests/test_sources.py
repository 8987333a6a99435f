from __future__ import annotations

import json

import pytest
from helpers import vectors

from vectide.errors import CollectionError, InvalidArgument
from vectide.operators import search
from vectide.plans import report
from vectide.sources import benchmark_set, labels


def test_label_files(spark, tmp_path):
    own = [0, 41, 2**53 + 1, 2**63, 2**64 - 1]
    data, crc = labels.encode_labels(own)
    assert labels.decode_labels(data, 5, crc) == own
    with pytest.raises(CollectionError, match="row_count_mismatch"):
        labels.decode_labels(data, 4, crc)
    with pytest.raises(CollectionError):
        labels.decode_labels(data, 5, crc ^ 1)
    with pytest.raises(InvalidArgument):
        labels.encode_labels([-1])
    (tmp_path / "labels.le64").write_bytes(data)
    got = labels.read_label_file(spark, f"file://{tmp_path}/labels.le64").orderBy("slot").collect()
    assert [int(r.label) for r in got] == own


def test_benchmark_set_and_report(spark, tmp_path):
    data = vectors(80, 8, 2) + [[0.0] * 8]
    spark.createDataFrame(list(enumerate(data)), "slot long, embedding array<float>").write.parquet(f"{tmp_path}/set/train")
    spark.createDataFrame([(i, data[i]) for i in range(5)], "query_id long, q array<float>").write.parquet(f"{tmp_path}/set/test")
    rows = spark.createDataFrame([(0, i, i, v) for i, v in enumerate(data)], "shard int, slot long, label long, embedding array<float>")
    best = search.search(rows, data[:5], 10).groupBy("query_id").agg({"slot": "collect_list"}).toDF("query_id", "neighbors")
    best.write.parquet(f"{tmp_path}/set/neighbors")
    s = benchmark_set.load(spark, f"{tmp_path}/set")
    found = search.search(rows, s.test, 10)
    times = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    one = report.report(found, s.recall_truth(10), times, wall_s=2.0)
    text = report.emit(one, str(tmp_path / "report.json"))
    assert "recall" in text
    assert json.loads((tmp_path / "report.json").read_text()) == {"recall": 1.0, "queries": 100, "mean": 50.5, "p50": 51.0, "p95": 96.0, "p99": 100.0, "qps": 50.0}
    unit = benchmark_set.load(spark, f"{tmp_path}/set", metric="cosine").train.collect()
    assert all(abs(sum(x * x for x in r.embedding) - (r.slot != 80)) < 1e-6 for r in unit)
    for bad in ({"metric": "euclidean"}, {}):
        with pytest.raises(InvalidArgument):
            benchmark_set.load(spark, f"{tmp_path}/set.h5" if not bad else f"{tmp_path}/set", **bad)
