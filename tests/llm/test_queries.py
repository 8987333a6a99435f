from __future__ import annotations

import pytest
from helpers import rows_by_name, sql_rows

from vectide.llm import queries

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, TINY)
    rows = df.collect()
    if name in queries.ORACLE_SQL:
        assert rows_by_name(df.columns, rows) == sql_rows(queries.ORACLE_SQL[name], TINY)
    else:
        assert rows


def test_pipeline(spark, small):
    """Each stage against what it must do to its own input."""
    import corpus_pipeline as p

    from vectide.llm import decontaminate, near_dedup, quality
    from vectide.llm.common import stored

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, inputs = docs.columns, [docs]
    for _, stage in p.STAGES:
        inputs.append(stored(stage(spark, inputs[-1], small)))
    assert [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    assert all(d.columns == names for d in inputs[:5])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in inputs]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[5] == ids[4]
    verdicts = quality.judge_quality(docs, spark.read.parquet(f"{small}/labels.parquet"), keep=["doc_id"]).collect()
    assert ids[1] == {r.row.doc_id for r in verdicts if r.kept}
    classes = {r.doc_id: r.class_id for r in near_dedup.label_near_duplicates(inputs[2], earlier=p._uncut(inputs[2], docs)).collect()}
    assert ids[3] == set(classes.values())
    alone = {r.class_id for r in near_dedup.label_near_duplicates(inputs[2]).collect()}
    whole = {r.doc_id: r.class_id for r in near_dedup.label_near_duplicates(docs).collect()}
    assert ids[3] <= alone and len({whole[i] for i in ids[3]}) == len(ids[3])  # no two that were near before lines were cut
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids[4] == {r.doc_id for r in decontaminate.contamination_report(inputs[3], bench).collect() if not r.contaminated}
    assert inputs[2].where("n_chars <> length(text)").count() == 0
    assert rows_by_name(["doc_id"], [(r.doc_id,) for r in p.run(spark, small).collect()])[1] == rows_by_name(["doc_id"], [(r.doc_id,) for r in inputs[5].collect()])[1]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, no labels, columns named as results are, and empty tables."""
    import random

    import corpus_pipeline as p
    from llm_texts import lined, prose
    from pyspark.sql import functions as F

    rng = random.Random(12)
    base, other, alone = (prose(rng, 90) for _ in range(3))
    near = [*base[:40], "changed", *base[41:]]
    rows = [(1, lined(base)), (1, lined(base)), (2, lined(base)), (3, lined(near)), (4, None), (5, ""), (6, "  \n\n"), (None, None), (None, lined(other)), (7, lined(other)), (8, lined(alone))]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit("x") for n in ("row", "res", "key", "id", "kept", "score", "t", "now", "a", "b", "s", "root", "number", "before", "spans")})
    at = str(tmp_path)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(alone[10:40])), (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    none, some = (True, 0), lambda *x: [(False, i) for i in x]
    want = {
        "quality rules": [*some(1, 1, 2, 3, 7, 8), none],
        "line dedup": [*some(1, 1, 4, 5, 6, 8), none, none],  # those of which nothing is left go
        "near dedup": [*some(1, 4, 6, 7, 8)],
        "decontamination": [*some(1, 1, 2, 3, 4, 5, 6, 7), none, none],
    }
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, at)
        assert got.columns == docs.columns and stage(spark, docs.where("false"), at).count() == 0
        found = ids(got)
        if name == "line dedup":
            assert set(found) - set(some(3)) == set(want[name]) and found.count(none) == 2
        else:
            assert found == want[name]
    assert p.STAGES[-1][1](spark, docs, at).select("doc_id").distinct().count() == 9
    assert p.run(spark, at).where("doc_id = 1 and start = 0").count() == 1
