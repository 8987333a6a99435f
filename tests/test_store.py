from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from helpers import vectors

from vectide.client import Collection, connect, create_index, flattened, open_index
from vectide.errors import Aborted, CollectionError, FailedPrecondition, InvalidArgument, NotFound, ResourceExhausted
from vectide.sources.store import Store
from vectide.sources.topology import AutoscalePolicy, Autoscaler, Shard, Topology, TopologyState, parse_table
from vectide.streaming.ingest import ingest, streaming_top_k


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def again(store: Store) -> Store:
    return Store(store.spark, store.files.root)


def test_flush_restore_and_generations(store):
    data = vectors(50, 8, 3)
    x = store.create(8, index_id="main", encoding="raw")
    assert x.add(data[:30]) == 30 and x.flush() == 1
    assert x.add(data[30:]) == 50 and x.flush() == 2 and x.flush() == 3
    assert [n for n in store.files.names("main") if n.startswith("gen-")] == ["gen-" + "2".rjust(20, "0"), "gen-" + "3".rjust(20, "0")]
    y = again(store).get("main")
    assert y.info() == x.info() and sorted(r.slot for r in y.rows.collect()) == list(range(50))
    rows = {r.slot: list(r.embedding) for r in y.rows.collect()}
    assert rows == {i: v for i, v in enumerate(data)}


def test_unflushed_rows_are_not_restored(store):
    x = store.create(8, index_id="main")
    x.add(vectors(5, 8, 1))
    x.flush()
    x.add(vectors(5, 8, 2))
    assert len(again(store).get()) == 5


def test_corrupt_generation_is_refused(store, tmp_path):
    x = store.create(8, index_id="main")
    x.add(vectors(5, 8, 1))
    x.flush()
    at = tmp_path / "store/main" / ("gen-" + "1".rjust(20, "0"))
    m = json.loads((at / "manifest.json").read_text())
    (at / ".manifest.json.crc").unlink(missing_ok=True)
    for bad in (m | {"bytes": 5}, m | {"parts": ["rows-gone"]}, m | {"index_id": "other"}, {k: v for k, v in m.items() if k != "len"}):
        (at / "manifest.json").write_text(json.dumps(bad))
        with pytest.raises(CollectionError):
            again(store)
    (at / "manifest.json").write_text(json.dumps(m | {"hash": 5}))
    with pytest.raises(CollectionError, match="aren't those"):
        again(store).get().verify()
    (at / "manifest.json").write_text(json.dumps(m))
    again(store).get().verify()


def test_appends_write_only_new_rows(store):
    x = store.create(8, index_id="main")
    names = lambda: {n for n in store.files.names("main") if n.startswith("rows-")}
    seen = []
    for i in range(3):
        x.add(vectors(5, 8, i))
        x.flush()
        seen.append(names())
    assert [len(s) for s in seen] == [1, 2, 3] and seen[0] < seen[1] < seen[2]
    x.label_rows(range(100, 115))
    x.flush()
    x.flush()
    assert len(names()) == 1 and not names() & seen[2]
    y = again(store).get()
    y.verify()
    assert sorted((r.slot, r.label) for r in y.rows.collect()) == [(i, 100 + i) for i in range(15)]


def test_retry_safe_append(store):
    x = store.create(8, index_id="main")
    data = vectors(3, 8, 9)
    first = x.add(data, operation_id="ingest-1", expected_len=0)
    assert (first, first.replayed, first.generation) == (3, False, 1)
    y = again(store).get()
    files = set(store.files.names("main"))
    again_ = y.add(data, operation_id="ingest-1", expected_len=0)
    assert (again_, again_.replayed, again_.generation) == (3, True, 1) and y.rows.count() == 3
    for rows, length in ((data[:2], 0), (data, 3)):
        with pytest.raises(FailedPrecondition):
            y.add(rows, operation_id="ingest-1", expected_len=length)
    for wrong in ({"operation_id": "x"}, {"expected_len": 3}, {"operation_id": "", "expected_len": 3}):
        with pytest.raises(InvalidArgument):
            y.add(data, **wrong)
    assert set(store.files.names("main")) == files and not store.files.names(".staged")
    with pytest.raises(Aborted):
        y.add(data, operation_id="ingest-2", expected_len=0)
    assert y.add(data, operation_id="ingest-2", expected_len=3) == 6
    y.add(data)
    with pytest.raises(FailedPrecondition):
        y.add(data, operation_id="ingest-2", expected_len=3)


def test_appends_are_whole_or_refused(store):
    x = store.create(None, index_id="lazy")
    with pytest.raises(InvalidArgument):
        x.add([[1.0] * 8, [1.0] * 7])
    with pytest.raises(InvalidArgument):
        x.add([[float("nan")] * 8])
    with pytest.raises(InvalidArgument):
        x.add([[1.0] * 7])
    assert len(x) == 0 and x.manifest.dim is None
    x.add([[1.0] * 8])
    with pytest.raises(CollectionError, match="dimension_mismatch"):
        x.add([[1.0] * 16])
    with pytest.raises(ResourceExhausted):
        Store(store.spark, store.files.root, type(store.limits)(max_add_coordinates=8)).create(8).add([[1.0] * 8] * 2)


def test_id_map_lifecycle(store):
    x = create_index(store, 8, id_mapped=True)
    data = vectors(64, 8, 5)
    x.add_with_ids(data, range(64))
    assert [n.id for n in x.search(data[20], 3, allowlist=[20, 30, 40])][0] == 20
    assert x.remove(20) and not x.remove(20) and len(x) == 63
    with pytest.raises(InvalidArgument):
        x.search(data[20], 3, allowlist=[20])
    with pytest.raises(InvalidArgument):
        x.add_with_ids(data[:1], [5])
    assert sorted(r.slot for r in x._own.rows.collect()) == list(range(63))
    with pytest.raises(FailedPrecondition):
        create_index(store, 8)._own.remove(1)


def test_wide_ids_stay_apart(store):
    ids = [42, 2**53, 2**53 + 1, 1861392837450923417, 2**63 - 1, 2**63, 2**64 - 1]
    x = create_index(store, 8, id_mapped=True)
    x.add_with_ids(vectors(7, 8, 6), ids)
    assert sorted(n.id for n in x.search([1.0] * 8, 7)) == sorted(ids)
    assert [n.id for n in x.search([1.0] * 8, 7, allowlist=[2**63])] == [2**63]
    assert x.remove(2**64 - 1) and not x.remove(2**64 - 1)
    with pytest.raises(InvalidArgument):
        x.add_with_ids(vectors(1, 8, 6), [2**64])


def test_labels_have_no_sign(store):
    labels = [5, 2**63, 2**64 - 1, 2**63 - 1]
    x = store.create(8)
    x.add(vectors(4, 8, 6))
    x.label_rows(labels)
    x.flush()
    c = Collection(again(store))
    assert [n.id for n in c.search([0.0] * 8, 4, stable_label_order=True)] == sorted(labels)
    assert [n.id for n in c.search([0.0] * 8, 4, labels=[2**63])] == [2**63]
    got = c.search([0.0] * 8, 4, bitmaps=[(0, 6, b"\x20"), (2**63 - 1, 2, b"\x02"), (2**64 - 8, 8, b"\x80")])
    assert sorted(n.id for n in got) == [5, 2**63, 2**64 - 1]


@pytest.mark.parametrize("encoding", ["rotated", "scalar"])
def test_codes_move_untouched(spark, store, encoding):
    """An index of codes, calibrated, split and joined again: the same scores to the bit, near those of the vectors."""
    import numpy as np

    data = vectors(150, 32, 21)
    x = store.create(32, encoding=encoding)
    if encoding == "scalar":
        with pytest.raises(FailedPrecondition):
            x.add(data)
    c = Collection(store, [x.manifest.index_id])
    pair = c.calibrate(data[:64])
    assert len(pair[0]) == 32
    x.add(data[:70])
    x.flush()
    x.add(data[70:])
    assert x.rows.columns == ["slot", "label", "codes", "scale"] and {len(r.codes) for r in x.rows.collect()} == {4 * 32 // 8}
    whole = c.search(data[:4], 20)
    coded = {r.slot: (bytes(r.codes), r.scale) for r in x.rows.collect()}
    made = c.split(x.manifest.index_id, 3, [50, 60, 40])
    assert c.search(data[:4], 20) == whole and all(store.get(i).calibration() == pair for i in made)
    joined = store.get(c.join())
    assert c.search(data[:4], 20) == whole and {r.slot: (bytes(r.codes), r.scale) for r in joined.rows.collect()} == coded
    assert [n.id for n in Collection(again(store), [joined.manifest.index_id]).search(data[0], 20)] == [n.id for n in whole[0]]
    true = np.array(data) @ np.array(data[0])
    assert all(abs(n.score - true[n.id]) < 0.15 * np.linalg.norm(data[0]) * np.linalg.norm(data[n.id]) for n in whole[0])
    assert set(np.argsort(-true)[:3].tolist()) <= {n.id for n in whole[0]}
    plain = store.create(32, encoding=encoding)
    if encoding == "rotated":
        plain.add(data)
        assert {r.slot: bytes(r.codes) for r in plain.rows.collect()} != {k: v[0] for k, v in coded.items()}


def test_client_surface(store):
    x = create_index(store, 8)
    data = vectors(20, 8, 8)
    assert x.add(data, operation_id="") and x.add(data[:1]) is None
    one, many = x.search(data[3], 5), x.search(data[:2], 5)
    assert len(one) == 5 and [len(m) for m in many] == [5, 5]
    assert open_index(store).id == x.id
    create_index(store, 8)
    with pytest.raises(CollectionError, match="ambiguous_index"):
        open_index(store)
    with pytest.raises(NotFound):
        open_index(store, "nothing")
    assert x.add(data, operation_id="op") == "op" and x.add(data, operation_id="op") == "op" and len(x) == 41
    for bad in ([], [[1.0], [1.0, 2.0]], [[]]):
        with pytest.raises(ValueError):
            flattened(bad)
    assert flattened([1, 2])[1] and not flattened([[1, 2]])[1]
    e = CollectionError.parse("mixed_calibration: two pairs")
    assert (e.name, e.detail, e.is_named) == ("mixed_calibration", "two pairs", True)
    with pytest.raises(FailedPrecondition):
        create_index(store).search([1.0] * 8)


def test_collection_split_join_and_filters(spark, store):
    x = create_index(store, 64)
    data = vectors(120, 64, 99)
    x.add(data)
    whole = x.search(data[:3], 10)
    c = Collection(store)
    made = c.split(x.id, 3, [30, 50, 40])
    assert c.search(data[:3], 10) == whole
    assert [n.id for n in c.search([0.0] * 64, 5, stable_label_order=True)] == [0, 1, 2, 3, 4]
    assert len(c.search([0.0] * 64, 5, tie_complete=True)) == 120
    assert [n.id for n in c.search(data[0], 5, labels=[7])] == [7] and c.search(data[0], 5, labels=[]) == []
    with pytest.raises(CollectionError, match="labelled_index_immutable"):
        store.get(made[0]).add(data[:1])
    with pytest.raises(CollectionError, match="row_count_mismatch"):
        c.split(x.id, 2, [60, 61])
    c.join()
    assert c.search(data[:3], 10) == whole and len(c.health()) == 1 and c.ready()
    lone = Collection(store, [x.id])
    with pytest.raises(FailedPrecondition):
        lone.search(data[0], 5, labels=[1])
    with pytest.raises(CollectionError, match="node_unreachable"):
        Collection(store, ["gone"]).search(data[0], 5)
    assert len(connect(spark, store.files.root).health()) == 4


def test_calibration_rules(store):
    c = Collection(store, [store.create(8, index_id=i).manifest.index_id for i in ("a", "b")])
    pair = c.calibrate(vectors(32, 8, 1))
    assert store.get("a").calibration() == store.get("b").calibration() == pair
    store.get("a").add(vectors(2, 8, 2))
    with pytest.raises(CollectionError, match="index_not_empty"):
        store.get("a").set_calibration(*pair)
    with pytest.raises(CollectionError, match="invalid_calibration"):
        store.get("b").set_calibration(pair[0][:3], pair[1])
    store.get("b").set_calibration([], [])
    with pytest.raises(CollectionError, match="mixed_calibration"):
        c.search([0.0] * 8, 1)
    with pytest.raises(CollectionError, match="positional_index_required"):
        store.create(8, kind="id_map").set_calibration(*pair)


def test_a_replica_stands_in(store):
    x = store.create(8, index_id="a")
    data = vectors(12, 8, 3)
    x.add(data)
    x.flush()
    x.flush()
    for name in ("b", "c"):
        y = store.create(8, index_id=name)
        y.add(data)
        y.flush()
    want = Collection(store, ["a"]).search(data[0], 3)
    gone = store.files.path("a/" + store.get("a").manifest.parts[0])
    store.files.rename(gone.removeprefix(store.files.root + "/"), "a/elsewhere")
    with pytest.raises(CollectionError):
        again(store)
    s = Store(store.spark, store.files.root, strict=False)
    assert set(s.lost) == {"a"} and set(s.indexes) == {"b", "c"}
    assert Collection(s, [("a", "b")]).search(data[0], 3) == want
    with pytest.raises(CollectionError, match="node_unreachable"):
        Collection(s, ["a"]).search(data[0], 3)
    s.get("c").flush()
    assert Collection(s, [("a", "b", "c")], required={"a": 2})._shards() == [s.get("c")]
    stale = Collection(s, [("a", "b", "c")], required={"a": 7})
    with pytest.raises(Aborted, match="shard_generation_mismatch"):
        stale.search(data[0], 3)
    assert not stale.ready() and Collection(s, [("a", "b")]).ready()


def test_growing_moves_the_rows(store):
    x = store.create(8, index_id="a")
    data = vectors(300, 8, 5)
    x.add(data)
    c = Collection(store, ["a"])
    want = c.search(data[:2], 10)
    assert c.grow(AutoscalePolicy()) is None and c.grow(AutoscalePolicy(300)) is None
    assert c.grow(AutoscalePolicy(200)) == "a" and [h["len"] for h in c.health()] == [150, 150]
    assert c.search(data[:2], 10) == want and c.grow(AutoscalePolicy(200)) is None
    assert c.grow(AutoscalePolicy(149, 3)) is not None and [h["len"] for h in c.health()] == [50, 50, 50, 150]
    assert c.search(data[:2], 10) == want
    store.create(8, index_id="z").add(data)
    with pytest.raises(FailedPrecondition):
        Collection(store, ["z", "a"]).grow(AutoscalePolicy(200))


def test_metrics_count_what_is_done(store):
    from vectide.streaming.candidates import Feed

    x = store.create(8, index_id="a")
    data = vectors(40, 8, 5)
    x.add(data)
    c = Collection(store, ["a"])
    c.split("a", 2)
    c.search(data[0], 3)
    open_index(store, "a").search(data[0], 3)
    with pytest.raises(FailedPrecondition):
        Collection(store, ["a"]).search(data[0], 3, labels=[1])
    rows = c.rows()
    feed = Feed(rows, data[0], block_rows=10, coding=store.get("a").manifest.coding, metrics=store.metrics)
    assert len(list(feed)) == 40 and feed.certificate.completed_shards == [0, 1] and feed.certificate.completed
    m = store.metrics
    assert (m.node_searches, m.coordinator_searches, m.search_errors, m.active_scans) == (4, 1, 1, 0)
    assert (m.candidates_emitted, m.blocks_scanned, m.rows_ingested) == (40, 2, 40)
    text = m.render()
    assert "vectide_rows_ingested_total 40\n" in text and "vectide_active_scans 0\n" in text and text.count("# HELP") == 8 and text.endswith("# EOF\n")
    with pytest.raises(FailedPrecondition):
        list(Feed(x.rows.withColumn("shard", F.lit(0)), data[0], coding=x.manifest.coding, metrics=m))
    assert m.search_errors == 2


def test_drop(store):
    store.create(8, index_id="main").flush()
    assert store.drop("main") and not store.drop("main")
    with pytest.raises(InvalidArgument):
        store.drop("..")
    assert again(store).indexes == {} and store.persist_all() == []


def test_node_table():
    t = parse_table("a:1|b:2 main 7, c:3\n# only, words\nhttps://d\n")
    assert t.shards == (Shard("http://a:1", ("http://b:2",), "main", 7), Shard("http://c:3"), Shard("https://d"))
    for bad in ("a b c d", "a b x", "a|"):
        with pytest.raises(InvalidArgument):
            parse_table(bad)


def test_topology(spark, tmp_path):
    root = f"file://{tmp_path}/topology"
    with pytest.raises(CollectionError, match="empty_collection"):
        TopologyState(spark, root)
    s = TopologyState(spark, root, Topology((Shard("http://a", ("http://r",)), Shard("http://b"))))
    assert s.register("a", lambda _: True) and not s.register("s1", lambda _: True) and not s.register("s1", lambda _: True)
    with pytest.raises(CollectionError, match="node_unreachable"):
        s.register("x", lambda _: False)
    s.register("s2", lambda _: True)
    moved = []
    a = Autoscaler(AutoscalePolicy(200), s)
    assert a.tick({"http://a": 100, "http://b": 200}, lambda *x: moved.append(x)) is None
    assert a.tick({"http://a": 100, "http://b": 301}, lambda *x: moved.append(x)) == "http://b"
    assert moved[0][1:] == (["http://s1", "http://s2"], [151, 150])
    assert [x.address for x in s.now.shards] == ["http://a", "http://s1", "http://s2"] and s.now.spares == () and s.now.generation == 2
    assert s.now.shards[0].replicas == ("http://r",)
    assert a.tick({"http://a": 999}, lambda *x: moved.append(x)) is None
    assert Autoscaler(AutoscalePolicy(), s).tick({"http://a": 999}, lambda *x: None) is None
    with pytest.raises(Aborted, match="shard_generation_mismatch"):
        s.rebind((Shard("http://z"),), 1)
    assert TopologyState(spark, root, Topology((Shard("http://other"),))).now == s.now


def test_stream_ingest_is_exactly_once(spark, store, tmp_path):
    data = vectors(40, 8, 4)
    src = str(tmp_path / "in")
    spark.createDataFrame(list(enumerate(data[:20])), "position long, embedding array<float>").write.parquet(src)
    x = store.create(8, index_id="live", encoding="raw")
    stream = spark.readStream.schema("position long, embedding array<float>").parquet(src)
    ingest(stream, x, str(tmp_path / "ck")).awaitTermination()
    assert len(x) == 20
    batch = spark.read.parquet(src)
    assert x.add(batch, operation_id="ingest-0", expected_len=0).replayed  # the batch again, as after a restart
    spark.createDataFrame([(i + 20, v) for i, v in enumerate(data[20:])], "position long, embedding array<float>").write.mode("append").parquet(src)
    ingest(stream, again(store).get("live"), str(tmp_path / "ck")).awaitTermination()
    rows = again(store).get("live").rows.orderBy("slot").collect()
    assert [list(r.embedding) for r in rows] == data


def test_streaming_top_k(spark, tmp_path):
    data = vectors(60, 8, 12)
    src = str(tmp_path / "in")
    schema = "g int, slot long, embedding array<float>"
    for part in range(3):
        rows = [(i % 2, i, data[i]) for i in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    best = streaming_top_k(stream, data[0], 5, by="g")
    q = best.writeStream.outputMode("update").format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    import numpy as np

    s = np.cumsum(np.array(data) * np.array(data[0]), axis=1)[:, -1]
    for g in (0, 1):
        want = sorted((i for i in range(60) if i % 2 == g), key=lambda i: (-s[i], i))[:5]
        seen = {r.slot for r in spark.table("best").where(f"g = {g}").collect()}
        assert set(want) <= seen


def test_restart_after_lost_writer(store):
    x = store.create(8, index_id="main")
    x.add(vectors(4, 8, 1))
    x.flush()
    at = store.files.root.removeprefix("file://") + "/main/.new-dead/rows"
    os.makedirs(at)
    y = again(store).get("main")
    assert len(y) == 4
    y.flush()
    assert not any(n.startswith(".new-") for n in store.files.names("main"))
