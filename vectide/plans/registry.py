"""The registered queries over the engine's operators, and the SQL that says the same.

"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..client import Collection
from ..operators import codes, filters, measures, search, shards
from ..sources import topology
from ..sources.store import Store
from ..streaming import candidates as feed
from . import report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Slots at which the three contiguous shards end, and the labels of the filter tests.
ENDS, LABELS, IDS = (137, 388), (5, 137, 499), (20, 30, 40)


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as one labelled shard, slot and label being vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("shard"), F.col("vec_id").alias("slot"), F.col("vec_id").alias("label"), "embedding")


def sharded(rows: DataFrame) -> DataFrame:
    """Three contiguous shards with slots of their own."""
    at, start = F.col("label"), F.lit(0)
    for e in ENDS:
        start = F.when(at >= e, e).otherwise(start)
    shard = F.when(at < ENDS[0], 0).when(at < ENDS[1], 1).otherwise(2)
    return rows.withColumn("shard", shard).withColumn("slot", (at - start).cast("long"))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: every vector whose id is divisible by 20, each against all rows."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def new_store(spark: SparkSession) -> Store:
    """A store in the folder that the cluster shares; on this machine alone where no folder is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/vectide-shared"
    return Store(spark, f"{root.rstrip('/')}/store-{uuid.uuid4().hex}")


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as an append: position, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), "embedding")


def short(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", F.col("label").alias("vec_id"), "score")


_S = """S AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[])]) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"""
_TOP = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM S"


def _top(where: str = "", k: int = 10) -> str:
    return f"WITH {_S} {_TOP} {where} QUALIFY rank <= {k}"


# Search ------------------------------------------------------------------------------------------------------
@register(_top())
def search_topk_batch(spark, sf_dir):
    return short(search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), 10))


@register(_top("WHERE query_id = 0"))
def search_topk_single(spark, sf_dir):
    return short(search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir).where("query_id = 0"), 10))


@register(_top())
def search_stream_order(spark, sf_dir):
    return short(search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), 10)).orderBy("query_id", "rank")


@register(_top("WHERE vec_id IN (20, 30, 40)"))
def search_k_exceeds_n(spark, sf_dir):
    return short(search.search_many(filters.admit_labels(rows_of(spark, sf_dir), IDS), queries_of(spark, sf_dir), 10))


@register(_top("WHERE vec_id IN (20, 30, 40)"))
def search_id_allowlist(spark, sf_dir):
    rows = rows_of(spark, sf_dir).withColumn("id", F.col("label"))
    return short(search.search_many(filters.admit_ids(rows, IDS), queries_of(spark, sf_dir), 10))


@register(_top("WHERE vec_id IN (20, 30, 40)", 2))
def search_slot_allowlist(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    n = rows.agg(F.max("slot")).first()[0]
    return short(search.search_many(filters.admit_slots(rows, IDS, (n or 0) + 1), queries_of(spark, sf_dir), 2))


@register(_top("WHERE vec_id IN (5, 137, 499)"))
def search_label_filter(spark, sf_dir):
    return short(search.search_many(filters.admit_labels(rows_of(spark, sf_dir), LABELS), queries_of(spark, sf_dir), 10))


@register(_top("WHERE false"))
def search_label_filter_empty(spark, sf_dir):
    return short(search.search_many(filters.admit_labels(rows_of(spark, sf_dir), ()), queries_of(spark, sf_dir), 10))


def _bits(base: int, count: int) -> tuple[int, int, bytes]:
    data = bytearray(-(-count // 8))
    for x in LABELS:
        if base <= x < base + count:
            data[(x - base) // 8] |= 1 << (x - base) % 8
    return base, count, bytes(data)


@register(_top("WHERE vec_id IN (5, 137, 499)"))
def search_label_bitmap(spark, sf_dir):
    rows = filters.admit_bitmap(rows_of(spark, sf_dir), [_bits(0, 129), _bits(129, 371)])
    return short(search.search_many(rows, queries_of(spark, sf_dir), 10))


@register("SELECT * FROM (VALUES (0, NULL), (1, 'order'), (2, 'size'), (3, 'tail'), (4, NULL), (5, 'empty')) t(seq, fault)")
def bitmap_validation(spark, sf_dir):
    data = [(0, 0, 129, 17, 1), (1, 100, 8, 1, 255), (2, 200, 16, 1, 255), (3, 300, 4, 1, 255), (4, 400, 4, 1, 15), (5, 500, 0, 0, 0)]
    return filters.bitmap_faults(spark.createDataFrame(data, "seq int, base long, cnt long, n_bytes int, tail int"))


@register(_top("WHERE score >= 0.2"))
def search_initial_floor(spark, sf_dir):
    return short(search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), 10, floor=0.2))


@register("SELECT 0 AS query_id, vec_id, 0.0::DOUBLE AS score FROM embeddings")
def search_tie_complete(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    zero = [[0.0] * 64]
    return search.search_many(rows, zero, 12, ties=True).select(F.col("query_id").cast("int").alias("query_id"), F.col("label").alias("vec_id"), "score")


def _interleaved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("shard", (F.col("label") % 3).cast("int")).withColumn("slot", F.floor(F.col("label") / 3).cast("long"))


@register("SELECT vec_id AS rank0, vec_id FROM embeddings WHERE vec_id < 12")
def search_stable_label_order(spark, sf_dir):
    got = search.search_many(_interleaved(rows_of(spark, sf_dir)), [[0.0] * 64], 12, by_label=True)
    return got.select((F.col("rank") - 1).cast("long").alias("rank0"), F.col("label").alias("vec_id"))


@register("SELECT vec_id // 3 AS rank0, vec_id FROM embeddings WHERE vec_id % 3 = 0 AND vec_id < 36")
def search_shard_slot_order(spark, sf_dir):
    got = search.search_many(_interleaved(rows_of(spark, sf_dir)), [[0.0] * 64], 12)
    return got.select((F.col("rank") - 1).cast("long").alias("rank0"), F.col("label").alias("vec_id"))


_UNIT = """N AS (SELECT vec_id, [x / n for x in v] AS u FROM
    (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum([x * x for x in embedding::DOUBLE[]])) AS n FROM embeddings)),
    S AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.u, e.u)]) AS score FROM N q, N e WHERE q.vec_id % 20 = 0)"""


@register(f"WITH {_UNIT} {_TOP} QUALIFY rank <= 10")
def cosine_topk(spark, sf_dir):
    rows, qs = rows_of(spark, sf_dir), queries_of(spark, sf_dir)
    rows, qs = rows.withColumn("embedding", V.unit(F.col("embedding"))), qs.withColumn("q", V.unit(F.col("q")))
    return short(search.search_many(rows, qs, 10))


# Candidates --------------------------------------------------------------------------------------------------
@register(f"WITH {_S} SELECT query_id, vec_id, score FROM S WHERE score >= 0.2")
def stream_candidates_floor(spark, sf_dir):
    got = search.candidates_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), floor=0.2)
    return got.select("query_id", F.col("label").alias("vec_id"), "score")


@register(f"WITH {_S} SELECT count(*) AS emitted, 3 AS shards_total, true AS completed FROM S WHERE score >= 0.2")
def candidate_certificate(spark, sf_dir):
    rows = sharded(rows_of(spark, sf_dir))
    return measures.certificate(search.candidates_many(rows, queries_of(spark, sf_dir), floor=0.2), rows, 3)


@register(f"WITH {_S} SELECT query_id, CAST((row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1) * 12 // 240 AS BIGINT) AS batch, vec_id FROM S WHERE score >= 0.2")
def candidate_batches(spark, sf_dir):
    got = search.candidates_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), floor=0.2)
    return feed.numbered_batches(got, 240).select("query_id", "batch", F.col("label").alias("vec_id"))


@register()
def pack_candidates(spark, sf_dir):
    return feed.packed_records(search.candidates_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), floor=0.2))


@register("""SELECT event_id, user_id, max(value) OVER w AS current, coalesce(max(value) OVER w > max(value) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS raised FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def floor_running_max(spark, sf_dir):
    got = measures.running_floor(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return got.select("event_id", "user_id", "current", "raised")


# Shards ------------------------------------------------------------------------------------------------------
@register(_top())
def sharded_topk_merge(spark, sf_dir):
    rows = sharded(rows_of(spark, sf_dir))
    return short(shards.merge_shards([rows.where(F.col("shard") == i) for i in range(3)], queries_of(spark, sf_dir), 10))


_SHARD = "CASE WHEN vec_id < 137 THEN 0 WHEN vec_id < 388 THEN 1 ELSE 2 END"


@register(f"WITH {_S} SELECT query_id, {_SHARD} AS shard, vec_id, score FROM S QUALIFY row_number() OVER (PARTITION BY query_id, {_SHARD} ORDER BY score DESC, vec_id) <= 5")
def shard_local_topk(spark, sf_dir):
    rows = sharded(rows_of(spark, sf_dir))
    got = None
    for i in range(3):
        own = search.scan_many(rows.where(F.col("shard") == i), queries_of(spark, sf_dir), 5)
        got = own if got is None else got.unionByName(own)
    w = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "slot")
    return got.withColumn("r", F.row_number().over(w)).where("r <= 5").select("query_id", "shard", F.col("label").alias("vec_id"), "score")


def _count(spark, sf_dir) -> int:
    return table(spark, sf_dir, "embeddings").count()


_EVEN = "SELECT i AS shard, n // 3 * i + least(i, n % 3) AS first, n // 3 * (i + 1) + least(i + 1, n % 3) AS past FROM (SELECT count(*) AS n FROM embeddings) a, (SELECT unnest(range(3)) AS i) b"


@register(f"SELECT CAST(shard AS INTEGER) AS shard, CAST(first AS BIGINT) AS first, CAST(past AS BIGINT) AS past FROM ({_EVEN})")
def split_plan(spark, sf_dir):
    return spark.createDataFrame(shards.split_plan(_count(spark, sf_dir), 3), "shard int, first long, past long")


@register(f"SELECT CAST(shard AS INTEGER) AS shard, CAST(past - first AS BIGINT) AS rows FROM ({_EVEN})")
def split_even(spark, sf_dir):
    return shards.shard_sizes(shards.split_rows(rows_of(spark, sf_dir), shards.split_plan(_count(spark, sf_dir), 3)))


@register(f"SELECT {_SHARD} AS shard, vec_id - CASE WHEN vec_id < 137 THEN 0 WHEN vec_id < 388 THEN 137 ELSE 388 END AS slot, vec_id AS label FROM embeddings")
def split_explicit(spark, sf_dir):
    n = _count(spark, sf_dir)
    plan = shards.split_plan(n, 3, (137, 251, n - 388))
    return shards.split_rows(rows_of(spark, sf_dir), plan).select("shard", "slot", "label")


@register(f"SELECT CAST(row_number() OVER (ORDER BY {_SHARD} DESC, vec_id) - 1 AS BIGINT) AS slot, vec_id AS label FROM embeddings")
def join_shards_reslot(spark, sf_dir):
    return shards.join_shards(sharded(rows_of(spark, sf_dir)), (2, 1, 0)).select("slot", "label")


@register(f"""WITH L AS (SELECT vec_id - CASE WHEN vec_id < 137 THEN 0 WHEN vec_id < 388 THEN 137 ELSE 388 END AS label FROM embeddings)
    SELECT label, count(*) AS copies FROM L GROUP BY label HAVING count(*) > 1""")
def label_uniqueness(spark, sf_dir):
    rows = sharded(rows_of(spark, sf_dir)).withColumn("label", F.lit(None).cast("long"))
    return shards.label_uniqueness(shards.join_shards(rows))


@register("SELECT vec_id AS slot, vec_id AS label FROM embeddings WHERE vec_id BETWEEN 100 AND 349")
def export_range(spark, sf_dir):
    return shards.export_rows(rows_of(spark, sf_dir), 100, 250, dim=64).select("slot", "label")


@register("SELECT CAST((vec_id - 100) // ((16384 - 8 * 64) // (4 * 64 // 8 + 12)) AS BIGINT) AS frame, count(*) AS rows FROM embeddings WHERE vec_id >= 100 GROUP BY 1")
def export_frames(spark, sf_dir):
    return shards.export_rows(rows_of(spark, sf_dir), 100, 0, dim=64, frame_bytes=16384).groupBy("frame").agg(F.count("*").alias("rows"))


@register("SELECT vec_id AS slot, vec_id AS label FROM embeddings")
def import_blocks(spark, sf_dir):
    rows, n = rows_of(spark, sf_dir), _count(spark, sf_dir)
    blocks = [rows.where((F.col("slot") >= a) & (F.col("slot") < b)) for a, b in ((0, 100), (100, 300), (300, n))]
    return shards.import_rows(blocks, n, dim=64).select("slot", "label")


@register(f"SELECT {_SHARD} AS shard, count(*) AS len, max(len(embedding)) AS dim, min(len(embedding)) = max(len(embedding)) AS one_dim FROM embeddings GROUP BY 1")
def index_info(spark, sf_dir):
    return shards.shard_info(sharded(rows_of(spark, sf_dir)))


def _probes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    table_ = spark.createDataFrame([(0, "http://a"), (1, "http://b"), (2, "http://c")], "pos int, address string")
    info = shards.shard_info(sharded(rows_of(spark, sf_dir)))
    address = F.when(F.col("shard") == 0, "http://a").otherwise("http://b")
    probes = info.where("shard < 2").select(address.alias("address"), "len", "dim", F.lit(None).cast("string").alias("error"))
    lost = spark.createDataFrame([("http://c", None, None, "node_unreachable")], "address string, len long, dim int, error string")
    return table_, probes.union(lost)


@register("""SELECT pos, address, servable, CASE pos WHEN 0 THEN a WHEN 1 THEN b ELSE 0 END AS rows FROM
    (SELECT count_if(vec_id < 137) AS a, count_if(vec_id >= 137 AND vec_id < 388) AS b FROM embeddings),
    (VALUES (0, 'http://a', true), (1, 'http://b', true), (2, 'http://c', false)) t(pos, address, servable)""")
def list_nodes(spark, sf_dir):
    return shards.list_nodes(*_probes(spark, sf_dir)).select("pos", "address", "servable", F.col("rows").cast("long").alias("rows"))


@register("SELECT max(len(embedding)) AS dim, 4 AS bit_width, count(*) AS rows, CAST(3 AS BIGINT) AS shards FROM embeddings")
def bind_agreement(spark, sf_dir):
    store, name = _indexed(spark, sf_dir)
    Collection(store, [name]).split(name, 3)
    store.drop(name)
    made = [x.manifest for x in store.indexes.values()]
    info = [(i, m.dim, m.bit_width, codes.fingerprint(m.dim, m.bit_width, m.shift, m.scale), m.len) for i, m in enumerate(made)]
    got = shards.bind(spark.createDataFrame(info, "pos int, dim int, bit_width int, pair string, len long"))
    return spark.createDataFrame([(got["dim"], got["bit_width"], got["rows"], got["shards"])], "dim int, bit_width int, rows long, shards long")


@register("SELECT coalesce(count(*) = 3 AND bool_and(ok), false) AS ready FROM (VALUES (true), (true), (true)) t(ok)")
def readiness(spark, sf_dir):
    info = shards.shard_info(sharded(rows_of(spark, sf_dir)))
    return info.agg(F.coalesce((F.count("*") == 3) & F.bool_and(F.col("dim").isNotNull()), F.lit(False)).alias("ready"))


# Rows --------------------------------------------------------------------------------------------------------
@register("SELECT vec_id AS slot FROM embeddings UNION ALL SELECT vec_id + (SELECT count(*) FROM embeddings) FROM embeddings WHERE vec_id < 100")
def add_append(spark, sf_dir):
    x, v = new_store(spark).create(64), vectors_of(spark, sf_dir)
    x.add(v)
    x.flush()
    x.add(v.where("position < 100"), operation_id="more", expected_len=len(x))
    return x.rows.select("slot")


@register("SELECT vec_id AS id, vec_id - CAST(vec_id > 20 AS BIGINT) AS slot FROM embeddings WHERE vec_id <> 20")
def remove_by_id(spark, sf_dir):
    x = new_store(spark).create(64, kind="id_map")
    x.add(vectors_of(spark, sf_dir).withColumn("id", F.col("position")))
    x.remove(20)
    return x.rows.select(F.col("label").alias("id"), "slot")


@register("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0")
def query_chunking(spark, sf_dir):
    flat = queries_of(spark, sf_dir).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("query_id", "q"))), lambda x: x["q"])).alias("flat"))
    return flat.select(F.posexplode(V.query_chunks(F.col("flat"), 64)).alias("i", "q")).select(F.col("i").cast("long").alias("query_id"), "q")


@register("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, true)) t(query_id, valid)")
def query_validation(spark, sf_dir):
    nan, inf = float("nan"), float("inf")
    data = [(0, [0.5] * 8), (1, [0.5] * 7), (2, [0.5] * 7 + [nan]), (3, [inf] + [0.5] * 7), (4, [0.5] * 16)]
    return spark.createDataFrame(data, "query_id int, q array<double>").select("query_id", V.valid_query(F.col("q"), 8).alias("valid"))


# Codes -------------------------------------------------------------------------------------------------------
@register("SELECT i * n // 100 AS slot FROM (SELECT count(*) AS n FROM embeddings), (SELECT unnest(range(100)) AS i)")
def calibration_sample(spark, sf_dir):
    return codes.stride_sample(rows_of(spark, sf_dir), 100).select("slot")


_FIT = """P AS (SELECT i AS pos, min(x) AS shift, CASE WHEN max(x) = min(x) THEN 1.0::DOUBLE ELSE 15.0::DOUBLE / (max(x) - min(x)) END AS scale
    FROM (SELECT unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY i)"""


@register(f"WITH {_FIT} SELECT CAST(pos AS INTEGER) AS pos, shift, scale FROM P")
def calibration_fit(spark, sf_dir):
    return codes.fit_pair(rows_of(spark, sf_dir), 4)


_CODES = f"""{_FIT}, A AS (SELECT list(shift ORDER BY pos) AS a, list(scale ORDER BY pos) AS s FROM P), C AS (SELECT vec_id, a, s,
    [CAST(least(greatest(floor((z[1] - z[2]) * z[3] + 0.5), 0), 15) AS INTEGER) for z in list_zip(embedding::DOUBLE[], a, s)] AS codes FROM embeddings, A)"""


def _encoded(spark, sf_dir) -> tuple[DataFrame, tuple]:
    rows = rows_of(spark, sf_dir)
    pair = codes.collect_pair(codes.fit_pair(rows, 4))
    return codes.scalar_encode(rows, pair, 4), pair


@register(f"WITH {_CODES} SELECT vec_id, codes FROM C")
def scalar_encode(spark, sf_dir):
    return _encoded(spark, sf_dir)[0].select(F.col("label").alias("vec_id"), "codes")


_SCALAR = f"""{_CODES}, D AS (SELECT vec_id, [z[1] / z[2] + z[3] for z in list_zip(codes::DOUBLE[], s, a)] AS d FROM C),
    S AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.embedding::DOUBLE[], e.d)]) AS score FROM embeddings q, D e WHERE q.vec_id % 20 = 0)"""


def _scalar_topk(spark, sf_dir) -> DataFrame:
    rows, pair = _encoded(spark, sf_dir)
    rows = codes.scalar_decode(rows, pair).withColumn("embedding", F.col("decoded"))
    return search.search_many(rows, queries_of(spark, sf_dir), 10)


@register(f"WITH {_SCALAR} {_TOP} QUALIFY rank <= 10")
def scalar_search_topk(spark, sf_dir):
    return short(_scalar_topk(spark, sf_dir))


def _indexed(spark, sf_dir) -> tuple[Store, str]:
    """The vectors in an index of scalar codes under the pair fitted to them."""
    store = new_store(spark)
    x = store.create(64, encoding="scalar")
    x.set_calibration(*codes.collect_pair(codes.fit_pair(rows_of(spark, sf_dir), 4)))
    x.add(vectors_of(spark, sf_dir), operation_id="all", expected_len=0)
    return store, x.manifest.index_id


@register(f"WITH {_SCALAR} {_TOP} QUALIFY rank <= 10")
def indexed_scalar_topk(spark, sf_dir):
    store, name = _indexed(spark, sf_dir)
    x = Store(spark, store.files.root).get(name)
    rows = x.rows.select(F.lit(0).alias("shard"), "slot", F.col("slot").alias("label"), "codes", "scale")
    return short(search.search_many(rows, queries_of(spark, sf_dir), 10, coding=x.manifest.coding))


@register(f"WITH {_SCALAR} {_TOP} QUALIFY rank <= 10")
def calibrated_split_topk(spark, sf_dir):
    store, name = _indexed(spark, sf_dir)
    whole = Collection(store, [name])
    whole.split(name, 3, (137, 251, len(store.get(name)) - 388))
    coding = store.get(whole.health()[0]["index_id"]).manifest.coding
    return short(search.search_many(whole.rows(), queries_of(spark, sf_dir), 10, coding=coding))


@register(f"""WITH {_SCALAR}, X AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[])]) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    T AS (SELECT query_id, vec_id FROM X QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
    G AS (SELECT query_id, vec_id FROM S QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10)
    SELECT count(G.vec_id) / (10.0::DOUBLE * count(DISTINCT T.query_id)) AS recall FROM T LEFT JOIN G USING (query_id, vec_id)""")
def recall_at_k(spark, sf_dir):
    truth = search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), 10)
    return measures.recall(_scalar_topk(spark, sf_dir), truth.select("query_id", "slot"), 10)


@register(f"WITH {_S}, T AS ({_TOP} QUALIFY rank <= 10) SELECT query_id FROM T GROUP BY query_id HAVING max(vec_id) < 480")
def ground_truth_subset(spark, sf_dir):
    truth = search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), 10).groupBy("query_id").agg(F.collect_list("slot").alias("neighbors"))
    return measures.ground_truth_subset(truth, 480).select("query_id")


@register()
def rotated_topk(spark, sf_dir):
    coded = codes.rotated_encode(rows_of(spark, sf_dir), 4, 64)
    turn = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in codes.rotation(64)])
    turned = queries_of(spark, sf_dir).select("query_id", F.transform(turn, lambda row: V.dot(row, F.col("q"))).alias("q"))
    return short(search.search_many(codes.rotated_decode(coded, 4, 64), turned, 10))


@register()
def fingerprint(spark, sf_dir):
    pair = codes.collect_pair(codes.fit_pair(rows_of(spark, sf_dir), 4))
    return spark.createDataFrame([(codes.fingerprint(64, 4, *pair), codes.fingerprint(64, 4, (), ()))], "calibrated string, plain string")


@register()
def label_crc32(spark, sf_dir):
    return rows_of(spark, sf_dir).select("label", F.crc32(V.le_bytes(F.col("label"), 8)).alias("crc32"))


# Figures and control -----------------------------------------------------------------------------------------
_PCT = ", ".join(f"max(CASE WHEN r = least(n * {p} // 100, n - 1) THEN value END) AS p{p}" for p in (50, 95, 99))


@register(f"SELECT {_PCT} FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)")
def latency_percentiles(spark, sf_dir):
    return measures.nearest_rank(table(spark, sf_dir, "events"), "value")


@register("SELECT CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS DOUBLE) / count(value) AS mean, count(*) / 2.5::DOUBLE AS qps FROM events")
def latency_mean_qps(spark, sf_dir):
    return measures.mean_qps(table(spark, sf_dir, "events"), "value", 2.5)


@register("SELECT * FROM (VALUES ('http://s2'), ('http://s3')) t(address)")
def spare_pool(spark, sf_dir):
    spares = spark.createDataFrame([(f"http://s{i}",) for i in (0, 1, 2, 2, 3)], "address string")
    placed = spark.createDataFrame([(["http://s0", "http://s9"],), (["http://a", "http://s1"],)], "addresses array<string>")
    return shards.spare_pool(spares, placed)


@register("SELECT * FROM (VALUES (0, 'http://b'), (1, 'http://c')) t(shard, address)")
def replica_choice(spark, sf_dir):
    data = [(0, 0, "http://a", True, 3), (0, 1, "http://b", True, 4), (0, 2, "http://x", True, 4), (1, 0, "http://c", True, 4), (2, 0, "http://d", False, 4)]
    return shards.choose_replica(spark.createDataFrame(data, "shard int, priority int, address string, reachable boolean, generation long").withColumn("required", F.lit(4)))


@register("SELECT * FROM (VALUES ('http://a', 'http://r1'), ('http://n', NULL)) t(address, replicas)")
def replica_carry_over(spark, sf_dir):
    new = spark.createDataFrame([("http://a",), ("http://n",)], "address string")
    return shards.carry_replicas(new, spark.createDataFrame([("http://a", "http://r1"), ("http://b", "http://r2")], "address string, replicas string"))


@register(f"SELECT shard AS pos, rows FROM (SELECT {_SHARD} AS shard, count(*) AS rows FROM embeddings GROUP BY 1) WHERE rows > 200 ORDER BY pos LIMIT 1")
def autoscale_pick(spark, sf_dir):
    return shards.grow_pick(shards.shard_sizes(sharded(rows_of(spark, sf_dir))).withColumnRenamed("shard", "pos"), 200)


@register("SELECT 'main' AS index_id")
def sole_index(spark, sf_dir):
    one = shards.sole_index(spark.createDataFrame([("main",)], "index_id string"))
    return spark.createDataFrame([(one,)], "index_id string")


@register("""SELECT * FROM (VALUES (0, 'http://a:1', '', '', NULL), (1, 'http://b:1', 'https://c:2|http://d:3', 'main', 7), (2, 'http://e', '', 'x', NULL))
    t(pos, address, replicas, index_id, generation)""")
def node_table_parse(spark, sf_dir):
    text = "a:1 # first, with a comma\nb:1|https://c:2|d:3  main 7, e x\n# nothing\n"
    got = topology.parse_tables(spark.createDataFrame([(text,)], "text string"))
    return got.withColumn("pos", F.row_number().over(Window.orderBy("pos")) - 1)


@register("SELECT n, 'gen-' || lpad(CAST(n AS VARCHAR), 20, '0') AS name FROM (SELECT unnest([0, 7, 1234567890123]) AS n)")
def generation_name(spark, sf_dir):
    return spark.createDataFrame([(0,), (7,), (1234567890123,)], "n long").select("n", V.generation_name(F.col("n")).alias("name"))


@register("SELECT * FROM (VALUES ('a:1', 'http://a:1'), ('https://b', 'https://b')) t(address, url)")
def address_scheme(spark, sf_dir):
    return spark.createDataFrame([("a:1",), ("https://b",)], "address string").select("address", V.with_scheme(F.col("address")).alias("url"))


@register("SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]+') AND name NOT IN ('.', '..') AS valid FROM (SELECT unnest(['a', 'A-1_b.c', '.', '..', 'a/b', '', 'é']) AS name)")
def shard_id_valid(spark, sf_dir):
    names = [(x,) for x in ("a", "A-1_b.c", ".", "..", "a/b", "", "é")]
    return spark.createDataFrame(names, "name string").select("name", V.valid_shard_id(F.col("name")).alias("valid"))


@register(f"""SELECT 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM embeddings
    UNION ALL SELECT 'shards', CAST(count(DISTINCT {_SHARD}) AS BIGINT) FROM embeddings
    UNION ALL SELECT 'largest_shard', CAST(max(n) AS BIGINT) FROM (SELECT count(*) AS n FROM embeddings GROUP BY {_SHARD})
    UNION ALL SELECT 'queries', CAST(count(*) AS BIGINT) FROM embeddings WHERE vec_id % 20 = 0""")
def metrics_snapshot(spark, sf_dir):
    return measures.snapshot(sharded(rows_of(spark, sf_dir)), queries_of(spark, sf_dir))


@register(f"""WITH {_SCALAR}, X AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[])]) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
    T AS (SELECT query_id, vec_id FROM X QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
    G AS (SELECT query_id, vec_id FROM S QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10),
    R AS (SELECT count(G.vec_id) / (10.0::DOUBLE * count(DISTINCT T.query_id)) AS recall FROM T LEFT JOIN G USING (query_id, vec_id)),
    W AS (SELECT {_PCT} FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL))
    SELECT recall, (SELECT count(value) FROM events) AS queries, p50, p95, p99, (SELECT count(value) / 2.5::DOUBLE FROM events) AS qps FROM R, W""")
def benchmark_report(spark, sf_dir):
    truth = search.search_many(rows_of(spark, sf_dir), queries_of(spark, sf_dir), 10)
    found, times = _scalar_topk(spark, sf_dir), table(spark, sf_dir, "events")
    one = report.report(found, truth.select("query_id", "slot"), times, column="value", r=10, wall_s=2.5)
    return one.select("recall", "queries", "p50", "p95", "p99", "qps")
