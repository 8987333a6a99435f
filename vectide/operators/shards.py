"""Shards: split, join, export, import, merge and agreement. A shard is a column value; a range of slots is one predicate."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CollectionError, InvalidArgument
from ..functions.vectors import even_counts, rows_per_frame
from .search import ranked, scan_many


def split_plan(total: int, targets: int, counts: Sequence[int] | None = None) -> list[tuple[int, int, int]]:
    """(shard, first slot, end) per target: even, or by explicit counts that sum to the total (K6, E5)."""
    if targets < 1:
        raise InvalidArgument("a split needs a target")
    own = even_counts(total, targets) if not counts else list(counts)
    if len(own) != targets or any(c < 0 for c in own):
        raise InvalidArgument(f"{targets} targets need as many row counts")
    if sum(own) != total:
        raise CollectionError("row_count_mismatch", f"the plan holds {sum(own)} rows, the source {total}")
    ends = list(accumulate(own))
    return [(i, e - c, e) for i, (c, e) in enumerate(zip(own, ends, strict=True))]


def payload(rows: DataFrame) -> list[str]:
    """What a row keeps beside its slot and label: floats, or codes and their scale, which move untouched."""
    return [c for c in ("embedding", "codes", "scale") if c in rows.columns]


def split_rows(rows: DataFrame, plan: Sequence[tuple[int, int, int]]) -> DataFrame:
    """rows (slot, label, embedding) with shard and the slot within it; without a label the old slot becomes it."""
    shard, start = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, first, end in reversed(plan):
        here = (F.col("slot") >= first) & (F.col("slot") < end)
        shard, start = F.when(here, i).otherwise(shard), F.when(here, F.lit(first)).otherwise(start)
    return rows.select(
        shard.cast("int").alias("shard"),
        (F.col("slot") - start).cast("long").alias("slot"),
        F.coalesce("label", "slot").cast("long").alias("label"),
        *payload(rows),
    )


def shard_sizes(rows: DataFrame) -> DataFrame:
    """shard, rows."""
    return rows.groupBy("shard").agg(F.count("*").alias("rows"))


def join_shards(rows: DataFrame, order: Sequence[int] | None = None) -> DataFrame:
    """One shard out of many, in the given order: slots are offset by the sizes of the shards before.

    The driver gets one count per shard; no row is sorted or shuffled. Labels stay, and an unlabelled row takes its old
    slot, so labels may collide; label_uniqueness() tells.
    """
    sizes = {r.shard: r.rows for r in shard_sizes(rows).collect()}
    order = sorted(sizes) if order is None else list(order)
    if not order and not sizes:
        raise CollectionError("empty_collection", "there is no shard to join")
    offset, offsets = 0, []
    for s in order:
        offsets.append((s, offset))
        offset += sizes.get(s, 0)
    base = rows.sparkSession.createDataFrame(offsets, "shard int, base long") if offsets else None
    return rows.join(base, "shard").select(
        F.lit(0).alias("shard"), (F.col("slot") + F.col("base")).alias("slot"), F.coalesce("label", "slot").alias("label"), *payload(rows)
    )


def label_uniqueness(rows: DataFrame) -> DataFrame:
    """label, copies of the labels that more than one row has (G)."""
    return rows.groupBy("label").agg(F.count("*").alias("copies")).where("copies > 1")


def export_rows(rows: DataFrame, start: int, count: int, *, dim: int, bits: int = 4, n: int | None = None, frame_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """frame, slot, label, embedding of count rows from start on, or up to the end for 0 (A6). A range beyond the index is refused."""
    if start < 0 or count < 0:
        raise InvalidArgument("start and count can't be negative")
    if n is not None and start + count > n:
        raise InvalidArgument(f"rows {start} to {start + count} are not all in an index of {n}")
    here = F.col("slot") >= start
    if count:
        here &= F.col("slot") < start + count
    frame = F.floor((F.col("slot") - start) / rows_per_frame(dim, bits, frame_bytes)).cast("long")
    return rows.where(here).select(frame.alias("frame"), "slot", F.coalesce("label", "slot").alias("label"), *payload(rows))


def import_rows(blocks: Sequence[DataFrame], expected_rows: int, *, dim: int, bits: int = 4) -> DataFrame:
    """slot, label and payload of the blocks one after the other (A7): refused unless dimension and row count are as declared."""
    parts, offset = [], 0
    for b in blocks:
        odd = F.octet_length("codes") != bits * dim // 8 if "codes" in b.columns else F.size("embedding") != dim
        got = b.agg(F.count("*").alias("n"), F.coalesce(F.min("slot"), F.lit(0)).alias("first"), F.count_if(odd).alias("odd")).first()
        if got.odd:
            raise CollectionError("dimension_mismatch", f"{got.odd} rows don't have {dim} coordinates")
        parts.append(b.select((F.col("slot") - got.first + offset).alias("slot"), "label", *payload(b)))
        offset += got.n
    if offset != expected_rows:
        raise CollectionError("row_count_mismatch", f"{offset} rows came, {expected_rows} were declared")
    if not parts:
        raise CollectionError("empty_collection", "there is no block to import")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_shards(shards: Sequence[DataFrame], queries, k: int, **how) -> DataFrame:
    """Global top-k over shards scanned apart (F1, G1): each gives its own best k, the union's best k are the answer."""
    if not shards:
        raise CollectionError("empty_collection", "there is no shard to search")
    own = [scan_many(s, queries, k, **how) for s in shards]
    union = own[0]
    for s in own[1:]:
        union = union.unionByName(s)
    return ranked(union, k, ties=how.get("ties", False), by_label=how.get("by_label", False))


def shard_info(rows: DataFrame, by: str = "shard") -> DataFrame:
    """by, len, dim and whether all rows agree on it."""
    dim = F.size("embedding")
    return rows.groupBy(by).agg(F.count("*").alias("len"), F.max(dim).alias("dim"), (F.min(dim) == F.max(dim)).alias("one_dim"))


def bind(info: DataFrame) -> dict:
    """dim, bit_width and rows of shards that agree, else the refusal's name.

    info: pos, dim, bit_width, pair (a digest of the calibration arrays), len; null dim marks a shard that
    couldn't be read.
    """
    first = F.min(F.struct("pos", "dim", "bit_width", "pair"))
    got = info.agg(
        F.count("*").alias("n"),
        F.sum("len").alias("rows"),
        F.count_if(F.col("dim").isNull()).alias("lost"),
        first.alias("first"),
        F.count_distinct("dim").alias("dims"),
        F.count_distinct("bit_width").alias("bits"),
        F.count_distinct(F.coalesce("pair", F.lit(""))).alias("pairs"),
    ).first()
    for bad, name in (
        (not got.n, "empty_collection"),
        (got.lost, "node_unreachable"),
        (got.dims > 1, "dimension_mismatch"),
        (got.bits > 1, "bit_width_mismatch"),
        (got.pairs > 1, "mixed_calibration"),
    ):
        if bad:
            raise CollectionError(name, f"{got.n} shards, {got.dims} dimensions, {got.bits} bit widths, {got.pairs} calibration pairs")
    return {"dim": got.first.dim, "bit_width": got.first.bit_width, "rows": got.rows, "shards": got.n}


def list_nodes(shards: DataFrame, probes: DataFrame) -> DataFrame:
    """Every shard of the table with its probe; a failed probe stays as an error row (K8, C5). Not servable: counts 0 rows."""
    out = shards.join(probes, "address", "left")
    ok = F.col("len").isNotNull() & F.col("error").isNull()
    return out.withColumn("servable", ok).withColumn("rows", F.when(ok, F.col("len")).otherwise(0))


def choose_replica(replicas: DataFrame) -> DataFrame:
    """The first eligible address of each shard: reachable and at the required generation."""
    able = replicas.where(F.col("reachable") & (F.col("generation") == F.col("required")))
    return able.groupBy("shard").agg(F.min_by("address", "priority").alias("address"))


def grow_pick(sizes: DataFrame, ceiling: int) -> DataFrame:
    """The first shard in table order above the ceiling, if any."""
    return sizes.where(F.col("rows") > ceiling).orderBy("pos").limit(1)


def spare_pool(spares: DataFrame, placed: DataFrame) -> DataFrame:
    """Registered spares without duplicates that serve no shard as primary or replica (C6, G3). placed: addresses."""
    used = placed.select(F.explode("addresses").alias("address"))
    return spares.dropDuplicates(["address"]).join(used, "address", "left_anti")


def carry_replicas(new: DataFrame, old: DataFrame) -> DataFrame:
    """New shards with the replicas that their address had before."""
    return new.join(old.select("address", "replicas"), "address", "left")


def sole_index(catalog: DataFrame) -> str:
    """The only index's id, or ambiguous_index."""
    rows = catalog.select("index_id").limit(2).collect()
    if len(rows) != 1:
        raise CollectionError("ambiguous_index", "name one index" if rows else "there is no index")
    return rows[0].index_id
