"""The surface for callers: indexes and collections of shards, with plain Python values in and out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Aborted, CollectionError, FailedPrecondition, InvalidArgument
from .operators import codes, filters, shards
from .operators.search import check_k, search, search_in_order
from .sources.store import Index as StoredIndex
from .sources.store import Store
from .sources.topology import AutoscalePolicy


@dataclass(frozen=True)
class Neighbour:
    """id is the row's label, or its slot where it has none."""

    id: int
    score: float


def flattened(vectors: Sequence) -> tuple[list[list[float]], bool]:
    """(list of vectors, whether one flat vector was given); empty and ragged input is refused."""
    if hasattr(vectors, "tolist"):
        vectors = vectors.tolist()
    if not len(vectors):
        raise ValueError("there are no vectors")
    flat = not hasattr(vectors[0], "__len__")
    rows = [list(map(float, v)) for v in ([vectors] if flat else vectors)]
    if len({len(v) for v in rows}) != 1 or not rows[0]:
        raise ValueError("vectors must have one length, and not be empty")
    return rows, flat


def _results(result: DataFrame, n: int) -> list[list[Neighbour]]:
    out: list[list[Neighbour]] = [[] for _ in range(n)]
    for r in search_in_order(result):
        out[r.query_id].append(Neighbour(r.slot if r.label is None else filters.unsigned(r.label), r.score))
    return out


class Index:
    def __init__(self, stored: StoredIndex):
        self._own = stored

    @property
    def id(self) -> str:
        return self._own.manifest.index_id

    def __len__(self) -> int:
        return len(self._own)

    def _expected(self, operation_id: str | None) -> int | None:
        """The length before the operation: for a retry the one that it was committed at."""
        last = self._own.manifest.operation
        if operation_id is None:
            return None
        return last.expected_len if last and last.operation_id == operation_id else len(self._own)

    def add(self, vectors: Sequence, operation_id: str | None = None) -> str | None:
        """Appends; an empty operation_id makes a fresh one, None means a plain append. Returns the operation id."""
        operation_id = uuid.uuid4().hex if operation_id == "" else operation_id
        self._own.add(flattened(vectors)[0], operation_id=operation_id, expected_len=self._expected(operation_id))
        return operation_id

    def add_with_ids(self, vectors: Sequence, ids: Sequence[int], operation_id: str | None = None) -> str | None:
        operation_id = uuid.uuid4().hex if operation_id == "" else operation_id
        self._own.add(flattened(vectors)[0], list(ids), operation_id=operation_id, expected_len=self._expected(operation_id))
        return operation_id

    def search(self, vectors: Sequence, k: int = 10, allowlist: Sequence[int] | None = None) -> list:
        """The neighbours of one vector, or a list of them for a batch. allowlist: ids, or slots of a positional index."""
        rows, flat = flattened(vectors)
        m, data = self._own.manifest, self._own.rows
        check_k(k, self._own.store.limits)
        if m.dim is None:
            raise FailedPrecondition("the index has no dimension yet")
        if m.kind == "id_map":
            data = filters.admit_ids(data.withColumn("id", F.col("label")), allowlist)
        else:
            data = filters.admit_slots(data, allowlist, m.len)
        with self._own.store.metrics.scan(node_searches=1):
            got = _results(search(data.withColumn("shard", F.lit(0)), rows, k, dim=m.dim, limits=self._own.store.limits, coding=m.coding), len(rows))
        return got[0] if flat else got

    def remove(self, id: int) -> bool:
        return self._own.remove(id)

    def flush(self) -> int:
        return self._own.flush()

    def info(self) -> dict:
        return self._own.info()


def create_index(store: Store, dim: int | None = None, bit_width: int = 4, id_mapped: bool = False, encoding: str = "rotated") -> Index:
    return Index(store.create(dim, bit_width, "id_map" if id_mapped else "positional", encoding=encoding))


def open_index(store: Store, index_id: str = "") -> Index:
    """The index of this id; without one the store's only index, else ambiguous_index."""
    return Index(store.get(index_id))


class Collection:
    """Shards of one store, searched as one index. A search answers for all shards or raises.

    A shard is an index id, or a primary's id and those of its replicas: the first that can be read, and is at the generation that ``required``
    names for the primary, answers for it (K12, B12).
    """

    def __init__(self, store: Store, index_ids: Sequence[str | Sequence[str]] | None = None, *, required: dict[str, int] | None = None):
        self.store, self.required = store, required or {}
        self._ids = None if index_ids is None else [(i,) if isinstance(i, str) else tuple(i) for i in index_ids]

    def _served(self, names: Sequence[str]) -> StoredIndex:
        found = [self.store.indexes[n] for n in names if n in self.store.indexes]
        need = self.required.get(names[0])
        for x in found:
            if need is None or x.manifest.generation == need:
                return x
        if found:
            raise Aborted(f"shard_generation_mismatch: no replica of {names[0]} is at generation {need}")
        raise CollectionError("node_unreachable", names[0])

    def _shards(self) -> list[StoredIndex]:
        ids = [(i,) for i in sorted(self.store.indexes)] if self._ids is None else self._ids
        if not ids:
            raise CollectionError("empty_collection", "there is no shard")
        own = [self._served(i) for i in ids]
        for name, of in (
            ("dimension_mismatch", lambda m: m.dim),
            ("bit_width_mismatch", lambda m: (m.bit_width, m.encoding)),
            ("mixed_calibration", lambda m: (m.shift, m.scale)),
        ):
            if any(of(x.manifest) != of(own[0].manifest) for x in own):
                raise CollectionError(name, ", ".join(x.manifest.index_id for x in own))
        return own

    def rows(self) -> DataFrame:
        """shard, slot, label of all shards, and what their encoding keeps."""
        out = None
        for i, x in enumerate(self._shards()):
            label = F.coalesce("label", "slot").alias("label") if x.manifest.labelled else "label"
            part = x.rows.select(F.lit(i).alias("shard"), "slot", label, *x.manifest.coding.columns)
            out = part if out is None else out.unionByName(part)
        return out

    def search(
        self,
        vectors: Sequence,
        k: int = 10,
        *,
        labels: Sequence[int] | None = None,
        bitmaps: Sequence[filters.Bitmap] | None = None,
        floor: float | None = None,
        tie_complete: bool = False,
        stable_label_order: bool = False,
    ) -> list:
        qs, flat = flattened(vectors)
        with self.store.metrics.scan(coordinator_searches=1):
            out = self._found(qs, k, labels, bitmaps, floor, tie_complete, stable_label_order)
        return out[0] if flat else out

    def _found(self, qs, k, labels, bitmaps, floor, tie_complete, stable_label_order) -> list[list[Neighbour]]:
        check_k(k, self.store.limits)
        if labels is not None and bitmaps is not None:
            raise InvalidArgument("labels and bitmaps exclude each other")
        shards_, rows = self._shards(), self.rows()
        if (labels is not None or bitmaps is not None or stable_label_order) and not all(x.manifest.labelled for x in shards_):
            raise FailedPrecondition("label filters and label order need labelled shards")
        rows = filters.admit_bitmap(filters.admit_labels(rows, labels), bitmaps)
        m = shards_[0].manifest
        got = search(rows, qs, k, dim=m.dim, floor=floor, ties=tie_complete, by_label=stable_label_order, limits=self.store.limits, coding=m.coding)
        out = _results(got, len(qs))
        self.store.metrics.add(node_searches=len(shards_))
        return out

    def calibrate(self, sample: Sequence, bits: int = 4) -> tuple[list[float], list[float]]:
        """Fits one pair to the sample and gives it to every shard; all are checked before any is changed."""
        rows, _ = flattened(sample)
        own = self._shards()
        table = self.store.spark.createDataFrame([(v,) for v in rows], "embedding array<float>")
        if own[0].manifest.encoding == "rotated":
            codes.check_shape(len(rows[0]), bits)
            pair = codes.fit_turned_pair(table, len(rows[0]))
        else:
            pair = codes.collect_pair(codes.fit_pair(table, bits))
        for x in own:
            if x.manifest.kind != "positional":
                raise CollectionError("positional_index_required", x.manifest.index_id)
            if x.manifest.len:
                raise CollectionError("index_not_empty", x.manifest.index_id)
            codes.check_pair(*pair, x.manifest.dim)
        for x in own:
            x.set_calibration(*pair)
        return pair

    def split(self, source: str, targets: int, row_counts: Sequence[int] | None = None) -> list[str]:
        """Cuts one shard into labelled ones by ranges of slots. The collection is then these targets alone."""
        src = self.store.get(source)
        plan = shards.split_plan(len(src), targets, row_counts)
        self._ids = [(i,) for i in self._cut(src, plan)]
        return [i for i, in self._ids]

    def _cut(self, src: StoredIndex, plan: Sequence[tuple[int, int, int]]) -> list[str]:
        return self._published([(src.rows.where((F.col("slot") >= a) & (F.col("slot") < b)), a, b - a) for _, a, b in plan], src)

    def grow(self, policy: AutoscalePolicy) -> str | None:
        """Splits the first shard above the policy's ceiling into its parts, in its place, rows included (K13); None if there is none.

        Shards without labels can't be cut while there are others, as their rows would be taken for those of another shard.
        """
        own = self._shards()
        big = next((i for i, x in enumerate(own) if policy.ceiling and len(x) > policy.ceiling), None)
        if big is None:
            return None
        if len(own) > 1 and not own[big].manifest.labelled:
            raise FailedPrecondition("a shard among others needs labels to be split")
        made = self._cut(own[big], shards.split_plan(len(own[big]), policy.parts))
        ids = [(x.manifest.index_id,) for x in own] if self._ids is None else self._ids
        self._ids = [*ids[:big], *((i,) for i in made), *ids[big + 1 :]]
        self.store.metrics.add(topology_generation=1)
        return own[big].manifest.index_id

    def join(self, sources: Sequence[str] = ()) -> str:
        """Concatenates shards (the collection's own by default) in order into one labelled shard."""
        own = [self.store.get(s) for s in sources] or self._shards()
        rows, at = None, 0
        for x in own:
            part = x.rows.select((F.col("slot") + at).alias("slot"), F.coalesce("label", "slot").alias("label"), *x.manifest.coding.columns)
            rows, at = part if rows is None else rows.unionByName(part), at + len(x)
        made = self._published([(rows, 0, at)], own[0])[0]
        self._ids = [(made,)]
        return made

    def _published(self, parts: list[tuple[DataFrame, int, int]], like: StoredIndex) -> list[str]:
        made = []
        for rows, start, n in parts:
            x = self.store.create(like.manifest.dim, like.manifest.bit_width, encoding=like.manifest.encoding)
            own = rows.select((F.col("slot") - start).alias("slot"), F.coalesce("label", "slot").alias("label"), *like.manifest.coding.columns)
            x.replaced(own, replace(x.manifest, len=n, labelled=True, shift=like.manifest.shift, scale=like.manifest.scale))
            made.append(x)
        for x in made:
            x.flush()
        return [x.manifest.index_id for x in made]

    def health(self) -> list[dict]:
        return [x.info() for x in self._shards()]

    def ready(self) -> bool:
        """Whether a search would be answered."""
        try:
            return all(x.manifest.dim is not None for x in self._shards())
        except (CollectionError, Aborted):
            return False


def connect(spark: SparkSession, root: str) -> Collection:
    """The collection of all indexes under a root."""
    return Collection(Store(spark, root))
