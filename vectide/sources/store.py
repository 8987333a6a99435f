"""Durable indexes: versioned Parquet generations behind an atomic pointer, with retry-safe appends.

root/<index id>/gen-<20 digits>/manifest.json lists the row folders of a generation and what they must hold, and CURRENT names the
generation that counts. Appended rows get a folder of their own (root/<index id>/rows-<name>) and earlier ones are never written again; only removing or
labelling rows writes all. A generation is written under a temporary name, renamed, and then pointed at; the one before stays. A
reader follows CURRENT only and refuses whatever disagrees with its manifest: the bytes of the files on opening, the rows in verify().

An append encodes: an index holds packed codes and a scale per row under the pair that it had when it was empty (or raw floats, if
created so), and a search scores what the codes stand for.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Limits
from ..errors import Aborted, CollectionError, FailedPrecondition, InvalidArgument, NotFound, ResourceExhausted
from ..operators.codes import ENCODINGS, Coding, check_pair, check_shape
from ..operators.filters import signed
from ..operators.measures import Metrics
from .files import Files

_KEYS = [T.StructField("slot", T.LongType()), T.StructField("label", T.LongType())]
RAW = T.StructType([*_KEYS, T.StructField("embedding", T.ArrayType(T.FloatType()))])
CODED = T.StructType([*_KEYS, T.StructField("codes", T.BinaryType()), T.StructField("scale", T.DoubleType())])
_NAME = re.compile(r"[A-Za-z0-9._-]+")


@dataclass(frozen=True)
class Operation:
    """The last committed append of an index; only that one replays."""

    operation_id: str
    expected_len: int
    rows: int
    len: int
    generation: int


class Added(int):
    """The length after an append; whether it was a replay, and the generation that holds it (None for one not yet durable)."""

    replayed: bool
    generation: int | None

    def __new__(cls, n: int, replayed: bool = False, generation: int | None = None) -> Added:
        out = super().__new__(cls, n)
        out.replayed, out.generation = replayed, generation
        return out


@dataclass(frozen=True)
class Manifest:
    index_id: str
    kind: str
    dim: int | None
    bit_width: int
    len: int = 0
    generation: int = 0
    labelled: bool = False
    shift: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    operation: Operation | None = None
    encoding: str = "rotated"
    parts: list[str] = field(default_factory=list)
    bytes: int = 0
    hash: int = 0

    @property
    def coding(self) -> Coding:
        return Coding(self.encoding, self.bit_width, self.dim or 8, tuple(self.shift), tuple(self.scale))

    @property
    def schema(self) -> T.StructType:
        return RAW if self.encoding == "raw" else CODED

    @classmethod
    def parse(cls, text: str) -> Manifest:
        """Unknown and missing fields are refused, as a manifest of another version would mean something else."""
        data = json.loads(text)
        if set(data) != set(cls.__dataclass_fields__):
            raise CollectionError("node_unreachable", f"the manifest's fields are {sorted(data)}")
        op = data.pop("operation")
        return cls(**data, operation=Operation(**op) if op else None)


def _hash(rows: DataFrame) -> tuple[int, int]:
    """Number and joined hash of all rows, whatever their order; hashes of parts are joined by XOR."""
    got = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("h")).first()
    return got.n, (got.h or 0) & (1 << 64) - 1


class Store:
    """All indexes under one root. One writer at a time; a lost writer leaves no half of a generation."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits(), *, strict: bool = True):
        """Opens all indexes. One that can't be read raises; with strict False it is kept in ``lost``, for its replicas to stand in."""
        self.spark, self.limits, self.files = spark, limits, Files(spark, root)
        self.files.make()
        self.indexes: dict[str, Index] = {}
        self.lost: dict[str, CollectionError] = {}
        self.metrics = Metrics()
        for name in self.files.names():
            if name.startswith(".tombstone-") or name == ".staged":
                self.files.delete(name)
            elif _NAME.fullmatch(name) and self.files.exists(f"{name}/CURRENT"):
                try:
                    self.indexes[name] = self._restored(name)
                except CollectionError as e:
                    if strict:
                        raise
                    self.lost[name] = e

    def _restored(self, name: str) -> Index:
        generation = self.files.read(f"{name}/CURRENT").strip()
        at = f"{name}/{generation}"
        if not self.files.exists(f"{at}/manifest.json"):
            raise CollectionError("node_unreachable", f"{at} has no manifest")
        m = Manifest.parse(self.files.read(f"{at}/manifest.json"))
        if m.index_id != name or f"gen-{m.generation:020d}" != generation:
            raise CollectionError("node_unreachable", f"{at} is the manifest of {m.index_id} {m.generation}")
        if self.files.size([f"{name}/{p}" for p in m.parts]) != m.bytes:
            raise CollectionError("node_unreachable", f"the files of {at} aren't those of its manifest")
        return Index(self, m, self.table(m))

    def table(self, m: Manifest) -> DataFrame:
        if not m.parts:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*[self.files.path(f"{m.index_id}/{p}") for p in m.parts])

    def create(self, dim: int | None, bit_width: int = 4, kind: str = "positional", index_id: str | None = None, encoding: str = "rotated") -> Index:
        """A new empty index; dim None binds on the first append (K1). encoding: rotated, scalar (needs a calibration pair) or raw."""
        if encoding not in ENCODINGS:
            raise InvalidArgument(f"rows are kept as one of {', '.join(ENCODINGS)}, not {encoding!r}")
        if kind not in ("positional", "id_map"):
            raise InvalidArgument(f"an index is positional or id_map, not {kind!r}")
        check_shape(8 if dim is None else dim, bit_width)
        index_id = index_id or uuid.uuid4().hex
        check_index_id(index_id)
        if index_id in self.indexes:
            raise CollectionError("index_not_empty", f"{index_id} exists")
        m = Manifest(index_id, kind, dim, bit_width, encoding=encoding)
        self.indexes[index_id] = Index(self, m, self.table(m))
        return self.indexes[index_id]

    def get(self, index_id: str = "") -> Index:
        """The index of this id, or the only one for an empty id."""
        if index_id:
            if index_id not in self.indexes:
                raise NotFound(index_id)
            return self.indexes[index_id]
        if len(self.indexes) != 1:
            raise CollectionError("ambiguous_index", f"there are {len(self.indexes)} indexes")
        return next(iter(self.indexes.values()))

    def drop(self, index_id: str) -> bool:
        """Whether there was such an index (A11). Its folder is renamed first, so it never comes back in part."""
        check_index_id(index_id)
        found = self.indexes.pop(index_id, None)
        if self.files.exists(index_id):
            gone = f".tombstone-{index_id}-{uuid.uuid4().hex}"
            self.files.rename(index_id, gone)
            self.files.delete(gone)
        return found is not None

    def persist_all(self) -> list[tuple[str, int]]:
        """Flushes every index, in the order of ids (A10)."""
        return [(i, self.indexes[i].flush()) for i in sorted(self.indexes)]

    def list(self) -> list[dict]:
        return [self.indexes[i].info() for i in sorted(self.indexes)]


def check_index_id(index_id: str) -> None:
    if not _NAME.fullmatch(index_id) or index_id in (".", ".."):
        raise InvalidArgument(f"{index_id!r} is no index id")


class Index:
    """One index: rows (slot, label, and what its encoding keeps); an id-mapped one keeps its ids as labels."""

    def __init__(self, store: Store, manifest: Manifest, rows: DataFrame):
        self.store, self.manifest, self.rows = store, manifest, rows
        self._staged: list[str] = []
        self._new: list[DataFrame] | None = []  # what the next generation adds to the last one; None if all rows are written again

    def info(self) -> dict:
        m = self.manifest
        hidden = ("shift", "scale", "operation", "parts", "bytes", "hash")
        return {k: v for k, v in asdict(m).items() if k not in hidden} | {"calibrated": bool(m.shift)}

    def __len__(self) -> int:
        return self.manifest.len

    def verify(self) -> None:
        """Reads all rows of the last generation and refuses what disagrees with its manifest."""
        m = self.manifest
        saved = self.store.table(m)
        if _hash(saved)[1] != m.hash:
            raise CollectionError("node_unreachable", f"the rows of {m.index_id} aren't those of its manifest")

    def _listed(self, vectors: DataFrame | Sequence, ids: Sequence[int] | None) -> tuple[DataFrame, int | None]:
        """(position, embedding, id) and the number of rows, where it is known without a scan."""
        spark, limits = self.store.spark, self.store.limits
        if isinstance(vectors, DataFrame):
            return (vectors if "id" in vectors.columns else vectors.withColumn("id", F.lit(None).cast("long"))), None
        rows = [[float(x) for x in v] for v in vectors]
        if sum(map(len, rows)) > limits.max_add_coordinates:
            raise ResourceExhausted(f"an append holds at most {limits.max_add_coordinates} coordinates")
        if ids is not None and len(ids) != len(rows):
            raise InvalidArgument("there must be as many ids as vectors")
        if len({len(v) for v in rows}) > 1:
            raise InvalidArgument("vectors of one append have one dimension")
        data = [(i, rows[i], None if ids is None else signed(int(ids[i]))) for i in range(len(rows))]
        return spark.createDataFrame(data, "position long, embedding array<float>, id long"), len(rows)

    def _numbered(self, vectors: DataFrame) -> tuple[DataFrame, int, int]:
        """slot, label and the encoded rows in order, their number and their dimension.

        vectors (position, embedding, id) are sorted by range of position, each task encodes and numbers its own
        rows, and the sizes of the tasks before it, one number each, are added; nothing is collected or sorted in one task.
        """
        spark, m = self.store.spark, self.manifest
        if m.dim is None and (one := vectors.select(F.size("embedding").alias("n")).head()) is not None:
            if one.n <= 0 or one.n % 8:
                raise InvalidArgument("vectors of one append have one dimension, a multiple of 8, and finite coordinates")
            m = replace(m, dim=one.n)
        sorted_ = vectors.repartitionByRange("position").sortWithinPartitions("position")
        part = F.shiftright(F.monotonically_increasing_id(), 33)
        within = F.monotonically_increasing_id() - F.shiftleft(part, 33)
        v = F.col("embedding").cast("array<float>")
        finite = F.coalesce(F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        rows = sorted_.select(part.alias("part"), within.alias("within"), F.col("id").alias("label"), (finite & (F.size(v) == (m.dim or 0))).alias("ok"), v.alias("embedding"))
        kept = self._kept(m.coding.encode(rows))
        sizes = (
            kept.groupBy("part")
            .agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.count_if(F.col("label").isNull()).alias("no_id"))
            .orderBy("part")
            .collect()
        )
        refused = None
        if any(r.bad for r in sizes):
            odd = vectors.where(F.size("embedding") != m.dim).head() if self.manifest.dim is not None else None
            if odd is not None and vectors.where(F.size("embedding") != F.size(F.lit(odd.embedding))).isEmpty() and len(odd.embedding) % 8 == 0:
                refused = CollectionError("dimension_mismatch", f"the index has {m.dim} coordinates, the vectors {len(odd.embedding)}")
            else:
                refused = InvalidArgument("vectors of one append have one dimension, a multiple of 8, and finite coordinates")
        elif m.kind == "id_map" and any(r.no_id for r in sizes):
            refused = InvalidArgument("an id-mapped index needs an id for each vector")
        if refused:
            self.store.files.delete(self._staged.pop())
            raise refused
        base, start = [], m.len
        for r in sizes:
            base.append((r.part, start))
            start += r.n
        offsets = spark.createDataFrame(base, "part long, base long")
        rows = kept.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("within")).alias("slot"), "label", *m.coding.columns)
        return rows, start - m.len, m.dim or 0

    def _kept(self, df: DataFrame) -> DataFrame:
        """df as a table under the store, so numbers given out once stay the same when a task runs again."""
        self._staged.append(f".staged/{uuid.uuid4().hex}")
        at = self.store.files.path(self._staged[-1])
        df.write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    def _replay(self, operation_id: str, expected_len: int, n: int) -> Added | None:
        """The answer to an operation that is committed already; a known id with other metadata is refused (A5)."""
        m, last = self.manifest, self.manifest.operation
        if last and last.operation_id == operation_id:
            if (last.rows, last.expected_len) != (n, expected_len):
                raise FailedPrecondition(f"{operation_id} was committed with {last.rows} rows at length {last.expected_len}")
            if m.len != last.len:
                raise FailedPrecondition(f"the index has changed since {operation_id}")
            return Added(m.len, True, last.generation)
        if expected_len != m.len:
            raise Aborted(f"{operation_id} expected {expected_len} rows; the index has {m.len}")
        return None

    def add(
        self, vectors: DataFrame | Sequence, ids: Sequence[int] | None = None, *, operation_id: str | None = None, expected_len: int | None = None
    ) -> Added:
        """Appends all vectors or none (A4) and returns the new length.

        operation_id and expected_len, the length that the caller saw, belong together (A5): the append is then committed durably, and
        a retry of the last one committed is found before anything is written, changes nothing and says so.
        """
        m = self.manifest
        if (operation_id is None) != (expected_len is None):
            raise InvalidArgument("operation_id and expected_len belong together")
        if operation_id == "":
            raise InvalidArgument("an operation id isn't empty")
        if m.labelled:
            raise CollectionError("labelled_index_immutable", m.index_id)
        if m.kind == "positional" and ids is not None or m.kind == "id_map" and ids is None and not isinstance(vectors, DataFrame):
            raise InvalidArgument("ids belong to id-mapped indexes, and those need them")
        if m.encoding == "scalar" and not m.shift:
            raise FailedPrecondition("scalar codes need a calibration pair")
        listed, n = self._listed(vectors, ids)
        if operation_id is not None:
            done = self._replay(operation_id, expected_len, listed.count() if n is None else n)
            if done is not None:
                return done
        if n == 0:
            return Added(m.len)
        rows, n, dim = self._numbered(listed)
        if not n:
            return Added(m.len)
        if m.kind == "id_map":
            twice = rows.groupBy("label").count().where("count > 1").head() or rows.join(self.rows, "label", "left_semi").head()
            if twice is not None:
                raise InvalidArgument(f"id {twice.label} occurs twice")
        self.rows = self.rows.unionByName(rows)
        if self._new is not None:
            self._new.append(rows)
        self.manifest = replace(m, dim=dim, len=m.len + n)
        self.store.metrics.add(rows_ingested=n)
        if operation_id is not None:
            self.manifest = replace(self.manifest, operation=Operation(operation_id, expected_len, n, m.len + n, m.generation + 1))
            return Added(m.len + n, False, self.flush())
        return Added(m.len + n)

    def remove(self, id: int) -> bool:
        """Whether a row had this id (K2). The slots behind it move up."""
        if self.manifest.kind != "id_map":
            raise FailedPrecondition("a positional index doesn't remove rows")
        id = signed(id)
        gone = self.rows.where(F.col("label") == id).head()
        if gone is None:
            return False
        slot = F.col("slot")
        self._new = None
        self.rows = self.rows.where(F.col("label") != id).withColumn("slot", F.when(slot > gone.slot, slot - 1).otherwise(slot))
        self.manifest = replace(self.manifest, len=self.manifest.len - 1)
        return True

    def set_calibration(self, shift: Sequence[float], scale: Sequence[float]) -> None:
        """The pair of an empty positional index of bound dimension (K3)."""
        m = self.manifest
        if m.kind != "positional":
            raise CollectionError("positional_index_required", m.index_id)
        if m.dim is None:
            raise FailedPrecondition("the index has no dimension yet")
        if m.len:
            raise CollectionError("index_not_empty", f"{m.len} rows are already encoded")
        check_pair(shift, scale, m.dim)
        self.manifest = replace(m, shift=[float(x) for x in shift], scale=[float(x) for x in scale])

    def calibration(self) -> tuple[list[float], list[float]]:
        """The pair; two empty arrays without one (K4). An id-mapped index has none to give."""
        if self.manifest.kind != "positional":
            raise CollectionError("positional_index_required", self.manifest.index_id)
        return self.manifest.shift, self.manifest.scale

    def label_rows(self, labels: Sequence[int]) -> None:
        """Gives every row a stable label; the index takes no more rows afterwards."""
        if len(labels) != self.manifest.len:
            raise CollectionError("row_count_mismatch", f"{len(labels)} labels for {self.manifest.len} rows")
        table = self.store.spark.createDataFrame([(i, signed(int(x))) for i, x in enumerate(labels)], "slot long, label long")
        self._new = None
        self.rows = self.rows.drop("label").join(table, "slot").select("slot", "label", *self.manifest.coding.columns)
        self.manifest = replace(self.manifest, labelled=True)

    def replaced(self, rows: DataFrame, manifest: Manifest) -> None:
        """Other rows, all of which the next generation writes."""
        self.rows, self.manifest, self._new = rows, manifest, None

    def flush(self) -> int:
        """Writes the next generation and returns its number (A8); the one before it stays, older ones go.

        Only rows that the last generation lacks are written, unless rows were removed or labelled.
        """
        m, files = self.manifest, self.store.files
        n = m.generation + 1
        name, temp = f"gen-{n:020d}", f".new-{uuid.uuid4().hex}"
        parts, hash_ = (list(m.parts), m.hash) if self._new is not None else ([], 0)
        new = self.rows if self._new is None else reduce(DataFrame.unionByName, self._new) if self._new else None
        if new is not None:
            part = f"rows-{uuid.uuid4().hex}"
            new.select(*m.schema.names).write.parquet(files.path(f"{m.index_id}/{part}"))
            parts.append(part)
            hash_ ^= _hash(self.store.spark.read.schema(m.schema).parquet(files.path(f"{m.index_id}/{part}")))[1]
        m = replace(m, generation=n, parts=parts, hash=hash_, bytes=files.size([f"{m.index_id}/{p}" for p in parts]))
        files.make(f"{m.index_id}/{temp}")
        Files(self.store.spark, files.path(f"{m.index_id}/{temp}")).replace("manifest.json", json.dumps(asdict(m)))
        if files.exists(f"{m.index_id}/{name}"):
            files.delete(f"{m.index_id}/{name}")
        files.rename(f"{m.index_id}/{temp}", f"{m.index_id}/{name}")
        Files(self.store.spark, files.path(m.index_id)).replace("CURRENT", name)
        self.manifest, self.rows, self._new = m, self.store.table(m), []
        while self._staged:
            files.delete(self._staged.pop())
        needed = set(parts)
        for old in files.names(m.index_id):
            if old.startswith(".new-") or old.startswith("gen-") and old < f"gen-{n - 1:020d}":
                files.delete(f"{m.index_id}/{old}")
            elif old.startswith("gen-") and files.exists(f"{m.index_id}/{old}/manifest.json"):
                needed.update(Manifest.parse(files.read(f"{m.index_id}/{old}/manifest.json")).parts)
        for old in files.names(m.index_id):
            if old.startswith("rows-") and old not in needed:
                files.delete(f"{m.index_id}/{old}")
        return n
