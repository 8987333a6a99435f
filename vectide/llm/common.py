"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Separators of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]: all of them are ASCII, so UTF-8 bytes can be mapped one by one.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def packed(df: DataFrame, keep: Iterable[str] | None = None) -> Column:
    """The kept columns as one struct, so that no result name can clash with theirs."""
    return F.struct(*[col(c).alias(c) for c in (df.columns if keep is None else keep)])


#: Bytes of an Arrow batch, so that long texts make batches of fewer rows and not larger ones.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow() in batches of bounded size. The bound is a setting of the session, read when the plan runs, so it stays; one that is set already is kept."""
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, _BATCH_BYTES)
    return df.mapInArrow(run, schema)


def doubles(spark: SparkSession, values: list[float]) -> Column:
    """A literal array of doubles in Spark's own layout. Plans name it in a few characters; any other literal would write all its values
    into every description of every plan that has it, megabytes each, which the driver keeps."""
    jvm, data = spark._jvm, np.array(values, dtype=">f8").tobytes()
    array = spark.sparkContext._gateway.new_array(jvm.double, len(values))
    jvm.java.nio.ByteBuffer.wrap(data).asDoubleBuffer().get(array)
    kind = spark._jsparkSession.parseDataType(T.ArrayType(T.DoubleType(), False).json())
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(array), kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def map_texts(
    df: DataFrame,
    inputs: dict[str, Column],
    make: Callable[[], Callable[[dict[str, list]], list]],
    result: str,
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """One result struct per row, in Arrow batches. make() is called once in each task."""
    kind = T._parse_datatype_string(result)
    src = df.select(packed(df, keep).alias("row"), *[c.alias(k) for k, c in inputs.items()])
    out = T.StructType([src.schema["row"], T.StructField("res", kind)])
    arrow, names = to_arrow_type(kind), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            got = f({k: b.column(k).to_pylist() for k in names})
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(got, type=arrow)], names=["row", "res"])

    return map_arrow(src, run, out)


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/vectide-shared"
    return f"{root.rstrip('/')}/vectide-{uuid.uuid4().hex}"


#: Folders written while a result is made that is about to be written itself; see until_written().
_MADE: list[list[str]] = []


def stored(df: DataFrame, where: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there, and a lost executor costs no recomputation."""
    where = where or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(where)
    if _MADE:
        _MADE[-1].append(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


@contextmanager
def until_written(spark: SparkSession) -> Iterator[None]:
    """What stored() writes in this block goes at its end, by when the result that reads it must have been written."""
    _MADE.append([])
    try:
        yield
    finally:
        for where in _MADE.pop():
            dropped(spark, where)


def dropped(spark: SparkSession, where: str) -> None:
    """Removes a folder that stored() or an archive writer has made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in one shared folder that goes when the result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._n = spark, shared_dir(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        return stored(df, f"{self.root}/{self._n}")

    def keep_narrow(self, df: DataFrame, share: int = 8) -> DataFrame:
        """For tables of a few numbers per document: an eighth of the shuffle's tasks writes them, in as many fewer files."""
        return self.keep(df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share)))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        dropped(self.spark, self.root)


# Word hashes -------------------------------------------------------------------------------------------------
#: A word's hash is the polynomial of its bytes at _P modulo 2**64, mixed; as _P is odd, prefix sums give every word's at once.
_P = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_MASK = np.frombuffer(_WORD_TABLE, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all of them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(_P), run(pow(_P, -1, 1 << 64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of words(text), the same in every process; in pieces of some 256 KB."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_TABLE)
    out, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= _CHUNK else data.find(b" ", at + _CHUNK)
        end = len(data) if end < 0 else end
        b = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        inside = np.zeros(len(b) + 2, dtype=np.int8)
        inside[1:-1] = b != 32
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(1 << max(19, len(b).bit_length()))
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(b * up[: len(b)], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    s = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        s = s * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(s)
