"""Content-defined line chunks, of which all but the first of equal ones are removed.

A rolling hash over the hashes of the last ``window`` lines with words puts a boundary at each line where it is 0 modulo ``spread``, so boundaries
are the same lines in every document that holds a passage, wherever it starts. A chunk runs from one boundary line to the next, both
included, so neighbouring chunks share a line and no two neighbouring lines are parted. Chunks are grouped by hash over all documents.

The coarser the chunks, the fewer rows, and the more is missed: a passage is only removed from its first boundary to its last. With
``spread`` 1, which is the default, every line is a boundary. Then chunks are pairs of neighbouring lines (with the blank lines between them), and as any passage
of two or more lines that equals an earlier one consists of pairs that do, exactly the union of all repeated passages goes.

Where a hash stands for one text only (the group's least and greatest bytes are equal) the
first chunk in document order stays and the others are removed; where two texts share a hash, they are grouped by
their bytes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, packed, stored

_M, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15


def boundaries(lines: list[bytes], window: int, spread: int) -> list[int]:
    """The lines with words at which the rolling hash puts a boundary."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    if spread == 1:
        return full
    hashes, out, roll, gone = [xxhash.xxh3_64_intdigest(lines[i]) for i in full], [], 0, pow(_BASE, window, 1 << 64)
    for k, h in enumerate(hashes):
        roll = (roll * _BASE + h) & _M
        if k >= window:
            roll = (roll - hashes[k - window] * gone) & _M
        if (roll >> 32) % spread == 0:
            out.append(full[k])
    return out


def chunk_ranges(lines: list[bytes], window: int, spread: int) -> Iterator[tuple[int, int]]:
    """First and last (exclusive) line of each chunk. A text's first and last line with words are boundaries of its own."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    at = sorted({*full[:1], *boundaries(lines, window, spread), *full[-1:]})
    for a, b in zip(at, at[1:], strict=False):
        yield a, b + 1


def _chunks(docs: DataFrame, window: int, spread: int, with_text: bool) -> DataFrame:
    """key, first, last (lines), h and the text of each chunk. docs: key, text."""
    schema = f"{docs.select('key').schema.simpleString()[7:-1].replace('key:', 'key ', 1)}, first int, last int, h binary"
    schema += ", chunk binary" if with_text else ""
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["first", "last", "h", "chunk"][: 4 if with_text else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, values = [], [[] for _ in names]
            for k, t in enumerate(b.column("text").to_pylist()):
                lines = t.encode("utf-8", "surrogatepass").split(b"\n") if t else []
                if len(lines) < 2:
                    continue
                for start, end in chunk_ranges(lines, window, spread):
                    chunk = b"\n".join(lines[start:end])
                    rows.append(k)
                    for v, x in zip(values, (start, end, xxhash.xxh3_128_digest(chunk), chunk), strict=False):
                        v.append(x)
            arrays = [pa.array(v, t) for v, t in zip(values, types, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), *arrays], names=["key", *names])

    return map_arrow(docs.select("key", "text"), run, schema)


def _key(doc_id: Column, text: Column) -> Column:
    """A row's place in document order; equal rows are one document."""
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("t"))


def repeated_chunks(docs: DataFrame, *, window: int = 2, spread: int = 1) -> DataFrame:
    """key, first, last: the line ranges to remove, which may overlap by a line. docs: key, text.

    These are the chunks that equal an earlier one which they don't overlap.
    """
    chunks = _chunks(docs, window, spread, True)
    place = F.struct("key", "first", "last")
    copy = ~(F.col("key").eqNullSafe(F.col("kept.key")) & (F.col("first") < F.col("kept.last")))
    groups = chunks.groupBy("h").agg(
        F.count("*").alias("n"), F.min(place).alias("kept"), F.min("chunk").alias("least"), F.max("chunk").alias("most")
    )
    groups = stored(groups.where("n > 1").select("h", "kept", (F.col("least") == F.col("most")).alias("same")))
    small = _chunks(docs, window, spread, False)
    gone = small.join(groups.where("same").drop("same"), "h").where(copy).select("key", "first", "last")
    clash = groups.where("not same").select("h")
    if clash.isEmpty():
        return gone
    mixed = chunks.join(clash, "h")
    texts = mixed.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(place).alias("kept")).where("n > 1")
    more = mixed.join(texts, ["h", "chunk"]).where(copy)
    return gone.unionByName(more.select("key", "first", "last"))


def dedupe_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = 2, spread: int = 1, keep: list[str] | None = None) -> DataFrame:
    """(row, text, n_lines, n_removed) per document: the text without its repeated chunks.

    Of equal chunks the one in the least document (by id, then text hash; a null id comes first) and at the least line
    stays. A null text stays null and an empty one empty; a text of one line has no chunks. Rows that repeat an id and
    a text are one document: they get the same result, and none of them is the other's copy. Everything outside
    removed chunks is kept byte by byte; a document whose every line is removed has an empty text. Texts count whole, however long; an
    empty table gives no rows; kept columns may have any names.
    """
    d = docs.select(packed(docs, keep).alias("row"), col(text).cast("string").alias("text"), col(doc_id).alias("id"))
    d = d.withColumn("key", _key(F.col("id"), F.col("text"))).drop("id")
    gone = repeated_chunks(d, window=window, spread=spread).distinct()
    lists = gone.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    lists = lists.select(F.col("key.id").alias("id"), F.col("key.t").alias("t"), F.array_sort("gone").alias("gone"))
    # where ranges overlap, the later one starts at the end of the one before
    last = lambda i: F.coalesce(F.get("gone", i - 1)["last"], F.lit(0))
    lists = lists.withColumn("gone", F.transform("gone", lambda g, i: F.struct(F.greatest(g["first"], last(i)).alias("first"), g["last"].alias("last"))))
    same = F.col("key.id").eqNullSafe(F.col("id")) & (F.col("key.t") == F.col("t"))
    d = d.join(lists, same, "left")
    lines = F.split("text", "\n")
    # kept lines: those between one removed range's end and the next one's start
    starts = F.concat(F.array(F.lit(0)), F.col("gone.last"))
    ends = F.concat(F.col("gone.first"), F.array(F.size("lines")))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))
    d = d.withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    return d.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n")).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda s, g: s + g["last"] - g["first"]), F.lit(0)).cast("long").alias("n_removed"),
    )
