"""Hierarchical multi-length packing.

Each task tokenizes its own documents and packs them in blocks, so nothing is shuffled and no key can make one
task large. In a block, documents are routed to context tiers (256, 512, 1024 and 2048 tokens) by length; a longer one
gives whole windows of 2048 first and its rest is routed. From the longest tier down, each window takes one document of
its tier, and its gap is filled with the longest documents of the shorter tiers that fit, then by cutting one
document. Windows are so filled to the last token; what is left at a block's end starts the next block, and only a
task's last few tokens are padded. Windows are dealt to step groups in a snake order of their attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import col, map_arrow
from .tokens import encoder

END = 1

_FIELDS = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "context int, step_group bigint"
)


class _Packer:
    """Packs (document, start, length) pieces into windows. A window is a list of pieces that sum to its context."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}

    def add(self, doc: int, n: int) -> Iterator[tuple[int, list]]:
        top, start = self.tiers[-1], 0
        while n - start >= top:
            yield top, [(doc, start, top)]
            start += top
        if n > start:
            self._route(doc, start, n - start)

    def _route(self, doc: int, start: int, n: int) -> None:
        tier = next(t for t in self.tiers if t >= n)
        self.pools[tier].append((n, doc, start))

    def _take(self, gap: int, tiers: list[int]) -> tuple[int, int, int] | None:
        """The longest piece of these tiers that fits into the gap."""
        for t in reversed(tiers):
            pool = self.pools[t]
            if pool and pool[0][0] <= gap:
                return pool.pop(bisect_right(pool, (gap, float("inf"), 0)) - 1)
        return None

    def _cut(self, gap: int, tiers: list[int]) -> tuple[int, int, int] | None:
        """The first gap tokens of the shortest longer piece; its rest goes back to its tier."""
        for t in tiers:
            pool = self.pools[t]
            at = bisect_right(pool, (gap, float("inf"), 0))
            if at < len(pool):
                n, doc, start = pool.pop(at)
                rest = (n - gap, doc, start + gap)
                other = self.pools[next(x for x in self.tiers if x >= rest[0])]
                other.insert(bisect_right(other, rest), rest)
                return gap, doc, start
        return None

    def pack(self, last: bool) -> Iterator[tuple[int, list]]:
        for pool in self.pools.values():
            pool.sort()
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], list(self.tiers[: k + 1])
            while self.pools[tier]:
                if sum(len(self.pools[t]) for t in below) < 64 and not last and sum(x[0] for t in below for x in self.pools[t]) < 2 * tier:
                    break
                window, gap = [], tier
                while gap and (piece := self._take(gap, below) or self._cut(gap, list(self.tiers))):
                    window.append((piece[1], piece[2], piece[0]))
                    gap -= piece[0]
                if not gap:
                    yield tier, window
                    continue
                for n, doc, start in ((x[2], x[0], x[1]) for x in window):
                    pool = self.pools[next(t for t in self.tiers if t >= n)]
                    pool.insert(bisect_right(pool, (n, doc, start)), (n, doc, start))
                break
        if last:
            yield from self._finish()

    def _finish(self) -> Iterator[tuple[int, list]]:
        """The tokens left are too few for their windows: powers of two down to 64 without a gap, then one padded window."""
        left = [(doc, start, n) for t in reversed(self.tiers) for n, doc, start in self.pools[t]]
        self.pools = {t: [] for t in self.tiers}
        size = self.tiers[-1]
        while left:
            total = sum(x[2] for x in left)
            while size > total:
                size //= 2
            size = size if size >= 64 else 0
            want, window = size or total, []
            while want:
                doc, start, n = left.pop(0)
                if n > want:
                    left.insert(0, (doc, start + want, n - want))
                    n = want
                window.append((doc, start, n))
                want -= n
            yield size or self.tiers[-1], window


def pack_documents(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    context: int = 2048,
    smallest: int = 256,
    block_tokens: int = 2_000_000,
    group_windows: int = 64,
    vocab: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group (and ids).

    A document's tokens are the vocabulary's ids and then id 1; a null or empty text is just that id. Each
    token lies in exactly one piece. A row is a document of its own, also if its id is null or repeated.
    sequence_id holds the task's number in its upper bits, so it is unique, and a task that runs again
    makes the same ids. No row is made for an empty table. Memory: one block of tokens and one Arrow batch, and a very long text's own
    tokens. Other columns play no part, whatever their names.
    """
    if context & (context - 1) or smallest & (smallest - 1) or not 64 <= smallest <= context:
        raise ValueError("context and smallest must be powers of two, 64 <= smallest <= context")
    tiers = tuple(smallest << i for i in range((context // smallest).bit_length()))
    src = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("t"))
    schema = T.StructType([src.schema["doc_id"], *T._parse_datatype_string(_FIELDS + (", ids array<int>" if with_ids else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable = encoder(vocab)
        arrow, task = to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        packer, ids, keys, held = _Packer(tiers), {}, {}, 0
        number, sequences, groups = 0, 0, 0

        def emit(windows: list[tuple[int, list]]) -> pa.RecordBatch:
            nonlocal sequences, groups
            n_groups = max(1, round(len(windows) / group_windows))
            cost = lambda w: (-sum(p[2] ** 2 for p in w[1]), -w[0])
            group = {}
            for rank, k in enumerate(sorted(range(len(windows)), key=lambda k: (cost(windows[k]), k))):
                turn, at = divmod(rank, n_groups)
                group[k] = at if turn % 2 == 0 else n_groups - 1 - at
            rows = {f.name: [] for f in schema.fields}
            for k, (size, window) in enumerate(windows):
                offset = 0
                for doc, start, n in window:
                    part = ids[doc][start : start + n]
                    values = (keys[doc], start, n, zlib.crc32(part.tobytes()), len(ids[doc]), task | sequences, offset, size, task | (groups + group[k]))
                    for name, v in zip(rows, values, strict=False):
                        rows[name].append(v)
                    if with_ids:
                        rows["ids"].append(part)
                    offset += n
                sequences += 1
            groups += n_groups
            return pa.RecordBatch.from_pydict(rows, schema=arrow)

        def block(windows: list[tuple[int, list]], last: bool) -> Iterator[pa.RecordBatch]:
            windows += packer.pack(last)
            if windows:
                yield emit(windows)
            live = {x[1] for pool in packer.pools.values() for x in pool}
            for k in [k for k in ids if k not in live]:
                del ids[k], keys[k]

        windows: list[tuple[int, list]] = []
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids[number] = np.array((encode(t) if t else []) + [END], dtype="<u4")
                keys[number] = key
                windows += packer.add(number, len(ids[number]))
                held += len(ids[number])
                number += 1
                if held >= block_tokens:
                    yield from block(windows, False)
                    windows, held = [], 0
        yield from block(windows, True)

    return map_arrow(src, run, schema)


def unpacked(pieces: DataFrame) -> DataFrame:
    """The documents' ids again, from pieces with ids: doc_id, ids. For documents with distinct ids."""
    parts = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return parts.select("doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
