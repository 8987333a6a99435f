"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words is one
window). A window lies in a document only if each of its words does, so its rarest word alone is a
necessary prefix. Words are ordered by their count over the whole corpus; only document positions that
hold some window's prefix word become candidates. The prefix word's place in the window and the window's
length bound where the window would start and end; what lies there is compared exactly.

The benchmark is cut into blocks of about ``block_words`` words; a longer item into pieces that overlap by a window. Each block is small enough to be sent to
every task, whatever the benchmark's size, and the documents, which never move, go past one block after the other. With more than one
block their rows are numbered and written once; a block gives the hits of the documents that it meets, and these are joined by number.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, map_texts, packed, stored, words

_RESULT = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _windows(item: list[bytes], size: int) -> list[list[bytes]]:
    return [item[i : i + size] for i in range(max(1, len(item) - size + 1))] if item else []


def _counts(docs: DataFrame, text: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of a block's vocabulary occurs in all documents; as many rows as the block has words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, seen = sent.value.__contains__, Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(filter(known, words(t)))
        yield pa.RecordBatch.from_pydict(
            {"w": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())}
        )

    rows = map_arrow(docs.select(col(text)), run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.w): r.n for r in rows}


def _index(items: list[tuple[str | None, list[bytes]]], size: int, counts: dict[bytes, int]) -> tuple[dict, dict]:
    """prefix word -> (place in the window, window's length); window -> ids of its items."""
    owners, prefixes = defaultdict(set), defaultdict(set)
    for key, item in items:
        for w in _windows(item, size):
            owners[b" ".join(w)].add(key)
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            prefixes[w[at]].add((at, len(w)))
    return {k: sorted(v) for k, v in prefixes.items()}, dict(owners)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int, window: int):
    """Blocks of items with about block_words words at most."""
    held, n = [], 0
    rows = benchmark.select(col(item_id).cast("string").alias("id"), col(text).cast("string").alias("text"))
    for r in rows.toLocalIterator():
        w = words(r.text)
        for at in range(0, max(1, len(w) - window + 1), block_words):
            piece = w[at : at + block_words + window - 1]
            if held and n + len(piece) > block_words:
                yield held
                held, n = [], 0
            held.append((r.id, piece))
            n += len(piece)
    if held:
        yield held


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_words: int = 1_000_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, res) per document: row holds the kept columns, res the words, hit spans and items found.

    res.n_words counts the words, res.spans lists disjoint word ranges [start, end) that lie in some
    occurrence of a window, res.items the sorted distinct ids (as strings) of the items with such windows.
    A null or empty text has no words and no hits; a null or empty item has no windows; an item without an
    id marks spans but is not listed. Repeated rows are judged one by one and repeated items count once. Texts and items count whole,
    however long; without documents there are no rows, without items no hits; kept columns may have any names.
    """
    spark = docs.sparkSession
    src = docs.select(packed(docs, keep).alias("row"), col(text).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_id, item_text, block_words, window)
    block, after = next(blocks, []), next(blocks, None)

    def judged(d: DataFrame, block: list, held: list[str]) -> DataFrame:
        vocabulary = frozenset(w for _, item in block for w in item)
        counts = _counts(d, "text", vocabulary) if vocabulary else {}
        index = spark.sparkContext.broadcast(_index(block, window, counts))
        got = map_texts(d, {"t": F.col("text")}, _judge(index), _RESULT, keep=held)
        return got.select(*[col("row").getField(c).alias(c) for c in held], "res")

    if after is None:
        return judged(src, block, ["row"])
    src = stored(src.withColumn("number", F.monotonically_increasing_id()))
    hits, lengths = None, None
    while block is not None:
        got = judged(src.select("number", "text"), block, ["number"])
        got = stored(got) if lengths is None else stored(got.where(F.size("res.spans") > 0))
        lengths = got.select("number", "res.n_words") if lengths is None else lengths
        got = got.where(F.size("res.spans") > 0).select("number", "res.spans", "res.items")
        hits = got if hits is None else hits.unionByName(got)
        block, after = after, next(blocks, None)
    hits = hits.groupBy("number").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    res = F.struct("n_words", _joined(F.col("spans")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return src.select("row", "number").join(lengths, "number").join(hits, "number", "left").select("row", res.alias("res"))


def _joined(spans: Column) -> Column:
    """Sorted spans with those that touch made one; none for null."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda done: F.get(done, F.size(done) - 1)
    longer = lambda done, x: F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (x["start"] <= F.get(done, F.size(done) - 1)["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer(done, x)))
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.coalesce(spans, none), none, step)


def _judge(index):
    def make():
        prefixes, owners = index.value

        def judge(data: dict[str, list]) -> list[dict]:
            got = []
            for t in data["t"]:
                w = words(t)
                n, starts, found = len(w), [], set()
                for i in [i for i, x in enumerate(w) if x in prefixes]:
                    for at, size in prefixes[w[i]]:
                        s = i - at
                        if 0 <= s <= n - size and (own := owners.get(b" ".join(w[s : s + size]))) is not None:
                            starts.append((s, s + size))
                            found |= own
                spans: list[dict] = []
                for s, e in sorted(starts):
                    if spans and s <= spans[-1]["end"]:
                        spans[-1]["end"] = max(e, spans[-1]["end"])
                    else:
                        spans.append({"start": s, "end": e})
                got.append({"n_words": n, "spans": spans, "items": sorted(x for x in found if x is not None)})
            return got

        return judge

    return make


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: its words, hit words, items, their digest, and whether at least a twentieth of the words is hit."""
    got = find_contamination(docs, benchmark, keep=[doc_id], **options)
    hit = F.aggregate("res.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.select(
        col("row").getField(doc_id).alias("doc_id"),
        F.col("res.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("res.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("res.items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, one_in: int = 20, **options) -> DataFrame:
    """The documents of which less than one word in ``one_in`` lies in benchmark windows, with their own columns."""
    got = find_contamination(docs, benchmark, **options)
    hit = F.aggregate("res.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.where((hit == 0) | (one_in * hit < F.col("res.n_words"))).select("row.*")
