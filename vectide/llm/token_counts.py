"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, map_arrow
from .tokens import encoder

#: Lengths that share a range are summed together; a range's own sums are then carried over the ranges.
_RANGE = 4096


def length_histogram(docs: DataFrame, *, text: str = "text", vocab: str | None = None) -> DataFrame:
    """length, n_docs: how many documents encode to so many tokens. Each task counts its own documents first.

    A null text is no document; an empty one has length 0. Repeated rows count each time. An empty table gives no row. Texts count
    whole, however long; other columns play no part, whatever their names.
    """

    def run(batches):
        encode, seen = encoder(vocab), Counter()
        for b in batches:
            seen.update(len(encode(t)) for t in b.column(0).to_pylist() if t is not None)
        yield pa.RecordBatch.from_pydict(
            {"length": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())}
        )

    counted = map_arrow(docs.select(col(text).cast("string")), run, "length bigint, n_docs bigint")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    n_tokens in documents of that length, docs_ge and tokens_ge in those of L or more, docs_le in those of L or
    fewer, and truncated_tokens, the total if each document were cut at L tokens.
    """
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens")).withColumn(
        "part", F.floor(F.col("length") / _RANGE)
    )
    sums = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = sums.select(
        "part",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    here = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.withColumns({"docs_ge": F.sum("n_docs").over(here), "tokens_ge": F.sum("n_tokens").over(here)})
        .join(sums, "part")
        .withColumns({"docs_ge": F.col("docs_ge") + F.col("d_after"), "tokens_ge": F.col("tokens_ge") + F.col("t_after")})
        .select(
            "length",
            "n_docs",
            "n_tokens",
            "docs_ge",
            "tokens_ge",
            (F.col("d_all") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
            (F.col("t_all") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
        )
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """docs, tokens, truncated_tokens and cut_docs at any limit, also one that is no document's length, from the suffix sums.

    The shortest length above the limit tells how many documents are cut and how many tokens these have; the shortest of all, the totals.
    """
    z, at = F.lit(0).cast("long"), F.struct("docs_ge", "tokens_ge")
    got = sums.agg(F.min_by(at, "length").alias("all"), F.min_by(at, F.when(F.col("length") > limit, F.col("length"))).alias("cut"))
    docs, tokens, cut = F.coalesce("all.docs_ge", z), F.coalesce("all.tokens_ge", z), F.coalesce("cut.docs_ge", z)
    whole = tokens - F.coalesce("cut.tokens_ge", z)
    return got.select(docs.alias("docs"), tokens.alias("tokens"), (whole + cut * F.lit(limit)).alias("truncated_tokens"), cut.alias("cut_docs"))


def length_quantile(sums: DataFrame, share: float) -> DataFrame:
    """The shortest length that at least this share of the documents does not exceed; null for an empty table."""
    total = F.col("docs_ge") + F.col("docs_le") - F.col("n_docs")
    return sums.where(F.col("docs_le") >= F.lit(share) * total).agg(F.min("length").alias("length"))
