"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Everything here is DataFrame expressions; no Python runs on the executors. Each word is hashed into one of ``buckets``
buckets, and so is each pair of neighbouring word endings (the last two characters, which hold inflection,
punctuation and case, and so say something of words never seen before). Two multinomials are counted over the buckets:
from the documents labelled as good, and from all documents. A document's score is the mean over its n-grams of
log(p_trusted / p_raw), so its length cancels. The threshold is the score that splits the labelled documents at least cost.

Labelled ids are parted in halves by hash. All good documents of one half are the trusted text and all labelled documents of the other set the
threshold, however many there are; all counts, scores and verdicts cover every document. Which half an id is in is known without its label, so each
half of the documents is shuffled to its labels once. The one table sent to every task are the weights, which ``buckets`` bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, doubles, packed

#: Fixed values of the word and symbol classes.
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
_BREAK = r"[\x09-\x0D]"
_SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    """The text's words. Splitting at single spaces is several times as fast as at a pattern, which only odd spacing needs."""
    bare = F.btrim(text, F.lit(_SPACE))
    line = F.regexp_replace(bare, _BREAK, " ")
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).when(F.contains(line, F.lit("  ")), F.split(bare, _SPACES)).otherwise(F.split(line, " "))


def _joined(hashes: Column, apart: int) -> Column:
    """Each hash with the one so far behind it: from runs of k words to runs of k + apart."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.transform(F.slice(hashes, 1, n), lambda x, i: F.xxhash64(x, F.get(hashes, i + apart)))


def _hashed(docs: DataFrame) -> DataFrame:
    """docs (with text) and words, h (a hash per word)."""
    return docs.withColumn("words", _words(F.col("text"))).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def _ends(words: Column) -> Column:
    """A hash of each word's last two characters."""
    return F.transform(words, lambda w: F.xxhash64(F.substring(w, -2, 2)))


def _word_bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _pair_bucket(a: Column, b: Column, buckets: int) -> Column:
    return a.bitwiseXOR(F.shiftright(b, 1)).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _counted(d: DataFrame) -> DataFrame:
    """d (row, text, words, h, ...) with base in place of the text: the plain counts.

    fence is never negative. A condition on it can't be moved below the step that makes it: a filter moved further
    down would repeat whole expressions inside each other, once for every element of an array.
    """
    d = d.withColumn("two", _joined(F.col("h"), 1)).withColumn("four", _joined(F.col("two"), 2))
    # eight words can only repeat where four do
    d = d.withColumn("seen", F.when(F.size(F.array_distinct("four")) < F.size("four"), _joined(F.col("four"), 4)))
    again = F.size(F.array_distinct("seen")) < F.size("seen")
    order = F.sort_array(F.transform("seen", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("order", F.when(again, order))
    at = F.col("order")
    same = lambda x, k: (x["h"] == F.get(at, k + 1)["h"]) | (x["h"] == F.get(at, k - 1)["h"])
    twice = F.filter(F.transform(at, lambda x, k: F.when(same(x, k), x["i"])), lambda i: i.isNotNull())
    d = d.withColumn("twice", F.sort_array(twice))
    covered = F.aggregate(
        "twice",
        F.struct(F.lit(0).alias("n"), F.lit(-8).alias("p")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(8), i - s["p"])).alias("n"), i.alias("p")),
        lambda s: s["n"].cast("long"),
    )
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != ""))
    n_symbols = F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))
    d = d.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.when(F.col("text").rlike(f"[{_SYMBOLS}]"), n_symbols).otherwise(F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "fence": F.spark_partition_id(),
        }
    )
    failed = (F.col("fence") < 0) | (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.withColumn("base", F.struct(*names, failed.alias("base_failed"))).drop(
        *names, "two", "four", "seen", "order", "twice", "lines", "text"
    )


def base_counts(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base) per document; base has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text is an empty one: it has no words, so base_failed.
    """
    return _counted(_hashed(_plain(docs, text, keep))).select("row", "base")


def _plain(docs: DataFrame, text: str, keep: list[str] | None) -> DataFrame:
    return docs.select(packed(docs, keep).alias("row"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))


def _labelled(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    """id, good, fit of each labelled id; an id with conflicting labels isn't good.

    One half (fit) is counted as trusted text and the other sets the threshold, as a document that is itself
    counted scores higher than an equally good one that is not.
    """
    one = labels.select(col(doc_id).alias("id"), col(quality).cast("int").alias("q")).dropna()
    one = one.groupBy("id").agg((F.min("q") == 1).alias("good"))
    return one.withColumn("fit", _fit())


def _fit() -> Column:
    """Whether the id is in the half that is counted; ids of one type hash alike in both tables."""
    return F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(2)) == 0


def _half(docs: DataFrame, labelled: DataFrame, fit: bool, *, text: str, doc_id: str) -> DataFrame:
    """good, text of the labelled documents of one half. Merged at any size: a broadcast of labels would grow with the corpus."""
    d = docs.select(col(doc_id).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")).where("id is not null")
    if d.schema["id"].dataType == labelled.schema["id"].dataType:
        d = d.where(_fit() == fit)
    return d.join(labelled.where(F.col("fit") == fit).select("id", "good").hint("merge"), "id").select("good", "text")


def _bucket_counts(texts: DataFrame, buckets: int) -> list[int]:
    """How many n-grams of the texts fall in each bucket; the driver gets one number per bucket, however large the corpus is."""
    d = _hashed(texts.select("text"))
    d = d.withColumn("ends", _ends(F.col("words"))).select(F.explode(F.arrays_zip("h", "ends", F.slice("ends", 2, F.size("ends")).alias("next"))).alias("g"))
    d = d.select(F.explode(F.array(_word_bucket(F.col("g.h"), buckets), _pair_bucket(F.col("g.ends"), F.col("g.next"), buckets))).alias("bucket"))
    out = [0] * buckets
    for x in d.where("bucket is not null").groupBy("bucket").count().collect():
        out[x["bucket"]] = x["count"]
    return out


def bucket_weights(texts: DataFrame, trusted: DataFrame, *, buckets: int) -> list[float]:
    """log(p_trusted / p_raw) per bucket, each count raised by 1; all 0 without trusted texts. texts, trusted: text."""
    raw, trusted = _bucket_counts(texts, buckets), _bucket_counts(trusted, buckets)
    n, m = sum(raw) + buckets, sum(trusted) + buckets
    if m == buckets:
        return [0.0] * buckets
    return [math.log((t + 1) / m) - math.log((r + 1) / n) for t, r in zip(trusted, raw, strict=True)]


def _scored(d: DataFrame, weights: list[float]) -> DataFrame:
    """d (words, h, ...) with score: the mean weight of the text's n-grams, 0 without any; and a fence as in _counted()."""
    w = doubles(d.sparkSession, weights)
    n = len(weights)
    d = d.withColumn("ends", _ends(F.col("words")))
    first, second = F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), F.slice("ends", 2, F.greatest(F.size("ends"), F.lit(1)))
    pairs = F.zip_with(first, second, lambda a, b: F.get(w, _pair_bucket(a, b, n)))
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + F.get(w, _word_bucket(x, n))) + F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    score = F.when(F.size("h") > 0, total / (2 * F.size("h") - 1)).otherwise(F.lit(0.0))
    return d.withColumns({"score": score, "fence": F.spark_partition_id()}).drop("ends", "words", "h")


def score_threshold(scored: DataFrame, *, caution: float, step: float = 0.001) -> DataFrame:
    """One row: the least score to keep, halfway between the two scores (on a grid of ``step``) that the best cut parts.

    scored: score, good, counts (false for documents that the base rules reject). Losing all good documents would cost
    ``caution``, keeping all bad ones 1; of equally cheap cuts the lowest is taken. Without good or without bad labels
    every score passes.
    """
    bins = scored.groupBy(F.floor(F.col("score") / step).alias("b")).agg(
        F.count_if(F.col("counts") & F.col("good")).alias("g"), F.count_if(F.col("counts") & ~F.col("good")).alias("n")
    )
    bins = bins.where("g + n > 0")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("b").rowsBetween(0, Window.unboundedFollowing)
    cost = bins.select(
        "b",
        F.lag("b").over(Window.orderBy("b")).alias("under"),
        F.coalesce(F.sum("g").over(before), F.lit(0)).alias("lost"),
        F.sum("n").over(after).alias("let"),
        F.sum("g").over(Window.partitionBy()).alias("gs"),
        F.sum("n").over(Window.partitionBy()).alias("ns"),
    ).where((F.col("gs") > 0) & (F.col("ns") > 0))
    loss = caution * F.col("lost") / F.col("gs") + F.col("let") / F.col("ns")
    best = cost.agg(F.min_by(F.struct("b", "under"), F.struct(loss, F.col("b"))).alias("x"))
    cut = (F.col("x.b") + F.col("x.under") + 1) / 2 * step
    return best.select(F.coalesce(cut, F.lit(float("-inf"))).alias("threshold"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    quality: str = "quality",
    buckets: int = 1 << 15,
    caution: float = 30.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, base, score, kept) for every document; kept is false for base_failed, else score >= the threshold.

    Null texts and texts under 20 words fail the base rules. Repeated rows get equal verdicts. Documents without an id
    have no label. Without labels, only the base rules decide. An empty table gives no rows. Texts count whole, in memory in proportion to
    their words; kept columns may have any names.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    labelled = _labelled(labels, doc_id, quality)
    fit, known = (_half(docs, labelled, x, text=text, doc_id=doc_id) for x in (True, False))
    weights = bucket_weights(docs.select(F.coalesce(col(text).cast("string"), F.lit("")).alias("text")), fit.where("good"), buckets=buckets)
    known = _scored(_counted(_hashed(_plain(known, "text", ["good"]))), weights)
    known = known.select("score", F.col("row.good").alias("good"), (~F.col("base.base_failed")).alias("counts"))
    threshold = score_threshold(known, caution=caution)
    d = _scored(_counted(_hashed(_plain(docs, text, keep))), weights)
    kept = (F.col("fence") >= 0) & ~F.col("base.base_failed") & (F.col("score") >= threshold.scalar())
    return d.select("row", "base", "score", kept.alias("kept"))
