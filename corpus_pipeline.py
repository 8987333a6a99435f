"""The corpus pipeline: quality rules, line dedup, near dedup, benchmark decontamination and packing, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import decontaminate, line_dedup, near_dedup, packing, quality
from vectide.llm.common import dropped, shared_dir, until_written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts and those under 20 words go; repeated rows get one verdict; ids
    without a label are judged too. An empty table gives no rows, and extra columns stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge_quality(docs, labels).where("kept").select("row.*")


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of two or more lines; one that had words and has none left is dropped. n_chars follows the text.
    Null and empty texts stay as they are; equal rows are one document. An empty table gives no rows, and extra columns stay."""
    got = line_dedup.dedupe_lines(docs)
    bare = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars")))
    return got.where(~((F.col("n_removed") > 0) & bare)).select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id, a null one only if there is no other.

    Line dedup cuts what a near copy shares with its original, and what is left of it is no longer near. So a text that was cut
    also counts as it stands in documents, and two documents are near copies if any of their texts are. Null and empty texts are one
    text; repeated rows are copies. An empty table gives no rows, and extra columns stay.
    """
    return near_dedup.without_near_duplicates(docs, earlier=_uncut(docs, spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _uncut(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """text, before: texts of docs and what documents holds under the same id, where the text is some of its lines."""
    now, then = docs.select("doc_id", "text").dropna(), documents.select("doc_id", F.col("text").alias("before")).dropna()
    cut = now.select("doc_id", F.md5("text").alias("a")).join(then.select("doc_id", F.md5("before").alias("b")), "doc_id").where("a <> b").select("doc_id").distinct()
    both = now.join(cut, "doc_id", "left_semi").join(then.join(cut, "doc_id", "left_semi"), "doc_id")
    lines = F.size(F.array_except(F.split("text", "\n"), F.split("before", "\n"))) == 0
    return both.where(lines & (F.btrim("text") != "") & (F.col("text") != F.col("before"))).select("text", "before")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages. Null and empty texts stay, as do all without an item in the
    benchmark; repeated rows are judged alike. An empty table gives no rows, and extra columns stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. A null or empty text is its end token alone; rows with equal or null ids are documents of their own. An
    empty table gives no rows; extra columns are left out."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_chunks),
    ("near dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", pack),
]

#: Rolling hashes, sketches, alignment and tokens have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again for the next, and goes when that one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        where = shared_dir(spark)
        with until_written(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(where)
        docs = spark.read.schema(made.schema).parquet(where)
        if before is not None:
            dropped(spark, before)
        before = where
    return STAGES[-1][1](spark, docs, sf_dir)
