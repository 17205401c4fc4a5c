"""A training-data pipeline of five of the operators in tallyloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.

Nulls and odd cases are the operators'; beyond them: of rows that repeat an id the near-duplicate stage keeps those of
the smallest text (by bytes, null last), once; rows with a null id are kept by it; the substring stage leaves texts of
which nothing goes as they are, null ones too; documents of which the substring stage leaves nothing go; rows that repeat an id, a
source and a size in the mixing stage all get as many copies as the one that gets most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import minhash_dedup, packing, quality_rules, source_mixing, substring_dedup
from tallyloom.llm.common import Scratch, table, words

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    # measured once: the fit reads the votes, the verdict the same table, and the texts join their verdicts by row
    scratch = Scratch(spark, "pipeline-quality")
    voted = scratch.keep(quality_rules.with_votes(docs.select(*COLUMNS)), "voted")
    return quality_rules.judge(voted, quality_rules.fit(voted)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (five words, 0.8)."""
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.select(*COLUMNS).where("doc_id is not null").join(kept, "doc_id")
    # one row an id, whatever the order of tasks
    rest = [c for c in COLUMNS if c != "doc_id"]
    least = F.min(F.struct(F.col("text").isNull().alias("none"), *rest)).alias("row")
    one = named.groupBy("doc_id").agg(least).select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])
    return one.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that windows of documents with smaller ids cover."""
    out = substring_dedup.remove_repeats(docs.withColumn("original", F.col("text")).withColumn("size", F.col("n_chars")), carry=("lang", "source", "original", "size"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("original"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("size"))
    return out.where("n_words > n_removed or n_words = 0").select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    copies = source_mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("n"), "copies")
    sized = docs.select(*COLUMNS).withColumn("size", F.size(words(F.col("text"))).cast("long"))
    met = sized.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("n")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated passages", repeats), ("mixture", mixture), ("packing", packed)]

#: Expectation-maximisation, drawing and tokenization are not expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs
