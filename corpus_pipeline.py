"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, ngram_join, packing, substring, toxicity
from tessera.llm._shared import discard, written
from tessera.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    got = toxicity.score(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return got.where("predicted = 0").select(docs.columns)


#: What links documents in the near-copy stage: Jaccard similarity (in percent) of the sets of so many consecutive words.
SHINGLE, PERCENT = 5, 80


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity, directly or through others, the one with the smallest id.

    Rows are judged by id and text, so another text of an id does not keep one that is linked elsewhere; of rows alike in both
    one stays. Rows without an id go if their group has an id, else one of the group stays. Texts without words link with
    nothing and stay.
    """
    groups = ngram_join.groups(docs, shingle=SHINGLE, percent=PERCENT, rows_apart=True)
    hashed = docs.withColumn("_kept_hash", F.xxhash64("text"))
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    # The join deals rows by id and hash, and so does the choice of one of them: the texts move once.
    out = hashed.withColumn("_kept_id", F.col("doc_id")).join(kept, ["_kept_id", "_kept_hash"], "left_semi").dropDuplicates(["_kept_id", "_kept_hash"]).select(docs.columns)
    unnamed, of_unnamed = hashed.where("doc_id is null"), groups.where("doc_id is null and component_id is null")
    wordless = of_unnamed.where("n_shingles = 0").select(F.col("text_hash").alias("_kept_hash")).distinct()
    first = of_unnamed.where("n_shingles > 0").groupBy("group").agg(F.min("text_hash").alias("_kept_hash"))
    out = out.unionByName(unnamed.join(wordless, "_kept_hash", "left_semi").select(docs.columns))
    return out.unionByName(unnamed.join(first, "_kept_hash", "left_semi").dropDuplicates(["_kept_hash"]).select(docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too; texts that hold none stay as they are."""
    got = substring.deduplicate(docs)
    changed = F.col("n_removed") > 0
    got = got.withColumn("text", F.when(changed, F.col("remains")).otherwise(F.col("text")))
    return got.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.find(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", one_of_each_group), ("substring dedup", drop_repeats), ("decontamination", drop_leaks), ("best-fit packing", pack)]

#: A trained network, a tokenizer and edit distances are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if n:
            discard(before)
    return docs
