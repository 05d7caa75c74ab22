"""From raw documents to packed training sequences, in five stages.

quality: documents that the quality classifier rejects go.
toxicity: documents that the toxicity classifier rejects go.
near_duplicates: of each group of near-duplicates the document with the least id stays; different texts of
one id are judged each by itself, the least text under the id and the others after all ids.
substrings: passages that occur in an earlier document are cut out of the text; every document stays.
packing: the tokens of the texts are laid into bins of the permitted lengths, one row per bin.

All but the last return the columns of their input, ``n_chars`` following the text. Each stage is
written as Parquet to the shared folder and read again, so none repeats another's work after a loss; what
the stage before has written and what the stage itself has left are deleted then.

Defined cases: where nothing can be learnt (no labelled rows, or of one class only) a classifier rejects
nothing; null and empty texts are judged like others by the classifiers, are no near-duplicates of one
another (null) or are (empty), and give no tokens; of rows with the same id and text one stays; rows
without an id pass near_duplicates and substrings as they are; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import chunkdedup, dartminhash, packing, quality, toxicity
from scholion.llm.common import release, remove, runs_so_far, shared_path, small_batches, table
from scholion.llm.queries import RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, _ = quality.train(docs, table(spark, sf_dir, "labels"))
    if model.constant is not None:
        return docs
    return docs.filter(model.column(F.col("text")) >= quality.THRESHOLD)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(toxicity.narrow(docs), table(spark, sf_dir, "labels"))
    if model.gram is None:
        return docs
    return docs.filter(model.column(F.col("text")) < toxicity.THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    texts = dartminhash.once(dartminhash.by_text(docs, "__text"), "__text")
    others = dartminhash.near_duplicates(texts, "__text").filter("doc_id <> class_id").select(F.col("doc_id").alias("__copy"))
    return texts.join(others, F.col("__text") == F.col("__copy"), "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = chunkdedup.deduplicate(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, RANKS)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: Classifiers, sketches, rolling hashes and packing have no form in SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path, mark = shared_path(spark, name), runs_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, mark)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
