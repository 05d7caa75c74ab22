"""The queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunkdedup, dartminhash, filteraudit, langid, linkfilter, media, mih, packing, quality, toxicity, warc, whitening
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spark, table(spark, sf_dir, "documents"), TOKENIZER)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_chunkdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.spans(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), RANKS)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.top_k(table(spark, sf_dir, "embeddings"))


def op11_linkfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkfilter.judge(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (op1_warc, op2_media, op3_toxicity, op4_bpe, op5_langid, op6_chunkdedup, op7_packing, op8_quality, op9_dartminhash, op10_mih, op11_linkfilter, op12_whitening, op13_filteraudit)
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op10_mih": mih.SQL, "op11_linkfilter": linkfilter.SQL, "op13_filteraudit": filteraudit.SQL}
