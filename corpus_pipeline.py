"""A corpus pipeline: language ID, quality rules, near duplicates, mixing, tokens. Part of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, language, mixing, near_duplicates, quality
from locusframe.llm.common import Scratch, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Share of the posterior that the likeliest language needs.
SURE = 0.5
#: Words of a shingle and per cent of similarity of near duplicates; op4 has its own contract.
NEAR = (5, 80)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without a letter or a likely language go."""
    pred, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    judged = language.predict(docs, language.learned(docs), pred, score)
    return judged.filter((F.col(pred) != "und") & (F.col(score) >= SURE)).select(*docs.columns)


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.apply_rules(docs).filter("q_kept").select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    return near_duplicates.first_of_group(docs, *NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, in decimal, joined by commas."""
    return bpe.encode_decode(docs).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language id", language_stage),
    ("quality rules", rule_stage),
    ("near duplicates", duplicate_stage),
    ("mixing sources", mixing_stage),
    ("bpe", token_stage),
]
#: Naive Bayes, near duplicates and BPE aren't written in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
