"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import collocations, decontaminate, jaccard, language, mixing, neighbours, projections, quality, resampling, secrets, sharding, suffixes, toxicity
from .common import table


def op1_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op2_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_model(spark, sf_dir):
    return language.score(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "part", F.length("candidate").alias("size"), F.sha2("candidate", 256).alias("sha256"), "score", "predicted")


def op6_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_near_dedup(spark, sf_dir):
    return projections.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_language_model": op3_language_model,
    "op4_mixing": op4_mixing,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op2_decontamination": decontaminate.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op8_suffix_dedup": suffixes.ORACLE,
    "op10_ngram_jaccard": jaccard.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
