"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, collocations, curve_packing, decontaminate, fit_packing, language, markov, minhash_join, near_vectors, quality, sharding, whitening, wrappers

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quantised_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(_read(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_packing.digest(fit_packing.pack_best_fit(_read(spark, sf_dir, "documents")))


def op3_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_packing.digest(curve_packing.pack_along_curve(_read(spark, sf_dir, "documents")))


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score_documents(_read(spark, sf_dir, "documents"))


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(_read(spark, sf_dir, "pages"))


def op9_minhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.link_documents(_read(spark, sf_dir, "documents"))


def op10_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_read(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(chat.PROBE_ID, json.dumps({"prompt": chat.PROBE_TEXT, "response": chat.PROBE_TEXT}))], "conv_id long, record string")
    turns = chat.turns_of_table(_read(spark, sf_dir, "conversations")).unionByName(chat.turns_of_json(probe, "record"))
    return chat.digest(chat.format_turns(turns))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_quantised_links": op1_quantised_links,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_splitter_shards": op3_splitter_shards,
        "op4_curve_packing": op4_curve_packing,
        "op5_hidden_markov": op5_hidden_markov,
        "op6_neighbour_quality": op6_neighbour_quality,
        "op7_subword_language": op7_subword_language,
        "op8_wrapper_text": op8_wrapper_text,
        "op9_minhash_links": op9_minhash_links,
        "op10_edit_matching": op10_edit_matching,
        "op11_phrases": op11_phrases,
        "op12_chat": op12_chat,
        "op13_whitening": op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_phrases": collocations.ORACLE_SQL, "op12_chat": chat.ORACLE_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
