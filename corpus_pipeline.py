"""The corpus pipeline: five stages over the documents, each of one operator, each written and read again.

quality, then language, near duplicates, benchmark decontamination, packing. Every stage but the last returns the columns
of documents; the last returns the packed pieces with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import curve_packing, decontaminate, language, minhash_join, quality
from tideframe.llm.idfilter import id_filter
from tideframe.llm.scratch import Scratch

#: Least similarity of near duplicates in hundredths (op9's own is 85), and the agreeing coordinates, of 40, of a candidate.
PERCENT, MATCHES = 80, 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], outputs: tuple[str, ...], wanted: str) -> DataFrame:
    """The rows of docs for which judge's outputs are as wanted; columns of docs with the name of an output keep their values."""
    if not set(outputs) & {c.lower() for c in docs.columns}:
        return judge(docs).where(wanted).select(docs.columns)
    whole = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("_row_"))
    return judge(whole).where(wanted).select("_row_.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of labelled neighbours does not reject. A null or empty text has the share of label 1 among the
    labels as its score and stays where that reaches the threshold; repeated rows stay or go together, as equal texts score
    alike; all columns keep their values."""
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return _kept(docs, lambda rows: quality.score_documents(rows, model), ("score", "predicted"), "predicted = 1")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with the calibrated certainty. Null texts and texts without letters have no language
    and go; equal texts stay or go together. An empty table, or one without languages to learn from, leaves nothing."""
    model = language.fit(docs)
    return _kept(docs, lambda rows: language.predict(rows, model), ("lang_pred", "score", "accepted"), "accepted")


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least id. Rows without id stay; rows that repeat an id are
    one document and stay or go together."""
    gone = Scratch(spark).cut(minhash_join.link_documents(docs, PERCENT, MATCHES).where("not kept").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    # most documents are surely none of these and need no join
    suspect = id_filter(gone, "doc_id").may_hold("doc_id")
    return docs.where(~suspect).unionByName(docs.where(suspect).join(gone, "doc_id", "left_anti").select(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none and stay; repeated rows stay or go
    together; without a benchmark all stay."""
    return decontaminate.without_items(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, neighbours on the curve together. A null text is the end id alone; repeated rows are packed
    each; no documents give no piece."""
    return curve_packing.pack_along_curve(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("language", keep_known_language),
    ("near_duplicates", keep_first_of_group),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL expresses none of the trained or packed stages; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder and the next one's input."""
    scratch, docs = Scratch(spark), _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
