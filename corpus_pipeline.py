"""The corpus pipeline: documents in, token digests of the training mixture out.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and is written as
Parquet and read again before the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appwatch.llm import common, minhash, mixing, quality_rules, sentencepiece, suffix_dedup
from appwatch.llm.common import stored
from appwatch.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Clean documents that are merely short fail the base rule."""
    judged = quality_rules.apply_rules(docs, quality_rules.fit_references(docs), prefix="rule_")
    return judged.where("rule_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of smallest id.

    Rows are told apart by id and text, so a unique text stays whatever other rows repeat its id. Of rows that repeat an id
    within a group, and of rows that repeat id and text, one stays: that of the smallest text key, and the least
    of the whole rows. Only documents whose key may go, by a bitmap of the keys, are shuffled to meet the keys.
    """
    found = stored(minhash.grouped(docs), "pipeline-groups")
    linked = found.where("linkable")
    stays = linked.where("doc_id = component_id").groupBy("component_id").agg(F.min("text_key").alias("stays"))
    goes = (F.col("doc_id") != F.col("component_id")) | (F.col("text_key") != F.col("stays"))
    gone = linked.join(stays, "component_id").where(goes).select(F.col("doc_id").alias("group_id"), F.col("text_key").alias("group_key")).distinct()
    again = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("group_id"), F.col("text_key").alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
    again = again.where("n > 1").drop("n").join(gone, ["group_id", "group_key"], "left_anti")

    gone, again = stored(gone, "pipeline-gone"), stored(again, "pipeline-again")
    touched = gone.unionByName(again)
    maybe = common.free_name(docs, "maybe")
    parted = common.marked(docs, [F.col("doc_id").cast("long"), minhash.text_key(F.col("text"))], touched, maybe)
    few = parted.where(F.col(maybe)).drop(maybe)

    def same(side: DataFrame):
        return (few["doc_id"] == side["group_id"]) & (minhash.text_key(few["text"]) == side["group_key"])

    single = parted.where(~F.col(maybe)).drop(maybe).unionByName(few.join(touched, same(touched), "left_anti"))
    once = few.join(again, same(again)).groupBy("group_id", "group_key").agg(F.min(F.struct(*[few[c] for c in docs.columns])).alias("row"))
    return single.unionByName(once.select("row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out of the texts; texts left empty go.

    A cut inside a character leaves its other bytes out too. ``n_chars`` is counted anew.
    """
    cut = suffix_dedup.cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture in training order, once for each time they are taken."""
    mixed = mixing.deal(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text as digests, with the text they decode to."""
    return sentencepiece.encode_documents(docs, piece_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeats),
    ("mixing", mixture),
    ("sentencepiece", encode),
]

#: Shingle sets, suffix arrays and token merges are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
