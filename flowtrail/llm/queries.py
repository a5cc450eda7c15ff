"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrail.llm import (
    chat, fim, minhash, mixing, oracle, packing, phrases, pieces, pii, quality_model, quality_rules, quantised, suffixes, token_counts,
)
from flowtrail.llm.common import table
from flowtrail.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracle.SQL)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "documents"))


@query
def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), pieces.Model.read())


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"))


@query
def op6_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    names = ("byte_bpe_50k", "byte_bpe_multi_50k")
    files = {n: token_counts.ranks_file(n) for n in names}
    rollup = token_counts.Rollup(spark, scratch_path(spark, "token_totals"))
    batches = token_counts.history(table(spark, folder, "documents"), files, *names)
    for name, deltas in [*batches.items(), *batches.items()]:  # every batch is sent twice
        rollup.commit(name, deltas)
    return rollup.totals()


@query
def op8_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, folder, "documents"))


@query
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", oracle.HOSTILE), (-7, 1, "assistant", oracle.HOSTILE)], turns.schema)
    return chat.digests(chat.format_chat(chat.records(turns.unionByName(hostile)), "conv_id"))


@query
def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_vectors(table(spark, folder, "embeddings"))


@query
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut(table(spark, folder, "documents"))
    # The checksum is taken where the ids lie; they need not travel to learn their place.
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op12_fim(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.restore(fim.transform(table(spark, folder, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))
