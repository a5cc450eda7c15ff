"""From raw documents to encoded training text.

Each stage takes what the one before kept, written as Parquet. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrail.llm import minhash, mixing, pieces, pii, quality_model
from flowtrail.llm.common import table
from flowtrail.session import stage


#: Share of common shingles from which documents are near copies; op1_minhash has its own.
NEAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_model.filtered(docs, table(spark, sf_dir, "labels"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates."""
    return minhash.deduplicated(docs, NEAR_PERCENT)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    return pii.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each whole time and one for a part.

    A part holds the words that were taken, with the white space between them.
    """
    taken = mixing.mix(docs, carry=tuple(docs.columns))
    size = F.nullif(F.col("size"), F.lit(0))
    times = taken.where("taken > 0").select(
        "carried", "skip",
        (F.col("taken") % size).cast("int").alias("part"),
        F.floor(F.col("taken") / size).alias("whole"),
        F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int"))).alias("time"),
    )
    words = F.regexp_extract_all("carried.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    some = F.rtrim(F.array_join(F.slice(words, (F.col("skip") + 1).cast("int"), F.col("part")), ""))
    text = F.when(F.col("time") <= F.col("whole"), F.col("carried.text")).otherwise(some)
    length = F.length(text).cast(docs.schema["n_chars"].dataType)
    new = {"text": text, "n_chars": length}
    return times.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text; ``exact`` says that decoding gives the text back."""
    return pieces.encode(docs, pieces.Model.read(), keep=("lang", "source"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", no_near_copies),
    ("personal data", no_personal_data),
    ("mixing", mixed_sources),
    ("piece encoding", encoded),
]

#: A classifier, a random field and a lattice are no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "kept")
    return STAGES[-1][1](spark, docs, sf_dir)
