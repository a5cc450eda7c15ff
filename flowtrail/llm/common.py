"""What several operators share: table access, word patterns, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrail.session import stage

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node reachable from every node of an undirected graph: (node, component).

    Alternates two steps until the edge set stays as it is: each node hands its larger
    neighbours to its smallest one, then its smaller neighbours. Every step is a partial
    minimum and a many-to-one join, so a node with very many links is never gathered in
    one place. Each round is written to the shared folder. Null ends and loops are left
    out; no edges give no rows.
    """
    now = stage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        seen = mark
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.col("hi"), F.min("lo")).alias("root"))
        large = (
            both.where(F.col("lo") > F.col("hi"))
            .join(least, "hi")
            .select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
            .distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("hi"), F.col("root").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("root").alias("lo")),
                )
            ).alias("e")
        )
        now = stage(small.select("e.hi", "e.lo").where("hi != lo").distinct(), "links")
