"""Near-duplicate documents by MinHash bands, Odd sketches and exact confirmation.

Each text becomes a set of hashed word shingles. Of a set remain: MinHash bands to find
candidates, an Odd sketch (the MinHash samples folded into a parity bitmap, whose XOR
population count estimates a high similarity closely) and a parity bitmap of the whole set
(whose XOR population count can never exceed the true difference, so it only refuses pairs
that cannot be linked). What both let through is confirmed on the full sets.

Equal sets are folded into one representative first. In each band bucket every set is
first tried against the smallest document only; buckets that are then one component need
nothing more, which keeps a bucket of thousands of close copies linear. Only in mixed
buckets are sets of different components compared. Both kinds of candidates meet the bitmaps
first, in mixed buckets inside the join, so pairs that are refused are never written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.llm.common import components
from flowtrail.session import stage

SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
PARITY_BITS = 1024
SIMILARITY_PERCENT = 85
# Chance that a pair at the threshold shares no band, and standard deviations of its Odd sketch.
MOST_MISSED, DEVIATIONS = 1e-6, 5

SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]
SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, " + ", ".join(
    f"{c} long" for c in SKETCH + PARITY
)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashed shingles, ascending; words are lower-cased in A-Z only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], U)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    run = one[: len(one) - size + 1].copy()
    for k in range(1, size):
        run = run * U(0x9E3779B97F4A7C15) + one[k : len(one) - size + 1 + k]
    return np.unique(mixed(run))


def parity(places: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def sign(batches):
    rng = np.random.default_rng(20240229)
    samples = BANDS * ROWS
    times = rng.integers(0, 1 << 32, (samples, 1), np.uint32) | np.uint32(1)
    flip = rng.integers(0, 1 << 32, (samples, 1), np.uint32)
    salt = mixed(np.arange(1, samples + 1, dtype=U))
    band = mixed(np.arange(1, BANDS + 1, dtype=U) << U(32))
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            found = shingles(text if isinstance(text, str) else None)
            if not len(found):
                rows.append((doc_id, 0, 0, 0, [], *[0] * (len(SKETCH) + len(PARITY))))
                continue
            short = (found >> U(32)).astype(np.uint32)
            least = np.full(samples, 0xFFFFFFFF, np.uint32)
            for i in range(0, len(short), 1024):
                np.minimum(least, ((short[i : i + 1024] ^ flip) * times).min(axis=1), out=least)
            wide = least.astype(U)
            keys = np.zeros(BANDS, U)
            for k in range(ROWS):
                keys = keys * U(0x9E3779B97F4A7C15) + mixed(wide[k::ROWS])
            keys = mixed(keys ^ band).view(np.int64)
            odd = parity((mixed(wide ^ salt) % U(SKETCH_BITS)).astype(np.int64), SKETCH_BITS)
            whole = parity((found % U(PARITY_BITS)).astype(np.int64), PARITY_BITS)
            fp1 = np.add.reduce(found).view(np.int64)
            fp2 = np.bitwise_xor.reduce(mixed(found ^ U(0x5851F42D4C957F2D))).view(np.int64)
            rows.append((doc_id, len(found), int(fp1), int(fp2), keys.tolist(), *odd.tolist(), *whole.tolist()))
        frame = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "fp1", "fp2", "bands", *SKETCH, *PARITY])
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def full_sets(batches):
    for batch in batches:
        texts = [x if isinstance(x, str) else None for x in batch["text"].tolist()]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "items": [shingles(x).view(np.int64) for x in texts]})


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets have 100 * intersection >= percent * union."""
    pairs = stage(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # Rows that share an id share the node; the smallest text stands for them.
    sets = stage(docs.join(wanted, "doc_id", "left_semi").mapInPandas(full_sets, "doc_id long, items array<long>"), "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("b_items"))
    both = F.size(F.array_intersect("a_items", "b_items"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("a_items") + F.size("b_items") - both))
        .select("a", "b")
        .distinct()
    )


def popcount(a: str, b: str, columns: list[str]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
    return total


def likely(percent: int) -> Column:
    """Whether bitmaps and sizes of ``a`` and ``b`` leave room for a link."""
    size_a, size_b = F.col("a.n_shingles"), F.col("b.n_shingles")
    return (
        (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
        & ((100 + percent) * popcount("a", "b", PARITY) <= (100 - percent) * (size_a + size_b))
        & (popcount("a", "b", SKETCH) <= odd_limit(percent))
    )


def not_refused(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that the bitmaps (one row per doc_id) let through."""
    found = pairs.alias("p").join(sketches.alias("a"), F.col("p.a") == F.col("a.doc_id")).join(sketches.alias("b"), F.col("p.b") == F.col("b.doc_id"))
    return found.where(likely(percent)).select("p.a", "p.b")


def missed(percent: int) -> float:
    """Chance that a pair of this similarity shares none of the bands."""
    return (1 - (percent / 100) ** ROWS) ** BANDS


def odd_limit(percent: int) -> float:
    """Most bits in which the Odd sketches of a pair of this similarity differ, ``DEVIATIONS`` above the mean.

    The spread is that of the number of samples that differ, and that of the bits they set.
    """
    samples, same = BANDS * ROWS, percent / 100
    differ = samples * (1 - same)
    slope = 2 * np.exp(-4 * differ / SKETCH_BITS)
    bits = SKETCH_BITS / 4 * (1 - np.exp(-8 * differ / SKETCH_BITS))
    spread = np.sqrt(samples * same * (1 - same) + bits / slope**2)
    return float(SKETCH_BITS / 2 * (1 - np.exp(-4 * min(samples, differ + DEVIATIONS * spread) / SKETCH_BITS)))


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle
    sets; component_id is the smallest doc_id that links reach. Texts that are null, empty
    or blank have no shingles and are linked with nothing. Rows with a null id are linked
    with nothing, have a null component_id and are kept. Repeated rows give repeated result
    rows; rows with one id and several texts are one node. An empty table gives no rows.
    Columns not named here are left out. A ``percent`` that the bands are too coarse for is refused.
    """
    if missed(percent) > MOST_MISSED:
        raise ValueError(f"{BANDS} bands of {ROWS} miss too many pairs at {percent} %")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(docs.mapInPandas(sign, SIGNED), "signatures")
    key = ["fp1", "fp2", "n_shingles"]
    live = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(live.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    ids = classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2")
    banded = live.select("doc_id", "fp1", "fp2", "bands").join(ids, ["doc_id", "fp1", "fp2"], "left_semi")
    banded = stage(banded.select("doc_id", F.explode("bands").alias("band")), "bands")
    texts = docs.where("doc_id is not null")

    centers = banded.groupBy("band").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1")
    shared = stage(banded.join(centers.select("band", "center"), "band"), "shared_bands")
    first = (
        shared.where("doc_id != center")
        .groupBy("doc_id", "center")
        .agg(F.count("*").alias("n"))
        .groupBy("doc_id")
        .agg(F.max_by("center", F.struct(F.col("n"), -F.col("center"))).alias("center"))
        .select(F.col("center").alias("a"), F.col("doc_id").alias("b"))
    )
    first = stage(first, "first_pairs")
    beside = shared.select("doc_id").distinct()
    bitmaps = live.select("doc_id", "fp1", "fp2", "n_shingles", *SKETCH, *PARITY).join(
        ids.join(beside, "doc_id", "left_semi"), ["doc_id", "fp1", "fp2"], "left_semi"
    )
    bitmaps = stage(bitmaps.drop("fp1", "fp2").dropDuplicates(["doc_id"]), "bitmaps")
    links = components(confirmed(texts, not_refused(first, bitmaps, percent), percent), "a", "b")
    links = stage(links, "first_components")

    rows = shared.join(links.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "band", F.coalesce("component", "doc_id").alias("component")
    )
    spread = (
        rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    )
    rows = stage(rows.join(spread.select("band"), "band", "left_semi"), "mixed_bands")
    rows = stage(rows.join(bitmaps, "doc_id"), "mixed_buckets")
    a, b = rows.alias("a"), rows.alias("b")
    second = (
        a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.component") < F.col("b.component")) & likely(percent))
        .select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    more = confirmed(texts, second, percent)
    ends = links.select(F.col("component").alias("a"), F.col("node").alias("b"))
    final = stage(components(ends.unionByName(more), "a", "b"), "components")

    reach = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, F.coalesce("component", "rep").alias("component")
    )
    reach = stage(reach, "class_components")
    linked = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        signed.select("doc_id", *key)
        .join(reach, key, "left")
        .select("doc_id", "n_shingles", linked.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one for each component. Rows with a null id all stay.

    Null, empty and blank texts stay, as nothing is linked with them. Of rows with one id one
    stays. An empty table gives no rows. Columns may have any name.
    """
    kept = "_kept"
    while kept in docs.columns:
        kept += "_"
    keep = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.join(keep, docs["doc_id"] == keep[kept], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
