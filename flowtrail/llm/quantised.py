"""Near-duplicate embeddings by product quantisation.

Vectors are put into coarse inverted lists and their residuals coded by subspace. A vector
asks its own list and those whose centres are nearly as good. How nearly is measured on the
fit sample: of vectors that lie just at the threshold in random directions, and of all linked
pairs in the sample, the wanted share must be in the lists asked. Vectors of cosine c are at most
sqrt(2 - 2c) apart, which bounds how much worse a neighbour's list can look from here; with
``recall=None`` all lists within that bound are asked, and no pair is lost. In a list,
distances are read from a table of query times codewords; the error of each coded vector is
known, which bounds the true cosine of a close pair from below, so a list loses no pair. Pairs that
pass are reranked by their exact cosine.

Equal vectors are folded first. A list is cut into chunks of bounded size, and chunks of
queries meet chunks of the list in separate tasks. A task returns link counts and a
spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.llm.common import components
from flowtrail.session import stage

COSINE = 0.93
#: Most rows the index is fitted on, in the order of a hash of their id.
MAX_FIT_ROWS = 20_000
PARTS, CODES = 8, 64
#: Share of sampled neighbours that must lie in the lists asked, and how many vectors are tried.
RECALL, TRIED = 0.999, 2000
#: Rows of the fit sample for each list, at least.
ROWS_A_LIST = 8
CHUNK = 2048
EPS = 1e-5


def unit(vectors, width: int) -> np.ndarray:
    """Rows of length one, padded with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def means(rows: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from rows picked at random; empty cells keep their centre."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        size = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


class Index:
    """Coarse centres and one codebook per subspace."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width = sample.shape[1]
        self.centres = means(sample, lists, rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, self.width, min(PARTS, self.width) + 1).astype(int)
        self.books = [means(rest[:, a:b], CODES, rng) for a, b in zip(self.cuts, self.cuts[1:])]

        squares = (self.centres**2).sum(axis=1)
        apart = squares[:, None] + squares - 2 * self.centres @ self.centres.T
        self.apart = np.sqrt(np.maximum(apart, 0))
        self.share = 1.0

    def gaps(self, rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Each row's own list, and by how much of what a neighbour can gain the other lists look worse (0 for its own)."""
        score = rows @ self.centres.T - (self.centres**2).sum(axis=1) / 2
        own = score.argmax(axis=1)
        worse = score[np.arange(len(rows)), own][:, None] - score
        return own, np.divide(worse, reach * self.apart[own], out=np.zeros_like(worse), where=self.apart[own] > 0)

    def tune(self, sample: np.ndarray, cosine: float, recall: float | None, seed: int = 6) -> float:
        """Sets the share of the bound within which lists are asked; returns the recall measured on the sample."""
        if recall is None or not len(sample):
            return 1.0
        rng, reach = np.random.default_rng(seed), (2 - 2 * cosine) ** 0.5
        rows = sample[rng.choice(len(sample), min(TRIED, len(sample)), replace=False)]
        _, gap = self.gaps(rows, reach)
        aside = rng.normal(size=rows.shape)
        aside -= (aside * rows).sum(axis=1, keepdims=True) * rows
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
        far = nearest(cosine * rows + (1 - cosine**2) ** 0.5 * aside, self.centres)
        made = gap[np.arange(len(rows)), far]
        lists, real = nearest(sample, self.centres), []
        for at in range(0, len(rows), 500):
            i, j = np.nonzero(rows[at : at + 500] @ sample.T >= cosine)
            real.append(gap[at + i, lists[j]])
        real = np.concatenate(real)
        needed = max(float(np.quantile(made, recall, method="higher")), 1.25 * float(real.max(initial=0)))
        self.share = min(1.0, needed)
        every = np.concatenate([made, real])
        return float((every <= self.share).mean())

    def coded(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = rows - self.centres[own]
        return np.stack([nearest(rest[:, a:b], c) for (a, b), c in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([c[codes[:, m]] for m, c in enumerate(self.books)], axis=1)


def encoder(index: Index, reach: float):
    def encode(batches):
        for batch in batches:
            rows = unit(batch["embedding"].tolist(), index.width)
            own, gap = index.gaps(rows, reach)
            probes = [np.flatnonzero(g <= index.share + EPS) for g in gap]
            codes = index.coded(rows, own)
            error = rows - index.decoded(own, codes)
            # A vector within reach of this one scores at least cosine - slack on its code.
            slack = (rows * error).sum(axis=1) + reach * np.linalg.norm(error, axis=1)
            yield batch.assign(list=own, probes=probes, codes=[x.astype(np.uint8).tobytes() for x in codes], slack=slack)

    return encode


def forest(i: np.ndarray, j: np.ndarray, ids_i: np.ndarray, ids_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest linked node) pairs that connect what the links i-j connect."""
    root_i, root_j = ids_i.copy(), ids_j.copy()
    by_j = np.argsort(j, kind="stable")
    at_i, first_i = np.unique(i, return_index=True)
    at_j, first_j = np.unique(j[by_j], return_index=True)
    while True:
        new_i, new_j = root_i.copy(), root_j.copy()
        new_i[at_i] = np.minimum(root_i[at_i], np.minimum.reduceat(root_j[j], first_i))
        new_j[at_j] = np.minimum(root_j[at_j], np.minimum.reduceat(new_i[i[by_j]], first_j))
        if (new_i == root_i).all() and (new_j == root_j).all():
            break
        root_i, root_j = new_i, new_j
    node, root = np.concatenate([ids_i, ids_j]), np.concatenate([root_i, root_j])
    return node[node != root], root[node != root]


def searcher(index: Index, cosine: float):
    empty = pd.DataFrame({"id": [], "n": [], "root": []}).astype({"id": "int64", "n": "int64", "root": "Int64"})

    def search(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return empty
        q, x = unit(asking["embedding"].tolist(), index.width), unit(held["embedding"].tolist(), index.width)
        codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(x), -1)
        score = np.repeat((q @ index.centres[held["list"].iloc[0]])[:, None], len(x), axis=1)
        for m, (a, b) in enumerate(zip(index.cuts, index.cuts[1:])):
            score += (q[:, a:b] @ index.books[m].T)[:, codes[:, m]]
        ids_q, ids_x = asking["id"].to_numpy(), held["id"].to_numpy()
        i, j = np.nonzero((score >= cosine - held["slack"].to_numpy() - EPS) & (ids_q[:, None] != ids_x))
        exact = np.concatenate(
            [(q[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)] or [np.zeros(0)]
        )
        i, j = i[exact >= cosine], j[exact >= cosine]
        if not len(i):
            return empty
        n = np.bincount(i, held["copies"].to_numpy()[j], len(q)).astype(np.int64)
        node, root = forest(i, j, ids_q, ids_x)
        return pd.concat([
            pd.DataFrame({"id": ids_q[n > 0], "n": n[n > 0], "root": pd.array([None] * int((n > 0).sum()), "Int64")}),
            pd.DataFrame({"id": node, "n": 0, "root": pd.array(root, "Int64")}),
        ])

    return search


def near_vectors(vectors: DataFrame, cosine: float = COSINE, max_fit_rows: int = MAX_FIT_ROWS, chunk: int = CHUNK,
                 recall: float | None = RECALL) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null, their lengths are equal
    and their cosine in double precision is at least ``cosine``. Vectors that are null,
    empty or zero or hold null or non-finite components, and rows with a null id, are linked
    with nothing (component_id of a null id is null, it is kept). ``n_links`` counts other
    ids. Repeated rows give repeated results; rows with one id and several vectors are one
    node. An empty table gives no rows. Columns not named here are left out. ``recall`` is the
    share of links at the threshold that the lists asked must hold on the fit sample (closer
    ones are hardly ever lost); None asks every list that can hold one.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"),
        F.xxhash64("label", "embedding").alias("key1"), F.xxhash64(F.lit(17), "embedding", "label").alias("key2"),
    )
    live = rows.where("good")
    classes = stage(
        live.select("key1", "key2", "vec_id").distinct().groupBy("key1", "key2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")),
        "vector_classes",
    )
    reps = live.select("key1", "key2", "vec_id", "label", "embedding").join(
        classes.withColumnRenamed("id", "vec_id"), ["key1", "key2", "vec_id"]
    ).dropDuplicates(["key1", "key2"])
    reps = stage(reps.select(F.col("vec_id").alias("id"), "label", F.size("embedding").alias("width"), "embedding", "copies"), "vectors")
    known = reps.agg(F.count("*").alias("n"), F.max("width").alias("width")).head()
    if known.n == 0:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(max_fit_rows).select("embedding").toPandas()
    lists = int(max(8, min(known.n**0.5 / 4, max_fit_rows / ROWS_A_LIST)))
    rows_fitted = unit(sample["embedding"].tolist(), known.width)
    index = Index(rows_fitted, lists)
    index.tune(rows_fitted, cosine, recall)
    reach = (2 - 2 * cosine) ** 0.5
    element = vectors.schema["embedding"].dataType.simpleString()
    kind = vectors.schema["label"].dataType.simpleString()
    coded = stage(
        reps.mapInPandas(
            encoder(index, reach),
            f"id long, label {kind}, width int, embedding {element}, copies long, list int, probes array<int>, codes binary, slack double",
        ),
        "codes",
    )
    cell = ["label", "width", "list"]
    asks = coded.select("id", "label", "width", "embedding", F.explode("probes").alias("list"))
    cells = (
        coded.groupBy(*cell).agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_held"))
        .join(asks.groupBy(*cell).agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_asking")), cell)
    )
    cells = stage(cells, "cells")
    part = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = asks.join(cells, cell).select("id", *cell, "embedding", part("n_asking").alias("row"), every("n_held").alias("col"))
    held = coded.join(cells, cell).select(
        "id", *cell, "embedding", "codes", "slack", "copies", part("n_held").alias("col"), every("n_asking").alias("row")
    )
    held = held.toDF(*held.columns)  # columns of its own, as both sides stem from one table
    place = [*cell, "row", "col"]
    found = stage(
        asking.groupBy(*place).cogroup(held.groupBy(*place)).applyInPandas(searcher(index, cosine), "id long, n long, root long"),
        "links_found",
    )
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.where("root is not null"), "id", "root")
    reach_of = stage(
        classes.join(counts, "id", "left")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .select("key1", "key2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")),
        "class_links",
    )
    linked = rows.withColumn("k", F.when(F.col("good"), F.col("key1"))).select("vec_id", "k", "key2")
    return (
        linked.join(reach_of, (F.col("k") == reach_of.key1) & (linked.key2 == reach_of.key2), "left")
        .select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
