"""Gradient-boosted trees by histograms, for all training splits at once.

Features are cut into bins at quantiles; a missing value has a bin of its own. Rows whose
bins and label are equal take the same way through every tree, so they are
folded into one row first, with a weight for each split. A level of the trees of all splits then costs one
job: tasks add up gradients per (split, node, feature, bin), these sums are added up, and the driver,
which holds a table as large as the trees' level whatever the data, picks every node's best
cut and the side that missing values go to. Of the two children of a cut only the one with fewer rows is
counted; sums being whole numbers, the other's are what is left of their parent's.

Gradients are summed as whole numbers, so the trees do not depend on how Spark deals the
rows. Rows do not carry their place in a tree; it follows from the trees grown since the
raw scores were last written, every ``rewrite`` rounds.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowtrail.session import release, stage

# Workers get what runs on them by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The bin of a missing value.
MISSING = 255
#: Gradients are whole multiples of 2 ** -SCALE_BITS; sums of 2 ** 31 rows fit in 64 bits.
SCALE_BITS = 31


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 250
    rate: float = 0.06
    depth: int = 4
    bins: int = 64
    least_rows: int = 20
    least_weight: float = 1e-3
    rewrite: int = 10
    #: Rows of the folded table in a partition.
    partition_rows: int = 4_000
    #: But no more partitions than cores or, if that is more, one for so many rows: each sends a table of sums a level.
    most_rows: int = 1_000_000
    #: The driver adds up the sums of so many tasks; those of more are added up in so many groups first.
    merged_here: int = 16


@dataclass
class Trees:
    """The trees of one round, one per split: nodes by place in a complete binary tree.

    Children of node i are 2 i + 1 and 2 i + 2. A feature of -1 marks a leaf.
    """

    feature: np.ndarray  # split x node
    cut: np.ndarray  # the left child takes bins up to this one
    missing_left: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, splits: int, depth: int) -> Trees:
        shape = (splits, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1), np.zeros(shape, int), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape))

    def nodes(self, columns: np.ndarray, split: int, levels: int) -> np.ndarray:
        """The node each row is in after ``levels`` steps; rows stop at leaves. ``columns``: codes, feature by row.

        Node by node over whole columns of bytes, which takes less time than looking up every row's own node.
        """
        kind = np.uint8 if self.feature.shape[1] <= 256 else np.int32
        at = np.zeros(columns.shape[1], kind)
        for node in range(2**levels - 1):
            f = self.feature[split, node]
            if f < 0:
                continue
            code = columns[f]
            left = code <= min(self.cut[split, node], MISSING - 1)
            if self.missing_left[split, node]:
                left |= code == MISSING
            at += (at == node) * (kind(node + 2) - left.view(np.uint8)).astype(kind, copy=False)
        return at

    def counted(self, level: int) -> np.ndarray:
        """Split x node of a level: the nodes whose rows are counted, the smaller child of every cut; at level 0 the root."""
        if level == 0:
            return np.ones((len(self.feature), 1), bool)
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        cut = self.feature[:, 2 ** (level - 1) - 1 : 2**level - 1] >= 0
        left, right = self.rows[:, at][:, ::2], self.rows[:, at][:, 1::2]
        return np.stack([cut & (left <= right), cut & (left > right)], axis=-1).reshape(len(cut), -1)

    def completed(self, level: int, sums: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        """Sums of all nodes of a level, from those counted and the sums of the level ``above``."""
        if level == 0:
            return sums
        cut = self.feature[:, 2 ** (level - 1) - 1 : 2**level - 1] >= 0
        rest = np.where(cut[None, :, :, None, None], above, 0) - sums[:, :, ::2] - sums[:, :, 1::2]
        counted, out = self.counted(level), sums.copy()
        for side in (0, 1):
            out[:, :, side::2] += np.where(counted[None, :, side::2, None, None], 0, rest)
        return out


class Binner:
    """Cut points of every feature, at quantiles of its values."""

    def __init__(self, names: tuple[str, ...], edges: list[np.ndarray]):
        self.names, self.edges = names, edges

    @classmethod
    def of(cls, rows: DataFrame, names: tuple[str, ...], bins: int) -> Binner:
        if not 2 <= bins < MISSING:
            raise ValueError(f"bins must be 2 to {MISSING - 1}")
        shares = [k / bins for k in range(1, bins)]
        found = rows.agg(*[F.percentile_approx(n, shares, 100 * bins).alias(n) for n in names]).head()
        return cls(names, [np.unique(np.array(found[n] or [], float)) for n in names])

    def codes(self, batch) -> np.ndarray:
        """Bins of an Arrow batch, row by feature."""
        out = np.empty((batch.num_rows, len(self.names)), np.uint8)
        for i, (n, e) in enumerate(zip(self.names, self.edges)):
            x = batch.column(n).to_numpy(zero_copy_only=False).astype(float)
            out[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(e, x, "left"))
        return out


def sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-raw))


def matrix(column, kind, width: int) -> np.ndarray:
    """Binary values of one length as a matrix over the column's own bytes."""
    if not len(column):
        return np.empty((0, width), kind)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(data, kind, len(column) * width, places[column.offset]).reshape(-1, width)


def weights(batch, splits: int) -> np.ndarray:
    """Row by split: the weight of a folded row in each split, or one weight and a byte for each split that learns from it."""
    weight = batch.column("weight")
    if pa.types.is_binary(weight.type) or pa.types.is_large_binary(weight.type):
        return matrix(weight, np.int64, splits)
    return matrix(batch.column("trains"), np.uint8, splits) * weight.to_numpy()[:, None]


def folded(rows: DataFrame, binner: Binner, splits: int) -> DataFrame:
    """Rows as codes, label and their number in the training rows of each split, ``w0`` and on; equal ones are one."""

    def coded(batches):
        for batch in batches:
            codes = binner.codes(batch)
            trains = np.ones((batch.num_rows, splits), np.uint8)
            for i, held in enumerate(batch.column("held_out").to_pylist()):
                trains[i, held or []] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in codes], pa.binary()), batch.column("label").cast(pa.float64()),
                 pa.array([x.tobytes() for x in trains], pa.binary())], ["codes", "label", "trains"],
            )

    plain = rows.select(*[F.col(n).cast("double").alias(n) for n in binner.names], F.col("label").cast("double").alias("label"), "held_out")
    made = plain.mapInArrow(coded, "codes binary, label double, trains binary")
    return made.groupBy("codes", "label").agg(
        *[F.count_if(F.substring("trains", s + 1, 1) == F.lit(b"\x01")).alias(f"w{s}") for s in range(splits)]
    )


def packed(table: DataFrame, start: np.ndarray) -> DataFrame:
    """A folded table as codes, label, the weights of all splits and their raw scores, all at ``start``."""
    splits, raw = len(start), start.tobytes()

    def run(batches):
        for batch in batches:
            weight = np.stack([batch.column(f"w{s}").to_numpy() for s in range(splits)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("codes"), batch.column("label"), pa.array([x.tobytes() for x in weight], pa.binary()),
                 pa.array([raw] * batch.num_rows, pa.binary())], ["codes", "label", "weight", "raw"],
            )

    return table.mapInArrow(run, "codes binary, label double, weight binary, raw binary")


def histogram(batches, trees: Trees, level: int, recent: list[Trees], shape: tuple[int, ...], rate: float):
    """(cell, gradient, hessian, rows) of the counted nodes of a level, over the batches of a task."""
    splits, nodes, features, bins = shape
    total = np.zeros((3, *shape), np.int64)
    first, counted = 2**level - 1, trees.counted(level)
    unit = float(1 << SCALE_BITS)
    for batch in batches:
        codes = matrix(batch.column("codes"), np.uint8, features)
        weight = weights(batch, splits)
        raw = matrix(batch.column("raw"), np.float64, splits)
        label = batch.column("label").to_numpy()
        columns = np.ascontiguousarray(codes.T)
        for s in range(splits):
            # Rows that stopped at a leaf are in no node of the level.
            wanted = np.concatenate([np.zeros(first, bool), counted[s]])
            at = trees.nodes(columns, s, level)
            own = np.flatnonzero(wanted[at] & (weight[:, s] != 0))
            if not len(own):
                continue
            mine = columns[:, own]
            p = sigmoid(raw[own, s] + advance(mine, s, recent, rate))
            node = (at[own].astype(np.int64) - first) * bins
            w = weight[own, s]
            amounts = (np.rint((p - label[own]) * unit).astype(np.int64) * w, np.rint(p * (1 - p) * unit).astype(np.int64) * w, w)
            exact = [np.abs(x).sum() < 1 << 53 for x in amounts]  # beyond, sums of doubles are not
            doubles = [x.astype(np.float64) for x in amounts]
            for f in range(features):
                cell = node + np.where(mine[f] == MISSING, bins - 1, mine[f])
                for k, x in enumerate(amounts):
                    if exact[k]:
                        total[k, s, :, f] += np.bincount(cell, doubles[k], nodes * bins).astype(np.int64).reshape(nodes, bins)
                    else:
                        whole = np.zeros(nodes * bins, np.int64)
                        np.add.at(whole, cell, x)
                        total[k, s, :, f] += whole.reshape(nodes, bins)
    flat = total.reshape(3, -1)
    used = np.flatnonzero(flat[2])
    yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(x[used]) for x in flat]], ["cell", "g", "h", "n"])


def advance(columns: np.ndarray, split: int, trees: list[Trees], rate: float) -> np.ndarray:
    """What trees add to the raw scores of a split; ``columns``: codes, feature by row."""
    out = np.zeros(columns.shape[1])
    for t in trees:
        out += (rate * t.value[split])[t.nodes(columns, split, depth_of(t))]
    return out


def depth_of(trees: Trees) -> int:
    return int(trees.feature.shape[1] + 1).bit_length() - 2


def grow(trees: Trees, level: int, sums: np.ndarray, params: BoostParams) -> bool:
    """Cuts the nodes of a level by their histograms (3 x split x node x feature x bin); says if any was cut.

    The last bin is that of missing values. The gain of a cut is what Newton steps in both
    children win over one in the node. Of equal gains the first feature, then the lowest cut, then missing values to the
    right count; of cuts that part the rows alike the middle one is taken. Where a node holds no missing value, later ones go with its larger child.
    """
    splits, nodes, features, bins = sums.shape[1:]
    first, any_cut = 2**level - 1, False
    scale = float(1 << SCALE_BITS)
    g, h, n = sums[0] / scale, sums[1] / scale, sums[2].astype(float)
    lost = [x[..., -1:] for x in (g, h, n)]
    below = [np.cumsum(x[..., :-1], axis=-1) for x in (g, h, n)]
    whole = [b[..., -1:] + m for b, m in zip(below, lost)]
    gain_of = lambda a, b: a * a / np.maximum(b, 1e-300)
    gains = []
    for with_missing in (0, 1):
        left = [b + m * with_missing for b, m in zip(below, lost)]
        right = [w - x for w, x in zip(whole, left)]
        fine = (left[2] >= params.least_rows) & (right[2] >= params.least_rows)
        fine &= (left[1] >= params.least_weight) & (right[1] >= params.least_weight)
        gain = gain_of(left[0], left[1]) + gain_of(right[0], right[1]) - gain_of(whole[0], whole[1])
        gains.append(np.where(fine, gain, -np.inf))
    best = np.stack(gains, axis=-1)  # split x node x feature x cut x side
    flat = best.reshape(splits, nodes, -1)
    pick = flat.argmax(axis=-1)
    for s in range(splits):
        for k in range(nodes):
            at, rows = first + k, whole[2][s, k, 0, 0]
            if rows == 0:
                continue
            total_g, total_h = whole[0][s, k, 0, 0], whole[1][s, k, 0, 0]
            trees.value[s, at] = -total_g / max(total_h, 1e-300)
            if flat[s, k, pick[s, k]] <= 1e-12:
                continue
            f, cut, side = np.unravel_index(pick[s, k], best.shape[2:])
            in_left = [b[s, k, f, cut] + m[s, k, f, 0] * side for b, m in zip(below, lost)]
            in_right = [w[s, k, f, 0] - x for w, x in zip(whole, in_left)]
            # Cuts that part the rows alike: the middle one.
            alike = np.flatnonzero(below[2][s, k, f] == below[2][s, k, f, cut])
            trees.feature[s, at], trees.cut[s, at] = f, (alike[0] + alike[-1] + 1) // 2
            trees.missing_left[s, at] = side if lost[2][s, k, f, 0] else in_left[2] > in_right[2]
            for child, (cg, ch, cn) in ((2 * at + 1, in_left), (2 * at + 2, in_right)):
                trees.value[s, child] = -cg / max(ch, 1e-300)
                trees.rows[s, child] = cn
            any_cut = True
    return any_cut


def with_doubles(rows: DataFrame, names: list[str]) -> StructType:
    return StructType([*rows.schema.fields, *[StructField(n, DoubleType()) for n in names]])


class Forest:
    """The fitted models of all splits."""

    def __init__(self, binner: Binner, start: np.ndarray, trees: list[Trees], rate: float):
        self.binner, self.start, self.trees, self.rate = binner, start, trees, rate

    def score(self, rows: DataFrame, names: list[str], splits: list[int] | None = None) -> DataFrame:
        """Adds the probability of label 1 by each split's model, under ``names``."""
        binner, start, trees, rate = self.binner, self.start, self.trees, self.rate
        wanted = list(range(len(start))) if splits is None else splits
        kept = rows.columns

        def run(batches):
            for batch in batches:
                codes = np.ascontiguousarray(binner.codes(batch).T)
                p = [pa.array(sigmoid(start[s] + advance(codes, s, trees, rate))) for s in wanted]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *p], [*kept, *names])

        return rows.mapInArrow(run, with_doubles(rows, names))


    def score_mixed(self, rows: DataFrame, donors: list[str], names: list[str], split: int) -> DataFrame:
        """Under each name the probability with one feature, in order, taken from its donor column."""
        binner, start, trees, rate = self.binner, self.start, self.trees, self.rate
        kept = rows.columns
        other = Binner(tuple(donors), binner.edges)

        def run(batches):
            for batch in batches:
                codes, given = (np.ascontiguousarray(b.codes(batch).T) for b in (binner, other))
                p = []
                for f in range(len(names)):
                    mixed = codes.copy()
                    mixed[f] = given[f]
                    p.append(pa.array(sigmoid(start[split] + advance(mixed, split, trees, rate))))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *p], [*kept, *names])

        return rows.mapInArrow(run, with_doubles(rows, names))


def fit(rows: DataFrame, features: tuple[str, ...], splits: int, params: BoostParams = BoostParams()) -> Forest:
    """Boosted trees on ``rows`` (features, label 0/1, held_out: the splits that must not learn from a row).

    Null and NaN features are missing values. Raw scores start at the log-odds of the split's
    labels; a split without both labels keeps that start (a probability of 0, 1 or, without rows, one half).
    """
    binner = Binner.of(rows, features, params.bins)
    bins = max([len(e) for e in binner.edges], default=0) + 2  # and one for missing values
    table = stage(folded(rows, binner, splits), "boost-folded")
    counts = table.agg(
        F.count("*").alias("rows"),
        *[x for s in range(splits) for w in [F.col(f"w{s}")]
          for x in (F.sum(w).alias(f"n{s}"), F.sum(w * F.col("label").cast("long")).alias(f"y{s}"))],
    ).head()
    n, y = (np.array([counts[f"{c}{s}"] or 0 for s in range(splits)], float) for c in "ny")
    # Without both labels there is nothing to learn; 40 stands for certainty.
    start = np.where(n == 0, 0.0, np.where(y == 0, -40.0, np.where(y == n, 40.0, np.log(np.maximum(y, 0.5) / np.maximum(n - y, 0.5)))))
    learns = (y > 0) & (y < n)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-counts["rows"] // params.partition_rows), max(cores, -(-counts["rows"] // params.most_rows))))
    state = stage(packed(table, start).repartition(parts), "boost-state").persist()
    release(table)
    done: list[Trees] = []
    recent: list[Trees] = []
    for number in range(params.rounds if learns.any() else 0):
        trees, above = Trees.empty(splits, params.depth), None
        for level in range(params.depth):
            shape = (splits, 2**level, len(features), bins)
            sums = level_sums(state, trees, level, recent, shape, params.rate, params.merged_here if parts > params.merged_here else None)
            sums[:, ~learns] = 0
            sums = above = trees.completed(level, sums, above)
            if not grow(trees, level, sums, params):
                break
        done.append(trees)
        recent.append(trees)
        if len(recent) == params.rewrite and number + 1 < params.rounds:
            old, state = state, stage(rescored(state, recent, splits, len(features), params.rate), "boost-state").persist()
            old.unpersist()
            release(old)
            recent = []
    state.unpersist()
    release(state)
    return Forest(binner, start, done, params.rate)


def added(batches, cells: int) -> np.ndarray:
    """3 x cell: the sums that rows of ``level_sums`` hold, added up."""
    out = np.zeros((3, cells), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            at = np.frombuffer(row["cell"], np.int64)
            for k, c in enumerate("ghn"):
                out[k, at] += np.frombuffer(row[c], np.int64)
    return out


def in_one_row(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (cells, *sums)], ["cell", *"ghn"])


def level_sums(
    state: DataFrame, trees: Trees, level: int, recent: list[Trees], shape: tuple[int, ...], rate: float, groups: int | None
) -> np.ndarray:
    """Sums over all rows. Every task, or with ``groups`` every group of tasks, sends one row: as many numbers as the level has cells, whatever the data."""
    known, cells, kind = list(recent), int(np.prod(shape)), "cell binary, g binary, h binary, n binary"

    def run(batches):
        for found in histogram(batches, trees, level, known, shape, rate):
            yield in_one_row(found.column("cell").to_numpy(), np.stack([found.column(c).to_numpy() for c in "ghn"]))

    def merged(batches):
        total = added(batches, cells)
        used = np.flatnonzero(total[2])
        yield in_one_row(used, total[:, used])

    rows = state.mapInArrow(run, kind)
    if groups is not None:
        rows = rows.repartition(groups).mapInArrow(merged, kind)
    return added(rows.toArrow().to_batches(), cells).reshape(3, *shape)


def rescored(state: DataFrame, recent: list[Trees], splits: int, features: int, rate: float) -> DataFrame:
    """The rows with the recent trees added to their raw scores."""
    known = list(recent)

    def run(batches):
        for batch in batches:
            codes = np.ascontiguousarray(matrix(batch.column("codes"), np.uint8, features).T)
            raw = matrix(batch.column("raw"), np.float64, splits).copy()
            for s in range(splits):
                raw[:, s] += advance(codes, s, known, rate)
            at = batch.schema.get_field_index("raw")
            yield batch.set_column(at, "raw", pa.array([x.tobytes() for x in raw], pa.binary()))

    return state.mapInArrow(run, state.schema)
