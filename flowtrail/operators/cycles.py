"""Simple directed cycles up to any length.

Two-cycles are reciprocal edges, already flagged on the edge table. Longer cycles are
found from the end with the smaller degree: each edge belongs to its lower end in the
(degree, id) order, so the paths enumerated grow with E * sqrt(E) and never with the
square of a hub's degree. From five accounts on, two half paths from a cycle's highest account
meet in the middle: both only step on lower accounts, so a cycle is found once, and half a
cycle's length is all that paths grow to. Cycles on the same accounts collapse to one candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import evidence
from flowtrail.functions.skew import shuffled
from flowtrail.session import release, stage

# Fixed values.
SHORT_SCORE, LONG_SCORE = 0.4, 0.8
# Places below sixteen in four bits each, as many as a long holds.
MOST_PLACES = 15


def _below(a_degree: str, a: str, b_degree: str, b: str) -> Column:
    return F.struct(F.col(a_degree), F.col(a)) < F.struct(F.col(b_degree), F.col(b))


def _on_cycles(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: something enters the tail and leaves the head."""
    return edges.where((F.col("from_in_degree") > 0) & (F.col("to_out_degree") > 0)).select(
        F.col("from_node").alias("src"),
        F.col("to_node").alias("dst"),
        F.col("from_degree").alias("src_degree"),
        F.col("to_degree").alias("dst_degree"),
    )


def two_cycles(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("reciprocal") & (F.col("from_node") < F.col("to_node"))).select(
        F.array("from_node", "to_node").alias("path")
    )


def three_cycles(edges: DataFrame) -> DataFrame:
    live = _on_cycles(edges)
    rising = _below("src_degree", "src", "dst_degree", "dst")
    leaving = live.where(rising).select(F.col("src").alias("apex"), F.col("dst").alias("second"))
    entering = live.where(~rising).select(F.col("dst").alias("apex"), F.col("src").alias("third"))
    closing = live.select(F.col("src").alias("second"), F.col("dst").alias("third"))
    wedges = leaving.join(shuffled(entering), "apex").where(F.col("second") != F.col("third"))
    return wedges.join(shuffled(closing), ["second", "third"]).select(F.array("apex", "second", "third").alias("path"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of two-step paths between a cycle's highest account and the one opposite."""
    live = _on_cycles(edges)
    rising = _below("src_degree", "src", "dst_degree", "dst")
    top_out = live.where(~rising).select(
        F.col("src").alias("top"), F.col("src_degree").alias("top_degree"), F.col("dst").alias("mid")
    )
    onward = live.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("dst_degree").alias("far_degree"))
    forth = (
        top_out.join(shuffled(onward), "mid")
        .where(_below("far_degree", "far", "top_degree", "top"))
        .select("top", "far", F.col("mid").alias("second"))
    )
    top_in = live.where(rising).select(
        F.col("dst").alias("top"), F.col("dst_degree").alias("top_degree"), F.col("src").alias("mid")
    )
    inward = live.select(F.col("dst").alias("mid"), F.col("src").alias("far"), F.col("src_degree").alias("far_degree"))
    back = (
        top_in.join(shuffled(inward), "mid")
        .where(_below("far_degree", "far", "top_degree", "top"))
        .select("top", "far", F.col("mid").alias("fourth"))
    )
    return (
        forth.join(shuffled(back), ["top", "far"])
        .where(F.col("second") != F.col("fourth"))
        .select(F.array("top", "second", "far", "fourth").alias("path"))
    )


def _half_paths(live: DataFrame, steps: int, onward: bool) -> dict[int, DataFrame]:
    """Paths of 1 to ``steps`` edges from (or, not ``onward``, to) an account over lower ones: top, end, path without top.

    Each length is written once and extended from there.
    """
    near, far = ("src", "dst") if onward else ("dst", "src")
    first = live.where(F.struct(f"{far}_degree", far) < F.struct(f"{near}_degree", near)).select(
        F.col(near).alias("top"), F.col(f"{near}_degree").alias("top_degree"), F.col(far).alias("end"), F.array(far).alias("path")
    )
    found = {1: first}
    for n in range(2, steps + 1):
        step = live.select(F.col(near).alias("end"), F.col(far).alias("next"), F.col(f"{far}_degree").alias("next_degree"))
        lower = F.struct("next_degree", "next") < F.struct("top_degree", "top")
        longer = found[n - 1].join(shuffled(step), "end").where(lower & ~F.array_contains("path", F.col("next")))
        longer = longer.select("top", "top_degree", F.col("next").alias("end"), F.concat("path", F.array("next")).alias("path"))
        found[n] = stage(longer, "half-paths")
    return found


def longer_cycles(edges: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Cycles of ``shortest`` to ``longest`` accounts, at least three: half paths that share only their two ends.

    Cycles are written, and half paths deleted, before they are grouped by their accounts.
    """
    live = stage(_on_cycles(edges), "cycle-edges")
    ahead = _half_paths(live, (longest + 1) // 2, True)
    back = _half_paths(live, longest // 2, False)
    out = None
    for length in range(shortest, longest + 1):
        a, b = ahead[(length + 1) // 2], back[length // 2]
        b = b.select(F.col("top"), F.col("end"), F.col("path").alias("back"))
        # Both paths end at the account where they meet.
        met = a.join(shuffled(b), ["top", "end"]).where(F.size(F.array_intersect("path", "back")) == 1)
        rest = F.slice(F.reverse("back"), F.lit(2), F.size("back"))
        paths = met.select(F.concat(F.array("top"), "path", rest).alias("path"))
        out = paths if out is None else out.unionByName(paths)
    found = stage(out, "cycle-paths")
    for table in (live, *(t for half in (ahead, back) for steps, t in half.items() if steps > 1)):
        release(table)
    return found


def _from_smallest(path: Column) -> Column:
    """The rotation of a path that starts at its smallest account."""
    start = F.array_position(path, F.array_min(path)).cast("int")
    return F.concat(F.slice(path, start, F.size(path)), F.slice(path, F.lit(1), start - 1))


def _smallest_paths(paths: DataFrame, max_length: int) -> DataFrame:
    """``accounts, path``: the smallest path of every set of accounts; all paths start at their smallest account.

    A path is sent as places among its sorted accounts, whose order is that of the paths themselves: as one
    number, whose minimum needs no sort, or beyond ``MOST_PLACES`` accounts as an array.
    """
    sets = paths.withColumn("accounts", F.array_sort("path"))
    place = lambda x: F.array_position("accounts", x)
    if max_length <= MOST_PLACES:
        code = F.aggregate("path", F.lit(0).cast("bigint"), lambda done, x: done * 16 + place(x))
        back = F.expr("transform(sequence(size(accounts) - 1, 0, -1), i -> element_at(accounts, cast(shiftright(code, 4 * i) & 15 AS int)))")
    else:
        code = F.transform("path", lambda x: place(x).cast("smallint"))
        back = F.transform("code", lambda p: F.element_at("accounts", p.cast("int")))
    sets = sets.select("accounts", code.alias("code")).groupBy("accounts").agg(F.min("code").alias("code"))
    return sets.select("accounts", back.alias("path"))


def cycles(edges: DataFrame, max_length: int = 4, min_length: int = 2) -> DataFrame:
    """Cycle candidates of ``min_length`` to ``max_length`` accounts, one per set of accounts."""
    if max_length < 2:
        raise ValueError("a cycle has two accounts at least")
    if min_length > max_length:
        raise ValueError("the shortest cycles asked for are longer than the longest")
    wanted = lambda n: min_length <= n <= max_length
    parts = [three_cycles(edges)] if wanted(3) else []
    if wanted(4):
        parts.append(four_cycles(edges))
    if max_length >= 5:
        parts.append(longer_cycles(edges, max(5, min_length), max_length))
    found = []
    if wanted(2):
        found.append(two_cycles(edges).select(F.col("path").alias("accounts"), "path"))
    if parts:
        turned = reduce(DataFrame.unionByName, parts).select(_from_smallest(F.col("path")).alias("path"))
        found.append(_smallest_paths(turned, max_length))
    paths = reduce(DataFrame.unionByName, found)
    length = F.size("path")
    return paths.select(
        "accounts",
        F.lit("cycle").alias("kind"),
        F.when(length == 2, F.lit(SHORT_SCORE)).otherwise(F.lit(LONG_SCORE)).alias("score"),
        evidence(length=length, path=F.col("path")).alias("evidence"),
    )
