"""Embedding near-dedup: all pairs with cosine at or above a threshold, by a dual traversal
of cover trees.

On the unit sphere the cosine threshold is a distance. Equal vectors are first made one.
The top of each label's tree is a set of cells round pivots; a pair of cells whose centres
lie further apart than both covering radii and the distance is dropped. For each pair that is
left, one task builds the lower levels of both trees, radii halving from level to level, and
walks them together, dropping node pairs by the same bound. What remains is compared exactly,
in double precision.

A task emits, per vector, how many it links with, and a spanning forest of the links, never
the pairs themselves. Components are then found over the forests.

Defined cases: a null label, and vectors that are null, empty, zero, or hold null or
non-finite components, link with nothing; others are scaled by a power of two, so tiny and huge
ones compare like any; vectors of different lengths do not link; repeated
rows count as vectors of their own (they link with each other); a null vec_id keeps its row,
with the component of its group; an empty table gives an empty table; other columns are
ignored.

At scale: cells over ``CELL`` vectors are dealt into blocks, so a task never holds more than
two blocks whatever a label's share; a hot vector is one row after a combined count; pivots
come from a bounded sample per label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import written
from pagoscope.llm.components import connected_components

THRESHOLD = 0.98
CELL = 2000        # vectors of a block
LEAF = 24          # members below which a node is not divided: its pairs are compared at once
MAX_PIVOTS = 64    # cells of a label
DEAL = 20_000      # vectors that one task assigns to cells
BLOCKS = 2**40     # more blocks than a cell can have
_SLACK = 1e-6


class Tree:
    """A cover tree over unit vectors: the cover of each node's children halves its own."""

    def __init__(self, points: np.ndarray, finest: float) -> None:
        self.points, self.finest = points, finest
        self.center, self.radius, self.members, self.children = [], [], [], []
        if len(points):
            first = np.linalg.norm(points - points[0], axis=1)
            self._add(0, np.arange(len(points)), first)

    def _add(self, center: int, members: np.ndarray, far: np.ndarray) -> int:
        node = len(self.center)
        radius = float(far.max())
        self.center.append(center), self.radius.append(radius), self.members.append(members)
        self.children.append([])
        if radius <= self.finest or len(members) <= LEAF:
            return node
        # farthest-first centres until every member lies within half the radius
        nearest, owner, centers = far.copy(), np.zeros(len(members), int), [center]
        while True:
            at = int(nearest.argmax())
            if nearest[at] <= radius / 2:
                break
            d = np.linalg.norm(self.points[members] - self.points[members[at]], axis=1)
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(centers)
            centers.append(int(members[at]))
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(centers) + 1))
        for k, c in enumerate(centers):
            part = order[bounds[k]:bounds[k + 1]]
            if len(part):
                self.children[node].append(self._add(c, members[part], nearest[part]))
        return node


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def near_pairs(left: Tree, right: Tree, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of candidate pairs (index left, index right); with one tree given twice, each
    unordered pair once and no point with itself."""
    if not left.center or not right.center:
        return
    same = left is right
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        kids_a, kids_b = left.children[a] or [a], right.children[b] or [b]
        if not left.children[a] and not right.children[b]:
            i, j = np.meshgrid(left.members[a], right.members[b], indexing="ij")
            i, j = i.ravel(), j.ravel()
            if same and a == b:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        ca = left.points[[left.center[k] for k in kids_a]]
        cb = right.points[[right.center[k] for k in kids_b]]
        ra = np.array([left.radius[k] for k in kids_a])
        rb = np.array([right.radius[k] for k in kids_b])
        keep = _distances(ca, cb) <= ra[:, None] + rb[None, :] + limit + _SLACK
        if same and a == b:
            keep = np.triu(keep)
        i, j = np.nonzero(keep)
        kids_a, kids_b = np.array(kids_a), np.array(kids_b)
        # pairs of single points need no further step
        one_a = np.array([len(left.members[k]) == 1 for k in kids_a])
        one_b = np.array([len(right.members[k]) == 1 for k in kids_b])
        single = one_a[i] & one_b[j]
        if same and a == b:
            done = single & (i != j)
        else:
            done = single
        if done.any():
            at = np.array([left.members[k][0] for k in kids_a])[i[done]]
            to = np.array([right.members[k][0] for k in kids_b])[j[done]]
            yield at, to
        stack.extend(zip(kids_a[i[~single]].tolist(), kids_b[j[~single]].tolist(), strict=True))


def links(
    left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Exact pairs with cosine >= threshold between two sets, or within one set."""
    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # huge components would overflow a square
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    limit = float(np.sqrt(2 - 2 * threshold))
    a = Tree(unit(left), limit / 4)
    b = a if right is None else Tree(unit(right), limit / 4)
    norm_a = np.linalg.norm(left, axis=1)
    other = left if right is None else right
    norm_b = np.linalg.norm(other, axis=1)
    found_i, found_j = [], []
    for i, j in near_pairs(a, b, limit):
        for at in range(0, len(i), 100_000):
            x, y = i[at:at + 100_000], j[at:at + 100_000]
            ok = np.einsum("ij,ij->i", left[x], other[y]) / (norm_a[x] * norm_b[y]) >= threshold
            found_i.append(x[ok]), found_j.append(y[ok])
    return found_i, found_j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For points 0..n-1, the smallest point of each one's component."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least), np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    return low


_VALID = (
    "label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null "
    "or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)"
)
# the power of two at or below the largest component: dividing by it changes no cosine, and no
# square of what is left over- or underflows
_SCALE = "pow(2D, cast(floor(log2(array_max(transform(v, x -> abs(x))))) as double))"


def scaled_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v: array<double>) of all rows; v is scaled, and null where the row may
    not link."""
    plain = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
    # bound by a lambda: as a column of its own it would be worked out again for each component
    return plain.selectExpr(
        "vec_id", "label", f"case when {_VALID} then transform(array({_SCALE}), by -> transform(v, x -> x / by))[0] end as v"
    )


def dedup(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept."""
    scaled = scaled_vectors(rows)
    valid = scaled.where("v is not null")
    key = "to_json(struct(label, size(v) as dims)) as part"
    # ids of the distinct vectors; a row without vec_id never stands for its group alone
    distinct = written(
        valid.groupBy("label", "v").agg(
            F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")
        ).selectExpr(key, "v", "vec_id", "copies", "xxhash64(label, v) as rep"),
        "vectors",
    )
    hashed = F.expr(f"pmod(xxhash64(rep), {2**20})")
    sizes = distinct.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("v", "rep").alias("first")
    ).selectExpr(
        "part", "n", "first", f"least({MAX_PIVOTS}, cast(ceil(2 * n / {CELL}) as int)) as cells",
        f"cast(ceil(n / {DEAL}) as int) as deals",
    )
    sizes = written(sizes, "sizes")
    dealt = distinct.join(sizes.select("part", "n", "cells", "deals"), "part").withColumn(
        "deal", F.expr("cast(pmod(rep, deals) as int)")
    )
    chosen = dealt.where((F.col("n") > CELL) & (hashed < F.col("cells") * 2.0 ** 20 / F.col("n"))).select(
        "part", "v", "deals"
    )
    pivots = sizes.select("part", F.col("first").alias("v"), "deals").union(chosen).groupBy("part").agg(
        F.array_sort(F.collect_set("v")).alias("pivots"), F.first("deals").alias("deals")
    )
    # a label's pivots go with each of its deals
    pivots = pivots.selectExpr("part", "pivots", "explode(sequence(0, deals - 1)) as deal")

    assigned_schema = "part string, rep bigint, copies bigint, v array<double>, cell int, far double"

    def assign(rows, tops):
        if rows.empty:  # a deal of pivots without a vector
            return rows[["part", "rep", "copies", "v"]].assign(cell=0, far=0.0)
        x = np.array(rows["v"].tolist())
        p = np.array([np.array(list(v)) for v in tops["pivots"].iloc[0]])
        unit = lambda m: (lambda s: s / np.linalg.norm(s, axis=1, keepdims=True))(m / np.abs(m).max(axis=1, keepdims=True))
        d = _distances(unit(x), unit(p))
        cell = d.argmin(axis=1)
        out = rows[["part", "rep", "copies", "v"]].copy()
        out["cell"], out["far"] = cell.astype("int32"), d[np.arange(len(x)), cell]
        return out

    assigned = written(
        dealt.select("part", "deal", "rep", "copies", "v").groupBy("part", "deal")
        .cogroup(pivots.groupBy("part", "deal"))
        .applyInPandas(assign, assigned_schema),
        "cells",
    )
    cells = assigned.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")
    ).withColumn("blocks", F.expr(f"cast(ceil(n / {CELL}) as int)"))
    cells = written(cells, "blocks")
    tops = pivots.where("deal = 0").selectExpr("part", "posexplode(pivots) as (cell, center)").withColumn(
        "center", F.expr("transform(center, x -> x / sqrt(aggregate(center, 0D, (s, y) -> s + y * y)))")
    )
    nodes = cells.join(tops, ["part", "cell"]).selectExpr(
        "part", "cell", "radius", "center", "explode(sequence(0, blocks - 1)) as block"
    ).withColumn("node", F.expr(f"cell * {BLOCKS}L + block"))
    limit = float(np.sqrt(2 - 2 * threshold))
    other = nodes.selectExpr("part", "node as node2", "radius as radius2", "center as center2")
    pairs = nodes.join(other, "part").where(
        f"node <= node2 and sqrt(greatest(0D, 2 - 2 * aggregate(zip_with(center, center2, (x, y) -> x * y), "
        f"0D, (s, x) -> s + x))) <= radius + radius2 + {limit} + {_SLACK}"
    ).select("part", "node", "node2")
    pairs = written(pairs, "pairs")
    roles = pairs.selectExpr("part", "node as own", "node", "node2", "0 as side").union(
        pairs.where("node <> node2").selectExpr("part", "node2 as own", "node", "node2", "1 as side")
    ).selectExpr("part", f"cast(own div {BLOCKS} as int) as cell", f"cast(own % {BLOCKS} as int) as block", "node", "node2", "side")
    blocked = assigned.join(cells.select("part", "cell", "blocks"), ["part", "cell"]).withColumn(
        "block", F.expr("cast(pmod(xxhash64(rep, 1), blocks) as int)")
    )
    dealt_pairs = blocked.join(roles, ["part", "cell", "block"]).select(
        "part", "node", "node2", "side", "rep", "copies", "v"
    )

    def walk(rows):
        import pandas as pd

        rows = rows.sort_values(["side", "rep"], kind="stable")
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        x, cut = np.array(rows["v"].tolist()), int((rows["side"] == 0).sum())
        whole = cut == len(rows)
        i, j = links(x[:cut], None if whole else x[cut:], threshold)
        i = np.concatenate([np.zeros(0, int), *i])
        j = np.concatenate([np.zeros(0, int), *j]) + (0 if whole else cut)
        count = np.zeros(len(rows), "int64")
        np.add.at(count, i, copies[j]), np.add.at(count, j, copies[i])
        low = forest(len(rows), i, j)
        seen = np.flatnonzero(count)
        return pd.DataFrame({"rep": rep[seen], "links": count[seen], "towards": rep[low[seen]]})

    found = written(
        dealt_pairs.groupBy("part", "node", "node2").applyInPandas(walk, "rep long, links long, towards long"),
        "links",
    )
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.selectExpr("rep as a", "towards as b"))
    placed = distinct.select("rep", "vec_id", "copies").join(
        groups.withColumnRenamed("node", "rep"), "rep", "left"
    ).withColumn("component", F.coalesce("component", "rep"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    per_vector = written(
        placed.join(least, "component").join(linked, "rep", "left").selectExpr(
            "rep", "coalesce(links, 0L) + copies - 1 as n_links", "component_id"
        ),
        "per_vector",
    )
    all_rows = scaled.selectExpr("vec_id", "case when v is not null then xxhash64(label, v) end as rep")
    return all_rows.join(per_vector, "rep", "left").selectExpr(
        "vec_id", "coalesce(n_links, 0L) as n_links",
        "coalesce(component_id, vec_id) as component_id",
    ).selectExpr("*", "vec_id <=> component_id as kept")
