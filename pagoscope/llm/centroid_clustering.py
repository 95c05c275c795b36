"""Centroid clustering of small-integer vectors by bit planes and popcounts.

Each component becomes the integer floor(scale * x). The 64 bits that the components hold at
one place, a bit plane, are packed into one 64-bit word; a vector is its planes in two's
complement, the last one with a negative weight. The dot product of two vectors is then the
sum over pairs of planes of weight * weight * popcount(plane AND plane), and a squared distance
is three such products: exact integers, whatever the magnitude.

A round is one pass over the written planes. Each task sums, per cluster, how often each bit of
each plane is set; Spark adds these counts up, and the driver gets at most clusters x planes
rows, from which it works out the floors of the means with exact integers. No vector is moved.

Defined cases: vectors that are null, have not exactly 64 components, or hold null or non-finite
ones are left out; with fewer vectors than clusters there are fewer clusters; repeated rows count
each, ties of the start order (equal ids) go by the words of the planes and a null vec_id comes
last in it; huge components only take more planes, and a distance or an
inertia beyond a long is given as the largest long; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import written

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
STEP = 8          # planes of a vector are padded to a multiple of this, so that few widths occur
SMALL = 24        # vectors of up to so many planes are multiplied in 64-bit integers
MOST = 2**63 - 1
_MEMBERS = -1     # the plane of all ones, which counts the members


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as int64, or as exact Python integers where these do not fit."""
    scaled = x * float(scale)
    if np.abs(scaled).max(initial=0.0) < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    exact = [
        [math.floor(scale * v) if abs(v) < 2.0**53 else scale * int(v) for v in row] for row in x.tolist()
    ]
    return np.array(exact, object)


def width_of(values: np.ndarray) -> int:
    """Planes that the values need with a sign, padded."""
    top = max((int(v) if v >= 0 else ~int(v)).bit_length() for v in (values.max(), values.min()))
    return -(-(top + 1) // STEP) * STEP


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """(n, width) uint64: bit j of plane p is bit p of component j."""
    planes = np.empty((len(values), width), np.uint64)
    for p in range(width):
        bits = ((values >> min(p, 62) if values.dtype != object else values >> p) & 1).astype(np.uint8)
        planes[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def plane_weights(width: int) -> list[int]:
    return [2**p for p in range(width - 1)] + [-(2 ** (width - 1))]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, m) exact dot products of the vectors with planes ``a`` (n, P) and ``b`` (m, Q)."""
    wa, wb = plane_weights(a.shape[1]), plane_weights(b.shape[1])
    small = max(len(wa), len(wb)) <= SMALL
    # pairs of planes of equal weight are added up first
    sums: dict[int, np.ndarray] = {}
    for p, x in enumerate(wa):
        for q, y in enumerate(wb):
            both = np.bitwise_count(a[:, p, None] & b[None, :, q]).astype(np.int64)
            at = sums.setdefault(p + q, np.zeros(both.shape, np.int64))
            at += both if (x > 0) == (y > 0) else -both
    total = np.zeros((len(a), len(b)), np.int64 if small else object)
    for place, count in sums.items():
        total = total + (count << place if small else count.astype(object) * 2**place)
    return total


def squared_norms(a: np.ndarray) -> np.ndarray:
    wa = plane_weights(a.shape[1])
    small = len(wa) <= SMALL
    total = np.zeros(len(a), np.int64 if small else object)
    for p, x in enumerate(wa):
        for q, y in enumerate(wa):
            both = np.bitwise_count(a[:, p] & a[:, q]).astype(np.int64)
            total = total + (both * (x * y) if small else both.astype(object) * (x * y))
    return total


class Centroids:
    """Centroids as planes, those of equal width together."""

    def __init__(self, vectors: list[list[int]]) -> None:
        by_width: dict[int, list[int]] = {}
        for k, v in enumerate(vectors):
            by_width.setdefault(width_of(np.array(v, object)), []).append(k)
        self.count = len(vectors)
        self.groups = []
        for width, members in sorted(by_width.items()):
            planes = packed(np.array([vectors[k] for k in members], object), width)
            self.groups.append((members, planes, squared_norms(planes)))

    def nearest(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and the squared distance to it."""
        own = squared_norms(a)
        parts = [(members, own[:, None] - 2 * dots(a, planes) + norms[None, :]) for members, planes, norms in self.groups]
        small = all(d.dtype != object for _, d in parts)
        far = np.empty((len(a), self.count), np.int64 if small else object)
        for members, d in parts:
            far[:, members] = d
        cluster = far.argmin(axis=1)
        return cluster, far[np.arange(len(a)), cluster]


def planes_of(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, planes array<long>) of the vectors that can be clustered."""
    valid = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).where(
        f"size(v) = {COMPONENTS} and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))"
    )

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            if not len(x):
                continue
            # rows of one width at a time, so that a huge vector does not widen the others
            size = np.frexp(np.abs(x).max(axis=1))[1]
            for part in np.unique(np.maximum(0, size) // STEP):
                at = np.flatnonzero(np.maximum(0, size) // STEP == part)
                values = integers(x[at], scale)
                planes = packed(values, width_of(values))
                ends = np.arange(len(at) + 1, dtype=np.int32) * planes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(planes.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), lists], names=["vec_id", "planes"])

    return valid.mapInArrow(pack, "vec_id long, planes array<long>")


def by_width(lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, planes) of the rows of each width in an Arrow column of planes."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.diff(lists.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield at, flat[starts[at][:, None] + np.arange(width)[None, :]]


def _bit_counts(table: DataFrame, centroids: Centroids) -> DataFrame:
    """(cluster, plane, negative, s0 .. s63): how many members have the bit set."""
    names = [f"s{j}" for j in range(COMPONENTS)]

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[tuple[int, bool], np.ndarray] = {}

        def add(key: tuple[int, bool], ones: np.ndarray) -> None:
            sums[key] = sums[key] + ones if key in sums else ones

        for batch in batches:
            for _, planes in by_width(batch.column("planes")):
                cluster, _ = centroids.nearest(planes)
                member = (cluster[None, :] == np.arange(centroids.count)[:, None]).astype(np.float64)
                add((_MEMBERS, False), np.repeat(member.sum(axis=1).astype(np.int64)[:, None], COMPONENTS, axis=1))
                for p in range(planes.shape[1]):
                    words = np.ascontiguousarray(planes[:, p]).view(np.uint8).reshape(-1, 8)
                    bits = np.unpackbits(words, axis=1, bitorder="little").astype(np.float64)
                    add((p, p == planes.shape[1] - 1), (member @ bits).astype(np.int64))
        for (plane, negative), ones in sums.items():
            k = centroids.count
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(k), pa.int32()), pa.array([plane] * k, pa.int32()), pa.array([negative] * k),
                 *[pa.array(ones[:, j]) for j in range(COMPONENTS)]],
                names=["cluster", "plane", "negative", *names],
            )

    schema = "cluster int, plane int, negative boolean, " + ", ".join(f"{n} long" for n in names)
    return table.mapInArrow(count, schema).groupBy("cluster", "plane", "negative").agg(
        *[F.sum(n).alias(n) for n in names]
    )


def _moved(old: list[list[int]], counts: list) -> list[list[int]]:
    """The floors of the clusters' means; an empty cluster's centroid stays."""
    sums = [[0] * COMPONENTS for _ in old]
    members = [0] * len(old)
    for row in counts:
        ones = row[3:]
        if row["plane"] == _MEMBERS:
            members[row["cluster"]] = ones[0]
            continue
        weight = -(2 ** row["plane"]) if row["negative"] else 2 ** row["plane"]
        mine = sums[row["cluster"]]
        for j, n in enumerate(ones):
            mine[j] += weight * n
    return [[s // n for s in total] if n else before for before, total, n in zip(old, sums, members, strict=True)]


def unpacked(planes: list[int]) -> list[int]:
    """The components of one vector of planes."""
    weights = plane_weights(len(planes))
    return [sum(w for w, word in zip(weights, planes, strict=True) if word >> j & 1) for j in range(COMPONENTS)]


@dataclass(frozen=True)
class Clustering:
    """``rows``: vec_id, cluster, distance of every vector; the final centroids."""

    rows: DataFrame
    centroids: list[list[int]]


def cluster(
    rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = "1"
) -> Clustering:
    """Lloyd's rounds from the ``clusters`` vectors whose sha256 of ``seed:vec_id`` is smallest."""
    table = written(planes_of(rows, scale), "planes")
    start = table.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = start.orderBy(F.asc_nulls_last("h"), "planes").limit(clusters).collect()
    centroids = [unpacked(row["planes"]) for row in first]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(centroids, _bit_counts(table, Centroids(centroids)).collect())
    last = Centroids(centroids)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            number, far = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            for at, planes in by_width(batch.column("planes")):
                number[at], exact = last.nearest(planes)
                far[at] = np.minimum(exact, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number), pa.array(far)], names=["vec_id", "cluster", "distance"]
            )

    return Clustering(table.mapInArrow(place, "vec_id long, cluster int, distance long"), centroids)


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def assignments(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: vec_id, cluster, distance, and the sums of its cluster and of all."""
    found = cluster(rows, clusters, rounds)
    placed = written(found.rows, "placed")
    spark = rows.sparkSession
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()
    whole = sum(int(row["s"]) for row in sums)
    few = spark.createDataFrame(  # a row per cluster
        [(row["cluster"], min(int(row["s"]), MOST), min(whole, MOST), centroid_digest(found.centroids[row["cluster"]]))
         for row in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(few), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
