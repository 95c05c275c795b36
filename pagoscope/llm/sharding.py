"""Sharding by longest processing time: groups of equal texts, sorted by size, go to the least
loaded shard through a heap.

A document's size is the UTF-8 length of its text plus a fixed overhead. Documents with equal
texts stay together; a group is known by a 64-bit hash of its text, and two texts that share
one would only stay together too. Groups over 1 / ``GRAIN`` of a shard's fair share, of which
there can be at most shards x GRAIN, are scheduled one by one. All smaller ones are bundled by
their hash into ``BUNDLES`` bundles, scheduled like groups. So the heap handles a bounded number
of items whatever the input, and loads differ by no more than the item placed last, unless one
group alone is larger than a fair share: it gets a shard for itself.

No text is shuffled: sizes are added up by hash and by bundle with map-side combine, so that a
group with a third of all rows costs a row per task, and the placements are joined by broadcast
of a bounded table. Slots are numbered in two steps, by task and within the tasks, so that no
shard's rows meet in one task.

Defined cases: a null text is of size zero plus the overhead and stays with the empty ones, its
crc32 is that of no bytes; a null or repeated doc_id is a row of its own; very long texts are
measured, not moved; fewer groups than shards leave shards empty; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagoscope.llm.common import written

SHARDS = 40
OVERHEAD = 16      # bytes of a document besides its text
GRAIN = 1000       # groups over 1 / GRAIN of a fair share are scheduled alone
BUNDLES = 2**15
LAW = "bytes"


def longest_first(items: Iterable[tuple[int, object]], shards: int) -> dict[object, int]:
    """The shard of each (size, key): by falling size, then key, to the least loaded shard,
    the smaller number among equals."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, key in sorted(items, key=lambda item: (-item[0], item[1])):
        load, shard = heap[0]
        placed[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@dataclass(frozen=True)
class Plan:
    """Where groups go: ``alone`` (h, shard) and, for all others, ``bundled`` (bundle, shard);
    both tables are bounded by the parameters, not by the input."""

    alone: DataFrame
    bundled: DataFrame
    bundles: int

    def place(self, rows: DataFrame, h: str) -> DataFrame:
        """``rows`` with a column ``shard`` by their group hash."""
        bundle = F.expr(f"pmod({h}, {self.bundles})")
        return (
            rows.join(F.broadcast(self.alone.select(F.col("h").alias("_alone"), F.col("shard").alias("_own"))),
                      F.col("_alone") == F.col(h), "left")
            .join(F.broadcast(self.bundled.select(F.col("bundle").alias("_bundle"), F.col("shard").alias("_shared"))),
                  F.col("_bundle") == bundle, "left")
            .withColumn("shard", F.coalesce("_own", "_shared"))
            .drop("_alone", "_own", "_bundle", "_shared")
        )


def plan(sizes: DataFrame, shards: int = SHARDS, grain: int = GRAIN, bundles: int = BUNDLES) -> Plan:
    """The placements for rows of (h, size)."""
    spark = sizes.sparkSession
    bundle = F.expr(f"pmod(h, {bundles})").cast("int").alias("bundle")
    loads = dict(sizes.groupBy(bundle).agg(F.sum("size")).collect())
    limit = sum(loads.values()) // (shards * grain)
    large = sizes.groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") > limit).collect()
    for row in large:
        loads[row["h"] % bundles] -= row["size"]
    items = [(row["size"], (0, row["h"])) for row in large]
    items += [(size, (1, number)) for number, size in loads.items() if size]
    placed = longest_first(items, shards)
    return Plan(
        spark.createDataFrame([(h, s) for (kind, h), s in placed.items() if kind == 0], "h long, shard int"),
        spark.createDataFrame([(b, s) for (kind, b), s in placed.items() if kind == 1], "bundle int, shard int"),
        bundles,
    )


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = _text()
    measured = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead).cast("long")).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
            F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        ),
        "sizes",
    )
    placed = written(plan(measured, shards).place(measured, "h"), "placed")
    # a slot: rows of the shard in earlier parts, and earlier ones of its own part
    counts = written(placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = counts.selectExpr(
        "shard", "part", "sum(n) over (partition by shard order by part) - n as before"
    )
    ranked = placed.withColumn("local", F.expr("row_number() over (partition by shard, part order by at) - 1"))
    return ranked.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("before") + F.col("local")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, overhead: int = OVERHEAD) -> None:
    """The documents, all their columns, in one folder ``_shard=N`` per shard, without a shuffle."""
    text = _text()
    sizes = written(
        docs.select(F.xxhash64(text).alias("h"), (F.octet_length(text) + F.lit(overhead).cast("long")).alias("size")),
        "sizes",
    )
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}  # no name of the table can clash
    own = docs.toDF(*names.values()).withColumn("_h", F.xxhash64(_text(names["text"])))
    placed = plan(sizes, shards).place(own, "_h")
    placed.select(
        *[F.col(short).alias(name) for name, short in names.items()], F.col("shard").alias("_shard")
    ).write.partitionBy("_shard").parquet(path)
