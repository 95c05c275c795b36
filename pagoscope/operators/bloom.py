"""A Bloom filter over keys as a single array, built by aggregates and tested before a shuffle.

The filter has a fixed size (``WORDS`` longs, half a megabyte), so it may be sent to every task
whatever the number of keys. Up to some hundred thousand keys it lets few others pass; beyond
that it lets more and more pass and saves less, but never holds a key back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 2**16
_BITS = 64 * WORDS  # 2**22: three positions out of one 64-bit hash
_SHIFTS = (0, 21, 42)


def _positions(key: Column) -> list[Column]:
    h = F.xxhash64(key)
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(_BITS - 1)) for by in _SHIFTS]


def bloom_filter(keys: DataFrame, key: str) -> Column:
    """The filter as a scalar subquery: evaluated once, before the stages that test it."""
    spark = keys.sparkSession
    bits = keys.select(F.explode(F.array(*_positions(F.col(key)))).alias("pos")).selectExpr(
        "cast(pos div 64 as int) as word", "shiftleft(1L, cast(pos % 64 as int)) as bits"
    )
    dense = bits.unionByName(spark.range(WORDS).selectExpr("cast(id as int) as word", "0L as bits"))
    words = dense.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(
        F.expr("transform(array_sort(collect_list(struct(word, bits))), x -> x.bits)").alias("words")
    ).scalar()


def may_hold(words: Column, key: str) -> Column:
    """Whether the filter may hold the key; never false for one that it holds."""
    tests = []
    for pos in _positions(F.col(key)):
        word = F.get(words, F.call_function("shiftright", pos, F.lit(6)).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(F.lit(63)).cast("int"))
        tests.append(word.bitwiseAND(bit) != 0)
    return tests[0] & tests[1] & tests[2]
