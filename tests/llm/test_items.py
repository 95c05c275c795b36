"""Clustering, ranked search and sharding against plain versions of their contracts."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import CLASHES, ODD, SMALL, make_docs  # noqa: F401  a fixture
from pyspark.sql import functions as F

from pagoscope.llm import centroid_clustering, lexical_search, sharding
from pagoscope.llm.queries import QUERIES

VECTORS = "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT, planes STRING, cluster STRING, distance STRING, h STRING"


def plain_clusters(rows, clusters=16, rounds=3):
    kept = [
        (i, [math.floor(64 * x) if abs(x) < 2.0**50 else 64 * int(x) for x in v]) for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "z"

    def start(row):  # equal ids go by the words of their planes
        values = np.array([row[1]], object)
        words = centroid_clustering.packed(values, centroid_clustering.width_of(values))
        return digest(row[0]), words.view(np.int64).ravel().tolist()

    centers = [v for _, v in sorted(kept, key=start)[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centers = [
            [sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if members[k] else c
            for k, c in enumerate(centers)
        ]
    found = [(i, *nearest(v)) for i, v in kept]
    total, by_cluster, most = sum(d for _, d, _ in found), Counter(), 2**63 - 1
    for _, d, k in found:
        by_cluster[k] += d
    return Counter(
        (i, k, min(d, most), min(by_cluster[k], most), min(total, most),
         hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, d, k in found
    )


def clustered(spark, rows, **more):
    full = [(i, v, 1, "p", "c", "d", "h") for i, v in rows]
    return Counter(map(tuple, centroid_clustering.assignments(spark.createDataFrame(full, VECTORS), **more).collect()))


def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = Counter(map(tuple, QUERIES["op11_centroid_clustering"](spark, SMALL).collect()))
    assert got == plain_clusters(rows) and sum(got.values()) > 0


def test_odd_vectors(spark):
    rng = random.Random(5)
    near = lambda at: [rng.gauss(at, 0.3) for _ in range(64)]
    rows = [(i, near(i % 5 - 2)) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0] * 63), (63, [None] + [1.0] * 63), (64, [math.nan] * 64),
             (65, [math.inf] + [0.0] * 63), (66, [0.0] * 64), (67, [1e-200] * 64), (68, [-1e-200] * 64),
             (7, near(9)), (7, near(-9)), (None, near(0)), (69, [1000.5] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)
    assert clustered(spark, rows[:3], clusters=5) == plain_clusters(rows[:3], 5)
    assert clustered(spark, [(60, None)]) == Counter() and clustered(spark, []) == Counter()
    # huge ones need many planes; their distances fit no long
    huge = rows + [(80, [1e30] * 64), (81, [-3e38] + [1e16 + 2] * 63), (82, [2.0**55 + 8] * 64)]
    assert clustered(spark, huge, clusters=30, rounds=2) == plain_clusters(huge, 30, 2)


def test_planes_give_the_vector_back():
    rng = np.random.default_rng(3)
    for low, high in ((-1, 1), (-64, 65), (-2**40, 2**40)):
        values = rng.integers(low, high, (20, 64))
        planes = centroid_clustering.packed(values, centroid_clustering.width_of(values))
        assert [centroid_clustering.unpacked([int(w) for w in row]) for row in planes] == values.tolist()
        expected = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in values] for a in values]
        assert centroid_clustering.dots(planes, planes).tolist() == expected


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return TERM.findall((text or "").translate(lower))


def plain_search(docs, items):
    terms = [(i, Counter(plain_terms(t))) for i, t in docs]
    terms = [(i, t, sum(t.values())) for i, t in terms if t]
    n_docs, total = len(terms), sum(n for _, _, n in terms)
    holding = Counter(w for _, t, _ in terms for w in t)
    found = Counter()
    for item, text in items:
        scores = []
        for i, t, n in terms:
            m = 10 + (90 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1)))
                * ((10**9 * t[w]) // (1000 * t[w] + 8 * m)) for w in set(plain_terms(text)) if w in t
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, missing, i) in enumerate(sorted(scores)[:10], 1):
            found[item, rank, None if missing else i, -score] += 1
    return found


def items_of(spark, rows):
    return spark.createDataFrame(
        [(i, t, "x", "y", "z") for i, t in rows], "item_id BIGINT, text STRING, row STRING, term STRING, rank STRING"
    )


def test_search_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = QUERIES["op12_lexical_search"](spark, SMALL).collect()
    assert Counter(map(tuple, got)) == plain_search(docs, items) and len(got) > 0


@pytest.mark.parametrize("block", [lexical_search.BLOCK, 6])
def test_search_of_odd_texts(spark, make_docs, block):
    texts = [*ODD, "One TWO-two three", "two\x00two\x7ftwo", "ÉCOLE École école", "日本語のテキスト one", "[\\]^_`{|}~@", "a" * 70_000 + " one"]
    docs = [*enumerate(texts), (None, "one two"), (3, "one"), (3, "one"), *((100 + i, "three") for i in range(15))]
    items = [(1, "one, one; TWO"), (1, "one, one; TWO"), (2, None), (3, ""), (None, "école three"), (4, "日本語のテキスト"),
             (5, "a" * 70_000), (6, "absent"), (7, "three")]
    table = make_docs(*docs, clash=CLASHES).repartition(5)
    got = Counter(map(tuple, lexical_search.search(table, items_of(spark, items), block=block).collect()))
    assert got == plain_search(docs, items)


def test_search_of_empty_tables(spark, make_docs):
    items, docs = items_of(spark, [(1, "one")]), make_docs("one", "two")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(make_docs(None, "", "--"), items).count() == 0
    assert lexical_search.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def plain_loads(sizes, shards):
    heap = [0] * shards
    for size in sorted(sizes, reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    return sorted(heap)


def checked_shards(rows, docs, shards):
    """Gapless slots, equal texts together, every document once; returns the loads."""
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in docs)
    slots, loads, of_text = defaultdict(list), [0] * shards, defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        of_text[r.size, r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    return loads


def test_shards_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    loads = checked_shards(QUERIES["op13_sharding"](spark, SMALL).collect(), docs, 40)
    groups = Counter()
    for _, text in docs:
        groups[text or ""] += len((text or "").encode()) + 16
    assert sorted(loads) == plain_loads(groups.values(), 40)


def test_shards_of_odd_documents(make_docs):
    rng = random.Random(1)
    docs = [*enumerate(ODD), (None, None), (3, "x"), (3, "x"), *((50 + i, "copy " * 30) for i in range(300)),
            *((1000 + i, f"{i} " * rng.randint(1, 40)) for i in range(500))]
    table = make_docs(*docs, clash=(*CLASHES, "shard", "h", "size", "part", "at", "slot", "bundle")).repartition(7)
    loads = checked_shards(sharding.shard(table, 8).collect(), docs, 8)
    # the copies, and one long text, outweigh a fair share: each has a shard alone, the others are near equal
    rest = sorted(loads)[:-2]
    assert max(rest) - min(rest) <= 16 + len("499 " * 40)
    assert sharding.shard(make_docs("x").limit(0)).count() == 0
    assert checked_shards(sharding.shard(make_docs("only")).collect(), [(0, "only")], 40).count(0) == 39


def test_small_groups_are_bundled(spark):
    sizes = spark.range(4000).select(F.xxhash64("id").alias("h"), F.lit(100).cast("long").alias("size"))
    plan = sharding.plan(sizes, 4, grain=10, bundles=64)
    assert plan.alone.count() == 0 and plan.bundled.count() == 64
    loads = [r.n for r in plan.place(sizes, "h").groupBy("shard").agg(F.count("h").alias("n")).collect()]
    assert sum(loads) == 4000 and max(loads) - min(loads) <= 100


def test_written_shards(spark, make_docs, tmp_path):
    docs = make_docs("a", "b", "a", None, "", "long " * 50, clash=("shard", "_h", "h"))
    sharding.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.drop("_shard").collect())) == Counter(map(tuple, docs.collect()))
    assert back.groupBy("text").agg(F.countDistinct("_shard").alias("n")).where("n > 1").count() == 0
