"""Near-duplicate documents and vectors, components, and the pipeline."""

import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from llm_cases import CLASHES, ODD, SMALL, make_docs  # noqa: F401  a fixture

from pyspark.sql import functions as F

import corpus_pipeline
from pagoscope.llm import embedding_dedup, minhash_dedup
from pagoscope.llm.components import connected_components
from pagoscope.llm.queries import QUERIES


def union(pairs, nodes):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    names = r.sample(range(10_000), 200)
    edges = list(zip(names[:60], names[1:60])) + [(names[60], n) for n in names[61:120]] + [(7777777, 7777777)]
    edges += [(r.choice(names[120:]), r.choice(names[120:])) for _ in range(60)] * 2
    frame = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    got = {x.node: x.component for x in connected_components(frame).collect()}
    want = union(edges, {n for e in edges for n in e})
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ documents
def brute_groups(texts, rare=minhash_dedup.RARE):
    words = minhash_dedup.Words()
    hashes = {i: words.of(t)[0] for i, t in texts.items()}
    df = Counter(w for h in hashes.values() for w in set(h.tolist()))
    least = max(1, len(texts) / rare)
    idf = {w: 1 + np.log((len(texts) + 1) / (max(n, least) + 1)) for w, n in df.items()}
    sets = {
        i: minhash_dedup.weighted_shingles(h, np.array([idf[w] for w in h.tolist()]))
        for i, h in hashes.items() if len(h)
    }
    holders = {}
    for i, (shingles, _) in sets.items():
        for s in shingles.tolist():
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    near = [(a, b) for a, b in pairs if minhash_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8]
    return union(near, texts)


def test_near_duplicates_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_minhash_dedup"](spark, SMALL).collect()
    assert {r.doc_id: r.group_id for r in rows} == brute_groups(texts)
    assert all(r.kept == (r.doc_id == r.group_id) for r in rows)


def test_block_similarities_equal_pairwise_ones():
    r, words = random.Random(5), minhash_dedup.Words()
    base = [f"w{r.randint(0, 30)}" for _ in range(120)]
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = f"n{r.randint(0, 9)}"
        texts.append(" ".join(own * r.randint(1, 2)))
    hashes = [words.of(t)[0] for t in texts]
    # a weight between 1 and 9 for each word
    full = [minhash_dedup.weighted_shingles(h, 1 + (h % np.uint64(800)) / 100, counted=True) for h in hashes]
    i, j = minhash_dedup.similar_pairs([minhash_dedup.items(*f) for f in full], 0.8)
    want = {(a, b) for b in range(40) for a in range(b) if minhash_dedup.weighted_jaccard(full[a][:2], full[b][:2]) >= 0.8}
    assert set(zip(i.tolist(), j.tolist())) == want and 0 < len(want) < 40 * 39 / 2


def test_samples_agree_as_often_as_sets_are_similar():
    words, sampler = minhash_dedup.Words(), minhash_dedup.Sampler()
    same = total = 0
    for n in range(40):
        base = [f"a{n}_{k}" for k in range(200)]
        other = [*base[:-10], *(f"b{n}_{k}" for k in range(10))]
        hashes = [words.of(" ".join(t))[0] for t in (base, other)]
        x, y = (minhash_dedup.weighted_shingles(h, np.ones(len(h))) for h in hashes)
        j = minhash_dedup.weighted_jaccard(x, y)
        same += (sampler.bands(*x) == sampler.bands(*y)).sum()
        total += minhash_dedup.BANDS
    assert abs(same / total - j**minhash_dedup.ROWS) < 0.08


def test_odd_documents(make_docs):
    long = " ".join(f"w{i}" for i in range(300))
    near = long.replace("w150", "other")
    docs = make_docs(*ODD, (20, long), (21, near), (22, long.upper()), (22, long.upper()), (None, long), (30, "one"),
                     (31, "two words"), clash=CLASHES)
    rows = minhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(ODD) + 7
    of = {r.doc_id: r for r in rows}
    assert {of[i].group_id for i in (20, 21, 22)} == {20} and of[None].group_id == 20
    assert of[20].kept and not of[21].kept and not of[22].kept and not of[None].kept
    assert of[22].class_id == 20 and of[21].class_id == 21 and of[30].group_id == 3
    assert of[0].kept and of[1].kept and of[2].kept and of[31].kept
    assert minhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [*range(len(ODD)), 20, 31]


def test_rows_without_a_word_all_stay(make_docs):
    docs = make_docs((None, None), (None, None), (None, ""), (None, ""), (5, None), (5, None), (6, "some text here"))
    docs = docs.withColumn("source", F.monotonically_increasing_id().cast("string"))
    assert minhash_dedup.drop_near_duplicates(docs).count() == 7
    again = minhash_dedup.drop_near_duplicates(docs.union(docs.where("doc_id = 6")))
    assert again.count() == 7 and again.select("source").distinct().count() == 7


def test_large_groups_need_no_pairs(make_docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "DEAL", 7)
    r, base = random.Random(8), [f"w{i}" for i in range(100)]
    rows = {}
    for i in range(60):
        own = list(base)
        for k in r.sample(range(100), r.choice([0, 1, 2, 3, 5])):
            own[k] = f"x{i}_{k}"
        rows[i] = " ".join(own)
    got = {x.doc_id: x.group_id for x in minhash_dedup.near_duplicates(make_docs(*rows.items())).collect()}
    assert got == brute_groups(rows)


def test_words_are_counted_exactly_in_a_small_memory(spark, make_docs):
    texts = {i: " ".join(f"w{k % (i + 2)}" for k in range(40)) for i in range(50)}
    rows = make_docs(*texts.items()).selectExpr("doc_id", "text", "xxhash64(text) as text_hash")
    counted = minhash_dedup._first_pass(rows, memory=5).where("kind = 1").groupBy("text_hash").agg(F.sum("doc_id"))
    words = minhash_dedup.Words()
    want = Counter(w for t in texts.values() for w in set(words.of(t)[0].view(np.int64).tolist()))
    assert dict(counted.collect()) == want


def test_rare_words_weigh_alike(make_docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "RARE", 4)
    idf = minhash_dedup.Idf({7: 90, -3: 30}, 100)
    found = idf.of(np.array([-3, 7, 11], np.int64).view(np.uint64))
    assert np.allclose(found, 1 + np.log(101 / np.array([31, 91, 26])))
    r = random.Random(9)
    rows = {i: " ".join(f"w{k // 20}_{k}" if r.random() < 0.97 else f"x{i}" for k in range(60)) for i in range(40)}
    got = {x.doc_id: x.group_id for x in minhash_dedup.near_duplicates(make_docs(*rows.items())).collect()}
    assert got == brute_groups(rows, rare=4)


def test_open_buckets_compare_across_groups_only(spark, make_docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "DEAL", 4)
    base = [f"w{i}" for i in range(100)]
    # 20 texts of one known group, one text like its last member only, and a stranger
    texts = {i: " ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(20)}
    texts[20] = " ".join([*base[:19], "x19", *base[20:50], "y50", *base[51:]])
    texts[21] = " ".join(f"z{i}" for i in range(100))
    buckets = spark.createDataFrame([(1, i) for i in texts], "band long, node long")
    groups = spark.createDataFrame([(i, 0) for i in range(20)], "node long, component long")
    held = spark.createDataFrame(list(texts.items()), "node long, text string")
    links = minhash_dedup._open_buckets(buckets, groups, held, minhash_dedup.Idf({}, 22), 0.8).collect()
    met = union([(x.a, x.b) for x in links], texts)
    assert any(20 in (x.a, x.b) for x in links) and not any(21 in (x.a, x.b) for x in links)
    assert all(met[i] != met[21] for i in range(21))


# ------------------------------------------------------------------ vectors
def brute_vectors(rows, threshold=0.98):
    ok = [(k, label, np.array(v, float)) for k, (_, v, label) in enumerate(rows)
          if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for x, (a, la, u) in enumerate(ok) for b, lb, v in ok[:x]
             if la == lb and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold]
    links = [sum(k in p for p in pairs) for k in range(len(rows))]
    group = union(pairs, range(len(rows)))
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, rows[k][0]), rows[k][0])
    return links, [least[group[k]] for k in range(len(rows))]


def test_vectors_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    links, groups = brute_vectors([(r.vec_id, r.embedding, r.label) for r in rows])
    got = QUERIES["op7_embedding_dedup"](spark, SMALL).orderBy("vec_id").collect()
    assert [r.n_links for r in got] == links and [r.component_id for r in got] == groups
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 12)  # several cells and blocks
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(90):
        v = centres[i % 6] + rng.normal(size=8) * (0.02 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in v], i % 2))
    v = rows[0][1]
    nan, inf = float("nan"), float("inf")
    rows += [(100, v, 0), (101, [2 * x for x in v], 0), (102, None, 0), (103, [0.0] * 8, 0), (104, v, None),
             (105, [nan, *v[1:]], 0), (106, [inf, *v[1:]], 0), (107, [None, *v[1:]], 0), (108, v[:4], 0),
             (109, [], 0), (110, v, 7), (111, [-x for x in v], 0)]
    # tiny and huge ones compare like the same vector of ordinary size
    far = {200 + i: 10.0 ** power for i, power in enumerate((-200, -310, 200, 307))}
    table = rows + [(i, [x / max(map(abs, v)) * by for x in v], 0) for i, by in far.items()] + [(210, [5e-324] * 8, 1)]
    rows = rows + [(i, v, 0) for i in far] + [(210, [1.0] * 8, 1)]
    frame = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").selectExpr("*", "'c' AS rep", "1 AS n_links")
    got = embedding_dedup.dedup(frame).orderBy("vec_id").collect()
    links, groups = brute_vectors(rows)
    assert [r.n_links for r in got] == links and [r.component_id for r in got] == groups
    assert embedding_dedup.dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, embedding_dedup.LEAF, 1000])
def test_tree_keeps_every_near_pair(monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5))
    x[50:100] = x[:50] + rng.normal(size=(50, 5)) * 0.05
    i, j = (np.concatenate(a) for a in embedding_dedup.links(x, None))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.98, 1)))}
    assert {(min(a, b), max(a, b)) for a, b in zip(i, j)} == want and len(i) == len(want)


# ------------------------------------------------------------------ pipeline
def test_every_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names[0] == "language ID" and len(names) == 5
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "MinHash near-dedup":
            texts = {r.doc_id: r.text for r in after.collect()}
            assert all(k == v for k, v in brute_groups(texts).items())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SMALL)
    assert last.count() == before.count() and last.where("not restored").count() == 0


def test_stages_take_odd_documents(spark, make_docs):
    docs = make_docs(*ODD, (None, "no id at all"), (3, "one"), (3, "one"), clash=CLASHES)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SMALL)
            assert table.columns == docs.columns, name
        corpus_pipeline.STAGES[-1][1](spark, table, SMALL).collect()


def test_groups_of_a_task_share_the_words(monkeypatch):
    learned, real = [], minhash_dedup.Words._learn
    monkeypatch.setattr(minhash_dedup.Words, "_learn", lambda self, new: learned.extend(new) or real(self, new))
    compare = minhash_dedup._comparer(minhash_dedup.Idf({}, 10), 0.8)
    text = " ".join(f"w{k}" for k in range(40))
    rows = pd.DataFrame({"node": [3, 1, 2], "text": [text, f"{text} w40", "other words are here only"]})
    first, again = compare(rows), compare(rows)
    assert first.to_dict("list") == again.to_dict("list") == {"a": [3], "b": [1]}
    assert len(learned) == len(set(learned)) == 46


@pytest.mark.parametrize("piece", [1, 40, minhash_dedup.PIECE])
def test_words_of_groups_equal_the_pattern(monkeypatch, piece):
    monkeypatch.setattr(minhash_dedup, "PIECE", piece)
    r = random.Random(12)
    every = [*"aAbzZ09_ .,-\n\t\0'", *"éßİıΣςſ日本ー語🙂\u0301\u200d٣²ǅ\ud800\U0010ffff"]
    texts = [None, "", " ", "ab ba", "x" * 5000, "a_b c-d", "ODOS ΟΔΟΣ ΣΑΣ", "word " * 300, "\n".join(every), "ab", "ba ab"]
    texts += ["".join(r.choices(every, k=r.randint(1, 60))) for _ in range(200)] + ["", None, "end"]
    want = [minhash_dedup.WORD.findall(t.lower()) if t else [] for t in texts]
    spilled = []
    words = minhash_dedup.Words(spill=lambda w: spilled.append(w.hash[:w.known].copy()), memory=50)
    got = [words.hash[at].tolist() for at in words.each(texts)]
    assert [len(g) for g in got] == [len(w) for w in want]
    pairs = {pair for g, w in zip(got, want) for pair in zip(g, w)}
    assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs}) > 500
    assert got == [minhash_dedup.Words().of(t)[0].tolist() for t in texts]  # alone as in a group
    assert (len(spilled) > 3) == (piece < 100) and all(len(set(s.tolist())) == len(s) for s in spilled)


def test_numbers_are_kept_when_the_table_of_words_grows():
    r, words = np.random.default_rng(14), minhash_dedup.Words(minhash_dedup.Idf({}, 9))
    hashes = r.integers(0, 2**64, 30_000, dtype=np.uint64)
    hashes[:3000] = np.arange(3000, dtype=np.uint64)  # all in one slot
    hashes[3000:6000] = np.uint64(2**64 - 1) - np.arange(3000, dtype=np.uint64)  # and in the last one
    for at in range(0, len(hashes), 1000):
        assert (words._find(hashes[at:at + 1000]) == -1).all()
        words._learn(hashes[at:at + 1000])
        assert (words._find(hashes[:at + 1000]) == np.arange(at + 1000)).all()
    assert (words.hash[:30_000] == hashes).all() and (words.weight[:30_000] == words.idf.rare).all()


def test_words_are_read_without_an_object_each():
    r = random.Random(15)
    texts = [" ".join("".join(r.choices("aeinorst", k=r.randint(2, 9))) for _ in range(5000)) for _ in range(40)]

    def seconds(read):
        began = time.process_time()
        for text in texts:
            read(text)
        return time.process_time() - began

    words = minhash_dedup.Words()
    assert min(seconds(words.of) for _ in range(3)) < 1.6 * min(seconds(minhash_dedup.WORD.findall) for _ in range(3))


def test_samples_equal_the_plain_formula():
    r, sampler = np.random.default_rng(3), minhash_dedup.Sampler()
    for n in (1, 5, minhash_dedup.BLOCK + 7):
        shingles, weights = r.integers(0, 2**64, n, dtype=np.uint64), r.uniform(0.5, 30, n)
        place = ((shingles * sampler.keys) >> np.uint64(64 - minhash_dedup.POOL_BITS)).astype(int)
        steps = np.floor(np.log(weights).astype(np.float32) * sampler.per_r[place] + sampler.beta[place])
        best = (sampler.base[place] - sampler.r[place] * steps).argmin(axis=1)
        taken = steps[np.arange(len(best)), best].astype(np.int64).astype(np.uint64)
        samples = minhash_dedup._mixed(shingles[best] + minhash_dedup._mixed(taken)).reshape(minhash_dedup.BANDS, minhash_dedup.ROWS)
        total = np.arange(1, minhash_dedup.BANDS + 1, dtype=np.uint64)
        for k in range(minhash_dedup.ROWS):
            total = minhash_dedup._mixed(total * minhash_dedup._MIX + samples[:, k])
        assert (sampler.bands(shingles, weights) == total.view(np.int64)).all()


def test_the_stages_send_small_batches_to_python(spark, make_docs, monkeypatch):
    docs = make_docs(*["some words " * 1000] * 100).coalesce(1)
    seen = lambda: docs.select("text").mapInArrow(
        lambda batches: (b.select([]).from_pydict({"n": [b.nbytes]}) for b in batches), "n long"
    ).agg({"n": "max"}).first()[0]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(corpus_pipeline, "BATCH_BYTES", "64k", raising=False)
    try:
        assert seen() > 1_000_000
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
            stage(spark, docs, SMALL)
            assert seen() < 200_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
