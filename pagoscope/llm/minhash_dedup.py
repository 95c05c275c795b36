"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: how often a shingle occurs in it
times the shingle's IDF. The IDF comes from the words' document frequencies, counted
exactly over all documents: a shingle is at most as frequent as its rarest word, and that
bound stands for its frequency. Words in less than one of ``RARE`` documents all weigh as
much as one in just so many, at any size of the input. Improved consistent weighted
sampling draws ``BANDS * ROWS`` samples of the set; two documents agree on a sample with
the probability of their weighted Jaccard similarity. Documents that agree on a whole band
are candidates; the exact weighted Jaccard similarity decides.

Links are wanted for the groups they make, so two documents already known to be in one
group are not compared again. In each band's bucket all are first compared with one leader.
In buckets that still hold several groups all members outside the largest group are then
compared with all members, pair of blocks by pair of blocks: a task works out the
similarities of its two blocks as matrix products over the shingles they share, and emits a
spanning forest of the links, never the pairs. So one stranger in a bucket of n costs n
comparisons, not n * n. Buckets with the same members are compared once.

Defined cases: a null text or one without a word is like no other document; a very long text
is taken whole; a text of fewer
than five words is one shingle; equal word sequences are one class, whatever their case and
punctuation; equal rows fare alike; null doc_ids come last when a group's document is
chosen; an empty table gives an empty table; other columns are ignored. Classes are told
apart by a 64-bit hash of their words.

At scale: copies meet in a combined count and are one node from then on; a bucket's leader
costs one row per member; hot buckets meet in plain joins of written tables, which Spark can
split. Word counts are combined in the tasks; the driver gets only the words of at least one
in ``RARE`` documents, at most ``RARE`` times the mean number of distinct words of a document.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import sliced, whole_rows, written
from pagoscope.llm.components import connected_components
from pagoscope.llm.embedding_dedup import forest

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4  # misses a pair at 0.8 with probability 0.0002
RARE = 4096          # one in so many documents: rarer words weigh alike
DEAL = 300           # documents of a block in which all pairs are compared
COLUMNS = 4096       # shingles that such a comparison holds at a time
MEMORY = 200_000     # words that a worker remembers
PIECE = 2**16        # characters in which words are found at a time
BLOCK = 2048         # shingles sampled at a time
POOL_BITS = 16

WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEYS = np.random.default_rng(11).integers(1, 2**63, BANDS * ROWS + SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Idf:
    """IDF by word hash: exact for words of at least one in ``RARE`` of the documents."""

    def __init__(self, frequent: dict[int, int], total: int) -> None:
        self.words = np.array(sorted(frequent), np.int64)
        self.total = total
        self.values = self._value(np.array([frequent[w] for w in self.words.tolist()], float))
        self.rare = float(self._value(np.array(max(1.0, total / RARE))))

    def _value(self, df: np.ndarray) -> np.ndarray:
        return 1 + np.log((self.total + 1) / (np.maximum(df, max(1.0, self.total / RARE)) + 1))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        signed = hashes.view(np.int64)
        if not len(self.words):
            return np.full(len(signed), self.rare)
        at = np.minimum(np.searchsorted(self.words, signed), len(self.words) - 1)
        return np.where(self.words[at] == signed, self.values[at], self.rare)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every character whether words hold it, and a random number."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    inside = np.zeros(len(every), bool)
    for run in WORD.finditer(every):
        inside[run.start():run.end()] = True
    return inside, np.random.default_rng(13).integers(0, 2**64, len(every), dtype=np.uint64)


def _odd(place: np.ndarray) -> np.ndarray:
    """A random odd number for each place in a word."""
    return _mixed(_mixed((place + 1).astype(np.uint64) * _MIX)) | np.uint64(1)


_ODD = _odd(np.arange(1024))


def _words_of(text: str, begun: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and first place of each word of a lower-case text, and how long the word is in which
    it ends; it begins within a word of which ``begun`` characters came before. A hash is the sum
    over the characters of a random number of the character times one of its place in the word,
    so the hashes of a word's parts add up to its own."""
    inside, letters = _letters()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    held = np.zeros(len(code) + 2, bool)
    held[1:-1] = inside[code]
    edges = np.flatnonzero(held[1:] != held[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, 0
    code = code[held[1:-1]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(code)) - np.repeat(first, lengths)
    if starts[0] == 0:
        place[:lengths[0]] += begun
    value = letters[code]
    value *= _ODD[place] if lengths.max() + begun <= len(_ODD) else _odd(place)
    ending = int(place[-1]) + 1 if edges[-1] == len(text) else 0
    return np.add.reduceat(value, first), starts, ending


def word_hashes(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Group by group of texts the hashes of their words, and where the words of each text end."""

    def hashed(group):
        whole, hashes, starts, parts, begun = "\n".join(group), [], [], [], 0
        for at in range(0, len(whole), PIECE):
            h, s, ending = _words_of(whole[at:at + PIECE], begun)
            hashes.append(h)
            starts.append(s + at)
            parts.append((s == 0) & (begun > 0))
            begun = ending
        if not hashes:
            return np.zeros(0, np.uint64), [0] * len(group)
        hashes, starts = np.concatenate(hashes), np.concatenate(starts)
        first = np.flatnonzero(~np.concatenate(parts))
        if len(first) < len(hashes):
            hashes, starts = np.add.reduceat(hashes, first), starts[first]
        return hashes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])).tolist()

    group, size = [], 0
    for text in texts:
        text = text.lower() if text else ""
        if group and size + len(text) > PIECE:
            yield hashed(group)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield hashed(group)


class Words:
    """The words of texts: their hashes, and the IDF of these if a table of it is given. Words
    are numbered as they come; beyond ``memory`` ``spill`` hears of them and they go."""

    def __init__(self, idf: Idf | None = None, spill: Callable | None = None, memory: int = MEMORY) -> None:
        self.idf, self.spill, self.memory = idf, spill, memory
        self._clear()

    def _clear(self) -> None:
        self.known = 0
        self.hash, self.weight = np.zeros(1024, np.uint64), np.zeros(1024)
        self.slots = np.full(4096, -1, np.int32)  # a word's number lies in its hash's slot or the next free one

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).view(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        slot = self._slot(hashes)
        at = self.slots[slot]
        other = np.flatnonzero((self.hash[at] != hashes) & (at >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            at[other] = found = self.slots[slot[other]]
            other = other[(self.hash[found] != hashes[other]) & (found >= 0)]
        return at

    def _learn(self, new: np.ndarray) -> None:
        at, self.known = self.known, self.known + len(new)
        if self.known > len(self.hash):
            room = np.zeros(2 * self.known - len(self.hash))
            self.weight = np.concatenate([self.weight, room])
            self.hash = np.concatenate([self.hash, room.astype(np.uint64)])
        self.hash[at:self.known] = new
        if self.idf is not None:
            self.weight[at:self.known] = self.idf.of(new)
        if 4 * self.known > len(self.slots):
            self.slots = np.full(1 << (8 * self.known).bit_length(), -1, np.int32)
            at = 0
        number = np.arange(at, self.known, dtype=np.int32)
        slot = self._slot(self.hash[at:self.known])
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several words one stays, the others go on
            left = self.slots[slot] != number
            number, slot = number[left], (slot[left] + 1) & (len(self.slots) - 1)

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Text by text the number of each word, valid until the next text."""
        for hashes, ends in word_hashes(texts):
            if self.known > self.memory:
                if self.spill is not None:
                    self.spill(self)
                self._clear()
            at = self._find(hashes)
            unknown = at < 0
            if unknown.any():
                new = hashes[unknown]
                self._learn(np.unique(new))
                at[unknown] = self._find(new)
            start = 0
            for end in ends:
                yield at[start:end]
                start = end

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and IDF of each word."""
        at = next(self.each([text]))
        return self.hash[at], self.weight[at]


def class_hash(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def weighted_shingles(hashes: np.ndarray, rare: np.ndarray, counted: bool = False) -> tuple[np.ndarray, ...]:
    """Shingle hashes in order, their TF-IDF weights and, if ``counted``, how often each
    occurs; ``rare`` is the IDF of each word."""
    if not len(hashes):
        return (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int))[:3 if counted else 2]
    width = min(SHINGLE, len(hashes))
    n = len(hashes) - width + 1
    total, best = np.full(n, width, np.uint64), np.zeros(n)
    for k in range(width):
        total = _mixed(total + hashes[k:k + n] * _KEYS[k])
        best = np.maximum(best, rare[k:k + n])
    order = total.argsort()
    total = total[order]
    first = np.flatnonzero(np.concatenate([[True], total[1:] != total[:-1]]))
    counts = np.diff(first, append=n)
    return (total[first], counts * best[order[first]], counts)[:3 if counted else 2]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either > 0 else 0.0


class Sampler:
    """Improved consistent weighted samples, their randomness drawn from a pool by hash."""

    def __init__(self) -> None:
        rng = np.random.default_rng(5)
        r, c = rng.gamma(2, 1, 2**POOL_BITS), rng.gamma(2, 1, 2**POOL_BITS)
        beta = rng.random(2**POOL_BITS)
        self.r, self.per_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.beta, self.base = beta.astype(np.float32), (np.log(c) + r * beta - r).astype(np.float32)
        self.keys = _KEYS[SHINGLE:, None]

    def bands(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value for each band."""
        draws = BANDS * ROWS
        least, sample = np.full(draws, np.inf, np.float32), np.zeros(draws, np.uint64)
        logs = np.log(weights).astype(np.float32)
        every = np.arange(draws)
        for at in range(0, len(shingles), BLOCK):
            part = shingles[at:at + BLOCK]
            place = part[None] * self.keys
            place >>= np.uint64(64 - POOL_BITS)
            place = place.view(np.int64)  # below 2**POOL_BITS, so nothing is clipped
            steps = self.per_r.take(place, mode="clip")
            steps *= logs[None, at:at + BLOCK]
            steps += self.beta.take(place, mode="clip")
            np.floor(steps, out=steps)
            value = self.r.take(place, mode="clip")
            value *= steps
            np.subtract(self.base.take(place, mode="clip"), value, out=value)
            best = value.argmin(axis=1)
            low = value[every, best]
            drawn = _mixed(part[best] + _mixed(steps[every, best].astype(np.int64).astype(np.uint64)))
            better = low < least
            least[better], sample[better] = low[better], drawn[better]
        rows = sample.reshape(BANDS, ROWS)
        total = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            total = _mixed(total * _MIX + rows[:, k])
        return total.view(np.int64)


def _first_pass(rows: DataFrame, memory: int = MEMORY) -> DataFrame:
    """Kind 0: a row per document with its class; kind 1: a word's hash and the documents that
    hold it, once a task or oftener."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, spilled = ["kind", "doc_id", "text_hash", "node"], []
        df = np.zeros(1024, np.int64)

        def counts(words):
            n = words.known
            return pa.RecordBatch.from_arrays(
                [pa.array([1] * n, pa.int32()), pa.array(df[:n].copy()), pa.array(words.hash[:n].view(np.int64)),
                 pa.nulls(n, pa.int64())], names=names,
            )

        def spill(words):
            spilled.append(counts(words))
            df[:] = 0

        words = Words(spill=spill, memory=memory)
        for batch in sliced(batches):
            classes = []
            for at in words.each(batch.column("text").to_pylist()):
                if len(words.hash) > len(df):
                    df = np.concatenate([df, np.zeros(len(words.hash) - len(df), np.int64)])
                df[at] += 1  # a number that is there twice counts once
                classes.append(class_hash(words.hash[at]) if len(at) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(classes), pa.int32()), batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(classes, pa.int64())], names=names,
            )
            while spilled:
                yield spilled.pop()
        yield counts(words)

    return rows.mapInArrow(run, "kind int, doc_id long, text_hash long, node long")


def _signatures(rows: DataFrame, idf: Idf) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, sampler = Words(idf), Sampler()
        for batch in sliced(batches):
            nodes, bands = [], []
            for at in words.each(batch.column("text").to_pylist()):
                if len(at):
                    h = words.hash[at]
                    nodes.append(class_hash(h))
                    bands.append(sampler.bands(*weighted_shingles(h, words.weight[at])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "bands"]
            )

    return rows.select("text").mapInArrow(run, "node long, bands array<long>")


def _similar(pairs: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose weighted Jaccard similarity is high enough."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words, known = Words(idf), {}

        def sets(node, text):
            if node not in known:
                if len(known) > 64:
                    known.clear()
                known[node] = weighted_shingles(*words.of(text))
            return known[node]

        for batch in sliced(batches, 64):  # each row holds two whole texts
            near = [
                weighted_jaccard(sets(a, x), sets(b, y)) >= similarity
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def items(shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted set as one of single items: the k-th occurrence of a shingle is an item of
    the shingle's IDF, so that sums over common items are sums of smaller weights."""
    again = np.repeat(np.arange(len(shingles)), counts)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _mixed(shingles[again] + nth.astype(np.uint64) * _MIX), (weights / counts)[again]


def similar_pairs(sets: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of item sets whose weighted Jaccard similarity is high enough."""
    n = len(sets)
    total = np.array([w.sum() for _, w in sets])
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    _, column, often = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    shared = often[column] > 1  # an item of one document adds nothing in common
    owner, weight, column = owner[shared], weight[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, weight = owner[order], weight[order]
    column = np.unique(column[order], return_inverse=True)[1] if len(order) else column
    common = np.zeros((n, n))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        block = np.zeros((n, COLUMNS))
        block[owner[low:high], column[low:high] - at] = np.sqrt(weight[low:high])
        common += block @ block.T
    either = total[:, None] + total[None] - common
    near = np.triu(common >= (similarity - 1e-12) * either, 1) & (either > 0)
    return np.nonzero(near)


def _comparer(idf: Idf, similarity: float) -> Callable:
    """Links (a, b) of the documents of a group of rows: a spanning forest."""
    remembered: list[Words] = []  # one for all groups of a task

    def compare(rows):
        import pandas as pd

        rows = rows.sort_values("node", kind="stable")
        if not remembered:
            remembered.append(Words(idf))
        words, sets = remembered[0], []
        for at in words.each(rows["text"]):
            h, w, n = weighted_shingles(words.hash[at], words.weight[at], counted=True)
            sets.append(items(h, w, n))
        node = rows["node"].to_numpy()
        low = forest(len(node), *similar_pairs(sets, similarity))
        tied = low != np.arange(len(node))
        return pd.DataFrame({"a": node[tied], "b": node[low[tied]]})

    return compare


def _open_buckets(buckets: DataFrame, groups: DataFrame, texts: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """Links (a, b) within the buckets that hold more than one group: a spanning forest."""
    placed = buckets.join(groups, "node", "left").withColumn("part", F.coalesce("component", "node"))
    counts = placed.groupBy("band", "part").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"),
    )
    bands = counts.groupBy("band").agg(
        F.count(F.lit(1)).alias("parts"), F.expr("max(struct(n, part))").alias("top"), F.sum("n").alias("n"),
        F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"),
    ).where("parts > 1").groupBy("n", "x", "y").agg(F.expr("min(struct(band, top))").alias("b"))
    # blocks of the members outside the largest group come first, those of the group after them
    bands = written(bands.selectExpr(
        "b.band as band", "b.top.part as top", f"cast(ceil((n - b.top.n) / {DEAL}) as int) as others",
        f"cast(ceil(b.top.n / {DEAL}) as int) as tops",
    ), "open")
    dealt = placed.select("band", "node", "part").join(bands, "band").withColumn(
        "own", F.expr(
            "cast(if(part = top, others + pmod(xxhash64(node, 2), tops), pmod(xxhash64(node, 2), others)) as int)"
        )
    ).selectExpr(
        "band", "node", "own",
        "explode(sequence(0, if(part = top, others - 1, others + tops - 1))) as other",
    ).selectExpr("band", "least(own, other) as i", "greatest(own, other) as j", "node")

    return dealt.join(texts, "node").groupBy("band", "i", "j").applyInPandas(_comparer(idf, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per row of ``docs``: doc_id, class_id (smallest id with the same words),
    group_id (smallest id of the near-duplicate group), kept, text_hash, and has_words."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    first = written(_first_pass(rows), "classes")
    ids = first.where("kind = 0").select("doc_id", "text_hash", "node")
    totals = first.where("kind = 1").groupBy("text_hash").agg(F.sum("doc_id").alias("n"))
    total = ids.count()
    idf = Idf(dict(totals.where(f"n * {RARE}L >= {total}L").collect()), total)

    signed = written(
        _signatures(rows, idf).groupBy("node").agg(F.first("bands").alias("bands")), "signatures"
    )
    banded = signed.select("node", F.explode("bands").alias("band"))
    shared = written(
        banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "bands"
    )
    buckets = written(banded.join(shared, "band"), "buckets")

    # the text of one document per candidate
    classes = written(
        ids.where("node is not null").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
        ), "class_rows",
    )
    wanted = buckets.select("node").distinct().join(classes, "node").selectExpr(
        "node", "first.no_id as no_id", "coalesce(first.doc_id, 0L) as id", "first.text_hash as text_hash"
    )
    keyed = rows.selectExpr("doc_id is null as no_id", "coalesce(doc_id, 0L) as id", "text_hash", "text")
    texts = written(
        keyed.join(wanted, ["no_id", "id", "text_hash"]).dropDuplicates(["node"]).select("node", "text"),
        "texts",
    )

    # one leader per bucket first; the same leader serves all buckets it is in
    leaders = written(
        buckets.groupBy("band").agg(F.min_by("node", F.xxhash64("node")).alias("lead")), "leaders"
    )
    pairs = written(
        buckets.join(leaders, "band").where("node <> lead").select(
            F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")
        ).distinct(), "pairs",
    )
    compared = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )
    links = written(_similar(compared, idf, similarity), "links")
    groups = connected_components(links)
    open_links = written(_open_buckets(buckets, groups, texts, idf, similarity), "open_links")
    if not open_links.isEmpty():
        groups = connected_components(links.union(open_links))

    grouped = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # written, so that the joins below meet plain shuffles and a hot group or class can be split
    chosen = written(grouped.groupBy("component").agg(F.min("first").alias("chosen")), "chosen")
    placed = written(
        grouped.join(chosen, "component").selectExpr("node", "first.doc_id as class_id", "chosen"), "placed"
    )
    return ids.join(placed, "node", "left").selectExpr(
        "doc_id", "coalesce(class_id, doc_id) as class_id",
        "case when node is null then doc_id else chosen.doc_id end as group_id",
        "node is null or (chosen.doc_id <=> doc_id and chosen.text_hash <=> text_hash) as kept",
        "text_hash", "node is not null as has_words",
    )


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays, and every
    row whose text is null or without a word, for it is like no other."""
    kept = near_duplicates(docs, similarity).where("kept").selectExpr(
        "doc_id is null as no_id", "coalesce(doc_id, 0L) as id", "coalesce(text_hash, 0L) as hash",
        "has_words",
    ).distinct()
    rows = docs.select(whole_rows(docs).alias("row")).selectExpr(
        "row", "cast(row.doc_id as long) is null as no_id", "coalesce(cast(row.doc_id as long), 0L) as id",
        "coalesce(xxhash64(cast(row.text as string)), 0L) as hash",
    )
    keys = ["no_id", "id", "hash"]
    found = rows.join(kept, keys).withColumn("own", F.expr("if(has_words, -1L, monotonically_increasing_id())"))
    return found.dropDuplicates([*keys, "own"]).select(
        *(F.col("row")[c].alias(c) for c in docs.columns)
    )
