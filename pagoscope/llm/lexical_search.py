"""Ranked lexical search: an Aho-Corasick automaton of all item terms scans every text.

Items (the queries) are few, documents many, so no index of documents is built. The terms of the
items, each between two guards, make one automaton. A text is brought to the same form, with
A-Z lower-cased and every byte outside a term turned into a guard, and scanned once: each match
is an occurrence of a whole term, so the matches counted by term are the tf of all items at once.
The automaton's outputs, term numbers, map to the items that hold the term.

A first scan counts documents, terms and document frequencies, added up in each task; a second
scans again, scores each document for every item that shares a term, and keeps the best documents
of each item per task. These meet in two steps, so that an item's rows from all tasks are never
sorted in one.

Scores are integers: a document of n terms has m = 100 - 90 + ((90 * n * N) div L), a term the
weight w = floor(1000 * ln((2 N + 2) / (2 df + 1))), and the score sums
w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the item's terms.

Defined cases: a null or empty text has no terms, neither as a document nor as an item; a term
counts once per item; items are rows, so a repeated item_id is answered as often as it occurs;
repeated documents are ranked each; equal scores go by doc_id, a null one last; texts are scanned
whole whatever their length; empty tables give an empty table; other columns are ignored.

What is sent to the tasks is bounded: items are dealt into blocks of about ``BLOCK`` (item, term)
pairs, and the documents are scanned block by block. A single item is never split.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import shared_path, written

TOP = 10
BLOCK = 200_000      # (item, term) pairs of an automaton
ROWS = 256           # documents scored together
CELLS = 4_000_000    # bounds the postings and scores held for them
FOLD = 256           # tasks whose best documents are ranked together first
NO_ID = np.iinfo(np.int64).max

# Bytes of a term are digits, letters and all bytes over 127
GUARD = 0x20
_FORM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else GUARD
    for b in range(256)
)


def guarded(text: bytes) -> bytes:
    """The UTF-8 text lower-cased, with guards for all that is no term, and one at either end."""
    return b" " + text.translate(_FORM) + b" "


def terms_of(text: str) -> list[bytes]:
    return guarded(text.encode()).split()


def count_terms(form: bytes) -> int:
    """Terms of a guarded text: places where one begins."""
    inside = np.frombuffer(form, np.uint8) != GUARD
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


@dataclass
class Items:
    """The items of a block: their terms, and for each term the places of its items."""

    terms: list[bytes]
    starts: np.ndarray          # term number -> first of its postings
    items: np.ndarray           # postings: places of items
    ids: list                   # place of an item -> item_id
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def of(pairs: list[tuple[int, object, bytes]]) -> Items:
        """From (row, item_id, term) of distinct terms per row."""
        places: dict[int, int] = {}
        ids: list = []
        by_term: dict[bytes, list[int]] = {}
        for row, item_id, term in pairs:
            if row not in places:
                places[row] = len(ids)
                ids.append(item_id)
            by_term.setdefault(bytes(term), []).append(places[row])
        terms = sorted(by_term)
        lengths = [len(by_term[t]) for t in terms]
        return Items(
            terms, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            np.array([i for t in terms for i in by_term[t]], np.int64), ids,
        )


_AUTOMATA: dict[str, object] = {}


def automaton_of(items: Items):
    """The automaton of the block's guarded terms; a worker keeps the last one."""
    if items.key not in _AUTOMATA:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, term in enumerate(items.terms):
            # one character per byte
            automaton.add_word((b" " + term + b" ").decode("latin-1"), number)
        automaton.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[items.key] = automaton
    return _AUTOMATA[items.key]


def frequencies(automaton, form: bytes) -> dict[int, int]:
    """Occurrences of each item term in a guarded text. Two terms in a row share their guard,
    so every occurrence is found although matches overlap."""
    return Counter(map(itemgetter(1), automaton.iter(form.decode("latin-1"))))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass(frozen=True)
class Corpus:
    documents: int
    terms: int


def _forms(batches: Iterator) -> Iterator[tuple[list, list[bytes]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch.column("doc_id").to_pylist(), [guarded(t) for t in batch.column("text").to_pylist()]


def _statistics(texts: DataFrame, items: Items) -> tuple[Corpus, np.ndarray]:
    """Documents and terms of the corpus, and the document frequency of each item term."""
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton, holding, documents, total = automaton_of(items), np.zeros(len(items.terms), np.int64), 0, 0
        for _, forms in _forms(batches):
            for form in forms:
                n = count_terms(form)
                documents, total = documents + (n > 0), total + n
                found = frequencies(automaton, form)
                holding[np.fromiter(found, np.int64, len(found))] += 1
        seen = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], seen]), pa.int64()),
             pa.array(np.concatenate([[documents, total], holding[seen]]), pa.int64())], names=["term", "n"],
        )

    sums = dict(
        texts.mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    )
    holding = np.array([sums.get(t, 0) for t in range(len(items.terms))], np.int64)
    return Corpus(sums.get(-2, 0), sums.get(-1, 0)), holding


class Best:
    """The best documents of every item, so far."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.scores = np.zeros((top, items), np.int64)
        self.docs = np.full((top, items), NO_ID, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` (documents, items); equal ones by document id."""
        better = np.flatnonzero((scores >= self.scores[-1]).any(axis=0) & (scores > 0).any(axis=0))
        if not len(better):
            return
        all_scores = np.vstack([self.scores[:, better], scores[:, better]])
        all_docs = np.vstack([self.docs[:, better], np.broadcast_to(docs[:, None], (len(docs), len(better)))])
        order = np.lexsort((all_docs, -all_scores), axis=0)[: self.top]
        self.scores[:, better] = np.take_along_axis(all_scores, order, axis=0)
        self.docs[:, better] = np.take_along_axis(all_docs, order, axis=0)


def impacts(found: dict[int, int], n: int, corpus: Corpus, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of a document and what each adds to an item's score."""
    m = 100 - 90 + (90 * n * corpus.documents) // corpus.terms
    term = np.fromiter(found.keys(), np.int64, len(found))
    tf = np.fromiter(found.values(), np.int64, len(found))
    return term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _scored(texts: DataFrame, items: Items, corpus: Corpus, holding: np.ndarray, top: int) -> DataFrame:
    """(place, doc_id, score, task): the best documents of each item in each task."""
    weights = np.array([weight(corpus.documents, int(h)) for h in holding], np.int64)
    together = max(1, min(ROWS, CELLS // max(1, len(items.ids), len(items.items))))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        automaton, best = automaton_of(items), Best(len(items.ids), top)
        lengths = np.diff(items.starts)
        for ids, forms in _forms(batches):
            for at in range(0, len(ids), together):
                part = forms[at:at + together]
                scores = np.zeros((len(part), len(items.ids)), np.int64)
                for row, form in zip(scores, part, strict=True):
                    found = frequencies(automaton, form)
                    if found:
                        term, adds = impacts(found, count_terms(form), corpus, weights)
                        many = lengths[term]
                        firsts = np.repeat(items.starts[term] - np.cumsum(many) + many, many)
                        np.add.at(row, items.items[firsts + np.arange(len(firsts))], np.repeat(adds, many))
                docs = np.array([NO_ID if i is None else i for i in ids[at:at + together]], np.int64)
                best.add(docs, scores)
        rank, place = np.nonzero(best.scores > 0)
        doc = best.docs[rank, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(doc, pa.int64(), mask=doc == NO_ID),
             pa.array(best.scores[rank, place], pa.int64()),
             pa.array(np.full(len(place), TaskContext.get().partitionId()), pa.int32())],
            names=["place", "doc_id", "score", "task"],
        )

    return texts.mapInArrow(scan, "place int, doc_id long, score long, task int")


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = f"partition by {', '.join(keys)} order by score desc, doc_id asc nulls last"
    return found.withColumn("rank", F.expr(f"row_number() over ({order})")).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Per item its ``top`` documents with a score over 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )

    def pairs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [
                (row, item, term)
                for row, item, text in zip(*(batch.column(c).to_pylist() for c in ("row", "item_id", "text")), strict=True)
                for term in dict.fromkeys(terms_of(text or ""))
            ]
            row, item, term = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(item, pa.int64()), pa.array(term, pa.binary())],
                names=["row", "item_id", "term"],
            )

    wanted = written(
        items.select(
            F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
            F.monotonically_increasing_id().alias("row"),
        ).mapInArrow(pairs, "row long, item_id long, term binary"),
        "items",
    )
    blocks = max(1, -(-wanted.count() // block))
    whole, path = None, shared_path(spark, "search")
    schema = "item_row int, item_id long, doc_id long, score long, rank int"
    dealt = wanted.withColumn("block", F.expr(f"cast(pmod(xxhash64(row), {blocks}) as int)"))
    for number in range(blocks):
        mine = Items.of(dealt.where(F.col("block") == number).select("row", "item_id", "term").collect())
        if not mine.terms:
            continue
        whole, holding = _statistics(texts, mine)
        if not whole.terms:
            break
        found = written(_scored(texts, mine, whole, holding, top), "found")
        few = _ranked(found.withColumn("fold", F.expr(f"task div {FOLD}")), ["place", "fold"], top)
        ids = spark.createDataFrame(list(enumerate(mine.ids)), "place int, item_id long")
        _ranked(few.drop("rank"), ["place"], top).join(F.broadcast(ids), "place").select(
            F.col("place").alias("item_row"), "item_id", "doc_id", "score", "rank"
        ).write.parquet(f"{path}/block={number}")
    if whole is None or not whole.terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return spark.read.schema(f"{schema}, block int").parquet(path).select("item_id", "rank", "doc_id", "score")
