"""SentencePiece encoding with N-best segmentations, and decoding.

The lattice of a text has its characters as nodes and the vocabulary's pieces as edges; a
character without a piece is one edge of byte pieces. A forward Viterbi pass gives the best
score from the start to each node. That score is an exact heuristic for an A* search from
the end backwards, which therefore yields the segmentations in order of their total score.

No piece reaches over the end of a chunk (a word with its leading spaces), so the lattice is
a row of small ones. For each chunk the passes give the best path and how much the next best
costs; only the N - 1 chunks with the cheapest alternatives can differ in the N best of the
text. Their own N best, found by A*, form a small lattice, on which the same search runs.

Encoding adds the dummy space of the model and decoding takes it away; a literal U+2581 is
encoded as bytes, so every text comes back exactly.

Defined cases: a null text has null pieces, no segmentation, and counts as restored; an empty
text has no pieces, score 0 and one segmentation; ties are broken by the search order, the
same on every run; lone surrogates cannot occur; an empty table gives an empty table; other
columns are ignored.

The distinct new chunks of a batch are worked out together: for chunks of one length both
passes run as array operations over all of them, with the pieces found by a rolling hash of 64
bits and their outer characters. Single chunks take the same passes character by character; results are equal.

At scale: one pass without a shuffle; memory grows with the longest text only, and the
chunks that a worker remembers are bounded: when they are too many, the frequent ones stay. A very long text is encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm import sentencepiece_model as spm
from pagoscope.llm.common import documents

N_BEST = 4
BYTE_SCORE = -50_000.0  # of one byte piece: below any ordinary piece's
MEMORY = 150_000        # chunks that a worker remembers
LISTED = 20_000         # chunks whose n best segmentations a worker remembers
LONGEST_KEPT = 48       # characters; longer chunks are worked out one by one and not remembered
TOGETHER = 8192         # chunks of one length that are worked out together
FEW = 4                 # fewer than these are not worth the arrays
SLOT_BITS = 20          # of the table in which pieces are looked up by hash
NEVER = float("-inf")
SPACES = re.compile(r" *[^ ]+| +")
SCHEMA = (
    "doc_id long, pieces array<int>, n_pieces long, score double, "
    "nbest_scores array<double>, restored boolean"
)

Edge = tuple[int, float, object]  # where it starts, its score, what it stands for


def a_star(end: int, forward: Callable[[int], float], into: Callable[[int], Iterable[Edge]], n: int) -> list[tuple[float, list]]:
    """The n best paths from node 0 to ``end``: total score and what the edges stand for.

    ``forward`` is the best score from 0 to a node: no estimate, so each path that reaches
    node 0 is the best of those not yet given out.
    """
    found, order = [], itertools.count()
    queue = [(-forward(end), next(order), 0.0, end, None)]
    while queue and len(found) < n:
        _, _, behind, node, path = heapq.heappop(queue)
        if node == 0:
            items = []
            while path is not None:
                items.append(path[0])
                path = path[1]
            found.append((behind, items))
            continue
        for start, score, item in into(node):
            heapq.heappush(queue, (-(forward(start) + score + behind), next(order), score + behind, start, (item, path)))
    return found


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, tuple[tuple[int, ...], float] | None], int, list[int], list[bytes]]:
    """Pieces and their beginnings (None) with spaces for marks; the longest piece; the ids
    of bytes; the bytes of each id."""
    ordinary, byte_ids = spm.pieces(path)
    trie: dict[str, tuple[tuple[int, ...], float] | None] = {}
    for piece, (number, score) in ordinary.items():
        text = piece.replace(spm.MARK, " ")
        for k in range(1, len(text)):
            trie.setdefault(text[:k], None)
        trie[text] = ((number,), score)
    raw = [b""] * spm.load(path).get_piece_size()
    for piece, (number, _) in ordinary.items():
        raw[number] = piece.replace(spm.MARK, " ").encode()
    for value, number in enumerate(byte_ids):
        raw[number] = bytes([value])
    return trie, max(map(len, ordinary)), byte_ids, raw


_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class PieceTable:
    """Pieces by a rolling hash of their characters, checked by length and outer characters."""

    def __init__(self, path: str) -> None:
        trie, self.longest, _, _ = vocabulary(path)
        by_length: dict[int, list] = {}
        for text, piece in trie.items():
            if piece:
                by_length.setdefault(len(text), []).append((text, piece))
        keys, outer, ids, scores = [], [], [], []
        for length, group in by_length.items():
            codes = code_points([text for text, _ in group], length)
            *_, last = rolled(codes)
            keys.append(last), outer.append(ends_of(codes[0], codes[-1], length))
            ids.extend(piece[0][0] for _, piece in group)
            scores.extend(piece[1] for _, piece in group)
        order = np.argsort(np.concatenate(keys))
        self.keys, self.outer = np.concatenate(keys)[order], np.concatenate(outer)[order]
        self.ids, self.scores = np.array(ids, np.int32)[order], np.array(scores)[order]
        # open addressing: a piece lies in its slot or in one of the next few
        self.slots, self.probes = np.full(2**SLOT_BITS + len(order), -1, np.int32), 0
        for number, at in enumerate(self._slot(self.keys).tolist()):
            last = at
            while self.slots[last] >= 0:
                last += 1
            self.slots[last] = number
            self.probes = max(self.probes, last - at + 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray, outer: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Fill in ``ids`` and ``scores`` of the substrings that are pieces."""
        at = self._slot(keys)
        found = self.slots[at]
        maybe = np.flatnonzero(found >= 0)
        found, at = found[maybe], at[maybe]
        for probe in range(1, self.probes + 1):
            same = self.keys[found] == keys[maybe]
            hits, piece = maybe[same], found[same]
            good = self.outer[piece] == outer[hits]
            ids[hits[good]], scores[hits[good]] = self.ids[piece[good]], self.scores[piece[good]]
            at, maybe = at[~same], maybe[~same]
            found = self.slots[at + probe]
            at, maybe, found = at[found >= 0], maybe[found >= 0], found[found >= 0]
            if not len(maybe):
                break


def code_points(texts: list[str], length: int) -> np.ndarray:
    """(length, n) code points of texts of equal length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)
    return np.ascontiguousarray(codes.T).astype(np.uint64)


def rolled(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the first 1, 2, ... characters."""
    total = np.zeros(codes.shape[1], np.uint64)
    for line in codes:
        total = (total + line + np.uint64(1)) * _BASE
        yield total


def ends_of(first: np.ndarray, last: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return (first << np.uint64(21) | last) << np.uint64(8) | np.asarray(length, np.uint64)


@functools.lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values."""
    return values if size <= len(values) else np.concatenate([values, np.zeros(2 * size - len(values), values.dtype)])


class Known(Mapping):
    """Chunks with their best pieces, the score of these and what the next best loses: a number
    for each chunk, the rest in arrays by number."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.starts = np.zeros(4096, np.int32), np.zeros(1024, np.int64)
        self.scores, self.losses, self.used = np.zeros(1024), np.zeros(1024), np.zeros(1024, np.int32)

    def __len__(self) -> int:
        return len(self.numbers)

    def __iter__(self) -> Iterator[str]:
        return iter(self.numbers)

    def __contains__(self, text: object) -> bool:
        return text in self.numbers

    def __getitem__(self, text: str) -> tuple[tuple[int, ...], float, float]:
        at = self.numbers[text]
        return tuple(self.flat[self.starts[at]:self.starts[at + 1]].tolist()), float(self.scores[at]), float(self.losses[at])

    def add(self, texts: list[str], flat: np.ndarray, sizes: np.ndarray, scores: np.ndarray, losses: np.ndarray) -> None:
        at, end = len(self.numbers), len(self.numbers) + len(texts)
        self.numbers.update(zip(texts, range(at, end), strict=True))
        self.starts, self.scores, self.losses, self.used = (
            grown(x, end + 1) for x in (self.starts, self.scores, self.losses, self.used)
        )
        self.starts[at + 1:end + 1] = self.starts[at] + np.cumsum(sizes)
        self.flat = grown(self.flat, int(self.starts[end]))
        self.flat[self.starts[at]:self.starts[end]] = flat
        self.scores[at:end], self.losses[at:end], self.used[at:end] = scores, losses, 0

    def of(self, texts: list[str]) -> tuple[np.ndarray, float, np.ndarray] | None:
        """Pieces in a row, score and losses by chunk of a text's chunks, if all are here."""
        numbers = list(map(self.numbers.get, texts))
        if None in numbers:
            self.used[[n for n in numbers if n is not None]] += 1
            return None
        at = np.array(numbers, np.int64)
        self.used[at] += 1
        starts = self.starts[at]
        return gathered(self.flat, starts, self.starts[at + 1] - starts), sum(self.scores[at].tolist()), self.losses[at]

    def forget(self, most: int, needed: set[str]) -> None:
        """Only the ``needed`` chunks stay and, of those in several texts, the ``most`` frequent."""
        texts, used = list(self.numbers), self.used[:len(self.numbers)]
        order = np.argsort(-used, kind="stable")[:most]
        stay = np.zeros(len(used), bool)
        stay[order[used[order] > 1]] = True
        stay[[self.numbers[c] for c in needed if c in self.numbers]] = True
        at = np.flatnonzero(stay)
        sizes = self.starts[at + 1] - self.starts[at]
        kept = Known()
        kept.add([texts[k] for k in at.tolist()], gathered(self.flat, self.starts[at], sizes), sizes, self.scores[at], self.losses[at])
        kept.used[:len(at)] = used[at] // 2
        self.__dict__ = kept.__dict__


class Codec:
    def __init__(self, path: str) -> None:
        if not spm.marks_lead(path):
            raise ValueError("the model has pieces that reach over a word's end")
        self.trie, self.longest, self.byte_ids, self.raw = vocabulary(path)
        self.table = piece_table(path)
        self.known = Known()
        self.listed: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    def _single(self, character: str) -> tuple[tuple[int, ...], float]:
        piece = self.trie.get(character)
        if piece is not None:
            return piece
        ids = tuple(self.byte_ids[b] for b in character.encode())
        return ids, BYTE_SCORE * len(ids)

    def edges(self, text: str, start: int) -> list[tuple[int, tuple[tuple[int, ...], float]]]:
        """The edges from a place: where each ends, its pieces and score."""
        get = self.trie.get
        found = [(start + 1, get(text[start]) or self._single(text[start]))]
        if text[start] not in self.trie:
            return found
        for end in range(start + 2, min(start + self.longest, len(text)) + 1):
            piece = get(text[start:end], 0)
            if piece:
                found.append((end, piece))
            elif piece == 0:
                break
        return found

    def forward(self, text: str) -> list[float]:
        """Viterbi: the best score from the start to each place."""
        best = [0.0] + [-np.inf] * len(text)
        for start in range(len(text)):
            here = best[start]
            for end, (_, score) in self.edges(text, start):
                if here + score > best[end]:
                    best[end] = here + score
        return best

    def chunk(self, text: str) -> tuple[tuple[int, ...], float, float]:
        """Best pieces of a chunk, their score, and what the next best loses (inf if none).

        A pass forward and one back give, for each edge, the best path through it.
        """
        n, short = len(text), len(text) <= LONGEST_KEPT
        best, came, by = [0.0] + [NEVER] * n, [0] * (n + 1), [()] * (n + 1)
        kept, get, longest = [], self.trie.get, self.longest
        for start in range(n):
            here, piece = best[start], get(text[start], False)
            more = piece is not False
            ids, score = piece or self._single(text[start])
            end, value = start + 1, here + score
            if value > best[end]:
                best[end], came[end], by[end] = value, start, ids
            edges = [(end, score)]
            if more:
                for end in range(start + 2, min(start + longest, n) + 1):
                    piece = get(text[start:end], False)
                    if piece:
                        ids, score = piece
                        value = here + score
                        if value > best[end]:
                            best[end], came[end], by[end] = value, start, ids
                        edges.append((end, score))
                    elif piece is False:
                        break
            if short:
                kept.append(edges)
        taken, ids, end = {}, [], n
        while end:
            ids.append(by[end])
            taken[came[end]] = end
            end = came[end]
        rest, loss, total = [0.0] * (n + 1), -NEVER, best[n]
        for start in range(n - 1, -1, -1):
            onward, next_cut = NEVER, taken.get(start)
            for end, score in kept[start] if short else [(e, p[1]) for e, p in self.edges(text, start)]:
                value = score + rest[end]
                if value > onward:
                    onward = value
                if end != next_cut and total - best[start] - value < loss:
                    loss = total - best[start] - value
            rest[start] = onward
        flat = ids[0] if len(ids) == 1 else tuple([i for part in reversed(ids) for i in part])
        return flat, total, loss

    def _together(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """:meth:`chunk` for chunks of one length, by the same passes over arrays: the pieces in a
        row, and by chunk their number, score and what the next best loses."""
        m, n = len(texts), len(texts[0])
        codes, every = code_points(texts, n), np.arange(len(texts))
        most = min(self.longest, n)
        number, score = np.full((n, most, m), -1, np.int32), np.full((n, most, m), NEVER)
        for start in range(n):
            part = codes[start:start + most]
            size = np.arange(1, len(part) + 1, dtype=np.uint64)[:, None]
            self.table.find(
                np.concatenate(list(rolled(part))), ends_of(codes[start], part, size).ravel(),
                number[start, :len(part)].reshape(-1), score[start, :len(part)].reshape(-1),
            )
        n_bytes = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
        score[:, 0] = np.where(number[:, 0] < 0, BYTE_SCORE * n_bytes, score[:, 0])
        edges = [[k for k in range(min(most, n - start)) if not k or number[start, k].max() >= 0] for start in range(n)]
        best, came = np.full((n + 1, m), NEVER), np.zeros((n + 1, m), np.int32)
        best[0] = 0.0
        for start in range(n):
            for k in edges[start]:
                value, end = best[start] + score[start, k], start + k + 1
                better = value > best[end]
                np.copyto(best[end], value, where=better)
                np.copyto(came[end], start, where=better)
        total, end, pieces, places = best[n], np.full(m, n), [], []
        cut = np.zeros((n, m), np.int64)  # where the best path's edge from a place ends
        while end.any():
            start, on = came[end, every], end > 0
            pieces.append(np.where(on, number[start, np.maximum(end - start, 1) - 1, every], -2))
            places.append(start)
            cut[start[on], every[on]] = end[on]
            end = np.where(on, start, 0)
        rest, loss = np.zeros((n + 1, m)), np.full(m, np.inf)
        for start in range(n - 1, -1, -1):
            onward, ahead = np.full(m, NEVER), total - best[start]
            for k in edges[start]:
                value = score[start, k] + rest[start + k + 1]
                np.maximum(onward, value, out=onward)
                np.minimum(loss, ahead - value, out=loss, where=cut[start] != start + k + 1)
            rest[start] = onward
        rows = np.array(pieces)[::-1].T
        sizes = (rows >= 0).sum(axis=1)
        if (rows != -1).all():
            return rows[rows >= 0], sizes, total, loss
        # characters that are bytes: each stands for several pieces
        chunk, place = np.nonzero(rows == -1)
        codes = codes[np.array(places)[::-1].T[chunk, place], chunk]
        distinct, which = np.unique(codes, return_inverse=True)
        spelled = [self._single(chr(c))[0] for c in distinct.tolist()]
        lengths = np.array([len(ids) for ids in spelled])
        wide = (rows >= 0).astype(np.int64)
        wide[chunk, place] = lengths[which]
        sizes = wide.sum(axis=1)
        wide = wide[rows >= -1]
        flat = np.repeat(rows[rows >= -1], wide)
        flat[flat < 0] = gathered(
            np.array(list(itertools.chain.from_iterable(spelled)), np.int32), (np.cumsum(lengths) - lengths)[which], lengths[which]
        )
        return flat, sizes, total, loss

    def learn(self, chunks: set[str]) -> None:
        """Work out the new ones of these chunks; when too many are remembered, others go."""
        by_length: dict[int, list[str]] = {}
        for text in chunks.difference(self.known.numbers):
            if len(text) <= LONGEST_KEPT:
                by_length.setdefault(len(text), []).append(text)
        if by_length and len(self.known) + sum(map(len, by_length.values())) > MEMORY:
            self.known.forget(MEMORY // 2, chunks)
        for group in by_length.values():
            for at in range(0, len(group), TOGETHER):
                part = group[at:at + TOGETHER]
                if len(part) >= FEW:
                    self.known.add(part, *self._together(part))
                    continue
                for text in part:
                    ids, score, loss = self.chunk(text)
                    self.known.add([text], np.array(ids, np.int32), np.array([len(ids)]), np.array([score]), np.array([loss]))

    def chunk_nbest(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a chunk by A*; those of frequent chunks are remembered."""
        found = self.listed.get((text, n))
        if found is not None:
            return found
        best = self.forward(text)

        def into(end: int) -> Iterator[Edge]:
            ids, score = self._single(text[end - 1])
            yield end - 1, score, ids
            for start in range(end - 2, max(-1, end - self.longest - 1), -1):
                piece = self.trie.get(text[start:end])
                if piece:
                    yield start, piece[1], piece[0]

        found = [
            (score, tuple(itertools.chain.from_iterable(path)))
            for score, path in a_star(len(text), best.__getitem__, into, n)
        ]
        if len(text) <= LONGEST_KEPT:
            if len(self.listed) >= LISTED:
                self.listed.clear()
            self.listed[text, n] = found
        return found

    @staticmethod
    def chunks(text: str) -> list[str]:
        words = text.split(" ")
        if "" not in words:
            return [" " + w for w in words]
        return SPACES.findall(" " + text)

    def encode(self, text: str, chunks: list[str] | None = None) -> tuple[list, float, np.ndarray, list[str]]:
        """Pieces by chunk, total score, losses by chunk, chunks; of a text that isn't empty."""
        chunks = chunks or self.chunks(text)
        found = list(map(self.known.get, chunks))
        if None in found:
            self.learn({c for c, r in zip(chunks, found, strict=True) if r is None})
            found = [r or self.known.get(c) or self.chunk(c) for c, r in zip(chunks, found, strict=True)]
        ids, scores, losses = zip(*found, strict=True)
        return ids, float(sum(scores)), np.array(losses), chunks

    def flat(self, text: str, chunks: list[str]) -> tuple[np.ndarray, float, np.ndarray]:
        """:meth:`encode` with the pieces in a row."""
        found = self.known.of(chunks)
        if found is not None:
            return found
        ids, total, losses, _ = self.encode(text, chunks)
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32), total, losses

    def nbest(self, text: str, n: int = N_BEST) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The n best segmentations: total score, and the chunks that differ from the best."""
        if not text:
            return [(0.0, {})]
        _, total, losses, chunks = self.encode(text)
        return self._nbest(total, losses, chunks, n)

    def _nbest(self, total: float, losses: np.ndarray, chunks: list[str], n: int) -> list:
        open_places = np.flatnonzero(np.isfinite(losses))
        if n <= 1 or not len(open_places):
            return [(total, {})]
        cheap = open_places[np.argsort(losses[open_places], kind="stable")[:n - 1]].tolist()
        choices = [self.chunk_nbest(chunks[place], n) for place in cheap]
        # a lattice with one step for each of those chunks; scores relative to the best
        def into(node: int) -> Iterator[Edge]:
            top = choices[node - 1][0][0]
            for k, (score, _) in enumerate(choices[node - 1]):
                yield node - 1, score - top, (node - 1, k)

        return [
            (total + loss, {cheap[at]: choices[at][k][1] for at, k in path if k})
            for loss, path in a_star(len(cheap), lambda node: 0.0, into, n)
        ]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the pieces; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker, so that what it remembers serves its later tasks."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """Per document: doc_id, pieces, n_pieces, score, nbest_scores (best first), restored:
    whether decoding the pieces gives the text back."""
    path = model_path or spm.default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = codec(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                flat, ends, scores, best, same, missing = [np.zeros(0, np.int32)], [0], [], [], [], []
                texts = batch.column("text").to_pylist()
                split = [own.chunks(t) if t else [] for t in texts]
                own.learn(set().union(*split))
                for text, parts in zip(texts, split, strict=True):
                    missing.append(text is None)
                    if not text:
                        ends.append(ends[-1])
                        scores.append(None if text is None else 0.0)
                        best.append(None if text is None else [0.0])
                        same.append(True)
                        continue
                    ids, total, losses = own.flat(text, parts)
                    flat.append(ids)
                    same.append(own.decode(ids.tolist()) == text)
                    ends.append(ends[-1] + len(ids))
                    scores.append(total)
                    best.append([score for score, _ in own._nbest(total, losses, parts, n_best)])
                offsets = pa.array(ends, pa.int32(), mask=np.array([*missing, False]))
                pieces = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pieces, pa.array(np.diff(ends), pa.int64()), pa.array(scores, pa.float64()),
                     pa.array(best, pa.list_(pa.float64())), pa.array(same, pa.bool_())],
                    names=["doc_id", "pieces", "n_pieces", "score", "nbest_scores", "restored"],
                )

    return documents(docs).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces)."""
    path = model_path or spm.default_path()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        own = codec(path)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "text": [None if p is None else own.decode(p) for p in batch["pieces"]],
            })

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "pieces").mapInPandas(
        run, "doc_id long, text string"
    )


def segmentations(docs: DataFrame, model_path: str | None = None, n_best: int = N_BEST) -> DataFrame:
    """A row per document and rank: doc_id, rank (from 1), score, pieces."""
    path = model_path or spm.default_path()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        own = codec(path)
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                if text is None:
                    continue
                ids, total, losses, chunks = own.encode(text) if text else ((), 0.0, np.array([]), [])
                rows = []
                for rank, (score, changed) in enumerate(own._nbest(total, losses, chunks, n_best), 1):
                    parts = [changed.get(k, part) for k, part in enumerate(ids)]
                    rows.append((doc, rank, score, list(itertools.chain.from_iterable(parts))))
                yield pd.DataFrame(rows, columns=["doc_id", "rank", "score", "pieces"])

    return documents(docs).mapInPandas(run, "doc_id long, rank int, score double, pieces array<int>")
