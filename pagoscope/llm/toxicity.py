"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

Units are the words of a text, and runs of single characters joined ("i d i o t"). The kernel
compares two units by the triples of letters that they hold in order, gaps allowed up to a
span of ``SPAN`` and each place of span costing a factor ``DECAY``: inserted characters widen
gaps but do not hide an insult. A Nystroem map over landmark units makes the machine linear.
Its weights fold into one table by letter triple, so a unit's exact margin is a sum of table
look-ups, whatever the number of landmarks.

Training: of the labelled rows, the ``SAMPLE_DOCS`` distinct texts of either label with the smallest
hash, at most ``SAMPLE_CHARS`` characters in even cuts of each (the driver's memory bound).
The machine learns from labelled sentences, as a multiple-instance machine: the margin of a
sentence is the largest of its units'. A sentence of a toxic text is labelled toxic if it holds
a telling unit: one that more toxic texts hold than chance allows (``CHANCE``, over all units
tested) and with odds of ``ODDS`` at least; its other sentences have no label. Sentences of
other texts are labelled clean. Each toxic sentence stands for the unit that is its witness, at
first a telling one, then the one with the largest margin; all units of clean sentences are
negative, but for telling ones and rare ones that are more frequent in toxic texts. A
logistic layer turns a text's largest margins into a probability.

Defined cases: a null or empty text has no unit and gets the score of such a text, near 0;
without labelled rows of both kinds every score is 0; equal texts get equal scores; an empty
table gives an empty table; other columns are ignored.

At scale: the sample is counted and chosen by keys with map-side combine; scoring is one pass without a shuffle, over
chunks of documents, with a bounded memory of margins by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import documents, sampled

SPAN, DECAY = 7, 0.5
LANDMARKS = 64           # negative ones; up to twice as many positive ones
FOLDS = 3
NEGATIVES = 2000         # units of clean sentences at first; half as many join in each of two rounds
SENTENCE_WORDS = 40      # longer sentences are cut
ODDS, CHANCE = 8, 0.05
PLAIN = 0.01             # share of the clean texts from which on a unit is plain, whatever its odds
SAMPLE_DOCS = 1500
SAMPLE_CUTS, SAMPLE_CHARS = 8, 6000
WIDTH = 24               # characters of a unit; longer words are cut into overlapping ones
MEMORY = 400_000
TOXIC = 0.7
SCHEMA = "doc_id long, score double, predicted int"

SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+|\n+")

# Characters often put in place of a letter.
STAND_INS = str.maketrans("013457@$", "oieastas")
_CLASSES = 40            # 0 pads, 1..26 letters, 27..38 other letters by code, 39 anything else
_LETTERS = 38
_SHAPES = [(i, j) for i in range(1, SPAN - 1) for j in range(1, SPAN - i)]


def units_of(word: str) -> list[str]:
    """The units of one word: lower case, without marks at its ends."""
    core = word.lower().strip(".,;:!?\"'()[]{}<>|#*$%&-_/\\")
    if len(core) <= WIDTH:
        return [core] if core else []
    return [core[i:i + WIDTH] for i in range(0, len(core) - WIDTH // 2, WIDTH // 2)]


def spelled_out(words: list[str]) -> list[str]:
    """Runs of three or more single characters, joined."""
    found, run = [], []
    for w in [*words, ""]:
        core = w.strip(".,;:!?\"'()*-_") if len(w) <= 4 else ""
        if len(core) == 1:
            run.append(core)
            continue
        if len(run) >= 3:
            found.append("".join(run))
        run = []
    return found


def sentences(text: str) -> list[list[str]]:
    """The distinct units of each sentence; sentences without a unit are left out."""
    found = []
    for sentence in SENTENCE_END.split(text):
        words = sentence.split()
        for at in range(0, len(words), SENTENCE_WORDS):
            part = words[at:at + SENTENCE_WORDS]
            units = {u for w in [*part, *spelled_out(part)] for u in units_of(w) if len(u) >= 3}
            if units:
                found.append(sorted(units))
    return found


def codes(units: list[str], width: int = WIDTH) -> np.ndarray:
    """Character classes, one row per unit, padded so that every triple can be read."""
    room = width + SPAN
    text = "".join([u[:width].ljust(room, "\0") for u in units]).translate(STAND_INS)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), room).astype(np.int32)
    classes = np.where(points >= 170, 27 + points % 12, 39)
    classes = np.where((points >= 97) & (points <= 122), points - 96, classes)
    return np.where(points == 0, 0, classes).astype(np.int32)


def triples(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Shape by shape of gaps: feature numbers, which of them hold three letters, weight."""
    width = rows.shape[1] - SPAN
    letter = (rows > 0) & (rows <= _LETTERS)
    for i, j in _SHAPES:
        a, b, c = rows[:, :width], rows[:, i:width + i], rows[:, i + j:width + i + j]
        there = letter[:, :width] & letter[:, i:width + i] & letter[:, i + j:width + i + j]
        yield (a * _CLASSES + b) * _CLASSES + c, there, DECAY ** (i + j + 1)


def kernel(units: list[str], table: np.ndarray) -> np.ndarray:
    """Normalised kernel sums of the units with the columns of ``table`` (features x columns),
    whose rows of triples with anything but letters are zero."""
    out = np.zeros((len(units), table.shape[1]), np.float32)
    step = max(64, 400_000 // table.shape[1] // WIDTH)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    for at in range(0, len(units), step):
        part = order[at:at + step]
        width = min(WIDTH, max(4, len(units[part[-1]])))
        total, square = np.zeros((len(part), table.shape[1]), np.float32), np.zeros(len(part))
        for numbers, there, weight in triples(codes([units[i] for i in part], width)):
            total += table.take(numbers, axis=0).sum(axis=1) * np.float32(weight)
            square += there.sum(axis=1) * weight**2
        out[part] = total / np.sqrt(np.maximum(square, 1e-9))[:, None]
    return out


def features(units: list[str]) -> np.ndarray:
    """Explicit kernel features, one column per unit; for landmarks only."""
    out = np.zeros((_CLASSES**3, len(units)), np.float32)
    square, columns = np.zeros(len(units)), np.arange(len(units))[:, None]
    for numbers, there, weight in triples(codes(units)):
        np.add.at(out, (numbers, columns), there * np.float32(weight))
        square += there.sum(axis=1) * weight**2
    return out / np.sqrt(np.maximum(square, 1e-9)).astype(np.float32)


def margins(units: list[str], table: np.ndarray, offset: float) -> np.ndarray:
    """The machine's value for each unit; a unit without a triple has the offset alone."""
    return kernel(units, table)[:, 0] + offset


@dataclass
class Machine:
    table: np.ndarray     # one column: margin weight by letter triple
    offset: float
    layer: np.ndarray     # logistic layer over ``summary``


def summary(values: np.ndarray) -> np.ndarray:
    """What the logistic layer sees of a text: its two largest margins (of those between
    -0.5 and 1, where the machine is unsure) and how many are large."""
    top = np.sort(values)[::-1][:2]
    top = np.pad(top, (0, 2 - len(top)), constant_values=-0.5)
    return np.array([1.0, *np.clip(top, -0.5, 1), np.log1p((values > 0.5).sum()), np.log1p((values > 0.8).sum())])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine by full gradient steps on the squared hinge loss."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = 1e-4 * np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(steps):  # Newton steps over the active set settle in a few rounds
        active = y * (x1 @ w) < 1
        a, v = x1[active], weight[active][:, None]
        new = np.linalg.solve(ridge + (a * v).T @ a / weight.sum(), (a * v).T @ y[active] / weight.sum())
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def _telling(with1: Counter, with0: Counter, n1: int, n0: int) -> list[str]:
    """Units that tell toxic texts, the most frequent first: the chance that so many of the
    texts that hold one are toxic, by Chernoff's bound and over all units, is below ``CHANCE``."""
    share, least = n1 / (n1 + n0), np.log(max(1, len(with1)) / CHANCE)
    found = []
    for unit, c1 in with1.items():
        c0 = with0[unit]
        odds = ((c1 + 0.5) / (n1 + 1)) / ((c0 + 0.5) / (n0 + 1))
        part = c1 / (c1 + c0)
        evidence = c1 * np.log(part / share) + (c0 * np.log((1 - part) / (1 - share)) if c0 else 0)
        if odds >= ODDS and evidence >= least:
            found.append(unit)
    if not found:  # a small sample: what is more frequent in toxic texts at all
        odds = {u: ((c + 0.5) / (n1 + 1)) / ((with0[u] + 0.5) / (n0 + 1)) for u, c in with1.items()}
        found = sorted((u for u in odds if odds[u] > 2), key=lambda u: (-odds[u], u))[:10]
    return sorted(found, key=lambda u: (-with1[u], u))


def _machine(texts: list[list[list[str]]], toxic: list[int], seed: int) -> tuple[np.ndarray, float] | None:
    """Table and offset of the machine learnt from the sentences of labelled texts."""
    rng = np.random.default_rng(seed)
    bags = [set().union(*text) for text in texts]
    n1 = sum(toxic)
    with1 = Counter(u for bag, t in zip(bags, toxic, strict=True) if t for u in bag)
    with0 = Counter(u for bag, t in zip(bags, toxic, strict=True) if not t for u in bag)
    telling = _telling(with1, with0, n1, len(toxic) - n1)
    known = set(telling)
    bad = [s for text, t in zip(texts, toxic, strict=True) if t for s in text if not known.isdisjoint(s)]
    clean = [s for text, t in zip(texts, toxic, strict=True) if not t for s in text]
    if not bad or not clean:
        return None
    often = Counter(u for s in clean for u in s)
    n0 = len(toxic) - n1
    pool = sorted(u for u in often if u not in known and (with0[u] * n1 >= with1[u] * n0 or with0[u] >= PLAIN * n0))
    if not pool:
        return None
    rank = {u: i for i, u in enumerate(telling)}
    witness = Counter(min((u for u in s if u in rank), key=rank.__getitem__) for s in bad)
    negative = [pool[i] for i in rng.permutation(len(pool))[:NEGATIVES]]
    for last in (False, False, True):
        positive = sorted(witness, key=lambda u: (-witness[u], u))
        base = features(positive[:2 * LANDMARKS] + negative[-LANDMARKS:])
        values, vectors = np.linalg.eigh((base.T @ base).astype(float))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T  # Nystroem map
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        # a unit counts by the sentences that hold it; both signs weigh the same
        weight = np.sqrt(np.array([witness[u] for u in positive] + [often[u] for u in negative], float))
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w, offset = _svm(kernel(positive + negative, base) @ root, y, weight)
        table = (base @ (root @ w))[:, None].astype(np.float32)
        if not last:
            # the negatives that look most toxic so far join, as landmarks too
            taken, value = set(negative), margins(pool, table, offset)
            worst = [pool[i] for i in np.argsort(-value, kind="stable")[:NEGATIVES] if pool[i] not in taken]
            negative = negative + worst[:NEGATIVES // 2][::-1]
            # and each toxic sentence is seen through its most toxic unit, negatives aside
            units = sorted(({u for s in bad for u in s} - set(pool)) | known)
            value = dict(zip(units, margins(units, table, offset).tolist(), strict=True))
            witness = Counter(max((u for u in s if u in value), key=lambda u: (value[u], u)) for s in bad)
    return table, offset


def train(texts: list[str], toxic: list[int], rest: float = 1.0, seed: int = 9) -> Machine | None:
    """``rest``: labelled texts that are not toxic, for each such text of the sample.

    The layer learns from machines that have not seen the text; the machine that is kept
    learns from all texts.
    """
    rng = np.random.default_rng(seed)
    if len(set(toxic)) < 2:
        return None
    split = [sentences(text) for text in texts]
    bags = [set().union(*text) for text in split]
    t = np.array(toxic, float)
    fold = np.zeros(len(bags), int)
    for label in (0, 1):  # equal texts would give a fold away, but cost only sharpness
        own = rng.permutation(np.flatnonzero(t == label))
        fold[own] = np.arange(len(own)) % FOLDS
    seen, x = np.zeros(len(bags), bool), np.zeros((len(bags), 5))
    for k in range(FOLDS):
        own = np.flatnonzero(fold != k)
        part = _machine([split[i] for i in own], [toxic[i] for i in own], seed)
        if part is not None:
            for i in np.flatnonzero(fold == k):
                x[i], seen[i] = summary(margins(sorted(bags[i]), *part)), True
    whole = _machine(split, toxic, seed)
    if whole is None:
        return None
    x, t = x[seen], t[seen]
    # texts count as often as in the labels table
    often = np.where(t > 0, 1.0, rest)
    layer = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        hess = (x * (often * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(layer))
        layer += np.linalg.solve(hess, x.T @ (often * (t - p)) - 0.1 * layer)
    return Machine(*whole, layer)


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine from the bounded sample of labelled documents."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)"
    )
    texts = documents(docs).where("text is not null and doc_id is not null")
    keyed = texts.selectExpr("doc_id", "xxhash64(text) as h").join(marked, "doc_id")
    # copies of a text count once, in the sample and in the counts
    chosen, counts = sampled(
        keyed.groupBy(F.col("toxic").alias("label"), "h").agg(F.min("doc_id").alias("doc_id")),
        lambda counts: dict.fromkeys(counts, SAMPLE_DOCS),
    )
    cut = SAMPLE_CHARS // SAMPLE_CUTS
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).selectExpr(
        "label as toxic",
        f"case when length(text) <= {SAMPLE_CHARS} then text else array_join(transform("
        f"sequence(0, {SAMPLE_CUTS - 1}), i -> substr(text, cast(1 + i * (length(text) - {cut}) "
        f"div {SAMPLE_CUTS - 1} as int), {cut})), ' ') end as text",
    ).distinct().limit(4 * SAMPLE_DOCS).collect()
    rows = sorted((r["text"], r["toxic"]) for r in rows)
    drawn = max(1, sum(not r[1] for r in rows))
    return train([r[0] for r in rows], [r[1] for r in rows], max(1.0, counts.get(0, 0) / drawn))


class Scorer:
    """Scores texts; remembers the largest margin by word up to ``MEMORY``."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.known = machine, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        split = [t.split() if t else [] for t in texts]
        split = [words + spelled_out(words) if words else words for words in split]
        new = list({w for words in split for w in words if w not in known})
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            units = [(i, u) for i, w in enumerate(part) for u in units_of(w) if len(u) >= 3]
            best = np.full(len(part), -2.0)
            if units:
                np.maximum.at(best, [i for i, _ in units], margins([u for _, u in units], self.machine.table, self.machine.offset))
            known.update(zip(part, best.tolist(), strict=True))
        out = []
        for words in split:
            # each distinct word once, as in training
            values = np.fromiter(map(known.__getitem__, set(words)), float)
            z = float(summary(values) @ self.machine.layer)
            out.append(1 / (1 + float(np.exp(-np.clip(z, -30, 30)))))
        return out


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """Per document: doc_id, score, predicted (1 from a score of ``TOXIC`` on)."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        scorer = Scorer(machine) if machine is not None else None
        for batch in batches:
            texts, found = batch["text"].tolist(), []
            for at in range(0, len(texts), 100):
                part = [t if isinstance(t, str) else None for t in texts[at:at + 100]]
                found += scorer.scores(part) if scorer else [0.0] * len(part)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "score": found,
                "predicted": np.array([s >= TOXIC for s in found], "int32"),
            })

    return documents(docs).mapInPandas(run, SCHEMA)
