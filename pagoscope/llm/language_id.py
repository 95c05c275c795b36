"""Language ID by a small convolutional network over bytes.

Filters of several widths slide over the lower-cased UTF-8 bytes of fixed-length windows;
the largest value of each filter goes through a softmax layer. Training is plain numpy on a
bounded sample of labelled rows; application covers every window of every text, in batches.

The sample: by language the distinct labelled texts with the smallest hash of the text,
``SAMPLE_DOCS`` dealt out evenly to the languages and no less than ``SAMPLE_LEAST`` to any
that has them, so that every labelled language is learnt; and of each at most
``SAMPLE_WINDOWS`` windows, evenly spread. This bound is the driver's memory bound too (about
6 MB up to 40 languages, 0.15 MB for each one more).

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled
row at all every text is ``und``; equal texts get equal results; ties go to the first
language by name; an empty table gives an empty table; other columns are ignored.

At scale: the sample takes a pass over the texts for their hashes, counted with map-side
combine, and one that fetches the chosen ones; the rest one pass without a shuffle. A task holds one
batch of windows, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import dealt, documents, free_name, numbered, sampled, sliced

SAMPLE_DOCS = 4000
SAMPLE_LEAST = 100     # of each language
SAMPLE_WINDOWS = 4
WINDOW = 256           # bytes that a window starts an n-gram at
WIDTHS = (2, 3, 4)      # the widest must be even: it is looked up by byte pairs
FILTERS = 16           # of each width
EPOCHS = 6
BATCH = 256
RATE = 0.05
UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double"

_SPAN = max(WIDTHS)
_WIDE = FILTERS * len(WIDTHS)


@dataclass
class Network:
    """``tables[k][b]``: what byte b at offset k adds to each filter; then the softmax layer."""

    languages: list[str]
    tables: np.ndarray   # (span, 256, filters)
    bias: np.ndarray
    weights: np.ndarray  # (filters, languages)
    offset: np.ndarray

    def filters(self, windows: np.ndarray) -> np.ndarray:
        """Filter values at each start: (windows, starts, filters)."""
        starts = windows.shape[1] - _SPAN + 1
        total = self.tables[0][windows[:, :starts]]
        for k in range(1, _SPAN):
            total += self.tables[k][windows[:, k:k + starts]]
        return total

    def prepared(self) -> "Network":
        """Adds tables of byte pairs, which halve the look-ups when the network is applied."""
        self.pairs = [
            (self.tables[k][:, None] + self.tables[k + 1][None]).reshape(65536, -1)
            for k in range(0, _SPAN, 2)
        ]
        return self

    def posteriors(self, windows: np.ndarray) -> np.ndarray:
        starts = windows.shape[1] - _SPAN + 1
        codes = windows[:, :-1].astype(np.int64) * 256 + windows[:, 1:]
        pooled = np.empty((len(windows), _WIDE), np.float32)
        for row, code in enumerate(codes):
            total = self.pairs[0].take(code[:starts], axis=0)
            total += self.pairs[1].take(code[2:2 + starts], axis=0)
            total.max(axis=0, out=pooled[row])
        return softmax(np.maximum(pooled + self.bias, 0) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, with the bytes that each one starts n-grams at."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + _SPAN - 1, np.uint8)
    padded[:len(data)] = data
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + _SPAN - 1)[::WINDOW]
    sizes = np.full(n, WINDOW)
    sizes[-1] = len(data) - (n - 1) * WINDOW
    return views, sizes


def train(texts: list[str], labels: list[str], seed: int = 7) -> Network | None:
    """Fit the network by Adagrad on windows and on random shorter cuts of them."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    x = np.concatenate([windows_of(t)[0][:1] for t in texts])
    y = np.array([languages.index(label) for label in labels])
    uses = np.zeros((_SPAN, 1, _WIDE), np.float32)  # which offsets belong to which filter
    for j, width in enumerate(WIDTHS):
        uses[:width, :, j * FILTERS:(j + 1) * FILTERS] = 1
    net = Network(
        languages,
        (rng.normal(0, 0.3, (_SPAN, 256, _WIDE)) * uses).astype(np.float32),
        np.zeros(_WIDE, np.float32),
        rng.normal(0, 0.3, (_WIDE, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    squares = [np.full_like(p, 1e-2) for p in (net.tables, net.bias, net.weights, net.offset)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at:at + BATCH]
            windows = x[pick].copy()
            cuts = rng.integers(16, WINDOW, len(pick))
            for row in np.flatnonzero(rng.random(len(pick)) < 0.5):
                windows[row, cuts[row]:] = 0
            values = net.filters(windows)
            where = values.argmax(axis=1)
            top = np.take_along_axis(values, where[:, None], axis=1)[:, 0] + net.bias
            pooled = np.maximum(top, 0)
            p = softmax(pooled @ net.weights + net.offset)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = (p @ net.weights.T) * (top > 0)
            tables = np.zeros_like(net.tables)
            for k in range(_SPAN):  # the gradient flows to the winning places only
                seen = np.take_along_axis(windows, where + k, axis=1)
                np.add.at(tables[k], (seen, np.arange(_WIDE)[None]), back)
            steps = (tables * uses, back.sum(axis=0), pooled.T @ p, p.sum(axis=0))
            for value, square, step in zip(
                (net.tables, net.bias, net.weights, net.offset), squares, steps, strict=True
            ):
                square += step * step
                value -= RATE * step / np.sqrt(square)
    return net


def sample(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """The bounded training sample of rows with ``text`` and a non-null ``lang``."""
    texts = labelled.where("lang is not null and text rlike '\\\\p{L}'").selectExpr(
        "cast(text as string) as text", "cast(lang as string) as label", "xxhash64(cast(text as string)) as h"
    )
    chosen, _ = sampled(
        texts.select("label", "h").distinct(), lambda counts: dealt(counts, SAMPLE_DOCS, SAMPLE_LEAST)
    )
    rows = (
        texts.join(F.broadcast(chosen), ["label", "h"])
        .selectExpr(
            "label", "h",
            f"transform(sequence(0, {SAMPLE_WINDOWS - 1}), i -> substr(text, "
            f"cast(1 + i * greatest(0, length(text) - {WINDOW}) div {SAMPLE_WINDOWS - 1} as int), {WINDOW})) as cuts",
        )
        .groupBy("label", "h").agg(F.min("cuts").alias("cuts"))  # copies meet before they reach the driver
        .selectExpr("label as lang", "explode(array_distinct(cuts)) as cut")
        .collect()
    )
    rows = sorted((r["cut"], r["lang"]) for r in rows if r["cut"])
    return [r[0] for r in rows], [r[1] for r in rows]


def fit(labelled: DataFrame) -> Network | None:
    return train(*sample(labelled))


def classify(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text: the windows' posteriors, weighted by their bytes."""
    sums = np.zeros((len(texts), len(net.languages)))
    waiting, owners, weights, held = [], [], [], 0

    def flush() -> None:
        nonlocal held
        if held:
            x = np.concatenate(waiting)
            p = np.concatenate([net.posteriors(x[i:i + BATCH]) for i in range(0, len(x), BATCH)])
            np.add.at(sums, np.concatenate(owners), p * np.concatenate(weights)[:, None])
        waiting.clear(), owners.clear(), weights.clear()
        held = 0

    letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
    for i, text in enumerate(texts):
        if not letters[i]:
            continue
        views, sizes = windows_of(text)
        waiting.append(views), owners.append(np.full(len(views), i)), weights.append(sizes)
        held += len(views)
        if held >= 8 * BATCH:
            flush()
    flush()
    total = sums.sum(axis=1, keepdims=True)
    share = np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)
    best = share.argmax(axis=1)
    return (
        [net.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)],
        [float(share[i, b]) if letters[i] else 0.0 for i, b in enumerate(best)],
    )


def identify(docs: DataFrame, net: Network | None, keep: bool = False) -> DataFrame:
    """Per document: doc_id, lang_pred, score. With ``keep``, the columns of ``docs`` and
    then the two results, under names that ``docs`` does not have."""
    rows = numbered(docs) if keep else documents(docs)
    given = [f for f in rows.schema if keep or f.name == "doc_id"]
    given_at = [rows.columns.index(f.name) for f in given]
    text_at = (docs if keep else rows).columns.index("text")
    names = [free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")] if keep else ["lang_pred", "score"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if net is not None:
            net.prepared()
        for batch in sliced(batches):
            texts = batch.column(text_at).to_pylist()
            if net is None:
                langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            else:
                langs, scores = classify(net, texts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(at) for at in given_at], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*(f.name for f in given), *names],
            )

    from pyspark.sql import types as T

    schema = T.StructType([*given, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    found = rows.mapInArrow(run, schema)
    return found.toDF(*docs.columns, *names) if keep else found


def held_out(remainder_of: int = 5):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % remainder_of == 0, F.lit(False))
