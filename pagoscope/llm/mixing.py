"""Soft-membership mixing to target weights.

The domains are the classes of the labels table: clean, low quality, toxic. A classifier
trained on labelled rows gives each document a posterior over the domains, so a document
belongs to several in part. Wanted are nonnegative rates (how often a document is shown)
whose expected tokens per domain, summed over all documents, meet the targets. They come
from projected-gradient least squares: each step sums rate x tokens x posterior per domain
over all documents, and moves every rate along its own posterior, cut off at zero.

A document's rate is a function of its posterior and of the domain gradients so far, so a
step keeps no state per document: it is one aggregate over the written posteriors, and only
one number per domain reaches the driver.

The classifier's sample: by domain the distinct labelled texts with the smallest hash of the
text, ``SAMPLE_DOCS`` dealt out evenly to the domains (what a small one leaves goes to the
others; the offsets of the classifier bring the shares of all labelled texts back), at most ``SAMPLE_CHARS`` characters in ``SAMPLE_CUTS`` even cuts of each; that bounds
the driver's memory.

Defined cases: a null or empty text has no tokens and keeps its rate, which nothing depends
on; labels rows without a document, with null labels, or repeated ones are harmless; without
any label all documents are in the first domain; an empty table gives an empty table; equal
rows get equal rates; other columns are ignored.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pagoscope.llm.common import dealt, free_name, numbered, sampled, sliced, written

DOMAINS = ("clean", "low_quality", "toxic")
TARGETS = {"clean": 0.88, "low_quality": 0.09, "toxic": 0.03}
SAMPLE_DOCS = 4000
SAMPLE_CUTS, SAMPLE_CHARS = 8, 4000
FEATURES = 2**14
STEPS = 40
TOLERANCE = 1e-4   # of the total, largest miss of a domain
MEMORY = 400_000

LOG = logging.getLogger(__name__)
WORD = re.compile(r"\S+")
RUNS = re.compile(r"[^\w\s.,]{2,}")


@dataclass
class Classifier:
    """Softmax over hashed words and a few shares; ``weights[:, k]`` scores domain k."""

    weights: np.ndarray
    offset: np.ndarray


class Features:
    """Sparse features of a text; word buckets are remembered up to ``MEMORY``."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature numbers, values and the number of tokens (words)."""
        from xxhash import xxh32_intdigest

        words = WORD.findall(text) if text else []
        known, found = self.known, list(map(self.known.get, words))
        if None in found:
            if len(known) > MEMORY:
                known.clear()
            for i, bucket in enumerate(found):
                if bucket is None:
                    w = words[i]
                    shape = RUNS.search(w) is not None or w in "|»›·•"
                    core = w.lower().strip(".,;:!?\"'()#*$%&|<>")
                    loud = len(core) > 1 and w.isupper()
                    bucket = (2 if loud else 1) if shape else (3 if loud else 4 + xxh32_intdigest(core.encode("utf-8", "surrogatepass")) % (FEATURES - 8))
                    found[i] = known[w] = bucket
        if not words:
            return np.zeros(0, int), np.zeros(0), 0
        buckets, counts = np.unique(np.array(found), return_counts=True)
        hashed = buckets >= 4
        # single words tell by presence, the three shapes by their share; repetition is one more
        values = np.where(hashed, np.log1p(counts) / np.sqrt(max(hashed.sum(), 1)), 8.0 * counts / len(words))
        repeated = 8.0 * max(0.0, 1 - len(set(words)) / len(words) - 0.4) if len(words) >= 20 else 0.0
        return np.append(buckets, 0), np.append(values, repeated), len(words)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], domains: list[int], epochs: int = 12, rate: float = 0.3, seed: int = 3) -> Classifier:
    features = Features()
    rows = [features.of(t)[:2] for t in texts]
    k = len(DOMAINS)
    model = Classifier(np.zeros((FEATURES, k)), np.zeros(k))
    if not rows:
        model.offset[:] = [0.0] + [-50.0] * (k - 1)
        return model
    squares = np.full((FEATURES, k), 1e-3)
    rng = np.random.default_rng(seed)
    seen = np.bincount(domains, minlength=k) > 0
    model.offset[~seen] = -50.0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            p = softmax(values @ model.weights[at] + model.offset)
            p[domains[i]] -= 1
            step = values[:, None] * p[None] + 1e-5 * model.weights[at]
            squares[at] += step * step
            model.weights[at] -= rate * step / np.sqrt(squares[at])
            model.offset[seen] -= 0.01 * p[seen]
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The domain classifier from the bounded sample of labelled documents."""
    cut = SAMPLE_CHARS // SAMPLE_CUTS
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where(
        "doc_id is not null and (quality is not null or toxic is not null)"
    ).selectExpr("doc_id", "case when toxic = 1 then 2 when quality = 0 then 1 else 0 end as domain")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null and text is not null")
    # the sample is chosen by ids and hashes alone; then its texts are fetched
    keys = texts.selectExpr("doc_id", "xxhash64(text) as h").join(marked, "doc_id")
    chosen, counts = sampled(
        keys.groupBy(F.col("domain").alias("label"), "h").agg(F.min("doc_id").alias("doc_id")),
        lambda counts: dealt(counts, SAMPLE_DOCS),
    )
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).selectExpr(
        "label as domain",
        f"case when length(text) <= {SAMPLE_CHARS} then text else array_join(transform("
        f"sequence(0, {SAMPLE_CUTS - 1}), i -> substr(text, cast(1 + i * (length(text) - {cut}) "
        f"div {SAMPLE_CUTS - 1} as int), {cut})), ' ') end as text",
    ).distinct().limit(4 * SAMPLE_DOCS).collect()
    rows = sorted((r["text"], r["domain"]) for r in rows)
    model = train([r[0] for r in rows], [r[1] for r in rows])
    drawn = dealt(counts, SAMPLE_DOCS)
    for domain, n in counts.items():
        model.offset[domain] += np.log(n / drawn[domain])
    return model


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per document: doc_id, text_hash, n_tokens, p0, p1, ... over ``DOMAINS``."""
    names = [f"p{k}" for k in range(len(DOMAINS))]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        features = Features()
        for batch in batches:
            p, n = np.zeros((len(batch), len(DOMAINS))), np.zeros(len(batch), "int64")
            for i, text in enumerate(batch["text"]):
                at, values, n[i] = features.of(text)
                p[i] = softmax(values @ model.weights[at] + model.offset)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"].astype("Int64"),
                "n_tokens": n, **{name: p[:, k] for k, name in enumerate(names)},
            })

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInPandas(
        run, "doc_id long, text_hash long, n_tokens long, " + ", ".join(f"{n} double" for n in names)
    )


def rate_text(moves: list[np.ndarray]) -> str:
    """SQL text of a document's rate after the given moves along its posterior."""
    text = "1D"
    for move in moves:
        along = " + ".join(f"({float(m)!r}D) * p{k}" for k, m in enumerate(move))
        text = f"greatest(0D, {text} - ({along}))"
    return text


def fit_rates(table: DataFrame, targets: dict[str, float] | None = None) -> list[np.ndarray]:
    """The moves of projected-gradient least squares for the posteriors' table.

    The target of a domain is its weight times all tokens; what is still missed after
    ``STEPS`` steps is logged as a warning. The squares of the domains' misses
    are weighted by the inverse of the posteriors' token-weighted second moments, and distances
    between rates by tokens: then the gradient of a rate is its posterior times the weighted
    misses, a step of 1 is the largest safe one, and only the cut at zero needs more steps.
    """
    weights = targets or TARGETS
    k = len(DOMAINS)
    total = sum(weights[d] for d in DOMAINS)
    wanted = np.array([weights[d] / total for d in DOMAINS])
    first = table.agg(
        F.sum("n_tokens"),
        *(F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)),
    ).first()
    if not first[0]:
        return []
    moments = np.array(first[1:], float).reshape(k, k) / first[0]
    inverse = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    moves: list[np.ndarray] = []
    while True:
        sums = table.selectExpr("n_tokens", *(f"p{i}" for i in range(k)), f"{rate_text(moves)} as rate").agg(
            *(F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col("rate")) for i in range(k))
        ).first()
        miss = np.array(sums, float) / first[0] - wanted
        if np.abs(miss).max() < TOLERANCE:
            return moves
        if len(moves) == STEPS:
            LOG.warning("targets not met in %d steps, misses by domain: %s", STEPS,
                        ", ".join(f"{d} {m:+.2g}" for d, m in zip(DOMAINS, miss, strict=True)))
            return moves
        moves.append(inverse @ miss)


def draw(text_hash: str) -> str:
    """SQL text of a document's draw in [0, 1), which rounds its rate."""
    return f"pmod(xxhash64(cast(doc_id as long), {text_hash}, 'mix'), 1048576) / 1048576D"


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_tokens, a share for each of ``DOMAINS``,
    rate, copies. ``copies`` is the rate rounded by the hash of the document's id and text,
    so that it is the rate on average and the same on every run."""
    table = written(posteriors(docs, fit(docs, labels)), "posteriors")
    moves = fit_rates(table, targets)
    return table.selectExpr(
        "doc_id", "text_hash", "n_tokens", *(f"p{k} as {d}" for k, d in enumerate(DOMAINS)),
        f"{rate_text(moves)} as rate",
    ).withColumn(
        "copies",
        F.expr(f"cast(floor(rate + {draw('text_hash')}) as long)"),
    )


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` of ``mix`` says.

    The rates are fitted over all rows; a row then works out its own posterior again, so no
    join carries texts around.
    """
    model = fit(docs, labels)
    moves = fit_rates(written(posteriors(docs, model), "posteriors"), targets)
    fields, text_at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in sliced(batches):
            texts, draws = batch.column(text_at).to_pylist(), batch.column(len(fields)).to_pylist()
            take = []
            for i, (text, drawn) in enumerate(zip(texts, draws, strict=True)):
                at, values, _ = features.of(text)
                p, rate = softmax(values @ model.weights[at] + model.offset), 1.0
                for move in moves:
                    # term by term, as in rate_text
                    rate = max(0.0, rate - sum(float(m) * float(q) for m, q in zip(move, p, strict=True)))
                take += [i] * int(rate + drawn)
            yield batch.take(pa.array(take, pa.int64())).select(range(len(fields)))

    drawn = F.expr(draw("xxhash64(cast(text as string))")).alias(free_name(docs, "_draw"))
    rows = numbered(docs.select("*", drawn))
    return rows.mapInArrow(run, numbered(docs).schema).toDF(*docs.columns)
