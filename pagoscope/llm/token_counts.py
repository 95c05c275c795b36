"""Token counts with a whole-token shortcut.

A text falls into chunks (a word with the space before it) over whose ends no merge can
reach; that is proved from the vocabulary. It is also proved, once per worker and by the
library itself, which vocabulary strings encode alone as one token. A chunk among those
counts as one; only the others are merged, each distinct one once while it is remembered.

Defined cases: a null text is an empty text with no bytes and no tokens; special strings
inside texts are ordinary text, as the library has it; equal rows give equal rows; an empty
table gives an empty table; other columns are ignored.

At scale: one pass, no shuffle; the memory of chunk counts is bounded and forgets when full.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame

from pagoscope.llm import sentencepiece_model as spm
from pagoscope.llm.common import documents

MEMORY = 300_000  # distinct chunks whose count a worker remembers
LONGEST_KEPT = 64  # characters; longer chunks are merged anew each time
LIMIT = 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@functools.lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, standing alone as a chunk, encode as one token."""
    model = spm.load(path)
    starts = [p for p in spm.pieces(path)[0] if p.startswith(spm.MARK)]
    encoded = model.encode([p[1:] for p in starts], num_threads=1)
    alone = {p for p, ids in zip(starts, encoded, strict=True) if len(ids) == 1}
    # a mark of its own cannot be given to the library, which would add another
    return frozenset(alone | ({spm.MARK} & set(starts)))


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first mark: the library adds that one itself."""
    words = text.split(" ")
    if "" not in words and spm.MARK not in text:
        return words
    return [c[1:] for c in spm.CHUNK.findall(spm.MARK + text.replace(" ", spm.MARK))]


class Counter:
    """Counts the tokens of texts; remembers chunk counts up to ``MEMORY``."""

    def __init__(self, path: str) -> None:
        self.model = spm.load(path)
        self.split = spm.marks_lead(path)
        self.whole = {p[1:]: 1 for p in whole_tokens(path)}
        self.known = dict(self.whole)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.model.encode(text))
        parts, known = chunks(text), self.known
        counts = list(map(known.get, parts))
        if None in counts:
            rest = list({c for c, n in zip(parts, counts) if n is None})
            merged = dict(zip(rest, map(len, self.model.encode(rest, num_threads=1)), strict=True))
            counts = [merged[c] if n is None else n for c, n in zip(parts, counts)]
            if len(known) > MEMORY:
                self.known = known = dict(self.whole)
            known.update((c, n) for c, n in merged.items() if len(c) <= LONGEST_KEPT)
        return sum(counts)


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit."""
    path = model_path or spm.default_path()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            n = [counter.count(t) for t in texts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            })

    return documents(docs).mapInPandas(run, SCHEMA)
