"""Inputs that every operator must take, and the table they are put into."""

import pytest
from pyspark.sql import functions as F

ODD = ("", None, " ", "one", "word " * 3000, "a\n\n\nb", "日本語 のテキスト 🙂", "x" * 5000)
CLASHES = (
    "n_words", "kept", "score", "words", "lines", "text_hash", "node", "band", "copies", "rate", "pieces",
    "n_lines", "clean_text", "row", "key", "id", "hash", "no_id", "lang_pred", "labels", "n_tokens", "held_out",
    "_lang_pred", "_lang_score", "_n_lines_removed", "_draw", "a.b", "own", "has_words", "no_text",
)
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts, or (doc_id, text[, lang]) rows."""
    def build(*rows, clash=()):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            text = row[1]
            full.append((row[0], text, row[2] if len(row) > 2 else None, "s", len(text) if text else None))
        frame = spark.createDataFrame(full, DOCS)
        return frame.withColumns({name: F.lit("clash") for name in clash})

    return build

