"""Pieces of a sentencepiece model, loaded once per Python worker.

The model's path is a parameter: a file that every machine has, such as an installed
package's. Nothing of it is shipped or copied.
"""

from __future__ import annotations

import functools
import re

MARK = "▁"  # stands for a space in a piece
# A chunk starts with all the marks in a row and runs to the next mark.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.lru_cache(maxsize=4)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> tuple[dict[str, tuple[int, float]], list[int]]:
    """Ordinary pieces with id and score, and the 256 ids of single bytes."""
    model = load(path)
    ordinary, byte_ids = {}, [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ordinary[piece] = (i, model.get_score(i))
    return ordinary, byte_ids


@functools.lru_cache(maxsize=4)
def marks_lead(path: str) -> bool:
    """Proof that chunks are independent: in no piece does a mark follow another character,
    so no merge and no piece can span the end of a chunk."""
    return not any(MARK in piece.lstrip(MARK) for piece in pieces(path)[0])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
