"""Piece ids of texts that are one unit with many marks after letters."""

import random

import numpy as np
import pytest

from foliant.llm.piece_bpe import PieceBPE

tokenizers = pytest.importorskip("public_tokenizers")


def test_marks_without_spaces():
    from sentencepiece import SentencePieceProcessor

    file = tokenizers.path("piece_bpe_32k.model")
    own, library = PieceBPE(file), SentencePieceProcessor(model_file=file)
    rng = random.Random(6)
    many = "".join(rng.choice(["a", "word", "中文", "é1", "_x", "9"]) + rng.choice([",", ";", ":", "!", "?", ".", ",,", "、"]) for _ in range(5000))
    for text in ("ab," * 100_000, "," * 100_000, many, "x:y;" * 3000 + " z", "ab,▁cd;" * 2000):
        ids = np.frombuffer(own.encode(text), np.uint16).tolist()
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)
    assert sum(map(len, own.known)) < 4_000_000
