"""Word-wise encoding against the whole-text encoder."""

import random

import numpy as np
from tokenizers import Tokenizer

from sigweave.llm import packing, queries


def test_ids_equal_those_of_whole_texts():
    path = queries.tokenizer_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    enc = packing.WordEncoder(path)
    rng = random.Random(2)
    atoms = ["word", "don't", "Größe", "漢字", "🙂", "12345", "...", "\n", "\n\n", "\t", "  ", "   ", " ", " ", "a\r\nb", "x_y", "'s", "ﬁ", "é", "\x00", *enc.special]
    texts = ["", " ", "  a", "a ", *("".join(rng.choice(atoms) + rng.choice([" ", "", " "]) for _ in range(rng.randint(1, 60))) for _ in range(400))]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for t, raw in zip(part, enc.encode(part), strict=True):
            assert np.frombuffer(raw, enc.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
