"""The encoder's ids for pre-tokens of all kinds, from the BPE model alone."""

import random

import numpy as np
from tokenizers import Tokenizer

from orbweave.llm import packing
from orbweave.llm.packing import Encoder, tokenizer_path

CHARACTERS = [*map(chr, range(0x180)), "語", "½", "２", " ", "​", "é", "😀", "\U00010348", *" '\n" * 20]


def texts():
    rng = random.Random(0)
    yield from ("", "it's they're don't''ll", " ".join(f"word{i}" for i in range(500)), *map(chr, range(0x180)))
    for _ in range(300):
        yield "".join(rng.choices(CHARACTERS, k=rng.randint(1, 120)))


def test_ids_are_the_tokenizers_and_words_do_not_pass_all_of_it(monkeypatch):
    """Unknown words cost the model alone; with a cache of 50 words, both generations turn over often."""
    monkeypatch.setattr(packing, "KNOWN_WORDS", 50)
    whole, encode = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    encode.tokenizer = None  # only a text with a marker needs it
    for text in texts():
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)
        assert len(encode.known) <= 50 and len(encode.known.older) <= 50
