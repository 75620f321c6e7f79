"""New words of printable ASCII are cut and merged without the whole tokenizer, to the same ids."""

import random

from tokenizers import Tokenizer

from waymark.llm import packing


class Whole:
    """The tokenizer, with a count of the texts that it gets whole."""

    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def encode(self, *args, **named):
        self.calls += 1
        return self.inner.encode(*args, **named)


def test_ascii_words():
    own, tokenizer = packing.WordEncoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    assert own.by_words and own.by_pieces
    rng = random.Random(5)
    words = ["don't", "I'LL", "'S", "x's9'll", "a_b-c", "AKIA0123456789", "key=\"a1b2\";", "''re", "$#@!", "<a|b>", "1.234,50"]
    words += ["".join(chr(rng.randrange(33, 127)) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    words = [w for w in words if "<|" not in w]
    own.tokenizer = Whole(own.tokenizer)
    assert all(own.encode(w) == own.pack(tokenizer.encode(w, add_special_tokens=False).ids) for w in words)
    assert own.tokenizer.calls == 0
    assert own.encode("x\x01y é#ü") == own.pack(tokenizer.encode("x\x01y é#ü", add_special_tokens=False).ids) and own.tokenizer.calls > 0
