"""Word hashes."""

import numpy as np

from recordframe.llm import hashing


def test_long_texts_are_cut_between_words(monkeypatch):
    text = b" ".join(b"Word%d" % (i * i % 977) for i in range(5_000)) + b"\n\t  end" + b"x" * 3_000
    whole = hashing.word_hashes(text)
    monkeypatch.setattr(hashing, "BLOCK", 100)
    assert (hashing.word_hashes(text) == whole).all() and len(whole) == len(text.split())


def test_equal_words_have_equal_hashes():
    h = hashing.word_hashes(b"One two ONE\x0bone  Two \xc3\x89 \xc3\xa9")
    assert h[0] == h[2] == h[3] and h[1] == h[4] and h[5] != h[6] and h[0] != h[1]
    assert hashing.word_hashes(b" \n").dtype == np.uint64 and len(hashing.word_hashes(b"")) == 0
