import random
import re

import numpy as np
import pyarrow as pa

from fernsift.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_equal_plain_splitting():
    rng = random.Random(5)
    texts = [None, "", " ", "x" * (words.CHUNK * 2 + 7), "a " * words.CHUNK]
    texts += ["".join(rng.choice("abA \n\té中\x0b\x1c") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    found = words.words_of(pa.array(texts))
    known: dict[str, int] = {}
    for i, t in enumerate(texts):
        plain = WORD.findall(t or "")
        assert len(plain) == len(found.of(i))
        assert found.chars[i] == sum(map(len, plain))
        for w, h in zip(plain, found.of(i).tolist(), strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_only_ascii_letters_are_folded():
    a, b, c, d = (words.words_of(pa.array([t]), lower=True).hashes[0] for t in ("ÀbC", "Àbc", "àbc", "ÀBC"))
    assert a == b == d != c


def test_sliced_arrays_and_windows():
    texts = pa.array(["drop me", "a b c d", "a b c", "a b c d e"]).slice(1)
    found = words.words_of(texts)
    sizes = [len(words.windows(found.of(i), 4)) for i in range(3)]
    assert sizes == [1, 1, 2]
    assert words.windows(found.of(0), 4)[0] == words.windows(found.of(2), 4)[0]
    assert len(words.windows(np.zeros(0, np.uint64), 4)) == 0
