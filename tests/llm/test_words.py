from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings, strategies as st

from patronlens.llm.words import split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="ab \n\té漢 \x0b", max_size=30), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = split_words([t.encode() for t in texts])
    data = words.data.tobytes()
    for i, text in enumerate(texts):
        own = range(words.first[i], words.first[i + 1])
        assert [data[words.start[k]:words.end[k]].decode() for k in own] == WORD.findall(text)


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_and_windows_tell_words_apart(texts):
    words = split_words([t.encode() for t in texts])
    hashes = words.hashes()
    plain = [w for t in texts for w in WORD.findall(t)]
    assert len(set(hashes.tolist())) == len(set(plain))
    assert {(w, h) for w, h in zip(plain, hashes.tolist())} == set(dict(zip(plain, hashes.tolist())).items())
    at, rolled = words.windows(hashes, 3)
    expected = {}
    for i, text in enumerate(texts):
        own = WORD.findall(text)
        for k in range(len(own) - 2):
            expected[int(words.first[i]) + k] = tuple(own[k:k + 3])
    assert at.tolist() == sorted(expected)
    seen = {}
    for place, value in zip(at.tolist(), rolled.tolist()):
        assert seen.setdefault(value, expected[place]) == expected[place]
    assert len(seen) == len(set(expected.values()))


def test_a_text_longer_than_the_kept_powers():
    text = b"word " * 700_000
    assert len(np.unique(split_words([text, b"word"]).hashes())) == 1
