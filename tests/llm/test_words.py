"""Words, hashes and windows of flat byte buffers against Python's own."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import linededup, text as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x1fabAB.é日", max_size=40)), max_size=8)


@given(TEXTS)
def test_words_and_hashes(texts):
    seen, place = {}, 0
    for lo, hi, data, offsets in T.slices(pa.array(texts, pa.string())):
        assert lo == place
        place = hi
        w = T.words(data, offsets)
        h = T.word_hash(w)
        for k in range(hi - lo):
            own = range(w.first[k], w.first[k + 1])
            got = [bytes(data[w.start[i] : w.end[i]]) for i in own]
            assert got == WORD.findall((texts[lo + k] or "").encode())
            for word, i in zip(got, own):
                assert seen.setdefault(word, h[i]) == h[i]
    assert place == len(texts)
    assert len(set(seen.values())) == len(seen)


@given(TEXTS)
def test_chunks_cover_the_text(texts):
    for lo, hi, data, offsets in T.slices(pa.array(texts, pa.string())):
        c = linededup.chunks(data, offsets)
        for k in range(hi - lo):
            parts = [bytes(data[c.start[p] : c.end[p]]) for p in range(c.first[k], c.first[k + 1])]
            assert b"\n".join(parts) == (texts[lo + k] or "").encode()


def test_windows_stay_in_documents():
    at, first = T.windows(np.array([0, 3, 3, 8]), 3)
    assert at.tolist() == [0, 3, 4, 5] and first.tolist() == [0, 1, 1, 4]
