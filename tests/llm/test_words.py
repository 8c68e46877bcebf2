"""Words, shingles and slices against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridtally.llm.words import ALNUM, SPACED, distinct, groups, pieces, shingles, words
from corpus_helpers import plain_words, shingle_set, spaced_words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\t\n\x0b-0😀", max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_equal_the_patterns(given_texts):
    column = pa.array(given_texts, pa.string())
    for kind, plain in ((SPACED, spaced_words), (ALNUM, plain_words)):
        w = words(column, kind)
        want = [plain(t) for t in given_texts]
        assert np.diff(w.first).tolist() == [len(x) for x in want]
        seen = {}
        for h, x in zip(w.hash.tolist(), [y for x in want for y in x]):
            assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(texts)
def test_shingle_sets_have_the_right_sizes(given_texts):
    column = pa.array(given_texts, pa.string())
    h, doc = shingles(words(column), 3)
    _, at = distinct(h, doc, len(given_texts))
    assert np.diff(at).tolist() == [len(shingle_set(t, 3)) for t in given_texts]


def test_pieces_and_groups_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "", "x" * 50, "yy"]), pa.array([1, 1, 2, 2, 3])], names=["t", "k"])
    assert [x for p in pieces([batch], "t", 4, 2) for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    got = [t.column("t").to_pylist() for t in groups([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3)], "k")]
    assert got == [["abc", None], ["", "x" * 50], ["yy"]]
    sliced = batch.slice(3)
    assert len(words(sliced.column("t"))) == 2
