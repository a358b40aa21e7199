"""The scan of transition functions against walking the automaton, and offsets against decoding."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import tokens as K


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="'sdtmrevlLa9., \n中", max_size=400), min_size=1, max_size=5))
def test_scan_equals_the_walk(texts):
    texts = [t for t in texts if t]
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(code):
        return
    at = np.cumsum([0, *map(len, texts)])[:-1]
    cls, table = K.classes()[code], K.transitions()
    state, walked = K.START, []
    for i, c in enumerate(cls.tolist()):
        state = int(table[c, K.START if i in at else state])
        walked.append(state)
    assert K.states(code, at).tolist() == walked


def test_offsets_decode_parts(spark):
    texts = ["it's <|endoftext|>  fine\n", "", None, "长 text mit Ümläuten 🙂 " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").selectExpr("*", "1 AS ends")
    merge = K.merger(K.DEFAULT_VOCABULARY)
    rows = K.encode_column(df, "k", "t", offsets=True).collect()
    assert len(rows) == 4
    for row in rows:
        raw = (texts[row.k] or "").encode()
        assert len(row.ends) == len(row.ids) and (not row.ends or row.ends[-1] == len(raw))
        for a in range(0, len(row.ids), 7):
            start = row.ends[a - 1] if a else 0
            stop = row.ends[min(a + 5, len(row.ids)) - 1]
            assert merge.decode(row.ids[a : a + 5]) == raw[start:stop].decode("utf-8", "replace")
    assert [x.asDict() for x in K.encode_column(df.limit(0), "k", "t", offsets=True).collect()] == []
