import random

import numpy as np
import pyarrow as pa

from quillsift.llm import common as C


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


def test_words_and_shingles_agree_with_python():
    rng = random.Random(1)
    texts = [None, "", " ", *(" ".join(rng.choice(["a", "bb", "ccc", "é", "\n"]) for _ in range(rng.randrange(12))) for _ in range(60)), "x" * 3000]
    by_text: dict = {}
    rows_seen = 0
    for lo, hi, data, offs in C.rows_of(batch(texts), max_bytes=64):
        starts, ends, rows = C.word_spans(data, offs, C.SPACE_SPLIT)
        h = C.word_hashes(data, starts, ends)
        got = [[] for _ in range(hi - lo)]
        for s, e, r in zip(starts, ends, rows):
            got[r].append(data[s:e].tobytes().decode())
        assert got == [(t or "").split() for t in texts[lo:hi]]
        for s, e, x in zip(starts, ends, h):
            assert by_text.setdefault(data[s:e].tobytes(), int(x)) == int(x)
        sh, owner, at = C.shingles(h, rows, 3)
        for r in range(hi - lo):
            w = got[r]
            want = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
            mine = sh[owner == r]
            assert len(mine) == len(want)
            for a, b in zip(mine, want):
                assert by_text.setdefault(b, int(a)) == int(a)
        rows_seen += hi - lo
    assert rows_seen == len(texts)
    assert len(set(by_text.values())) == len(by_text)


def test_binary_round_trip():
    m = np.arange(12, dtype=np.uint32).reshape(3, 4)
    assert (C.matrix_of(C.binary_rows(m), np.uint32) == m).all()
    assert (C.matrix_of(C.binary_rows(m).slice(1, 2), np.uint32) == m[1:]).all()
