import random

import numpy as np
import pyarrow as pa

from quillsift.llm import pieces
from quillsift.llm.common import rows_of

#: White space beyond ASCII, a piece mark as text, a letter that normalises to a phrase, signs of no width.
ODD = ["a", "bc", "\u00e9", "\u0416", "\u6f22", "\u00a0", "\u3000", " ", "\n", "\x1c", "x\u2581y", "\ufdfa", "\U0001f600", "1.5", "\u200b", "it's", "\u2013", "\u01c6", "\uff21", "\ufffd"]


def test_table_gives_what_the_tokeniser_gives():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(1500)] + ["", " ", "plain words only, again and again"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for model in (pieces.DEFAULT_MODEL, pieces.SECOND_MODEL):
        have = pieces.word_table(model)
        for size in (200, 1 << 20):
            have.clear()
            for lo, hi, data, offs in rows_of(batch, max_bytes=size):
                ids, at, chars, broken = pieces.encode_docs(data, offs, model)
                n, chars2, broken2 = pieces.measure_docs(data, offs, model)
                assert (np.diff(at) == n).all() and (chars == chars2).all() and (broken == broken2).all()
                for k in range(lo, hi):
                    want = [i for w in texts[k].split() for i in have.vocabulary.each([w])[0]]
                    assert ids[at[k - lo] : at[k - lo + 1]].tolist() == want
                    assert chars[k - lo] == sum(map(len, texts[k].split())) and broken[k - lo] == have.vocabulary.is_byte[want].sum()


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    have = pieces.word_table(pieces.DEFAULT_MODEL)
    have.clear()
    texts = [" ".join(f"w{i * 7 + j}" for j in range(20)) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for lo, hi, data, offs in rows_of(batch, max_bytes=100):
        n, _, _ = pieces.measure_docs(data, offs, pieces.DEFAULT_MODEL)
        assert n.tolist() == [sum(map(len, have.vocabulary.each(t.split()))) for t in texts[lo:hi]]
        assert len(have.keys) <= 50
    have.clear()


def test_counts_of_whole_texts_are_those_of_the_tokeniser():
    rng = random.Random(3)
    gaps = ["", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n "]
    plain = [x for x in ODD if not x.isspace()]
    texts = ["".join(rng.choice(kind) + rng.choice(gaps) for _ in range(rng.randrange(14))) for kind in (ODD, plain) for _ in range(2000)]
    texts += ["", " ", "\n", " \n", "x" * 5000, "long " * 4000, "\n" * 3000, " " * 3000 + "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for model in (pieces.SECOND_MODEL, pieces.DEFAULT_MODEL):
        whole = pieces.word_table(model).vocabulary.whole
        for size in (300, 1 << 20):
            got = np.concatenate([pieces.count_docs(data, offs, model) for _, _, data, offs in rows_of(batch, max_bytes=size)])
            assert got.tolist() == [whole(t) if t else 0 for t in texts]
