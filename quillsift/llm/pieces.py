"""Word-wise encoding under public vocabularies with a bounded table in each Python worker.

A text is the sequence of its words, split at white space, and each word is
encoded on its own. Words are found and hashed over whole Arrow buffers; a word
that the table has costs a lookup, only others reach the tokeniser. The table
holds CACHE_WORDS words and starts anew with those of the next chunk when it is
full, so its size does not depend on the data. Words are told apart by 64-bit
hashes.

Byte-level vocabularies (.tiktoken) encode a word with the space before it.

``count_docs`` gives the length of each whole text as its tokeniser has it, white
space included: a byte-level vocabulary splits a text into words with or without
one space before them and runs of the white space between, so each of these is
counted once and looked up after that.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache
from itertools import chain

import numpy as np

from quillsift.llm.common import SPACE_SPLIT, byte_class, word_hashes, word_spans

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SECOND_MODEL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 1_000_000
CACHE_GAPS = 100_000
LONG_GAP = 1_000  # bytes; longer ones aren't remembered
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bytes of words that may hold white space or vanish when normalised: all but visible ASCII and Latin letters.
_ODD = ~byte_class(rb"[\x21-\x7e\x80-\xbf\xc3-\xc8]")
#: What may be white space to a tokeniser or to Python but isn't one of the six ASCII characters: texts with it are encoded whole.
_WIDE_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Vocabulary:
    """size, is_byte (pieces that are no whole characters) and the ids of words.

    With bare, a byte-level vocabulary encodes words that have no space before them.
    """

    def __init__(self, path: str, bare: bool = False) -> None:
        if not os.path.exists(path):
            raise FileNotFoundError(f"no tokenizer model at {path}")
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.size = max(ranks.values()) + 1
            self.is_byte, self.width = np.zeros(self.size, bool), np.zeros(self.size, np.int64)
            for piece, i in ranks.items():
                self.is_byte[i], self.width[i] = not _whole(piece), len(piece)
            self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.each, self.joined = (self._each_bare, self._joined_bare) if bare else (self._each_bytes, self._joined_bytes)
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.model.get_piece_size()
            self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
            self.begins = np.array([self.model.id_to_piece(i).startswith("\u2581") for i in range(self.size)])
            self.each, self.joined = self._each_piece, self._joined_pieces
        if self.size > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 pieces don't fit the 16-bit ids")

    def _each_piece(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1) if words else []

    def _each_bytes(self, words: list[str]) -> list[list[int]]:
        return [self.bpe.encode_ordinary(" " + w) for w in words]

    def _each_bare(self, words: list[str]) -> list[list[int]]:
        return [self.bpe.encode_ordinary(w) for w in words]

    def _joined_bare(self, words: list[str], size: np.ndarray) -> None:
        """Only words at the start of a line are bare: they are encoded one by one."""

    def whole(self, text: str) -> int:
        """The length of a text that is encoded as it is."""
        return len(self.bpe.encode_ordinary(text) if hasattr(self, "bpe") else self.model.encode(text, num_threads=1))

    def _joined_pieces(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all words, of size bytes each, and the number of ids of each, from longer strings; None where word starts are unclear."""
        got = self.model.encode([" ".join(words[i : i + 24]) for i in range(0, len(words), 24)], num_threads=1)
        ids = np.fromiter(chain.from_iterable(got), np.int64, sum(map(len, got)))
        first = np.flatnonzero(self.begins[ids])
        return (ids, np.diff(np.append(first, len(ids)))) if len(first) == len(words) and first[0] == 0 else None

    def _joined_bytes(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(words)), np.int64)
        ends, cuts = np.cumsum(self.width[ids]), np.cumsum(size + 1)
        last = np.searchsorted(ends, cuts)
        return (ids, np.diff(last, prepend=-1)) if len(ids) and (ends[np.minimum(last, len(ends) - 1)] == cuts).all() else None


def _whole(piece: bytes) -> bool:
    try:
        piece.decode()
    except UnicodeDecodeError:
        return False
    return True


class WordTable:
    """Word hash -> place in one flat array of piece ids; numbers of pieces, of characters and of byte pieces."""

    def __init__(self, path: str, bare: bool = False) -> None:
        self.vocabulary = Vocabulary(path, bare)
        self.gaps: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.n, self.chars, self.broken = (np.zeros(0, np.int32) for _ in range(4))
        self.flat = np.zeros(0, np.uint16)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each word in the table; unknown words are encoded first."""
        h = word_hashes(data, starts, ends)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._find(u)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_WORDS:
                self.clear()
                known = np.zeros(len(u), bool)
            self._learn(u[~known], data, starts[first[~known]], ends[first[~known]])
            at, _ = self._find(u)
        return at[inverse]

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds words that the table lacks; h is sorted."""
        size = ends - starts
        lines = np.full(int(size.sum()) + len(size), 10, np.uint8)
        before = np.cumsum(size) - size
        at = np.arange(int(size.sum()))
        raw = data[at + np.repeat(starts - before, size)]
        lines[at + np.repeat(np.arange(len(size)), size)] = raw  # a line feed after each word
        text = lines.tobytes().decode("utf-8", "replace")
        words = text.split("\n")[:-1]
        owner = np.repeat(np.arange(len(size)), size)
        plain = np.bincount(owner, _ODD[raw], len(size)) == 0
        if "\ufffd" in text:  # broken UTF-8
            plain[:] = False
        chars = np.bincount(owner, (raw & 0xC0) != 0x80, len(size)).astype(np.int64)
        n = np.zeros(len(size), np.int64)
        some = [w for w, p in zip(words, plain.tolist()) if p] if not plain.all() else words
        got = self.vocabulary.joined(some, size[plain]) if some else None
        if some and got is None:
            plain[:] = False
        new = np.zeros(0, np.uint16)
        if plain.any():
            new, n[plain] = got[0].astype(np.uint16), got[1]
        start = len(self.flat) + np.cumsum(n) - n
        parts = [self.flat, new]
        if not plain.all():
            # Other white space than ASCII's splits these words here.
            odd = np.flatnonzero(~plain)
            split = [words[i].split() for i in odd.tolist()]
            encoded = iter(self.vocabulary.each([w for ws in split for w in ws]))
            ids = [[i for _ in ws for i in next(encoded)] for ws in split]
            chars[odd] = [sum(map(len, ws)) for ws in split]
            n[odd] = [len(x) for x in ids]
            start[odd] = len(self.flat) + len(new) + np.cumsum(n[odd]) - n[odd]
            parts.append(np.array([i for x in ids for i in x], np.uint16))
        more = np.concatenate(parts[1:])
        split = np.append(0, np.cumsum(self.vocabulary.is_byte[more]))
        at = start - len(self.flat)
        broken = split[at + n] - split[at]
        self.flat = np.concatenate(parts)
        to = np.searchsorted(self.keys, h)
        self.keys, self.start, self.n, self.chars, self.broken = (np.insert(old, to, x) for old, x in ((self.keys, h), (self.start, start), (self.n, n), (self.chars, chars), (self.broken, broken)))


    def gap(self, raw: bytes) -> int:
        """The length of a run of white space that no word takes a space of."""
        n = self.gaps.get(raw)
        if n is None:
            if len(self.gaps) >= CACHE_GAPS:
                self.gaps.clear()
            n = self.vocabulary.whole(raw.decode())
            if len(raw) <= LONG_GAP:
                self.gaps[raw] = n
        return n


@cache
def word_table(model: str, bare: bool = False) -> WordTable:
    return WordTable(model, bare)


def measure_docs(data: np.ndarray, offs: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, characters (without white space) and byte pieces of each text of a chunk from rows_of()."""
    have = word_table(model)
    starts, ends, rows = word_spans(data, offs, SPACE_SPLIT)
    at = have.places(data, starts, ends)
    return tuple(np.bincount(rows, x[at], len(offs) - 1).astype(np.int64) for x in (have.n, have.chars, have.broken))


def encode_docs(data: np.ndarray, offs: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All piece ids of a chunk in a row and the offsets of each text in them; each text's characters and byte pieces."""
    have = word_table(model)
    starts, ends, rows = word_spans(data, offs, SPACE_SPLIT)
    at = have.places(data, starts, ends)
    docs = len(offs) - 1
    n = have.n[at].astype(np.int64)
    last = np.cumsum(n)
    ids = have.flat[np.repeat(have.start[at] - (last - n), n) + np.arange(int(last[-1]) if len(n) else 0)]
    out = np.zeros(docs + 1, np.int64)
    np.cumsum(np.bincount(rows, n, docs), out=out[1:])
    return ids, out, *(np.bincount(rows, x[at], docs).astype(np.int64) for x in (have.chars, have.broken))


def count_docs(data: np.ndarray, offs: np.ndarray, model: str) -> np.ndarray:
    """The number of tokens of each text of a chunk from rows_of() under its own tokeniser."""
    have, docs = word_table(model), len(offs) - 1
    if not model.endswith(".tiktoken"):
        return np.array([have.vocabulary.whole(data[a:b].tobytes().decode()) if b > a else 0 for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], np.int64)
    starts, ends, rows = word_spans(data, offs, SPACE_SPLIT)
    n = np.zeros(docs, np.int64)
    spaced = (starts > offs[rows]) & (data[starts - 1] == 32)
    for table, own in ((have, spaced), (word_table(model, True), ~spaced)):
        if own.any():
            at = table.places(data, starts[own], ends[own])
            n += np.bincount(rows[own], table.n[at], docs).astype(np.int64)
    # White space before each word, less the space that the word takes, and at the end of each text.
    first = np.ones(len(starts), bool)
    first[1:] = rows[1:] != rows[:-1]
    last_end = offs[:-1].copy()
    last_end[rows] = ends  # the last word of a text stands
    lo = np.where(first, offs[rows], np.append(0, ends[:-1]))
    # A word takes a single space; any other last character stands alone, apart from the run before it.
    n += np.bincount(rows, (starts > lo) & ~spaced, docs).astype(np.int64)
    lo, hi, row = np.concatenate([lo, last_end]), np.concatenate([np.maximum(starts - 1, lo), offs[1:]]), np.concatenate([rows, np.arange(docs)])
    size = hi - lo
    n += np.bincount(row, size == 1, docs).astype(np.int64)
    for i in np.flatnonzero(size > 1).tolist():
        n[row[i]] += have.gap(data[lo[i] : hi[i]].tobytes())
    raw = data.tobytes()
    wide = np.array([m.start() for m in _WIDE_SPACE.finditer(raw)], np.int64)
    for i in np.unique(np.searchsorted(offs, wide, side="right") - 1).tolist():
        n[i] = have.vocabulary.whole(raw[offs[i] : offs[i + 1]].decode())
    return n
