"""Cutting texts into pieces that a byte-level tokenizer encodes one by one.

A byte-level BPE splits a text into pre-tokens by a pattern (contractions, runs of letters,
of digits, of other signs, each with a space before it, and white space). ``cut`` finds
borders of pre-tokens for many texts at once, on their UTF-8 bytes, and only such as are
borders whatever stands around them; so pieces can be encoded apart, each distinct one once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 22  # of text that are cut at once
KEPT_BYTES = 160 << 20  # of pieces and their ids that a coder keeps
LONG = 256  # letters of a piece above which it is not kept
# FOREIGN: of a character of several bytes that is no white space; OTHER: not known.
FOREIGN, LETTER, DIGIT, SIGN, QUOTE, SPACE, WHITE, OTHER = range(8)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = SIGN
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    kind[39], kind[32] = QUOTE, SPACE
    kind[9:14] = WHITE
    return kind


_KINDS = _kinds()
#: Lead bytes of two-byte characters that are all letters (Latin, Cyrillic), but for the signs of multiplication and division.
_LETTER_LEADS = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
#: Lead bytes of all other characters that can be told apart from white space, by the number of their bytes.
_WIDTHS = np.zeros(256, np.int64)
_WIDTHS[[*range(0xCA, 0xD0), *range(0xD2, 0xE0)]] = 2
_WIDTHS[0xE0:0xF0], _WIDTHS[0xF0:0xF5] = 3, 4


def _foreign(data: np.ndarray, kind: np.ndarray) -> None:
    """Set the kinds of the characters led by ``_WIDTHS``."""
    lead = np.flatnonzero(_WIDTHS[data])
    if not len(lead):
        return
    first, second, width = data[lead], data[lead + 1], _WIDTHS[data[lead]]
    third = data[np.minimum(lead + 2, len(data) - 1)]
    kinds = np.full(len(lead), FOREIGN, np.uint8)
    # Blocks that hold white space: U+1680, U+180E, U+2000 to U+207F, and U+3000 itself.
    kinds[(first == 0xE1) & ((second == 0x9A) | (second == 0xA0)) | (first == 0xE2) & (second <= 0x81) | (first == 0xE3) & (second == 0x80) & (third == 0x80)] = OTHER
    # U+4E00 to U+9FBF are letters; the stops and marks between them are none.
    kinds[(first == 0xE4) & (second >= 0xB8) | (first >= 0xE5) & (first <= 0xE8) | (first == 0xE9) & (second < 0xBF)] = LETTER
    kinds[(first == 0xE3) & (second == 0x80) & ((third == 0x81) | (third == 0x82))] = SIGN
    kinds[(first == 0xEF) & (second == 0xBC) & np.isin(third, [0x81, 0x8C, 0x9A, 0x9B, 0x9F])] = SIGN
    for k in range(4):
        wide = width > k
        kind[lead[wide] + k] = kinds[wide]



def _borders() -> np.ndarray:
    """Whether a pre-token always ends between two kinds."""
    out = np.zeros((8, 8), bool)
    for a in (LETTER, DIGIT, SIGN, QUOTE):
        for b in (LETTER, DIGIT, SIGN, QUOTE, WHITE, SPACE):
            signs = {a, b} <= {SIGN, QUOTE}
            contraction = a == QUOTE and b == LETTER
            out[a, b] = a != b and not signs and not contraction
    for b in (FOREIGN, LETTER, DIGIT, SIGN, QUOTE):
        out[WHITE, b] = True
    out[FOREIGN, [SPACE, WHITE]] = True
    return out


_BORDERS = _borders().ravel()


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in turn, and the place of each text's first, with the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    off = offsets - offsets[0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
    kind = _KINDS[data]
    lead = np.flatnonzero(_LETTER_LEADS[data[:-1]])
    if len(lead):
        lead = lead[~((data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)))]
        kind[lead] = kind[lead + 1] = LETTER
    _foreign(data, kind)
    begin = np.empty(len(data), bool)
    begin[0] = True
    np.take(_BORDERS, (kind[:-1] << 3) | kind[1:], out=begin[1:])
    # A run of white space is left to the tokenizer but for a lone space, which opens the next pre-token.
    spaced = np.flatnonzero(begin & (kind == SPACE))
    after = kind[np.minimum(spaced + 1, len(data) - 1)]
    begin[spaced[(spaced + 1 == len(data)) | (after == SPACE) | (after == WHITE) | (after == OTHER)]] = False
    # Of a longer run, what the tokenizer leaves to its last sign depends on what follows: no border after it.
    behind = np.flatnonzero(begin[2:] & (kind[1:-1] == WHITE)) + 2
    before = kind[behind - 2]
    begin[behind[(before == SPACE) | (before == WHITE) | (before == OTHER)]] = False
    begin[off[off < len(data)]] = True
    begins = np.flatnonzero(begin)
    pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data))
    return pieces, np.searchsorted(begins, off)


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``SLICE_BYTES``, with the place of their first; a longer text is one by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


class PieceCoder:
    """Ids of texts, through ``encode_all(pieces) -> list of id lists`` for pieces not met before.

    What has been met is kept up to ``most`` bytes and then for the half of them met first,
    where the frequent ones are; pieces of more than ``LONG`` letters are not kept. That changes cost and never results.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]], most: int = KEPT_BYTES):
        self.encode_all, self.most, self.known, self.held = encode_all, most, {}, 0

    def _keep(self, name: str, ids: bytes) -> None:
        self.known[name] = ids
        self.held += sys.getsizeof(name) + sys.getsizeof(ids) + 100  # an entry of the table
        if self.held > self.most:
            while self.held > self.most // 2:
                x, dropped = self.known.popitem()  # the last one
                self.held -= sys.getsizeof(x) + sys.getsizeof(dropped) + 100

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the place of each text's first, with the end."""
        pieces, at = cut(texts)
        if not len(pieces):
            return np.empty(0, "<u4"), at
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        parts = list(map(self.known.get, names))
        fresh = [k for k, x in enumerate(parts) if x is None]
        if fresh:
            for k, ids in zip(fresh, self.encode_all([names[k] for k in fresh]), strict=True):
                parts[k] = np.array(ids, "<u4").tobytes()
                if len(names[k]) <= LONG:
                    self._keep(names[k], parts[k])
        flat = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(starts[which] - ends + lengths, lengths)
        return flat[places], np.concatenate([[0], ends])[at]
