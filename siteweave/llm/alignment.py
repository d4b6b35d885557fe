"""Operator 12: alignment of two tokenizers' ids by an associative fragment monoid.

Tokenizer A is byte-level BPE over space+text, B a sentencepiece BPE that adds the space.
Byte offsets where tokens of both end cut the tokens into groups. A text is read in byte
ranges of about ``CHUNK``; each range gives a fragment: an open prefix (up to its first
common offset), closed groups, and an open suffix. Fragments compose: what lies between
two of them is aligned again, which closes groups there; so a very long text is aligned by
many tasks, and its open edges are folded ``FAN`` at a time in a tree over Spark tasks,
while closed groups stay where they were made. A short text is one fragment.

Each range is encoded on its own because it begins, for each tokenizer, at a border that no
token crosses: for A before white space or punctuation after a letter; for B between two
characters that stand side by side in no piece. The two need not be the same offset, and
a range without such a border runs on to the next. Inside, texts are cut at many such
borders into units, each distinct one encoded once a process and kept within ``KEEP_BYTES``.

Two linked tokens end at one offset, so one's bytes end with the other's: the vocabularies
alone bound the number of id pairs (by the sum of their entries' lengths), whatever the
corpus. That proven bound is what lets counts pass through the driver.

Cases: texts that are null, empty, or whose joined bytes differ under A or B (B reads U+2581
as a space) have no tokens and zeros; special-token
strings are plain text; null and repeated doc_ids and repeated rows are rows like others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.pieces import cut as cut_for_a
from siteweave.llm.shared import Scratch, partitions

CHUNK = 1 << 16  # bytes of a text that make one fragment, about
FAN = 8  # fragments that one step of the tree composes
KEEP_BYTES = 1 << 25  # of units that a process keeps for one tokenizer
RUN_BYTES = 1 << 20  # of texts that are aligned at once
CALL_UNITS = 4096  # that a library encodes at once
TEXT_ROWS = 64  # whose groups are written as texts at once
ARROW_ROWS, LONG_ROWS = 256, 32  # rows of short and of long texts that a worker gets at once
LISTS = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
#: Of a row: how many ids and groups it has, the digest of its groups, and their links: places among the pairs that can be, 4 bytes each.
SUMMARY = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
GROUPS = f"doc_id long, ok boolean, {LISTS}, {SUMMARY}"
EDGE = "array<array<long>>"
FRAGMENT = f"row long, doc_id long, seq long, ok boolean, until long, {LISTS}, cut boolean, prefix {EDGE}, suffix {EDGE}"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --- vocabularies


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, the bytes of their entries, and the id pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        a.encode_special_tokens = True
        letters = _byte_letters()
        entries = a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        whole = [p for k, p in enumerate(pieces) if not self.b.is_byte(k) and not self.b.is_control(k)]
        self.b_inner = {x + y for p in whole for x, y in zip(p.replace("▁", " "), p.replace("▁", " ")[1:], strict=False)}
        if any("\n" in pair or (pair[1] == " " != pair[0]) for pair in self.b_inner):
            raise ValueError("pieces of B cross the end of a word")
        self.a_coder = UnitCoder(cut_for_a, lambda units: [x.ids for x in a.encode_batch_fast(units, add_special_tokens=False)], self.a_bytes)
        # A line feed stands apart from all that follows and takes the added space: two ids to drop.
        together = np.zeros((128, 128), bool)
        for pair in self.b_inner:
            if pair.isascii():
                together[ord(pair[0]), ord(pair[1])] = True
        self.b_coder = UnitCoder(lambda texts: cut_for_b(texts, together), lambda units: [x[2:] for x in self.b.encode(["\n" + u for u in units], num_threads=1)], self.b_bytes)
        self.pairs = self._pairs()

    def rested(self) -> Vocabularies:
        """For tasks that encode nothing: without the units that a process keeps."""
        self.a_coder.forget()
        self.b_coder.forget()
        return self

    def key(self, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
        return a_ids.astype(np.int64) * len(self.b_bytes) + b_ids

    def _pairs(self) -> np.ndarray:
        """Keys of all id pairs of which one's bytes end with the other's, in order."""
        out = []
        for left, right, flip in ((self.a_bytes, self.b_bytes, False), (self.b_bytes, self.a_bytes, True)):
            by_bytes: dict[bytes, list[int]] = {}
            for k, entry in enumerate(right):
                by_bytes.setdefault(entry, []).append(k)
            for k, entry in enumerate(left):
                for i in range(len(entry)):
                    out += [(m, k) if flip else (k, m) for m in by_bytes.get(entry[i:], ())]
        a_ids, b_ids = np.array(out, np.int64).reshape(-1, 2).T
        return np.unique(self.key(a_ids, b_ids))


_loaded: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Loaded once in a process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Vocabularies(a_path, b_path)
    return _loaded[a_path, b_path]


# --- encoding


def cut_for_b(texts: pa.Array, together: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Units of texts and the place of each text's first, with the end: cut before a space after another
    character, and between ASCII characters that stand side by side in no piece of B."""
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if not len(data):
        return pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
    begin = np.ones(len(data), bool)
    plain = data < 128
    begin[1:] = (data[1:] == 32) & (data[:-1] != 32) | plain[1:] & plain[:-1] & ~together[data[:-1] & 127, data[1:] & 127]
    begin[off[off < len(data)]] = True
    begins = np.flatnonzero(begin)
    units = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int64)), pa.py_buffer(data))
    return units, np.searchsorted(begins, off)


class UnitCoder:
    """Ids of texts, through those of their units: parts between borders that no token crosses."""

    def __init__(self, cut, encode_all, entries: list[bytes]):
        self.cut, self.encode_all, self.entries = cut, encode_all, entries
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # ids of a unit; nothing: its bytes do not come back
        self.before: dict[str, bytes] = {}  # what was known until ``known`` was last begun anew
        self.kept = 0

    def _encoded(self, units: list[str], sizes: np.ndarray) -> list[bytes]:
        """The ids of units of ``sizes`` bytes, none for a unit whose bytes do not come back."""
        lists, entry = self.encode_all(units), self.entries.__getitem__
        flat = array("i", chain.from_iterable(lists))
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        lengths = np.append(0, np.cumsum(self.lengths[np.frombuffer(flat, np.int32)]))[ends]
        if np.array_equal(lengths, np.cumsum(sizes)) and b"".join(map(entry, flat)) == "".join(units).encode():  # so that of each unit
            data, places = flat.tobytes(), [0, *(4 * ends).tolist()]
            return [data[lo:hi] for lo, hi in pairwise(places)]
        return [array("i", ids).tobytes() if b"".join(map(entry, ids)) == unit.encode() else b"" for unit, ids in zip(units, lists, strict=True)]

    def _values(self, names: list[str], sizes: np.ndarray) -> list[bytes]:
        values = list(map(self.known.get, names))
        missing = [k for k, v in enumerate(values) if v is None]
        units = [names[k] for k in missing]
        found = list(map(self.before.get, units))
        fresh = [k for k, v in enumerate(found) if v is None]
        sizes = sizes[missing] if missing else sizes[:0]
        for lo in range(0, len(fresh), CALL_UNITS):
            some = fresh[lo : lo + CALL_UNITS]
            for k, value in zip(some, self._encoded([units[k] for k in some], sizes[some]), strict=True):
                found[k] = value
        for k, value in zip(missing, found, strict=True):
            values[k] = value
        if len(sizes) and sizes.max() > 64:
            short = [k for k, unit in enumerate(units) if len(unit) <= 64]
            units, found = [units[k] for k in short], [found[k] for k in short]
        self.known.update(zip(units, found, strict=True))
        self.kept += sum(map(len, units)) + sum(map(len, found)) + 200 * len(units)
        if self.kept > KEEP_BYTES // 2:
            before = self.known
            self.forget()
            self.before = before
        return values

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in turn, the place of each text's first, with the end, and whether each text's bytes came back."""
        units, at = self.cut(texts)
        if not len(units):
            return np.empty(0, np.int32), at, np.ones(len(texts), bool)
        coded = units.dictionary_encode()
        parts = self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), pc.binary_length(coded.dictionary).to_numpy())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(parts), "<i4")))
        taken = lists.take(coded.indices)
        ends = taken.offsets.to_numpy()
        bad = np.append(0, np.cumsum(np.diff(ends) == 0))[at]
        return taken.values.to_numpy(), ends[at], np.diff(bad) == 0


# --- groups and fragments


class Run(NamedTuple):
    """Closed groups: ids of both kinds, and how many of each every group has."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray


class Edge(NamedTuple):
    """Open tokens of both kinds with the offsets where they end."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray

    @staticmethod
    def of(lists) -> Edge:
        return Edge(*(np.array(x, np.int64) for x in lists))

    def joined(self, other: Edge) -> Edge:
        return Edge(*map(np.concatenate, zip(self, other, strict=True)))

    def part(self, a_from: int, a_to: int | None, b_from: int, b_to: int | None) -> Edge:
        return Edge(self.a_ids[a_from:a_to], self.a_ends[a_from:a_to], self.b_ids[b_from:b_to], self.b_ends[b_from:b_to])


NOTHING = Edge(*(np.empty(0, np.int64),) * 4)


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of each kind that end together."""
    at = np.searchsorted(b_ends, a_ends)
    same = np.append(b_ends, -1)[at] == a_ends
    return np.flatnonzero(same), at[same]


def closed(tokens: Edge, a_cuts: np.ndarray, b_cuts: np.ndarray, first: int) -> tuple[int, Run]:
    """The groups after cut ``first`` (-1: the beginning) up to the last cut, with the offset where they end."""
    a, b = np.append(-1, a_cuts)[first + 1 :], np.append(-1, b_cuts)[first + 1 :]
    return int(tokens.a_ends[a[-1]]) if a[-1] >= 0 else 0, Run(tokens.a_ids[a[0] + 1 : a[-1] + 1], tokens.b_ids[b[0] + 1 : b[-1] + 1], np.diff(a), np.diff(b))


@dataclass
class Fragment:
    """Element of the monoid: without a cut all is ``prefix``."""

    cut: bool
    prefix: Edge
    suffix: Edge

    @staticmethod
    def of(tokens: Edge, opens: bool) -> tuple[Fragment, tuple[int, Run] | None]:
        """The fragment of one range's tokens, with its closed groups; ``opens``: its begin is a cut, that of the text."""
        a_cuts, b_cuts = common_ends(tokens.a_ends, tokens.b_ends)
        if not len(a_cuts):
            return (Fragment(True, NOTHING, tokens) if opens else Fragment(False, tokens, NOTHING)), None
        prefix = NOTHING if opens else tokens.part(0, a_cuts[0] + 1, 0, b_cuts[0] + 1)
        suffix = tokens.part(a_cuts[-1] + 1, None, b_cuts[-1] + 1, None)
        run = closed(tokens, a_cuts, b_cuts, -1 if opens else 0)
        return Fragment(True, prefix, suffix), run if len(run[1].a_sizes) else None

    def then(self, other: Fragment) -> tuple[Fragment, tuple[int, Run] | None]:
        """Both in turn, with the groups that close between them."""
        middle = (self.suffix if self.cut else self.prefix).joined(other.prefix)
        seam, run = Fragment.of(middle, self.cut)
        prefix = self.prefix if self.cut else seam.prefix
        cut = self.cut or seam.cut
        if not cut:
            return Fragment(other.cut, prefix, other.suffix), run
        # The other's prefix ends at its first cut, so that nothing of the middle stays open then.
        return Fragment(True, prefix, other.suffix if other.cut else seam.suffix), run


# --- borders of ranges


_A_STOPS = frozenset(".,;:!?()[]{}\"、。，！？：；「」،؟।")


def _a_border(text: str, k: int) -> bool:
    """Whether no token of A crosses from ``text[k - 1]`` to ``text[k]``: a letter, and then a space or a stop."""
    return text[k - 1].isalpha() and (text[k] == " " or text[k] in _A_STOPS)


def ranges(text: str, inner: set[str], chunk: int) -> list[tuple[int, int, int, int]]:
    """Begin and end, in characters of space+text, of the ranges for A and for B."""
    marks, size, step = [], 0, min(1024, chunk)
    for k in range(0, len(text), step):
        size += len(text[k : k + step].encode())
        if size >= chunk:
            marks.append(min(k + step, len(text)))
            size = 0
    cuts = [(0, 0)]
    for k in marks:
        a, b = max(k, cuts[-1][0] + 1), max(k, cuts[-1][1] + 1)
        while a < len(text) and not _a_border(text, a):
            a += 1
        while b < len(text) and text[b - 1 : b + 1] in inner:
            b += 1
        if a < len(text) and b < len(text):
            cuts.append((a, b))
    ends = [*cuts[1:], (len(text), len(text))]
    return [(a, to_a, b, to_b) for (a, b), (to_a, to_b) in zip(cuts, ends, strict=True)]


# --- over documents


def _spaced(texts: pa.Array) -> pa.Array:
    """A space before every text that is not empty."""
    none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), none)
    return pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))


def _runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of about ``RUN_BYTES`` of texts, with the place of their first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    marks = np.flatnonzero(np.diff(sizes // RUN_BYTES, prepend=0, append=-1))[:-1] + 1 if len(texts) else []
    for lo, hi in zip([0, *marks], [*marks, len(texts)], strict=True):
        if lo < hi:
            yield lo, texts.slice(lo, hi - lo)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def aligned_slice(vocab: Vocabularies, spaced: pa.Array) -> tuple[np.ndarray, Run, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of many whole texts: which have tokens, all groups in turn, and each text's places among A ids, B ids and groups."""
    a_ids, a_at, a_ok = vocab.a_coder.ids(spaced)
    b_ids, b_at, b_ok = vocab.b_coder.ids(spaced)
    ok = a_ok & b_ok
    if not ok.all():
        a_ids, b_ids = a_ids[np.repeat(ok, np.diff(a_at))], b_ids[np.repeat(ok, np.diff(b_at))]
        a_at, b_at = (np.append(0, np.cumsum(np.where(ok, np.diff(at), 0))) for at in (a_at, b_at))
    a_ends, b_ends = np.cumsum(vocab.a_coder.lengths[a_ids]), np.cumsum(vocab.b_coder.lengths[b_ids])
    _, run = closed(Edge(a_ids, a_ends, b_ids, b_ends), *common_ends(a_ends, b_ends), -1)
    return ok, run, a_at, b_at, np.searchsorted(np.append(0, np.cumsum(run.a_sizes)), a_at)


def _hashed(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest() if text else ""


def group_hashes(run: Run, a_at: np.ndarray, b_at: np.ndarray, g_at: np.ndarray) -> list[str]:
    """The digest of each row's groups, of ``TEXT_ROWS`` rows at once."""
    out = []
    for lo in range(0, len(g_at) - 1, TEXT_ROWS):
        (a0, *_, a1), (b0, *_, b1), g = (x[lo : lo + TEXT_ROWS + 1] for x in (a_at, b_at, g_at))
        some = Run(run.a_ids[a0:a1], run.b_ids[b0:b1], run.a_sizes[g[0] : g[-1]], run.b_sizes[g[0] : g[-1]])
        out += map(_hashed, group_text(some, g - g[0]))
    return out


def _packed(links: np.ndarray, g_at: np.ndarray) -> pa.Array:
    """Each row's links as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(g_at) - 1, [None, pa.py_buffer((4 * g_at).astype(np.int32)), pa.py_buffer(links.astype("<i4"))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The links of all rows in turn, and each row's places among them."""
    off = np.frombuffer(column.buffers()[1] or bytes(4), np.int32)[column.offset :][: len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data.view("<i4"), (off - off[0]) // 4


def align_short(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Groups of every row whose text is one range, with what is known of them before pairs are counted."""

    def run(batches):
        vocab = vocabularies(a_path, b_path)
        for batch in batches:
            for lo, texts in _runs(batch.column(1)):
                ok, groups, a_at, b_at, g_at = aligned_slice(vocab, _spaced(texts))
                columns = [batch.column(0).slice(lo, len(texts)), pa.array(ok), _lists(groups.a_ids, a_at), _lists(groups.b_ids, b_at), _lists(groups.a_sizes, g_at), _lists(groups.b_sizes, g_at)]
                numbers = [pa.array(np.diff(at), pa.int64()) for at in (a_at, b_at, g_at)]
                columns += [*numbers, pa.array(group_hashes(groups, a_at, b_at, g_at), pa.string()), _packed(_links(vocab, groups), g_at)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [c.split()[0] for c in GROUPS.split(", ")]
    return docs.mapInArrow(run, GROUPS)


def _as_lists(edge: Edge) -> list[list[int]]:
    return [x.tolist() for x in edge]


def _fragment_row(row, doc_id, seq, ok, fragment: Fragment | None, run: tuple[int, Run] | None) -> dict:
    until, groups = run or (-1, Run(*(np.empty(0, np.int64),) * 4))
    edges = (fragment.cut, _as_lists(fragment.prefix), _as_lists(fragment.suffix)) if fragment else (None, None, None)
    values = (row, doc_id, seq, ok, until, *(x.tolist() for x in groups), *edges)
    return dict(zip((c.split()[0] for c in FRAGMENT.split(", ")), values, strict=True))


def _fragment_batch(rows: list[dict]) -> pa.RecordBatch:
    ints, edges = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), ints, ints, ints, ints, pa.bool_(), edges, edges]
    names = [c.split()[0] for c in FRAGMENT.split(", ")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))


def long_ranges(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """``docs(row, doc_id, text)`` cut into ranges, with the byte offsets where they begin."""

    def run(batches):
        inner = vocabularies(a_path, b_path).b_inner
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, a_from, b_from = " " + text, 0, 0
                for seq, (a, to_a, b, to_b) in enumerate(ranges(text, inner, chunk)):
                    a_text, b_text = text[a:to_a], text[b:to_b]
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": pa.array([doc_id], pa.int64()), "seq": [seq], "a_from": [a_from], "b_from": [b_from], "a_text": [a_text], "b_text": [b_text]})
                    a_from, b_from = a_from + len(a_text.encode()), b_from + len(b_text.encode())

    return docs.mapInArrow(run, "row long, doc_id long, seq long, a_from long, b_from long, a_text string, b_text string")


def range_fragments(chunks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One fragment for each range, with its closed groups."""

    def run(batches):
        vocab = vocabularies(a_path, b_path)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row, doc_id, seq, a_from, b_from = (one.column(c)[0].as_py() for c in ("row", "doc_id", "seq", "a_from", "b_from"))
                a_ids, _, a_ok = vocab.a_coder.ids(one.column("a_text").cast(pa.large_string()))
                b_ids, _, b_ok = vocab.b_coder.ids(one.column("b_text").cast(pa.large_string()))
                if not (a_ok.all() and b_ok.all()):
                    yield _fragment_batch([_fragment_row(row, doc_id, seq, False, Fragment(False, NOTHING, NOTHING), None)])
                    continue
                tokens = Edge(a_ids, a_from + np.cumsum(vocab.a_coder.lengths[a_ids]), b_ids, b_from + np.cumsum(vocab.b_coder.lengths[b_ids]))
                yield _fragment_batch([_fragment_row(row, doc_id, seq, True, *Fragment.of(tokens, seq == 0))])

    return chunks.mapInArrow(run, FRAGMENT)


def folded(fragments: DataFrame, fan: int) -> DataFrame:
    """One level of the tree: ``fan`` neighbours become one fragment, and the groups closed between them rows of their own."""

    def fold(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        row, doc_id, seq = (pdf[c].iloc[0] for c in ("row", "doc_id", "seq"))
        doc_id = None if pd.isna(doc_id) else int(doc_id)
        ok, whole, out = bool(pdf["ok"].all()), None, []
        for cut, prefix, suffix in zip(pdf["cut"], pdf["prefix"], pdf["suffix"], strict=True) if ok else ():
            one = Fragment(bool(cut), Edge.of(prefix), Edge.of(suffix))
            if whole is None:
                whole = one
                continue
            whole, run = whole.then(one)
            if run:
                out.append(_fragment_row(row, doc_id, -1, True, None, run))
        out.append(_fragment_row(row, doc_id, int(seq) // fan, ok, whole or Fragment(False, NOTHING, NOTHING), None))
        return pd.DataFrame(out).astype({"doc_id": "Int64"})

    return fragments.groupBy("row", F.expr(f"seq div {fan}")).applyInPandas(fold, FRAGMENT)


def align_long(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Runs of closed groups ``row, doc_id, ok, until, ...`` of rows whose texts have many ranges; sorted by ``until`` they are a text's groups."""
    spark = docs.sparkSession
    keyed = docs.withColumn("row", F.monotonically_increasing_id()).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = scratch.stored(long_ranges(keyed, a_path, b_path, chunk), "ranges", arrow_rows=LONG_ROWS)  # from here on the row numbers are fixed
    spread = chunks.repartition(partitions(spark), "row", "seq")
    level = scratch.stored(range_fragments(spread, a_path, b_path), "fragments", arrow_rows=LONG_ROWS)
    runs = [level.where("until >= 0")]
    open_rows, last = level.drop("until", *Run._fields).where("seq >= 0"), level.agg(F.max("seq")).first()[0]
    while last:
        made = scratch.stored(folded(open_rows, fan), "folded")
        runs.append(made.where("until >= 0"))
        open_rows, last = made.drop("until", *Run._fields).where("seq >= 0"), last // fan
    bad = open_rows.where(~F.col("ok")).select("row", F.lit(True).alias("bad"))
    found = runs[0]
    for run in runs[1:]:
        found = found.unionByName(run)
    kept = found.select("row", "doc_id", "ok", "until", *Run._fields).join(bad, "row", "left_anti")
    none = open_rows.where(~F.col("ok")).select("row", "doc_id", F.lit(False).alias("ok"), F.lit(0).cast("long").alias("until"), *(F.array().cast("array<int>").alias(c) for c in Run._fields))
    return kept.unionByName(none)


class Alignments(NamedTuple):
    """Groups of all rows: those of one range, and runs of those of many."""

    short: DataFrame
    long: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch, chunk: int = CHUNK, fan: int = FAN) -> Alignments:
    """The groups of every row of ``docs(doc_id, text)``, stored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = scratch.stored(align_short(docs.where(size < chunk), a_path, b_path), "short", arrow_rows=ARROW_ROWS)
    return Alignments(short, align_long(docs.where(size >= chunk), a_path, b_path, scratch, chunk, fan))


def _flat(batch: pa.RecordBatch) -> tuple[Run, list[np.ndarray]]:
    """A batch's lists as one run, and each row's places in them."""
    columns = [batch.column(c) for c in Run._fields]
    offsets = [c.offsets.to_numpy().astype(np.int64) for c in columns]
    return Run(*(c.flatten().to_numpy().astype(np.int64) for c in columns)), [o - o[0] for o in offsets]


def _links(vocab: Vocabularies, run: Run) -> np.ndarray:
    """The number, among the pairs that can be, of the pair that ends each group."""
    a, b = np.cumsum(run.a_sizes) - 1, np.cumsum(run.b_sizes) - 1
    return np.searchsorted(vocab.pairs, vocab.key(run.a_ids[a], run.b_ids[b]))


def pair_counts(found: Alignments, a_path: str, b_path: str, scratch: Scratch) -> DataFrame:
    """``a_id, b_id, n``: how many links hold each pair, over all rows."""

    def run(batches):
        vocab = vocabularies(a_path, b_path).rested()
        counts = np.zeros(len(vocab.pairs), np.int64)
        for batch in batches:
            links = _unpacked(batch.column(0))[0] if batch.num_columns == 1 else _links(vocab, _flat(batch)[0])
            counts += np.bincount(links, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*np.divmod(vocab.pairs[at], len(vocab.b_bytes)), counts[at])], ["a_id", "b_id", "n"])

    tables = (found.short.select("links"), ARROW_ROWS), (found.long.select(*Run._fields), LONG_ROWS)
    parts = [scratch.stored(x.mapInArrow(run, "a_id long, b_id long, n long"), "pairs", arrow_rows=rows) for x, rows in tables]
    return parts[0].unionByName(parts[1]).groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


def _digits(most: int) -> np.ndarray:
    """Rows of decimal digits and their number."""
    text = np.arange(most + 1).astype("S10").view(np.uint8).reshape(most + 1, 10)
    return np.concatenate([text, (text > 0).sum(axis=1, dtype=np.uint8)[:, None]], axis=1)


_digit_rows: dict[int, np.ndarray] = {}


def group_text(run: Run, g_at: np.ndarray) -> list[bytes]:
    """Each row's groups as ``a1,a2|b1;a3|b2,b3``."""
    a, b = np.append(0, np.cumsum(run.a_sizes)), np.append(0, np.cumsum(run.b_sizes))
    at_a = np.arange(len(run.a_ids)) + np.repeat(b[:-1], run.a_sizes)
    at_b = np.arange(len(run.b_ids)) + np.repeat(a[1:], run.b_sizes)
    ids, ends = np.empty(len(at_a) + len(at_b), np.int64), np.full(len(at_a) + len(at_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = run.a_ids, run.b_ids
    ends[at_a[a[1:] - 1]], ends[at_b[b[1:] - 1]] = ord("|"), ord(";")
    most = 1 << max(16, int(ids.max(initial=0)).bit_length())
    if most not in _digit_rows:
        _digit_rows[most] = _digits(most)
    rows = _digit_rows[most][ids]
    sizes = rows[:, 10].astype(np.int64)
    width = int(sizes.max(initial=0)) + 1
    rows = rows[:, :width]
    rows[np.arange(len(rows)), sizes] = ends
    text = rows[np.arange(width) <= sizes[:, None]].tobytes()
    places = np.append(0, np.cumsum(sizes + 1))[(a + b)[g_at]]
    return [text[lo : max(lo, hi - 1)] for lo, hi in zip(places, places[1:], strict=False)]


class _Count:
    """The best counts, for tasks: arrays as long as the list of possible pairs, which the vocabularies bound."""

    def __init__(self, vocab: Vocabularies, rows: list):
        a_ids, b_ids, n = np.array(rows, np.int64).reshape(-1, 3).T
        at = np.searchsorted(vocab.pairs, vocab.key(a_ids, b_ids))
        most = np.zeros(len(vocab.b_bytes), np.int64)
        np.maximum.at(most, b_ids, n)
        self.counts, self.best = np.zeros(len(vocab.pairs), np.int64), np.zeros(len(vocab.pairs), bool)
        self.counts[at], self.best[at] = n, n == most[b_ids]


def alignment_digests(found: Alignments, counts: DataFrame, a_path: str, b_path: str, scratch: Scratch) -> DataFrame:
    """The digest columns of every row."""
    spark = counts.sparkSession
    known = _Count(vocabularies(a_path, b_path), [tuple(r) for r in counts.collect()])
    shared = spark.sparkContext.broadcast(known)  # at most as long as the vocabularies allow
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def counted(links, at):
        best = np.append(0, np.cumsum(shared.value.best[links]))
        total = np.append(0, np.cumsum(shared.value.counts[links]))
        return [np.diff(best[at]), np.diff(total[at])]

    def figures(vocab, batch):
        run, at = _flat(batch)
        return [np.diff(at[0]), np.diff(at[1]), np.diff(at[2]), np.diff(at[2]), *counted(_links(vocab, run), at[2])], group_text(run, at[2])

    def of_short(batches):
        for batch in batches:
            doc_id, n_a, n_b, n_groups, shas, links = batch.columns
            numbers = [pa.array(x, pa.int64()) for x in counted(*_unpacked(links))]
            yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, n_groups, *numbers, shas], names)

    def of_long(batches):
        vocab = vocabularies(a_path, b_path)
        now = doc_id = None
        sums, sha, seen = np.zeros(6, np.int64), hashlib.sha256(), False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.array([int(x)], pa.int64()) for x in sums), pa.array([sha.hexdigest() if seen else ""])], names)

        for batch in batches:
            numbers, texts = figures(vocab, batch)
            for k, (key, own) in enumerate(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                if key != now:
                    if now is not None:
                        yield row()
                    now, doc_id, sums, sha, seen = key, own, np.zeros(6, np.int64), hashlib.sha256(), False
                sums += [x[k] for x in numbers]
                if texts[k]:
                    sha.update((b";" if seen else b"") + texts[k])
                    seen = True
        if now is not None:
            yield row()

    ordered = found.long.repartition(partitions(spark), "row").sortWithinPartitions("row", "until")
    short = scratch.stored(found.short.select("doc_id", *(c.split()[0] for c in SUMMARY.split(", "))).mapInArrow(of_short, DIGEST), "digests", arrow_rows=ARROW_ROWS)
    return short.unionByName(scratch.stored(ordered.mapInArrow(of_long, DIGEST), "digests", arrow_rows=LONG_ROWS))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    scratch = Scratch(spark, "alignment")
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths, scratch)
    return alignment_digests(found, pair_counts(found, *paths, scratch), *paths, scratch)
