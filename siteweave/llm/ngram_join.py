"""Operator 3: n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct five-word shingles (as 64-bit hashes). Sets are put in
one global order, the shingles most frequent in the whole table last. Of a set of n
shingles, of which any partner must share at least a = ceil(0.75 n), the prefix holds the
first n - a + l; two similar sets share at least min(l1, l2) shingles of their prefixes,
and more if their sizes are close (``needed_matches``). Every document takes the l, from 1
to ``MAX_MATCHES``, whose estimated postings plus candidate checks cost least: documents
with frequent shingles in their prefix take a longer one and in exchange need more shared
shingles before anything is verified.

Equal sets are one class from the start. Postings carry their place in the order: what two
sets can still share from there on (the positional bound) decides whether they meet at all.
Sketches of both sets, about
a byte a shingle, then bound what they share, and only sets of possible pairs are moved.
Links are found in two passes. In the rounds of the first, each class proposes one other
class, the one that shares most among the classes that its shingles elect as their centres;
so a round makes a row a class at most. Linked classes form components. The second pass
pairs a class with whole other components, the smaller with the larger, for which enough
shared shingles are left, and compares it with all sets of the component in blocks. A
shingle that lies in more than ``CROWD`` components makes no row for two of them: its classes
are first compared with a pivot, a class of the largest of them, and what is left are
classes that are not similar to it. Such two can be similar to each other only if they
differ from the pivot in common, so they meet by what each has that the pivot lacks, or
the other way round (``departures``). All
links between components are found so, and the components are exact whatever order was
used. Then links are counted: they lie inside components only, so the sets of each
component are dealt into blocks and every two blocks are compared as matrices, which counts
all links of a set and makes no row for a pair.

Cases: null, empty and blank texts have no shingles and are alone; texts of fewer than
five words have one; rows that repeat share a component; rows are told apart by a hash of
doc_id and text, so null and repeated doc_ids are compared like others, and a component of
nulls alone has a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.components import components
from siteweave.llm.shared import Scratch, few, kept_by, lean, partitions

WORDS = 5
PERCENT = 75
MAX_MATCHES = 4
SKETCH_BITS = 22  # of the counters that estimate how frequent a shingle is
CHUNKS = 128  # parts in which the counters are summed
CHECK_COST = 8.0  # of verifying a candidate, in postings
ROUNDS = 5  # of the first pass, at most
FEW = 0.05  # links a proposal under which the first pass ends
LENIENT = 4  # a first-pass pair is verified for this part of the matches it needs
BLOCK = 512  # sets of a component's block
BLOCK_SHINGLES = 1 << 20  # of a component's block
WIDTH = 4096  # shingles that are compared at once
FEW_ROWS = 16  # of blocks of sets that a Python worker gets at once
ROWS = 1000  # of prefixes that are dealt at once
SLICE_BYTES = 1 << 19  # of text that are shingled at once
HELD_POSTINGS = 1 << 18  # that a task gathers before it deals them out
SMALL = 1 << 21  # shingles of all sets in question, up to which the sets themselves are sent to every task
CROWD = 24  # components in a shingle's list from which on they meet through a pivot
FAMILY = 64  # classes that are told from a pivot by one key, on the mean
HALF = PERCENT / (100 + PERCENT)  # of the sum of two sizes that similar sets share at least
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_INVERSE = np.uint64(pow(int(_MUL[0]), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MUL[4]
    x = (x ^ (x >> np.uint64(29))) * _MUL[3]
    return x ^ (x >> np.uint64(32))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    shown = np.ones(256, bool)
    shown[[9, 10, 11, 12, 13, 32]] = False
    codes = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL[1])
    codes[65:91] = codes[97:123]  # A-Z as a-z
    return shown, codes


_SHOWN, _CODES = _tables()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Word and shingle hashes of many texts at once.

    A word's hash is a polynomial over its bytes. Running sums over all bytes give it for
    every word: the sum between its ends, divided by the power at its start.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.up, self.down = words, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def word_hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words (A-Z taken as a-z) and the place of each text's first, with the end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        off = offsets - offsets[0]
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
        if len(self.up) <= len(data):
            self.up, self.down = (_powers(x, max(SLICE_BYTES, len(data)) + 1) for x in (_MUL[0], _INVERSE))
        shown = _SHOWN[data]
        first, last = shown.copy(), shown.copy()
        first[1:] &= ~shown[:-1]
        last[:-1] &= ~shown[1:]
        inner = off[(off > 0) & (off < len(data))]
        first[inner], last[inner - 1] = shown[inner], shown[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * self.up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        return _mix(hashes ^ ((ends - starts).astype(np.uint64) * _MUL[2])), np.searchsorted(starts, off)

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The shingle hashes (int64) of all texts, repeats and all, and the place of each text's first, with the end."""
        h, at = self.word_hashes(texts)
        words = np.diff(at)
        counts = np.where(words > 0, np.maximum(1, words - self.words + 1), 0)
        places = np.concatenate([[0], np.cumsum(counts)])
        begin = np.repeat(at[:-1] - places[:-1], counts) + np.arange(places[-1])
        length = np.minimum(words, self.words)
        length = length[0] if len(length) and (length == length[0]).all() else np.repeat(length, counts)
        mixed = np.zeros(len(begin), np.uint64) + np.asarray(length).astype(np.uint64)
        for k in range(self.words):
            if np.ndim(length) == 0 and k >= length:
                break
            near = h[np.minimum(begin + k, len(h) - 1)] if len(h) else h
            step = mixed ^ near
            step *= _MUL[k % 5]
            step ^= step >> np.uint64(31)
            mixed = step if np.ndim(length) == 0 else np.where(k < length, step, mixed)
        return _mix(mixed).view(np.int64), places

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        return distinct(self.shingles(pa.array([text], pa.string()))[0])


def word_hashes(text: str | None) -> np.ndarray:
    return Shingler().word_hashes(pa.array([text], pa.string()))[0]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``SLICE_BYTES``, with the place of their first; a longer text is one by itself."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def least_shared(n: int, percent: int = PERCENT) -> int:
    return -(-n * percent // 100)


class Order:
    """The global order of shingles: by estimated frequency, then by hash.

    ``counts`` has a counter for every value of a shingle's leading bits; what other
    shingles add to a counter on the mean is taken off the estimate. Levels are eighths of
    an octave, a byte a counter.
    """

    def __init__(self, counts: np.ndarray):
        self.shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
        self.levels = np.floor(8 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
        self.others = np.maximum(0.0, 2.0 ** (np.arange(256) / 8) - counts.mean() - 1)

    def prefix(self, tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
        """A set's prefix, in order, and the number of matches that it asks for."""
        n = len(tokens)
        shared = least_shared(n, percent)
        most = min(MAX_MATCHES, shared)
        level = self.levels[(tokens.view(np.uint64) >> self.shift).view(np.int64)]
        order = np.argsort(level, kind="stable")[: n - shared + most]
        others = np.cumsum(self.others[level[order]])  # documents besides this one in the lists of a prefix
        m = np.arange(1, most + 1)
        others = others[n - shared + m - 1]
        best = int(np.argmin(n - shared + m + others + CHECK_COST * others / m)) + 1
        return tokens[order[: n - shared + best]], best


def shingle_order(docs: DataFrame, bits: int = SKETCH_BITS) -> Order:
    """Counters of all shingles of all documents, equal texts next to each other once.

    Every task sums up its share of the table in counters of a fixed number, which are
    added chunk by chunk. They only set the order and the matches asked for, so they change
    cost and never results; a counter of one task stops at 255.
    """
    size = (1 << bits) // CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("ngram_join")
        shingler, counts, held = Shingler(), np.zeros(1 << bits, np.int32), []

        def settle() -> None:
            if held:
                np.add(counts, np.bincount((np.concatenate(held).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64), minlength=1 << bits), out=counts, casting="unsafe")
                held.clear()

        for batch in lean(batches):
            for _, texts in slices(batch.column(0)):
                held.append(shingler.shingles(texts.unique())[0])
                if sum(map(len, held)) > 1 << 19:
                    settle()
        settle()
        parts = np.minimum(counts, 255).astype(np.uint8).reshape(CHUNKS, size)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["chunk", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int32)
        for x in rows["counts"]:
            total += np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    counts = np.zeros((CHUNKS, size), np.int32)
    for r in docs.select("text").mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect():  # CHUNKS rows at most
        counts[r.chunk] = np.frombuffer(r.counts, np.int32)
    return Order(counts.ravel())


def class_of(tokens: np.ndarray, seed: int = 0) -> int:
    """One number for a whole set."""
    return int(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed)) - (1 << 63)


def described(docs: DataFrame, order: Order, seed: int = 0) -> DataFrame:
    """``doc_id, key, n, class, check, matches, prefix`` of ``docs(doc_id, text, key)``; class and check are two hashes of the set."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # a byte a counter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("ngram_join")
        shingler, prefix = Shingler(), shared.value.prefix
        for batch in lean(batches):
            for lo, texts in slices(batch.column(1)):
                tokens, at = shingler.shingles(texts)
                sizes, classes, checks, matches, prefixes = [], [], [], [], []
                for k in range(len(texts)):
                    own = distinct(tokens[at[k] : at[k + 1]])
                    first, m = prefix(own) if len(own) else (own, 0)
                    sizes.append(len(own))
                    classes.append(class_of(own, seed) if len(own) else None)
                    checks.append(xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None)
                    matches.append(m)
                    prefixes.append(first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
                part = batch.slice(lo, len(texts))
                arrays = [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), pa.array(matches, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "class", "check", "matches", "prefix"])

    return docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key long, n long, class long, check long, matches int, prefix array<long>")


def sizes_fit(na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)


def index_length(n, m, ceil=F.ceil):
    """Length of the shorter prefix that a set needs towards sets that are not smaller."""
    return n - ceil(2 * PERCENT * n / (100 + PERCENT)) + m


def needed_matches(larger: tuple[Column, Column], smaller: tuple[Column, Column]) -> Column:
    """Shingles that the larger set's prefix and the smaller one's index prefix must share.

    Similar sets share at least c = ceil(0.75 / 1.75 (na + nb)). Common shingles up to the
    end of the prefix that ends first lie in both; after it that set has at most as many
    shingles left as its prefix leaves out, so c less the greater of those are shared.
    """
    (na, ma), (nb, mb) = larger, smaller
    left_out = F.greatest(F.ceil(PERCENT * na / 100) - ma, nb - index_length(nb, mb))
    return F.greatest(F.lit(1), common_least(na, nb) - left_out).cast("long")


def common_least(na: Column, nb: Column) -> Column:
    return F.ceil(PERCENT * (na + nb) / (100 + PERCENT))


def may_meet(x: str, z: str) -> tuple[Column, Column]:
    """The matches that the postings ``x`` and ``z`` (column prefixes) ask for, and whether they can count as one.

    The k-th common shingle in order leaves each side n - pos shingles, itself included;
    for k up to the matches asked for, k - 1 and those must reach what similar sets share.
    """
    (cx, nx, px, mx, ix), (cz, nz, pz, mz, iz) = ([F.col(f"{s}.{c}") for c in ("class", "n", "pos", "matches", "indexed")] for s in (x, z))
    smaller = (nx < nz) | ((nx == nz) & (cx < cz))
    needed = F.when(smaller, needed_matches((nz, mz), (nx, mx))).otherwise(needed_matches((nx, mx), (nz, mz)))
    reach = F.least(nx - px, nz - pz) + needed - 1
    return needed, F.when(smaller, ix).otherwise(iz) & sizes_fit(nx, nz) & (reach >= common_least(nx, nz))


RECORD = np.dtype([("token", "<i8"), ("class", "<i8"), ("n", "<i4"), ("pos", "<i4"), ("m", "i1")])
LIVE = "token long, class long, n long, pos long, matches int, indexed boolean"


def live_postings(table: DataFrame, buckets: int) -> DataFrame:
    """The postings that another one in their list could match, a row each.

    Nearly all shingles of prefixes are in one set alone. Tasks deal their postings by
    shingle into buckets, packed; each bucket is sorted and keeps what can matter.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            bucket = ((rows["token"].view(np.uint64) * _MUL[2]) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            parts = [rows[a:b].tobytes() for a, b in zip(first, [*first[1:], len(rows)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "data"])

        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                _, own = np.unique(batch.column(0).to_numpy(), return_index=True)  # equal sets once
                batch = batch.take(pa.array(np.sort(own)))
                lists = batch.column(3)
                sizes = lists.value_lengths().to_numpy()
                rows = np.empty(int(sizes.sum()), RECORD)
                rows["token"] = lists.flatten().to_numpy()
                for name, column in (("class", 0), ("n", 1), ("m", 2)):
                    rows[name] = np.repeat(batch.column(column).to_numpy(), sizes)
                rows["pos"] = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                held.append(rows)
                if sum(map(len, held)) >= HELD_POSTINGS:
                    yield dealt()
        if held:
            yield dealt()

    def sift(bucket: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x.as_py(), RECORD) for x in bucket["data"]])
        rows = rows[np.lexsort((rows["class"], rows["token"]))]
        rows = rows[np.concatenate([[True], (rows["token"][1:] != rows["token"][:-1]) | (rows["class"][1:] != rows["class"][:-1])])]
        rows = sifted(rows)
        n, m = rows["n"].astype(np.int64), rows["m"].astype(np.int64)
        indexed = rows["pos"] < index_length(n, m, np.ceil)
        return pa.table({"token": rows["token"].copy(), "class": rows["class"].copy(), "n": n, "pos": rows["pos"].astype(np.int64), "matches": m.astype(np.int32), "indexed": indexed})

    packed = table.where("n > 0").select("class", "n", "matches", "prefix").mapInArrow(deal, "bucket int, data binary")
    return packed.groupBy("bucket").applyInArrow(sift, LIVE)


def sifted(rows: np.ndarray) -> np.ndarray:
    """Of postings in order of their shingle, those that the positional bound lets match another one of the same list."""
    while len(rows):
        first = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
        sizes = np.diff(first, append=len(rows))
        group = np.repeat(np.arange(len(first)), sizes)
        n = rows["n"].astype(np.float64)
        spare = n - rows["pos"] + (np.maximum.reduceat(rows["m"], first)[group] - 1) - HALF * n  # no two ask for more matches than one of them
        keep = (sizes[group] > 1) & (_best_of_others(spare, first, sizes, group) >= HALF * n - 1e-6) & (-_best_of_others(-n, first, sizes, group) * HALF <= spare + 1e-6)
        if keep.all():
            break
        rows = rows[keep]
    return rows


def _best_of_others(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The greatest value of each group without the row itself."""
    order = np.lexsort((-values, group))
    top = values[order][first]
    second = np.where(sizes > 1, values[order][np.minimum(first + 1, len(values) - 1)], -np.inf)
    out = top[group]
    leaders = order[first]
    out[leaders] = second
    return out


def sketch_of(tokens: np.ndarray) -> bytes | None:
    """How many shingles of a set fall into each of about as many buckets, a byte a bucket; None if a byte is too small."""
    size = 1 << max(0, len(tokens).bit_length() - 1)
    counts = np.bincount(tokens & (size - 1), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def may_be_similar(one: bytes | None, other: bytes | None, sizes: int) -> bool:
    """Whether two sets, of ``sizes`` shingles in all, can be similar enough: no bucket holds more common ones than either set has in it."""
    if one is None or other is None:
        return True
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    size = min(len(a), len(b))
    a, b = (x if len(x) == size else x.reshape(-1, size).sum(axis=0, dtype=np.uint32) for x in (a, b))
    most = int(np.minimum(a, b).sum(dtype=np.int64))
    return 100 * most >= PERCENT * (sizes - most)


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """``class, n, sketch, tokens``: the sets of the classes ``wanted(class)``, made again from one document of each."""
    chosen = scratch.stored(classes.select("class", F.col("_rep").alias("key")).join(few(wanted), "class", "left_semi"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("ngram_join")
        shingler = Shingler()
        for batch in lean(batches):
            for lo, texts in slices(batch.column(1)):
                tokens, at = shingler.shingles(texts)
                names = batch.column(0).slice(lo, len(texts)).to_pylist()
                sets = [distinct(tokens[at[k] : at[k + 1]]) for k in range(len(texts))]
                same = [k for k, s in enumerate(sets) if class_of(s, seed) == names[k]]  # two rows' keys may be equal
                arrays = [pa.array([names[k] for k in same], pa.int64()), pa.array([len(sets[k]) for k in same], pa.int64()), pa.array([sketch_of(sets[k]) for k in same], pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([sets[k] for k in same], pa.list_(pa.int64()))], ["class", "n", "sketch", "tokens"])

    texts = docs.select("key", "text").join(few(chosen), "key").select("class", "text")  # beyond few, texts are shuffled
    sets = scratch.stored(texts.mapInArrow(run, "class long, n long, sketch binary, tokens array<long>"), "sets")
    if sets.count() > chosen.count():  # rows that repeat
        sets = scratch.stored(sets.dropDuplicates(["class"]), "sets")
    return sets


def possible(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sketches allow that they are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = [may_be_similar(x.as_py(), y.as_py(), n) for x, y, n in zip(batch.column(4), batch.column(5), sizes, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    for side in "ab":
        pairs = pairs.join(sets.select(F.col("class").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    return scratch.stored(pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long"), "possible")


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, small: bool) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose sets are similar enough, by their whole sets; only sets of possible pairs are moved, or all if they are ``small``."""
    if small:
        sets = F.broadcast(sets.select("class", "tokens"))
    else:
        pairs = possible(pairs, sets, scratch)
        wanted = scratch.stored(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "wanted")
        sets = sets.select("class", "tokens").join(few(wanted), "class", "left_semi")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    found = both.where(100 * common >= PERCENT * (F.size("ta") + F.size("tb") - common)).select("a", "b")
    return scratch.stored(found, "links")


def proposals(placed: DataFrame, turn: int) -> DataFrame:
    """``a, b``: for each class the one class of another component that it shares most centred shingles with.

    Every shingle that is still in several components has one class as its centre, by a
    hash of class and turn, so that a class is a centre of all its shingles or of few.
    """
    centre = F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("hash"), "class", "n", "pos", "matches", "indexed", "comp")).alias("z")
    centres = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), centre).where("lo <> hi").select("token", "z")
    met = placed.select("token", F.struct("class", "n", "pos", "matches", "indexed", "comp").alias("x")).join(centres, "token")
    needed, fits = may_meet("x", "z")
    met = met.where((F.col("x.comp") != F.col("z.comp")) & fits)
    met = met.select(F.col("x.class").alias("a"), F.col("z.class").alias("b"), F.col("z.hash").alias("hash"), needed.alias("needed")).repartition("a")  # no more rows than a's prefix has shingles
    pairs = met.groupBy("a", "b", "hash", "needed").count()
    best = pairs.where(f"{LENIENT} * count >= needed").groupBy("a").agg(F.max(F.struct("count", "hash", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def onward() -> Column:
    """Whether a class's component goes to another one, ``g``: the smaller to the larger."""
    return (F.col("members") < F.col("g.members")) | ((F.col("members") == F.col("g.members")) & (F.col("comp") > F.col("g.comp")))


def in_several(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of those keys that lie in several components."""
    return rows.join(rows.groupBy(*keys).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(*keys), list(keys), "left_semi")


def crowds(placed: DataFrame) -> DataFrame:
    """``token, top, pivot`` of the shingles that lie in more than ``CROWD`` components: the largest of them, to which all others go, and one of its classes.

    The pivot has the fewest shingles that are rarer, so it holds little beside what the others share.
    """
    each = placed.groupBy("token", "comp", "members").agg(F.min(F.struct("pos", "class")).alias("first"))
    lists = each.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.min(F.struct((-F.col("members")).alias("less"), "comp", "first")).alias("top"))
    return lists.where(F.col("comps") > CROWD).select("token", F.col("top.comp").alias("top"), F.col("top.first.class").alias("pivot"))


def beside(placed: DataFrame, crowd: DataFrame) -> DataFrame:
    """``class, comp, members, pivot``: the classes in the lists of ``crowd`` that are not in the pivot's component."""
    return placed.join(few(crowd), "token").where("comp <> top").select("class", "comp", "members", "pivot").distinct()


def most_apart(sizes):
    """The most elements that are in one of two similar sets alone, by the sum of their sizes."""
    return sizes - 2 * -(-PERCENT * sizes // (100 + PERCENT))


def departure(own: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set and a pivot that it is not similar to do not share, those that the pivot lacks first, and how many of the first of it to look for.

    The elements in one of two sets alone are those in one of their departures from the
    pivot alone. Few may be, and the departures are long, as neither set is similar to the
    pivot: so they have many elements in common, one of them at least among the first of
    both. Were none common, the pivot would lie between the two sets and be as similar.
    """
    added, missing = np.setdiff1d(own, pivot, assume_unique=True), np.setdiff1d(pivot, own, assume_unique=True)
    n, size = len(own), len(added) + len(missing)
    other = np.arange(least_shared(n), 100 * n // PERCENT + 1)  # sizes of sets that can be similar
    least = np.maximum(np.abs(other - len(pivot)), most_apart(other + len(pivot)) + 1)
    common = max(1, int((-(-(size + least - most_apart(n + other)) // 2)).min()))
    return np.concatenate([added, missing]), size - common + 1


def departures(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """``pivot, token, class, comp, members, n, size, rest``: the first of the departure of each class of ``apart`` from its pivot, and how much of it each one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for own, pivot in zip(batch.column(4), batch.column(5), strict=True):
                tokens, first = departure(own.values.to_numpy(), pivot.values.to_numpy())
                found.append(tokens[:first])
                sizes.append(len(tokens))
            lengths = np.array([len(x) for x in found], np.int64)
            rows = batch.select([0, 1, 2, 3]).take(pa.array(np.repeat(np.arange(len(found)), lengths)))
            n, size = (np.repeat(x, lengths) for x in (batch.column(4).value_lengths().to_numpy().astype(np.int64), np.array(sizes, np.int64)))
            at = np.arange(len(size)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            tokens = np.concatenate([*found, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in (tokens, n, size, size - at))], ["class", "comp", "members", "pivot", "token", "n", "size", "rest"])

    parts = apart.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("parts"))
    pivots = sets.select(F.col("class").alias("pivot"), F.col("tokens").alias("theirs")).join(few(parts), "pivot")
    pivots = pivots.select("pivot", "theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = apart.join(few(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    rows = rows.join(sets.select("class", "tokens"), "class").join(pivots, ["pivot", "part"])
    return rows.select("class", "comp", "members", "pivot", "tokens", "theirs").mapInArrow(run, "class long, comp long, members long, pivot long, token long, n long, size long, rest long")


def crossings_beside(told: DataFrame) -> DataFrame:
    """``class, comp`` as of ``crossings``, by the stored ``departures``: of two classes at least as many elements as leave few apart must be left, from the common one on."""
    rows = in_several(told, "pivot", "token")
    groups = rows.groupBy("pivot", "token", "comp", "members").agg(F.max("rest").alias("rest"), F.min("size").alias("size"), F.max("n").alias("n"))
    groups = groups.select("pivot", "token", F.struct("comp", "members", "rest", "size", "n").alias("g"))
    fits = 2 * F.least("rest", "g.rest") + 1e-6 >= F.col("size") + F.col("g.size") - (1 - 2 * HALF) * (F.col("n") + F.col("g.n"))
    return rows.join(groups, ["pivot", "token"]).where(onward() & fits).select("class", F.col("g.comp").alias("comp")).distinct()


def crossings(placed: DataFrame, crowd: DataFrame) -> DataFrame:
    """``class, comp``: classes and whole components, not smaller than their own, that may hold a partner of theirs; in the lists of ``crowd`` the largest alone.

    A row of the join stands for all of a component's postings in a list. A pair that is
    similar enough shares as many shingles as both ask for, each of which passes the bound.
    Of two classes that share a shingle of ``crowd``, and neither is in the largest
    component there, ``crossings_beside`` finds out.
    """
    rows = in_several(placed, "token")
    spare = F.col("n") - F.col("pos") - HALF * F.col("n")
    groups = rows.groupBy("token", "comp", "members").agg(
        F.max(spare).alias("spare"), F.min("n").alias("n"), F.min("matches").alias("matches"), F.max("matches").alias("most"), F.max("indexed").alias("indexed")
    )
    groups = groups.join(few(crowd), "token", "left").where("top is null or comp = top")
    groups = groups.select("token", F.struct("comp", "members", "spare", "n", "matches", "most", "indexed").alias("g"))
    x = rows.select("token", "class", "comp", "members", "n", "matches", "indexed", spare.alias("spare"))
    more = F.greatest("matches", "g.most") - 1 + 1e-6  # matches that may have come before
    fits = (F.col("g.spare") + more >= HALF * F.col("n")) & (F.col("spare") + more >= HALF * F.col("g.n")) & (F.col("indexed") | F.col("g.indexed"))
    met = x.join(groups, "token").where(onward() & fits)
    counts = met.groupBy("class", F.col("g.comp").alias("comp")).agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("matches", "g.matches")).alias("needed"))
    return counts.where("shared >= needed").select("class", "comp")


def in_blocks(members: DataFrame, sets: DataFrame, content: str, scratch: Scratch) -> DataFrame:
    """``comp, own, blocks, sets``: class, size and ``content`` of the sets of each component of ``members(class, comp)``, in blocks of bounded size."""
    members = few(members)
    sizes = sets.select("class", "n").join(members, "class").groupBy("comp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("held"))
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("held") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = sets.select("class", "n", content).join(members, "class")
    held = held.join(few(scratch.stored(sizes, "sizes")), "comp").withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    return held.groupBy("comp", "own", "blocks").agg(F.collect_list(F.struct("class", "n", content)).alias("sets"))  # BLOCK sets on the mean


def meeting(crossing: DataFrame, members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``class, comp, own``: the blocks of components in which, by the sketches, a class of ``crossing(class, comp)`` may have a partner."""
    blocks = scratch.stored(in_blocks(members, sets, "sketch", scratch), "sketch-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, own, others in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                own, sets = own.as_py(), others.values
                keep.append(any(may_be_similar(own, y.as_py(), n + m) for y, m in zip(sets.field("sketch"), sets.field("n").to_pylist(), strict=True)))
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    rows = crossing.join(blocks.select("comp", "own"), "comp").join(sets.select("class", "n", "sketch"), "class")
    rows = rows.join(blocks.select("comp", "own", "sets"), ["comp", "own"])
    return scratch.stored(rows.select("class", "comp", "own", "n", "sketch", "sets").mapInArrow(run, "class long, comp long, own int"), "meeting", FEW_ROWS)


def compared_with(crossing: DataFrame, members: DataFrame, sets: DataFrame, scratch: Scratch, small: bool) -> DataFrame:
    """Links ``(a, b)``: of every row of ``crossing(class, comp)`` one to each block of the component that has any."""
    if not small:
        crossing = meeting(crossing, members, sets, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values.to_numpy()
                others = batch.column(2)[k].values
                lists = others.field("tokens")
                ends = lists.offsets.to_numpy()
                theirs = lists.values.to_numpy()[ends[0] : ends[-1]]
                hits = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                sums = np.concatenate([[0], np.cumsum(hits)])
                ends = ends - ends[0]
                common, sizes = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
                found = np.flatnonzero(100 * common >= PERCENT * (sizes + len(own) - common))
                if len(found):
                    a.append(batch.column(0)[k].as_py())
                    b.append(others.field("class")[int(found[0])].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    named, wanted = (scratch.stored(crossing.select(c).distinct(), "wanted") for c in ("comp", "class"))
    blocks = in_blocks(scratch.stored(members.join(few(named), "comp", "left_semi"), "cross-members"), sets, "tokens", scratch)
    blocks = scratch.stored(blocks, "cross-blocks")
    if "own" not in crossing.columns:
        crossing = crossing.join(few(blocks.select("comp", "own")), "comp")
    theirs = sets.select("class", "tokens").join(few(wanted), "class", "left_semi")
    rows = crossing.join(F.broadcast(theirs) if small else theirs, "class").join(blocks.select("comp", "own", "sets"), ["comp", "own"])
    return scratch.stored(rows.select("class", "tokens", "sets").mapInArrow(run, "a long, b long"), "links", FEW_ROWS)


def links_within(tokens: np.ndarray, sizes: np.ndarray, own: np.ndarray, i: int, j: int) -> np.ndarray:
    """How many sets of block j each set of block i is similar to, and the other way round; ``tokens`` holds all sets in turn."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    owner, column = owner[times[column] > 1], column[times[column] > 1]
    columns, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    common = np.zeros((len(left), len(right)))
    for at in range(0, len(columns), WIDTH):
        lo, hi = np.searchsorted(column, (at, at + WIDTH))
        held = np.zeros((len(sizes), min(WIDTH, len(columns) - at)), np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        common += held[left] @ held[right].T
    similar = (100 * common >= PERCENT * (sizes[left][:, None] + sizes[right] - common)) & (left[:, None] != right)
    out = np.zeros(len(sizes), np.int64)
    out[left] += similar.sum(axis=1)
    if i != j:
        out[right] += similar.sum(axis=0)
    return out


def link_counts(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``class, n_links``: the other classes similar to each class of ``members(class, comp)``; all of them are in its component."""
    blocks = scratch.stored(in_blocks(members, sets, "tokens", scratch), "count-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = [batch.column(c)[k].values for c in range(batch.num_columns) if batch.column(c)[k].is_valid]
                lists = [x.field("tokens") for x in parts]
                sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in lists]
                own = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                found = links_within(np.concatenate([x.flatten().to_numpy() for x in lists]), np.concatenate(sizes), own, 0, len(parts) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.field("class").to_numpy() for x in parts])), pa.array(found)], ["class", "links"])

    inside = blocks.select("sets", F.lit(None).cast(blocks.schema["sets"].dataType).alias("other"))
    many = blocks.where("blocks > 1")
    one = many.select("comp", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "sets").where("i < j")
    other = many.select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("own").alias("j"), F.col("sets").alias("other")).where("i < j")
    cells = inside.unionByName(one.join(other, ["comp", "i", "j"]).select("sets", "other"))
    return scratch.stored(cells.mapInArrow(run, "class long, links long").groupBy("class").agg(F.sum("links").alias("n_links")), "degrees", FEW_ROWS)


def row_key() -> Column:
    """What tells rows apart: only rows with the same doc_id and text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull())


def compared(docs: DataFrame, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """The described rows of ``docs(doc_id, text)``, and ``class, comp, component_id`` and ``n_links`` of the sets, stored."""
    scratch = Scratch(docs.sparkSession, "ngram")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    order, seed = shingle_order(docs), 0
    while True:
        table = scratch.stored(described(docs, order, seed), "docs")
        classes = table.where("n > 0").groupBy("class").agg(F.min("key").alias("_rep"), F.min("doc_id").alias("least"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        classes = scratch.stored(classes, "classes")
        if classes.where("lo <> hi").isEmpty():
            break
        seed += 1  # two sets had one number

    live = scratch.stored(live_postings(table, 4 * partitions(docs.sparkSession)), "live")
    sets = whole_sets(docs, classes, scratch.stored(live.select("class").distinct(), "wanted"), scratch, seed)
    small = (sets.agg(F.sum("n")).first()[0] or 0) <= SMALL

    def members(comps: DataFrame | None) -> DataFrame:
        """Postings with their component and its number of classes."""
        if comps is None:
            return live.withColumn("comp", F.col("class")).withColumn("members", F.lit(1).cast("long"))
        sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
        known = comps.join(few(sizes, comps), "comp").select(F.col("node").alias("class"), "comp", "members")
        return live.join(few(scratch.stored(known, "members")), "class", "left").withColumn("comp", F.coalesce("comp", "class")).withColumn("members", F.coalesce("members", F.lit(1).cast("long")))

    comps = None
    for turn in range(ROUNDS):
        asked = scratch.stored(proposals(members(comps), turn), "proposals")
        found = verified(asked, sets, scratch, small)
        n, n_found = asked.count(), found.count()
        if n_found:
            comps = components(found, "first", scratch, comps)
        if n_found <= FEW * n:
            break

    while True:
        placed = members(comps)
        crowd = scratch.stored(crowds(placed), "crowds")
        if crowd.isEmpty():
            break
        apart = scratch.stored(beside(placed, crowd), "beside")
        found = verified(apart.select(F.col("class").alias("a"), F.col("pivot").alias("b")), sets, scratch, small)
        if found.isEmpty():
            break  # none beside a pivot's component is similar to the pivot
        comps = components(found, "first", scratch, comps)
    crossing = crossings(placed, crowd)
    if not crowd.isEmpty():
        told = scratch.stored(departures(apart, sets), "departures", FEW_ROWS)
        crossing = crossing.union(crossings_beside(told)).distinct()
    crossing = scratch.stored(crossing, "crossing")
    named = crossing.select("comp").distinct()
    theirs = scratch.stored(placed.select("class", "comp").distinct().join(named, "comp", "left_semi"), "theirs")
    second = compared_with(crossing, theirs, sets, scratch, small)
    if not second.isEmpty():
        comps = components(second, "second", scratch, comps)

    classes = classes.select("class", "least")
    if comps is None:
        classes = classes.select("class", "least", F.col("class").alias("comp"), F.lit(0).cast("long").alias("n_links"))
    else:
        groups = comps.withColumnRenamed("node", "class")
        degree = link_counts(groups, sets, scratch) if count_links else groups.select("class", F.lit(None).cast("long").alias("n_links"))
        classes = classes.join(few(groups), "class", "left").join(few(degree), "class", "left").select("class", "least", F.coalesce("comp", "class").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = scratch.stored(classes, "grouped")
    roots = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = scratch.stored(classes.join(roots, "comp").select("class", "comp", "component_id", "n_links"), "named")
    scratch.drop_but(table, named)
    return table, named


def similar_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_shingles, component_id, n_links``.

    ``n_links`` counts the other sets, each once however many documents have it, that are
    similar enough to the document's set.
    """
    table, named = compared(docs)
    full = table.where("n > 0").select("doc_id", "n", "class").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component (stage of the pipeline): the smallest doc_id, a null only if there is no other.

    Different texts that share a doc_id, or have none, are judged each by itself. All rows
    without shingles stay.
    """
    table, named = compared(docs, count_links=False)
    found = table.where("n > 0").select("doc_id", "key", "class").join(named.select("class", "comp"), "class")
    kept = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("_best")).select(F.col("_best.key").alias("_key"))
    shown = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\t\n\x0B\f\r ]")  # has a word, and so a shingle
    one = docs.where(shown).withColumn("_key", row_key()).join(kept, "_key").dropDuplicates(["_key"]).drop("_key")
    return one.unionByName(docs.where(~shown))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
