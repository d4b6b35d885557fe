"""Operator 9: byte-level BPE by rank, encoding and decoding.

Pre-tokens are looked up in two tiers. A minimal perfect hash over the vocabulary
answers for pre-tokens that are themselves one entry; the others are merged byte by byte
over a linked list, the cheapest pair taken from a heap. Texts are cut at sure borders of
pre-tokens, and workers remember the pieces they have already encoded, within a fixed
number of entries.

Cases: null and empty texts have no ids; special-token strings are ordinary text; a very
long pre-token costs n log n; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.pieces import PieceCoder, slices
from siteweave.llm.shared import kept_by

BUCKET = 4  # mean number of keys that share a displacement
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MASK = (1 << 64) - 1


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PerfectHash:
    """A minimal perfect hash from n keys to the numbers 0 to n-1.

    Hash and displace into a table a quarter larger than n, which is quick to fill; the
    rank of a key's place among the filled ones is its number.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.places, self.buckets = max(1, n + n // 4), max(1, n // BUCKET)
        hashes = [_hash(k) for k in keys]
        groups: dict[int, list[int]] = {}
        for k, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(k)
        self.shift = [0] * self.buckets
        held: list[int] = [-1] * self.places
        for b, members in sorted(groups.items(), key=lambda x: -len(x[1])):
            d = 0
            while True:
                at = [self._place(hashes[k], d) for k in members]
                if all(held[p] < 0 for p in at) and len(set(at)) == len(at):
                    break
                d += 1
            for k, p in zip(members, at, strict=True):
                held[p] = k
            self.shift[b] = d
        filled = np.array(held) >= 0
        self.rank = np.where(filled, np.cumsum(filled) - 1, -1).tolist()
        self.keys = [keys[k] for k in held if k >= 0]

    def _place(self, h: int, d: int) -> int:
        x = (h + d * 0x9E3779B97F4A7C15) & MASK
        return ((x ^ (x >> 29)) * 0xD6E8FEB86659FD93 & MASK) % self.places

    def find(self, key: bytes) -> int:
        """The number of a key, or -1."""
        if not self.keys:
            return -1
        h = _hash(key)
        at = self.rank[self._place(h, self.shift[h % self.buckets])]
        return at if at >= 0 and self.keys[at] == key else -1


class ByteBPE:
    """A vocabulary of byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.slot_ids = [ranks[k] for k in self.table.keys]
        self.tokens = {i: b for b, i in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        import regex

        own = self.pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.split = regex.compile(own).findall
        self.coder = PieceCoder(lambda pieces: [self._encode(x) for x in pieces])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "coder")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merge(self, piece: bytes) -> list[int]:
        """Merge the bytes of a pre-token: lowest rank first, leftmost among equals."""
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0: merged away
        back = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i, stop = pop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                back[stop] = i
                if (x := get(piece[i : end[stop]])) is not None:
                    push(heap, (x, i, end[stop]))
            p = back[i]
            if p >= 0 and (x := get(piece[p:stop])) is not None:
                push(heap, (x, p, stop))
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : end[i]]))
            i = end[i]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        slot = self.table.find(piece)
        return [self.slot_ids[slot]] if slot >= 0 else self.merge(piece)

    def _encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out += self.encode_piece(piece.encode())
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.coder.ids(pa.array([text], pa.string()))[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def model(path: str, pattern: str) -> ByteBPE:
    """The vocabulary, built once in a process that serves no other operator meanwhile."""
    models = kept_by("byte_bpe")
    if (path, pattern) not in models:
        models[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return models[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` with ``ids array<int>`` and ``decoded binary`` for each row."""

    def run(batches):
        bpe = model(path, pattern)
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                ids, at = bpe.coder.ids(texts)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                decoded = [bpe.decode(ids[at[k] : at[k + 1]].tolist()) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes, made where the ids are."""

    def run(batches):
        bpe = model(path, pattern)
        digits = {i: str(i) for i in bpe.tokens}
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                flat, at = bpe.coder.ids(texts)
                ids_sha, text_sha = [], []
                for k in range(len(texts)):
                    ids = flat[at[k] : at[k + 1]].tolist()
                    ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                columns = [batch.column(0).slice(lo, len(texts)), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
