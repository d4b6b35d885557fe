"""Operator 1: token ids in seekable zstandard files.

A file holds one zstandard frame for each document (its ids as little-endian unsigned
32-bit integers, with the frame's own content checksum), a skippable frame with the
document ids, and a trailing seek table in the public seekable layout: sizes and a
32-bit XXH64 of every frame. A reader fetches the table from the end of the file and
then only the frames it needs.

Cases: a null or empty text is a document that holds the end id alone; null doc_ids
come first; rows with equal doc_ids keep an order fixed by their text; repeated rows are
repeated documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.pieces import PieceCoder, slices
from siteweave.llm.shared import new_path, stored

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1

FILE_DOCS, FILE_TOKENS = 1 << 16, 1 << 26  # after which a task begins its next file
WINDOW = 1 << 22  # bytes of frames that a reader of a whole file fetches at once
MANIFEST = "part int, nth int, path string, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _xxh(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class LibraryCoder:
    """Ids of texts as the library gives them, each distinct piece encoded once.

    A text that holds one of the tokenizer's added tokens ("<|endoftext|>") goes through
    the library whole: the library takes these tokens out before it looks for pre-tokens.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.pieces = PieceCoder(lambda pieces: [x.ids for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])
        added = [re.escape(x.content) for x in tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(sorted(added, key=len, reverse=True))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``PieceCoder.ids``."""
        marked = pc.fill_null(pc.match_substring_regex(texts, self.added), False) if self.added else None
        if marked is None or not pc.any(marked).as_py():
            return self.pieces.ids(texts)
        flat, at = self.pieces.ids(pc.if_else(marked, "", texts))
        lists = [flat[a:b] for a, b in itertools.pairwise(at)]
        for k in np.flatnonzero(marked.to_numpy(zero_copy_only=False)):
            lists[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


_coders: dict[str, LibraryCoder] = {}


def coder(tokenizer_path: str) -> LibraryCoder:
    """The tokenizer, with the pieces that this process has met."""
    if tokenizer_path not in _coders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _coders[tokenizer_path] = LibraryCoder(Tokenizer.from_file(tokenizer_path))
    return _coders[tokenizer_path]


class FrameWriter:
    """Writes documents to one open stream; ``close`` adds the index and the seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[bytes] = []
        self.doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, payload: bytes) -> None:
        frame = self.zstd.compress(payload)
        self.stream.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(payload), _xxh(payload)))
        self.doc_ids.append(doc_id)

    def close(self) -> None:
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        body = ids.tobytes() + known.tobytes()
        index = struct.pack("<II", INDEX_MAGIC, len(body)) + body
        self.stream.write(index)
        self.entries.append(struct.pack("<III", len(index), 0, _xxh(body)))
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("not a seekable token file")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3)
        self.sizes, self.lengths, self.sums = (table[:, k].astype(np.int64) for k in range(3))
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        body = self._at(int(self.places[count - 1]) + 8, int(self.sizes[-1]) - 8)
        if _xxh(body) != self.sums[-1]:
            raise ValueError("damaged document index")
        n = count - 1
        known = np.frombuffer(body, np.uint8, offset=8 * n)
        ids = np.frombuffer(body, "<i8", count=n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths[:n] // 4)])

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _checked(self, k: int, frame: bytes) -> bytes:
        raw = self.zstd.decompress(frame, max_output_size=int(self.lengths[k]))
        if len(raw) != self.lengths[k] or _xxh(raw) != self.sums[k]:
            raise ValueError(f"damaged frame {k}")
        return raw

    def payload(self, k: int) -> bytes:
        """The bytes of document ``k``, checked against both checksums; reads its frame alone."""
        return self._checked(k, self._at(int(self.places[k]), int(self.sizes[k])))

    def payloads(self) -> Iterator[bytes]:
        """The bytes of every document in turn, fetched in windows."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.places, self.places[lo] + WINDOW, side="right")) - 1)
            hi = min(hi, len(self))
            data = self._at(int(self.places[lo]), int(self.places[hi] - self.places[lo]))
            for k in range(lo, hi):
                at = int(self.places[k] - self.places[lo])
                yield self._checked(k, data[at : at + int(self.sizes[k])])
            lo = hi

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.payload(k), "<u4")


def open_reader(path: str) -> FrameReader:
    where, name = pafs.FileSystem.from_uri(path)
    return FrameReader(where.open_input_file(name), where.get_file_info(name).size)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 0) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files under ``folder`` in ascending doc_id order.

    Returns the manifest, one row a file, itself stored as a table. A file gets a name
    of its own for every attempt of a task and counts only if the manifest lists it, so
    retried and speculative tasks leave whole results.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = coder(tokenizer_path), TaskContext.get().partitionId()
        writer = path = None
        nth = tokens = 0

        def opened() -> FrameWriter:
            where, name = pafs.FileSystem.from_uri(folder)
            where.create_dir(name)
            return FrameWriter(where.open_output_stream(f"{name}/{path}"))

        def closed() -> pa.RecordBatch:
            writer.close()
            columns = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([f"{folder}/{path}"]), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([tokens], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["part", "nth", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                ids, at = encode.ids(texts)
                for k, doc_id in enumerate(batch.column(0).slice(lo, len(texts)).to_pylist()):
                    if writer is None:
                        path = f"part-{part:06d}-{nth:04d}-{uuid.uuid4().hex[:8]}.tokz"
                        writer, tokens = opened(), 0
                    payload = ids[at[k] : at[k + 1]].tobytes() + end
                    writer.add(doc_id, payload)
                    tokens += len(payload) // 4
                    if len(writer.doc_ids) >= FILE_DOCS or tokens >= FILE_TOKENS:
                        yield closed()
                        writer, nth = None, nth + 1
        if writer is not None:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, schema: str, per_document) -> DataFrame:
    """Read every document back: ``per_document(doc_id, start, ids)`` gives a row of ``schema``.

    ``start`` counts the ids of all documents before it in the whole corpus. Only the
    manifest, one row a file, passes through the driver.
    """
    spark = manifest.sparkSession
    base, files = 0, []
    for row in sorted(manifest.collect(), key=lambda r: (r.part, r.nth)):
        files.append((row.path, base))
        base += row.n_tokens
    names = [part.split()[0] for part in schema.split(", ")]

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for path, first in pdf.itertuples(index=False):
                reader = open_reader(path)
                rows = []
                for k, raw in enumerate(reader.payloads()):
                    rows.append(per_document(reader.doc_ids[k], int(first + reader.starts[k]), np.frombuffer(raw, "<u4")))
                    if len(rows) == 4096 or k + 1 == len(reader):
                        columns = dict(zip(names, zip(*rows, strict=True), strict=True))
                        if "doc_id" in columns:
                            columns["doc_id"] = pd.array(columns["doc_id"], "Int64")  # whole numbers, also beside nulls
                        yield pd.DataFrame(columns)
                        rows = []

    table = spark.createDataFrame(files, "path string, first long")
    return table.repartition(max(1, len(files)), "path").mapInPandas(read, schema)


def token_digests(manifest: DataFrame) -> DataFrame:
    return read_token_files(manifest, DIGEST, lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.tobytes())))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_token_files(docs, new_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(manifest)
