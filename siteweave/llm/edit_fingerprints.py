"""Operator 6: document fingerprints by randomised edit embedding.

A text is read by a random walk over its code points: at every step the walk emits the code
point under its pointer and moves on or stays, by a random bit that depends on the step and
on that code point and is shared by all texts. After an edit two walks soon run in step
again, so the number of steps at which they emit different signs (the Hamming distance of
the embedded texts) follows the edit distance of the texts. Steps are kept apart: each adds
a random value, of the step and of what it emits, to the one of 256 counters that the step
is dealt to, and the signs of the counters are the fingerprint. So the Hamming distance of
two fingerprints estimates that of the embedded texts, and likeness is the cosine that it
stands for: about the share of steps that agree.

The walks of many texts run side by side. A text of more than ``SEGMENT`` code points is
walked in segments, each with steps of its own; one of fewer than ``FULL`` is walked several
times, with other steps each time, so that its counters fill. All of the text takes part.

Banding samples bits of the fingerprints by a fixed permutation; ``near_duplicates`` takes
as many bits a band as the number of texts asks for, as many bands as the threshold asks
for, and verifies by likeness all pairs of a band that could still join two groups.

Cases: null counts as empty; an empty text has the all-zero fingerprint; equal texts have
equal ones; very long texts are walked in segments, never shortened; rows with
equal doc_ids keep an order fixed by their text; a lone document is its own successor;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.components import components
from siteweave.llm.shared import Scratch, partitions

BITS = 256
SEGMENT = 1 << 14  # code points of a walk at most
FULL = 1024  # code points up to which a text is walked more than once
CHECKED = 64  # steps between looks for walks that have ended
BATCH_CHARS = 8_000_000
RECALL = 0.95  # of pairs at the threshold, by the bands alone
SHOWN_BANDS, SHOWN_BITS = 48, 20  # of the query
ROUNDS = 4  # of links to a band's centre
GROUP = 64  # range borders that are looked at once
_K = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
LIKENESS = np.maximum(0.0, np.cos(np.pi * np.arange(BITS + 1) / BITS))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def _walk_constants(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """For every step a multiplier, whose product with a sign decides, and the counter that it is dealt to."""
    h = _mix(np.arange(1, steps + 1, dtype=np.uint64) * _K[0])
    return h | np.uint64(1), (_mix(h) & np.uint64(BITS - 1)).astype(np.int64)


TURN, PLACE = _walk_constants(1 << 16)
VALUE = np.array([0, -1, 1, 0, 0, -1, 1, 0], np.int16)  # of the second and third bit of the product
TURNED = 37  # counters by which a text's next walk is turned, so that short walks fill all


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``BITS / 8`` bytes for each text."""
    out, at = np.zeros((len(texts), BITS // 8), np.uint8), 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= BATCH_CHARS):
            size += len(texts[stop])
            stop += 1
        out[at:stop] = _fingerprints(texts[at:stop])
        at = stop
    return out


def _walks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and number of every walk's sign buffer; buffers end with a zero."""
    sizes = np.array([len(t) for t in texts], np.int64)
    times = np.where(sizes > 0, np.maximum(-(-sizes // SEGMENT), -(-FULL // np.maximum(sizes, 1))), 0)
    text = np.repeat(np.arange(len(texts)), times)
    number = np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
    return sizes, text, number


def _fingerprints(texts: list[str]) -> np.ndarray:
    sizes, text, number = _walks(texts)
    if not len(text):
        return np.zeros((len(texts), BITS // 8), np.uint8)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.cumsum(sizes) - sizes
    segments = sizes[text] >= SEGMENT
    start = first[text] + np.where(segments, number * SEGMENT, 0)
    length = np.where(segments, np.minimum(SEGMENT, sizes[text] - number * SEGMENT), sizes[text])
    kept = length > 0
    text, number, start, length = text[kept], number[kept], start[kept], length[kept]
    order = np.argsort(-length, kind="stable")
    text, number, start, length = text[order], number[order], start[order], length[order]
    # Every walk's signs in a buffer of their own: a nonzero hash of code point and walk number, then a zero that stops it.
    ends = np.cumsum(length + 1)
    begin = ends - length - 1
    signs = np.zeros(int(ends[-1]), np.uint64)
    for b, s, n, own in zip(begin.tolist(), start.tolist(), length.tolist(), ((number.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) + np.uint64(1), strict=True):
        np.add(x[s : s + n], own, out=signs[b : b + n])
    for lo in range(0, len(signs), 1 << 20):
        part = signs[lo : lo + (1 << 20)]
        part[:] = _mix(part * _K[3]) | np.uint64(1)
    signs[ends - 1] = 0
    totals = np.zeros((len(texts), BITS), np.int32)

    def add(text: np.ndarray, number: np.ndarray, counters: np.ndarray) -> None:
        for turn in np.unique(number * TURNED % BITS):
            own = number * TURNED % BITS == turn
            np.add.at(totals, text[own], np.roll(counters[:, own], turn, axis=0).T)

    at, counters, step = begin, np.zeros((BITS, len(begin)), np.int16), 0
    turn, place = list(TURN), PLACE.tolist()
    top, low = np.uint64(63), np.uint64(61)
    take, value, multiply, shift, plus = signs.take, VALUE.take, np.multiply, np.right_shift, np.add
    while len(at):
        moved, h, m, v = at.view(np.uint64), np.empty(len(at), np.uint64), np.empty(len(at), np.uint64), np.empty(len(at), np.int16)
        which, rows, left = h.view(np.int64), list(counters), len(at)
        while left > 0.75 * len(at):
            for j in range(step, step + CHECKED):
                j %= len(turn)
                take(at, None, h, "clip")
                multiply(h, turn[j], h)
                shift(h, top, m)
                plus(moved, m, moved)
                shift(h, low, h)
                value(which, None, v, "clip")
                row = rows[place[j]]
                plus(row, v, row)
            step += CHECKED
            on = signs[at] != 0
            left = int(on.sum())
        add(text[~on], number[~on], counters[:, ~on])
        at, text, number, counters = at[on], text[on], number[on], np.ascontiguousarray(counters[:, on])
    return np.packbits(totals > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return LIKENESS[np.bitwise_count(a ^ b).sum(axis=1)]


def sampled_bits(bands: int, bits: int) -> np.ndarray:
    """The bits that each band samples: without repeats within a band."""
    rng = np.random.default_rng(6)
    return np.stack([rng.permutation(BITS)[:bits] for _ in range(bands)])


def band_keys(prints: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """A number for every band of every fingerprint."""
    own = np.unpackbits(prints, axis=1).astype(np.int64)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    return np.stack([own[:, chosen] @ weights for chosen in sampled_bits(bands, bits)], axis=1)


def bands_for(texts: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bands and bits a band: two bits more than tell ``texts`` apart, and bands enough for ``recall`` at the threshold."""
    bits = min(40, max(12, math.ceil(math.log2(max(2, texts))) + 2))
    same = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(1 - recall) / math.log(1 - same**bits)), bits


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame) -> DataFrame:
    """``part, tail, doc_id, text``: every part ends with the first document of the next one.

    Parts are ranges of doc_id between quantiles, dealt out once; the rows that stand at
    a border, one a part, are sent to both sides. Only borders reach the driver.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = docs.agg(F.percentile_approx(rank, [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))[: n - 1]
    part = F.lit(0)
    if cuts:  # the group of borders first, then the border in it
        below = lambda numbers: F.size(F.filter(numbers, lambda c: c < rank))
        group = below(F.array(*map(F.lit, cuts[GROUP - 1 :: GROUP]))) if len(cuts) >= GROUP else F.lit(0)
        part = group * GROUP + below(F.slice(F.array(*map(F.lit, cuts)), group * GROUP + 1, F.lit(GROUP)))
    placed = docs.withColumn("part", part)
    firsts = sorted((r.part, r.first) for r in placed.groupBy("part").agg(F.min(rank).alias("first")).collect())
    before = [(firsts[k][0], firsts[k][1], firsts[k - 1][0]) for k in range(len(firsts))]  # the first wraps round to the last
    borders = F.broadcast(spark.createDataFrame(before, "part int, first long, earlier int"))  # a row a part
    joined = placed.join(borders, "part", "left")
    own = F.struct(F.col("part"), F.lit(False).alias("tail"))
    sent = F.when(rank == F.col("first"), F.array(own, F.struct(F.col("earlier").alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    dealt = joined.select(F.explode(sent).alias("to"), "doc_id", "text").select("to.part", "to.tail", "doc_id", "text")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "tail", "doc_id", F.xxhash64("text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, the likenesses between them and the bands they meet in."""

    def finish(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        n = len(rows)
        texts = [t for _, t, _ in rows]
        changed = [edited(t, f) for _, t, f in rows]
        ends = [k for k in range(n) if k == n - 1 or rows[k][2] is not rows[k + 1][1]]  # where the next row is not the next document
        prints = fingerprints([*texts, *changed, *(rows[k][2] for k in ends)])
        mine, edits = prints[:n], prints[n : 2 * n]
        following = np.roll(mine, -1, axis=0)
        following[ends] = prints[2 * n :]
        bands = [band_keys(x, SHOWN_BANDS, SHOWN_BITS) for x in (mine, edits, following)]
        columns = {
            "doc_id": pa.array([i for i, _, _ in rows], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [p.tobytes().hex() for p in mine],
            "edited_fingerprint": [p.tobytes().hex() for p in edits],
            "near_edited": likeness(mine, edits),
            "near_next": likeness(mine, following),
            "bands_edited": (bands[0] == bands[1]).sum(axis=1).astype(np.int32),
            "bands_next": (bands[0] == bands[2]).sum(axis=1).astype(np.int32),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the document whose successor is still to come
        rows: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for part, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting is not None and waiting[0] == part:
                    rows.append((waiting[1], waiting[2], text))
                    size += len(text)
                waiting = None if tail else (part, doc_id, text)
                if size > BATCH_CHARS // 2:
                    yield finish(rows)
                    rows, size = [], 0
        if rows:
            yield finish(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"
    return with_following(docs).select("part", "tail", "doc_id", "text").mapInArrow(run, schema)


def apart(a: str, b: str) -> Column:
    """Bits in which the fingerprints of two structs differ."""
    return sum((F.bit_count(F.col(f"{a}.p{k}").bitwiseXOR(F.col(f"{b}.p{k}"))) for k in range(BITS // 64)), F.lit(0))


def near_duplicates(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, component_id`` by banded, verified fingerprints.

    Equal fingerprints are one node from the start. In rounds, every node is linked to the
    centre of each of its bands' lists, a row each; then all pairs of a list that are still in
    different components are verified. A component's id is its smallest doc_id.
    """
    scratch = Scratch(docs.sparkSession, "edit")
    most = int(np.searchsorted(-LIKENESS, -threshold, side="right")) - 1
    longs = [f"p{k}" for k in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.ascontiguousarray(fingerprints([t or "" for t in batch.column(1).to_pylist()])).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(numbers[:, k]) for k in range(len(longs)))], ["doc_id", *longs])

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in longs))
    table = scratch.stored(table.withColumn("node", F.xxhash64(*longs)), "prints")
    nodes = scratch.stored(table.groupBy("node", *longs).agg(F.min("doc_id").alias("least")), "nodes")
    bands, bits = bands_for(nodes.count(), threshold)

    def banded(batches: Iterator) -> Iterator:
        for pdf in batches:
            prints = np.ascontiguousarray(pdf[longs].to_numpy(np.int64)).view(np.uint8)
            yield pdf.assign(bands=list(band_keys(prints, bands, bits)))

    schema = "node long, " + ", ".join(f"{c} long" for c in longs)
    rows = nodes.select("node", *longs).mapInPandas(banded, schema + ", bands array<long>").select(F.struct("node", *longs).alias("x"), F.posexplode("bands").alias("band", "key"))
    lists = rows.groupBy("band", "key").agg(F.min("x.node").alias("lo"), F.max("x.node").alias("hi")).where("lo <> hi").select("band", "key")
    rows = scratch.stored(rows.join(lists, ["band", "key"], "left_semi"), "bands")
    links = comps = None

    def placed() -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("x.node"))
        return rows.join(comps.withColumnRenamed("node", "_node"), F.col("x.node") == F.col("_node"), "left").withColumn("comp", F.coalesce("comp", "x.node")).drop("_node")

    for turn in range(ROUNDS + 1):
        at = placed()
        if turn < ROUNDS:
            centre = F.min(F.struct(F.xxhash64("x.node", F.lit(turn)), "x", "comp")).alias("c")
            other = at.groupBy("band", "key").agg(centre).select("band", "key", F.col("c.x").alias("y"), F.col("c.comp").alias("far"))
        else:  # all that the rounds have left
            open_ = at.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key")
            at = at.join(open_, ["band", "key"], "left_semi")
            other = at.select("band", "key", F.col("x").alias("y"), F.col("comp").alias("far"))
        met = at.join(other, ["band", "key"]).where((F.col("comp") != F.col("far")) & (apart("x", "y") <= most))
        found = scratch.stored(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comps = components(links, "components", scratch)
    grouped = nodes.select("node", "least", F.col("node").alias("comp")) if comps is None else nodes.join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
    roots = grouped.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = scratch.stored(grouped.join(roots, "comp").select("node", "component_id"), "named")
    scratch.drop_but(table, known)
    return table.join(known, "node").select("doc_id", "component_id")


def op6_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
