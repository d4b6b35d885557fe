"""Operator 13: quality rules by repetition coverage.

A text's words are numbered; rolling hashes of runs of 3 and of 5 to 10 words, in numpy
over many texts at once, find the runs that a text holds twice or more. What counts is
coverage: the characters of words inside a later copy of a run, each once, as a share of
all characters in words, and the same for later copies of whole lines. A run of n words
can only repeat where its shorter runs do, so longer lengths look at few places. Equal
hashes are compared word by word; should two different runs ever share one, the hashes
are made anew.

Cases: null and empty texts have no words and fail the base rule; white space alone is no
line; rows that repeat, and null doc_ids, are judged row by row; a very long text is one
slice of its own (memory: some fifteen times its bytes); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.pieces import slices

SYMBOLS = b"#*$%&|<>"
BASE_RUN, BASE_WORDS, BASE_REPEAT_PERCENT = 3, 50, 50
#: The published limits, in percent, of characters inside repeated runs of so many words.
RUN_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The published limits, in percent, of repeated lines, and of characters inside them.
LINE_LIMIT, LINE_CHARS_LIMIT = 30, 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in RUN_LIMITS)]
MEASURES = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

_SEPARATOR = np.isin(np.arange(256), [32, *range(9, 14)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _copies(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal keys: all places that share theirs with another, those that are not the first, and neighbours to compare."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    inside = np.zeros(len(keys), bool)
    inside[1:] |= same
    inside[:-1] |= same
    members = places[order[inside]]
    if not len(members):
        return members, members, np.empty((2, 0), np.int64)
    opens = np.flatnonzero(np.append(True, ranked[inside][1:] != ranked[inside][:-1]))
    firsts = np.repeat(np.minimum.reduceat(members, opens), np.diff(np.append(opens, len(members))))
    return members, members[members != firsts], np.stack([firsts, members])


class Words:
    """The words of many texts, as numbers, with where each text's begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.n = len(off) - 1
        word = ~_SEPARATOR[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        begin[off[off < len(data)]] |= word[off[off < len(data)]]
        begins = np.flatnonzero(begin)
        letters = data[word]
        starts = np.append((np.cumsum(word) - 1)[begins], len(letters)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(starts), pa.py_buffer(letters)])
        self.ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        chars = np.append(0, np.cumsum((letters & 0xC0) != 0x80))
        self.chars = np.diff(chars[starts])
        self.text = np.searchsorted(off, begins, side="right") - 1

    def total(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, weights, minlength=self.n).astype(np.int64)

    def repeated_runs(self, lengths) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: the begins of runs that their text holds twice or more, and of those that are later copies."""
        for seed in range(1, 1000):
            found = self._repeated_runs(lengths, np.uint64(seed))
            if found is not None:
                return found
        raise ArithmeticError("no hash tells the runs apart")

    def _repeated_runs(self, lengths, seed):
        coded = _mixed((self.ids.astype(np.uint64) + seed) * _MIX)
        salt = _mixed((self.text.astype(np.uint64) + np.uint64(1)) * _MIX + seed)
        rolling, n, found = coded, 1, {}
        places = np.arange(len(coded))
        base = _mixed(np.array([seed], np.uint64))[0] | np.uint64(1)
        for length in lengths:
            while n < length:  # the run one word longer: a step of the rolling hash at every place
                rolling = rolling[:-1] * base + coded[n:]
                n += 1
            places = places[places < len(rolling)]
            places = places[self.text[places] == self.text[places + length - 1]]
            members, later, pairs = _copies(_mixed(rolling[places] ^ salt[places]), places)
            if any((self.ids[pairs[0] + k] != self.ids[pairs[1] + k]).any() for k in range(length)) or (self.text[pairs[0]] != self.text[pairs[1]]).any():
                return None
            found[length] = members, later
            places = np.sort(members)
        return found

    def covered(self, begins: np.ndarray, length: int) -> np.ndarray:
        """The words inside any of the runs, each once."""
        inside = np.zeros(len(self.ids), bool)
        for k in range(length):
            inside[begins + k] = True
        return np.flatnonzero(inside)


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of many texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if not len(data):
        return {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    words = Words(data, off)
    out = {"n_words": words.total(words.text), "word_chars": words.total(words.text, words.chars)}
    out["n_symbols"] = words.total(np.searchsorted(off, np.flatnonzero(_SYMBOL[data]), side="right") - 1)
    out |= _lines(data, off, words.n)
    runs = words.repeated_runs([BASE_RUN, *RUN_LIMITS])
    out["n_repeat_words"] = words.total(words.text[words.covered(runs[BASE_RUN][0], BASE_RUN)])
    for n in RUN_LIMITS:
        inside = words.covered(runs[n][1], n)
        out[f"dup_chars_{n}"] = words.total(words.text[inside], words.chars[inside])
    return out


def _lines(data: np.ndarray, off: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Lines with a word, those equal to an earlier one of their text, and the characters of words in these."""
    begins = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1]))
    begins = begins[begins < len(data)]
    kept = data != 10
    letters = data[kept]
    starts = np.append(np.append(0, np.cumsum(kept))[begins], len(letters)).astype(np.int64)
    inner = np.append(0, np.cumsum(~_SEPARATOR[letters] & ((letters & 0xC0) != 0x80)))
    chars = np.diff(inner[starts])
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(starts), pa.py_buffer(letters)])
    ids = lines.dictionary_encode().indices.to_numpy().astype(np.uint64)
    text = np.searchsorted(off, begins, side="right") - 1
    full = np.flatnonzero(chars > 0)
    later = _copies((text[full].astype(np.uint64) << np.uint64(32)) | ids[full], full)[1]
    count = lambda at, weights=None: np.bincount(text[at], weights, minlength=n).astype(np.int64)
    return {"n_lines": count(full), "n_dup_lines": count(later), "dup_line_chars": count(later, chars[later])}


def repetition_measures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the counts of ``COUNTS`` for each row."""

    def run(batches):
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                counts = measured(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURES)


def base_failure() -> Column:
    """Too few words, or too many of them inside runs of three that repeat."""
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def repetition_failure() -> Column:
    """Too many characters inside repeated runs or lines, or too many repeated lines."""
    out = 100 * F.col("n_dup_lines") > LINE_LIMIT * F.col("n_lines")
    out |= 100 * F.col("dup_line_chars") > LINE_CHARS_LIMIT * F.col("word_chars")
    for n, limit in RUN_LIMITS.items():
        out |= 100 * F.col(f"dup_chars_{n}") > limit * F.col("word_chars")
    return out


def judged_documents(docs: DataFrame) -> DataFrame:
    """The measures of each row with ``base_failed`` and ``kept``."""
    return repetition_measures(docs).withColumn("base_failed", base_failure()).withColumn("kept", ~F.col("base_failed") & ~repetition_failure())


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    run = lambda n: " || ' ' || ".join(f"lead(w, {k}) OVER p" for k in range(n))
    runs = {BASE_RUN: 0, **RUN_LIMITS}
    grams = ", ".join(f"{run(n)} AS g{n}" for n in runs)
    marks = ", ".join([f"count(*) OVER (PARTITION BY doc_id, g{BASE_RUN}) > 1 AND g{BASE_RUN} IS NOT NULL AS m{BASE_RUN}", *(f"row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY pos) > 1 AND g{n} IS NOT NULL AS m{n}" for n in RUN_LIMITS)])
    inside = ", ".join(f"max(m{n}::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS c{n}" for n in runs)
    sums = ", ".join(f"CAST(coalesce(sum(length(w)) FILTER (WHERE c{n}), 0) AS BIGINT) AS dup_chars_{n}" for n in RUN_LIMITS)
    limits = " AND ".join(f"100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in RUN_LIMITS.items())
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS if c != "n_symbols")
    return f"""
        WITH w AS (
            SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
        ), g AS (SELECT doc_id, pos, w, {grams} FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
        m AS (SELECT doc_id, pos, w, {marks} FROM g),
        c AS (SELECT doc_id, w, {inside} FROM m),
        s AS (
            SELECT doc_id, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, count(*) FILTER (WHERE c{BASE_RUN}) AS n_repeat_words, {sums}
            FROM c GROUP BY doc_id
        ), l AS (
            SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) AS nth, length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')
        ), d AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (WHERE nth > 1), 0) AS BIGINT) AS dup_line_chars
            FROM l GROUP BY doc_id
        ), a AS (
            SELECT doc_id, CAST(coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS BIGINT) AS n_symbols, {zero}
            FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN d USING (doc_id)
        ), b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM a)
        SELECT *, NOT base_failed AND 100 * n_dup_lines <= {LINE_LIMIT} * n_lines AND 100 * dup_line_chars <= {LINE_CHARS_LIMIT} * word_chars AND {limits} AS kept FROM b"""


ORACLE = _sql()
