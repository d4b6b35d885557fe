"""Operator 7: secret scans.

An Aho-Corasick automaton finds the fixed words that every keyword rule begins with;
each rule's regular expression is then matched only at such a hit, anchored there. Rules
that carry a checksum or a structure are validated before they count. Long hexadecimal
runs have no keyword; they are found by one scan for runs of 24 or more.

Cases: null and empty texts have no spans and the digest of the empty string; very long
texts are scanned whole; a private key's span covers its body, to the END line or, if that
is missing, over the base64 lines; spans of different kinds may overlap; repeated rows repeat;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.shared import kept_by, lean

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked_token", "jwt", "private_key")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
ROWS = 256  # of texts that are redacted at once
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
# The header, and all up to its END line before any other header; without one, the headers and base64 lines that follow (the last may be short).
KEY = re.compile(
    r"""-----BEGIN\x20((?:[A-Z]+\x20)*)PRIVATE\x20KEY-----
    (?:(?:(?!-----BEGIN\x20).)*?-----END\x20\1PRIVATE\x20KEY-----
    |(?:(?:\s|\\[rn])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{16,}+={0,2}+))++(?:(?:\s|\\[rn])++[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\x20\t]*+(?:[\r\n]|\\[rn]|["'`]|\Z)))?+
    |)""",
    re.S | re.X,
)


def checksum_holds(body: str, check: str) -> bool:
    """The last six letters are the CRC-32 of the others in base 62."""
    value = zlib.crc32(body.encode())
    letters = ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        letters = BASE62[digit] + letters
    return letters == check


def header_holds(part: str) -> bool:
    """The first part of a JWT decodes to a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # also of JSON nested too deeply
        return False
    return isinstance(head, dict) and "alg" in head


# keyword in lower case -> kind, expression, validation
RULES = {
    "password": ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    "passwd": ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    "secret": ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    "token": ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    "apikey": ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    "api_key": ("assign", ASSIGN, lambda m: len(m[2]) >= 6),
    "akia": ("access", ACCESS, lambda m: len(m[0]) >= 20),
    **{p: ("checked_token", CHECKED, lambda m: checksum_holds(m[1], m[2])) for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")},
    "eyj": ("jwt", JWT, lambda m: header_holds(m[1])),
    "-----begin ": ("private_key", KEY, lambda m: True),
}


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word in RULES:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of every secret, by start and then kind."""
        low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
        hits = sorted((end - len(word) + 1, word) for end, word in self.automaton.iter(low))
        past = dict.fromkeys(KINDS, 0)
        found = []
        for start, word in hits:
            kind, expression, holds = RULES[word]
            if start < past[kind]:
                continue
            if not (m := expression.match(text, start)):
                if kind == "jwt":  # what follows the run of letters decides, for all hits in it
                    past[kind] = JWT_RUN.match(text, start).end()
                continue
            past[kind] = m.end()  # a match that fails validation still takes up its text
            if holds(m):
                found.append((kind, start, m.end()))
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with counts by base kind, the base digest and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("secret_scan")
        scanner = Scanner()
        for batch in batches:
            all_spans = [scanner.spans(x.as_py() or "") for x in batch.column(1)]
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in all_spans], pa.int64()) for kind in BASE]
            digests = [hashlib.sha256(joined([x for x in s if x[0] in BASE]).encode()).hexdigest() for s in all_spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for s in all_spans], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """Documents with their secrets replaced (stage of the pipeline); none is dropped."""
    text_at, size_at = docs.columns.index("text"), docs.columns.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by("secret_scan")
        scanner = Scanner()
        for batch in (whole.slice(lo, ROWS) for whole in lean(batches) for lo in range(0, whole.num_rows, ROWS)):
            before = batch.column(text_at).to_pylist()
            texts = [x if x is None else redacted(x, scanner.spans(x)) for x in before]
            sizes = [n if old == new else len(new) for old, new, n in zip(before, texts, batch.column(size_at).to_pylist(), strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
