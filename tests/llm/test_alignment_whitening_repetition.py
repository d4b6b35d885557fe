"""Operators 11 to 13 against second, plain implementations."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from pyspark.sql import functions as F

from siteweave.llm import alignment, repetition, whitening
from siteweave.llm.shared import Scratch

# --- 13: quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    later = [x for k, x in enumerate(lines) if x in lines[:k]]
    out |= {"n_lines": len(lines), "n_dup_lines": len(later), "dup_line_chars": sum(len("".join(WORD.findall(x))) for x in later)}
    for n in (3, *repetition.RUN_LIMITS):
        runs = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        count, seen, inside = Counter(runs), set(), set()
        for k, run in enumerate(runs):
            if (n == 3 and count[run] > 1) or (n > 3 and run in seen):
                inside |= set(range(k, k + n))
            seen.add(run)
        out["n_repeat_words" if n == 3 else f"dup_chars_{n}"] = len(inside) if n == 3 else sum(len(words[k]) for k in inside)
    return out


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x1c#本", max_size=60)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_measures_equal_plain_ones(texts):
    got = repetition.measured(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert {c: int(got[c][k]) for c in repetition.COUNTS} == plain_measures(text)


def test_quality_rules_on_odd_rows(spark):
    prose = " ".join(f"word{k}" for k in range(120))
    rows = [(1, prose), (None, prose), (2, None), (3, ""), (4, " \n\n"), (5, "few words"), (6, "\n".join([prose] * 3)), (1, prose), (7, "spam ham eggs " * 40), (8, prose + " " + " ".join(f"word{k}" for k in range(30)) + " " + " ".join(f"x{k}" for k in range(20)))]
    docs = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, n_words int")
    got = repetition.judged_documents(docs).collect()
    assert sorted((str(r.doc_id), *(r[c] for c in repetition.COUNTS)) for r in got) == sorted((str(i), *(plain_measures(t)[c] for c in repetition.COUNTS)) for i, t in rows)
    kept = defaultdict(set)
    for r in got:
        kept[r.doc_id].add((r.base_failed, r.kept))
    assert kept == {1: {(False, True)}, None: {(False, True)}, 2: {(True, False)}, 3: {(True, False)}, 4: {(True, False)}, 5: {(True, False)}, 6: {(True, False)}, 7: {(True, False)}, 8: {(False, False)}}
    assert repetition.judged_documents(docs.limit(0)).count() == 0


def test_equal_hashes_of_different_runs_are_found_out(monkeypatch):
    whole = repetition.measured(pa.array(["a b c d a b c e"]))
    real, calls = repetition._mixed, []

    def weak(x):
        calls.append(1)
        return real(x) & np.uint64(1) if len(calls) < 6 else real(x)

    monkeypatch.setattr(repetition, "_mixed", weak)
    assert {c: v.tolist() for c, v in repetition.measured(pa.array(["a b c d a b c e"])).items()} == {c: v.tolist() for c, v in whole.items()}


# --- 11: whitening


def plain_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, constant term first."""
    d = len(matrix)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(matrix[i][x] * m[x][i] for x in range(d)) for i in range(d)) / k)
    return [int(x) for x in reversed(c)]


def scatter(rows):
    x = [[int(v) for v in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    return [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    for rows in (rng.integers(-30, 30, (9, 6)), rng.integers(-3, 3, (4, 6)), np.zeros((3, 2)), rng.integers(-(10**9), 10**9, (7, 4)), [[1], [4], [9]]):
        matrix = scatter(rows)
        assert whitening.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)


def test_roots_are_counted_isolated_and_refined():
    poly = [1]
    for root in (0, 3, 7, 7, 7, 10**12, 10**12 + 1):
        poly = [a - root * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    for at, above in ((-1, 7), (0, 6), (2, 6), (3, 5), (6, 5), (7, 2), (10**12, 1), (10**12 + 1, 0)):
        assert whitening.roots_above(poly, at) == above
    for hints in ([], [0.0, 3.0, 7.0, 7.0, 7.0, 1e12, 1e12], [5.0, 1e12]):
        bits, found = whitening.isolated_roots(poly, 6, hints)
        scaled = whitening.scaled_polynomial(poly[1:], bits)
        roots = [(Fraction(whitening.refined_root(scaled, *f), 1 << bits), f[2]) for f in found]
        assert [(round(r), n) for r, n in roots] == [(10**12 + 1, 1), (10**12, 1), (7, 3), (3, 1)]
        assert all(abs(r - round(r)) <= Fraction(1, 1 << bits) for r, _ in roots)


def test_null_vectors_of_equal_roots_are_orthogonal():
    matrix = [[5, 2, 2, 0], [2, 5, 2, 0], [2, 2, 5, 0], [0, 0, 0, 3]]  # 9, and 3 three times
    (one,) = whitening.null_vectors(matrix, 9 << 200, 200, 1)
    three = np.array(whitening.null_vectors(matrix, 3 << 200, 200, 3))
    assert np.allclose(np.abs(one), [3**-0.5] * 3 + [0], atol=1e-15)
    assert np.allclose(three @ three.T, np.eye(3), atol=1e-14) and np.allclose(three @ np.array(matrix), 3 * three, atol=1e-14)


def whitened_frame(spark, rows, most=32):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    fit, vectors = whitening.fit_whitening(whitening.usable_vectors(frame), most)
    return fit, whitening.whiten(vectors, fit).collect() if fit else []


def test_whitening_equals_dense_linear_algebra(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(90, 7)) * [3, 1, 1, 0.5, 0.2, 0.1, 0.1]).astype(np.float32)
    bad = [(500, None), (501, []), (502, [None] * 7), (503, [float("nan")] + [1.0] * 6), (504, [float("inf")] + [1.0] * 6), (505, [1.0, 2.0])]
    rows = [(k if k % 7 else None, v.tolist(), "x") for k, v in enumerate(base)] + [(k, v, "x") for k, v in bad]
    fit, got = whitened_frame(spark, rows, 5)
    x = np.floor(64 * base.astype(float))
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    want = ((x - x.mean(0)) @ u / np.sqrt(e))[:, ::-1][:, :5]
    dev = [int(v) for v in ((len(x) * x - x.sum(0)) ** 2).sum(1)]
    assert len(got) == 90 and sorted(r.deviation for r in got) == sorted(dev)
    at = {d: k for k, d in enumerate(dev)}
    w = np.array([r.whitened for r in got])
    v = want[[at[r.deviation] for r in got]]
    assert np.allclose(w * np.sign((w * v).sum(0)), v, atol=1e-9)
    assert np.allclose(fit.explained, (e / e.sum())[::-1][:5], rtol=1e-12)


def test_whitening_of_few_equal_and_huge_rows(spark):
    assert whitened_frame(spark, [(1, [1.0, 2.0], "a")])[0] is None
    assert whitened_frame(spark, [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a")])[0] is None
    fit, got = whitened_frame(spark, [(1, [1.0, 2.0, 3.0], "a"), (2, [2.0, 4.0, 6.0], "a"), (None, [0.0, 0.0, 0.0], "a")])
    assert len(fit.eigenvalues) == 1 and np.allclose(sorted(r.whitened[0] for r in got), [-(1.5**0.5), 0, 1.5**0.5], atol=1e-12)
    fit, got = whitened_frame(spark, [(1, [3e38, 1.0], "a"), (2, [-3e38, 2.0], "a"), (3, [1e10, 7.0], "a")])
    assert len(fit.eigenvalues) == 2 and [r.deviation for r in got] == [None] * 3
    w = np.array([r.whitened for r in got])
    assert np.allclose(w.T @ w / 3, np.eye(2), atol=1e-6)


def test_exact_sums_of_large_numbers(spark):
    values = [[1e14, -3.5], [-2e14, 7.25], [5e12, 0.0]] * 700
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "vec_id long, embedding array<double>").repartition(3)
    n, sums, gram = whitening.exact_sums(frame, 2)
    x = [[int(np.floor(64 * v)) for v in r] for r in values]
    assert (n, sums) == (2100, [sum(r[k] for r in x) for k in range(2)])
    assert gram == [[sum(r[i] * r[j] for r in x) for j in range(2)] for i in range(2)]


def test_whitening_query_is_white(spark):
    rows = whitening.op11_whitening(spark, "/root/testdata/sf0.001")
    facts = rows.agg(F.max("identity_error").alias("e"), F.countDistinct("identity_error", "n").alias("k"), F.countDistinct("component").alias("c"), F.count("*").alias("all"), F.max("n").alias("n")).first()
    assert facts.e < 1e-9 and facts.k == 1 and facts.c == 32 and facts["all"] == 32 * facts.n
    seen = rows.groupBy("component").agg(F.avg("whitened").alias("m"), F.var_pop("whitened").alias("v")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.v - 1) < 1e-9 for r in seen)


# --- 12: alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """The alignment as its definition says, text by text."""

    def __init__(self):
        sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
        self.a, self.b = tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        letters = alignment._byte_letters()
        self.a_bytes = {k: bytes(map(letters.get, x)) for x, k in self.a.get_vocab(with_added_tokens=False).items()}

    def b_bytes(self, k):
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()

    def groups(self, text):
        whole, sides = (" " + (text or "")).encode(), []
        for ids, entry in ((self.a.encode(" " + (text or ""), add_special_tokens=False).ids, self.a_bytes.get), (self.b.encode(text or ""), self.b_bytes)):
            ends, at = [], 0
            for k in ids:
                at += len(entry(k))
                ends.append((at, k))
            sides.append(ends)
            if not text or b"".join(map(entry, ids)) != whole:
                return []
        out, lows = [], [0, 0]
        for end in sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]}):
            out.append([[k for e, k in side if low < e <= end] for low, side in zip(lows, sides, strict=True)])
            lows = [end, end]
        return out

    def digests(self, rows):
        found = [(i, self.groups(t)) for i, t in rows]
        counts = Counter((a[-1], b[-1]) for _, g in found for a, b in g)
        most = defaultdict(int)
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        for i, g in found:
            links = [(a[-1], b[-1]) for a, b in g]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
            yield (i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)


TEXTS = [None, "", " ", "  a  b ", "x▁y", "日本語のテキスト。長い文章です、はい。" * 12, "مرحبا بالعالم، هذا نص. " * 9, "<|endoftext|> and <s> </s><0x41> don't 'twas  \n\n a\tb  c " * 4, "é 　x \xa0y 1234 " * 8, "word " * 90, "nospace" * 60, "ab" * 40 + " ?!..." * 12, "a１２ ３4½ ²x" * 9, "\x00\x01 a\x1f b\x85 c" * 6, "🙂👍🏽 zero​width" * 8, "ﬁ①"]


@pytest.mark.parametrize("chunk, fan", [(1 << 16, 8), (40, 2), (200, 3)])
def test_alignment_equals_its_definition(spark, chunk, fan):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[7]), (3, TEXTS[7])]
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], "doc_id long, text string, a_ids string, row int")
    scratch = Scratch(spark, "alignment")
    found = alignment.align(docs, *PATHS, scratch, chunk=chunk, fan=fan)
    got = alignment.alignment_digests(found, alignment.pair_counts(found, *PATHS, scratch), *PATHS, scratch).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, Plain().digests(rows)))
    if chunk == 40:
        assert found.long.groupBy("row").count().agg(F.max("count")).first()[0] > 10


def test_alignment_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    scratch = Scratch(spark, "alignment")
    found = alignment.align(docs, *PATHS, scratch)
    assert alignment.alignment_digests(found, alignment.pair_counts(found, *PATHS, scratch), *PATHS, scratch).count() == 0


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_fragments_compose_in_any_order(data):
    """Any cut of both token rows into ranges, composed in any tree, gives the groups of the whole."""
    total = data.draw(st.integers(1, 40))
    ends = [sorted(data.draw(st.sets(st.integers(1, total), max_size=15)) | {total}) for _ in range(2)]
    parts = data.draw(st.integers(1, 6))
    cuts = [[0, *sorted(data.draw(st.lists(st.integers(0, len(e)), min_size=parts - 1, max_size=parts - 1))), len(e)] for e in ends]
    runs, todo = [], []
    for k in range(parts):
        (a0, a1), (b0, b1) = ((c[k], c[k + 1]) for c in cuts)
        tokens = alignment.Edge(np.arange(a0, a1), np.array(ends[0][a0:a1], np.int64), np.arange(b0, b1), np.array(ends[1][b0:b1], np.int64))
        fragment, run = alignment.Fragment.of(tokens, k == 0)
        todo.append(fragment)
        runs += [run] if run else []
    while len(todo) > 1:
        k = data.draw(st.integers(0, len(todo) - 2))
        both, run = todo[k].then(todo[k + 1])
        todo[k : k + 2] = [both]
        runs += [run] if run else []
    assert todo[0].cut and not any(map(len, (*todo[0].prefix, *todo[0].suffix)))
    runs = [r for _, r in sorted(runs, key=lambda x: x[0])]
    whole = alignment.Run(*map(np.concatenate, zip(*runs, strict=True)))
    common = sorted(set(ends[0]) & set(ends[1]))
    assert whole.a_ids.tolist() == list(range(len(ends[0]))) and whole.b_ids.tolist() == list(range(len(ends[1])))
    assert np.cumsum(whole.a_sizes).tolist() == [ends[0].index(e) + 1 for e in common] and np.cumsum(whole.b_sizes).tolist() == [ends[1].index(e) + 1 for e in common]


def test_linked_pairs_are_bounded_by_the_vocabularies():
    vocab = alignment.vocabularies(*PATHS)
    assert 0 < len(vocab.pairs) <= sum(map(len, vocab.a_bytes)) + sum(map(len, vocab.b_bytes))


def test_kept_units_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(alignment, "KEEP_BYTES", 5000)
    cut = lambda texts: alignment.cut_for_b(texts, np.ones((128, 128), bool))
    coder = alignment.UnitCoder(cut, lambda units: [list(u.encode()) for u in units], [bytes([k]) for k in range(256)])
    for k in range(200):
        text = f"{k} words" + " long" * 3 + "x" * 100
        ids, at, ok = coder.ids(pa.array([text, "", None and ""], pa.large_string()).fill_null(""))
        assert bytes(ids.tolist()).decode() == text and at.tolist() == [0, len(text), len(text), len(text)] and ok.all()
        assert coder.kept <= 2500 and all(len(x) <= 64 for x in coder.known)


def test_units_encoded_together_are_those_encoded_alone():
    """A batch of units is checked as a whole; one whose bytes do not come back has no ids and leaves the others theirs."""
    lossy = lambda units: [[0 if c == "?" else b for c in u for b in c.encode()] for u in units]
    coder = alignment.UnitCoder(None, lossy, [bytes([k]) for k in range(256)])
    for units in (["ab", "é", "c"], ["ab", "?", "c", "é?"], ["?"], []):
        want = [b"" if "?" in u else np.array(list(u.encode()), np.int32).tobytes() for u in units]
        sizes = np.array([len(u.encode()) for u in units], np.int64)
        assert coder._encoded(units, sizes) == want and coder._values(units, sizes) == want and coder._values(units, sizes) == want
    swapped = alignment.UnitCoder(None, lambda units: [[97], [98, 99]], coder.entries)  # the whole comes back, its parts do not
    assert swapped._encoded(["ab", "c"], np.array([2, 1])) == [b"", b""]


def test_what_follows_the_alignment_reads_no_groups(spark):
    """Digests and links are made where the groups are, so that the later passes need not read these again."""
    rows = [(i, t) for i, t in enumerate(TEXTS * 9)]
    scratch = Scratch(spark, "alignment")
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS, scratch)
    bare = found.short.select("doc_id", *(F.lit(None).cast("array<int>").alias(c) for c in alignment.Run._fields), *(c for c in found.short.columns if c not in ("doc_id", "ok", *alignment.Run._fields)))
    found = alignment.Alignments(bare, found.long)
    got = alignment.alignment_digests(found, alignment.pair_counts(found, *PATHS, scratch), *PATHS, scratch).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, Plain().digests(rows)))


@pytest.mark.parametrize("sizes", [[], [0], [2, 0, 3], [0, 0, 1, 4]])
def test_links_come_back_from_their_bytes(sizes):
    at = np.append(0, np.cumsum(sizes)).astype(np.int64)
    links = np.arange(at[-1]) * 70000
    packed = alignment._packed(links, at)
    for lo in range(len(sizes) + 1):
        got, places = alignment._unpacked(packed.slice(lo))
        assert got.tolist() == links[at[lo] :].tolist() and places.tolist() == (at[lo:] - at[lo]).tolist()
