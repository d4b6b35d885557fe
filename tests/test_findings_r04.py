"""Findings of the fourth round: what grew too large, against plain forms on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.llm import vector_topk as V
from siteweave.operators import geometry as Geo
from siteweave.operators import graph as G
from siteweave.operators import pairs as P


# F1


def test_topk_join_is_not_broadcast(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    found = V.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan


def test_topk_of_every_width_of_numbers(spark):
    rng = np.random.default_rng(4)
    for size in (1, 100, 10**6):
        m = (rng.normal(size=(120, 4)) * size).round(3)
        whole = np.floor(m * 64).astype(np.int64).astype(object)
        found = V.top_k(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 4)
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in found.collect()}
        for q in range(0, 120, 10):
            best = sorted(((-int(whole[q] @ whole[c]), c) for c in range(120) if c != q))[:4]
            assert [got[q, k + 1] for k in range(4)] == [(c, -s) for s, c in best]


# F6, F12, F14 to F22: geometry without a row for every pair, over several tiles of a chain


@pytest.fixture(scope="module")
def dense(spark):
    """Two chains of 700 and 40 residues with CA and CB in a small ball, as a table and as arrays."""
    rng, rows = np.random.default_rng(6), []
    for chain, n in (("A", 700), ("B", 40)):
        for resno in range(1, n + 1):
            aa = "ACDEFGHIKLMNPQRSTVWY"[rng.integers(20)]
            rows += [(7, chain, resno, aa, atom, "C", *map(float, rng.normal(size=3) * 9), float(rng.uniform(30, 90))) for atom in ("CA", "CB")]
    columns = "structure_id int, chain string, resno int, aa string, atom string, element string, x double, y double, z double, bfactor double"
    return spark.createDataFrame(rows, columns).repartition(3), rows


def around(rows, radius):
    """For each residue the others of its chain with an atom within ``radius`` of its CA: (chain, resno) to {resno: (aa, d)}, and the atoms."""
    out = {}
    for chain in "AB":
        mine = [r for r in rows if r[1] == chain]
        at, numbers = np.array([r[6:9] for r in mine]), np.array([r[2] for r in mine])
        for r in mine[::2]:
            d = np.sqrt(((at - np.array(r[6:9])) ** 2).sum(axis=1))
            near = np.flatnonzero((d <= radius) & (numbers != r[2]))
            best = {}
            for k in near:
                best[mine[k][2]] = (mine[k][3], min(d[k], best.get(mine[k][2], (0, np.inf))[1]))
            out[chain, r[2]] = best, at[near]
    return out


def tiled_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [structure_id" in plan and "_g#" in plan and "MapInArrow" in plan
    return df.collect()


def test_f6_nearest_by_type(dense):
    ca = [r for r in dense[1] if r[4] == "CA" and r[1] == "A"]
    at, letters = np.array([r[6:9] for r in ca]), np.array([r[3] for r in ca])
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    got = {(r.chain, r.resno): r for r in tiled_plan(Geo.nearest_by_type(dense[0]))}
    assert len(got) == 740
    for k, r in enumerate(ca):
        assert np.isclose(got["A", r[2]].nearest_S, d[k][letters == "S"].min()) and np.isclose(got["A", r[2]].nearest_negative, d[k][np.isin(letters, ["D", "E"])].min())


def test_f12_counts_by_type(dense):
    got = {(r.chain, r.resno): r for r in tiled_plan(Geo.counts_by_type(dense[0]))}
    want = {k: v for k, (v, _) in around(dense[1], 10.0).items() if v}
    assert got.keys() == want.keys()
    for k, near in want.items():
        letters = [aa for aa, _ in near.values()]
        assert got[k].count_K == letters.count("K") and got[k].count_aromatic == sum(aa in "FWYH" for aa in letters)


def test_f14_f20_pocket_and_contact_groups(dense):
    got = {(r.chain, r.resno): r for r in tiled_plan(Geo.pocket(dense[0], 5.0))}
    want = {k: v for k, (v, _) in around(dense[1], 5.0).items() if v}
    assert got.keys() == want.keys()
    assert all(got[k].negative_count == sum(aa in "DE" for aa, _ in near.values()) and got[k].net_charge == sum((aa in "KRH") - (aa in "DE") for aa, _ in near.values()) for k, near in want.items())


def test_f16_f15_neighbour_counts(dense):
    got = {(r.chain, r.resno): r.n_neighbours for r in tiled_plan(Geo.neighbour_counts(dense[0]))}
    assert got == {k: len(v) for k, (v, _) in around(dense[1], 10.0).items()}
    assert Geo.residue_features(dense[0]).where(F.col("n_neighbours") > 0).count() == sum(n > 0 for n in got.values())


def test_f17_nearest_residues(dense):
    got = {}
    for r in tiled_plan(Geo.nearest_residues(dense[0])):
        got.setdefault((r.chain, r.resno), {})[r.rank] = (r.n_resno, r.n_aa, r.distance)
    want = {k: v for k, (v, _) in around(dense[1], 10.0).items() if v}
    assert got.keys() == want.keys()
    for k, near in want.items():
        best = sorted(near.items(), key=lambda x: (x[1][1], x[0]))[:10]
        assert [got[k][i + 1][:2] for i in range(len(best))] == [(n, aa) for n, (aa, _) in best] and len(got[k]) == len(best)
        assert np.allclose([got[k][i + 1][2] for i in range(len(best))], [d for _, (_, d) in best])


def test_f18_b_factor_stats(dense):
    own = {}
    for r in dense[1]:
        own.setdefault((r[1], r[2]), []).append(r[9])
    own = {k: np.mean(v) for k, v in own.items()}
    want = around(dense[1], 10.0)
    for r in tiled_plan(Geo.b_factor_stats(dense[0])):
        near = [own[r.chain, n] for n in want[r.chain, r.resno][0]]
        assert np.isclose(r.neighbour_mean, np.mean(near)) if near else r.neighbour_mean is None


def test_f19_f21_pairs(dense):
    ca = [r for r in dense[1] if r[4] == "CA"]
    d = {(a[1], a[2], b[1], b[2]): np.sqrt(sum((a[k] - b[k]) ** 2 for k in (6, 7, 8))) for i, a in enumerate(ca) for b in ca[i + 1 :]}
    for found, want in ((Geo.contacts(dense[0], 8.0), {k: v for k, v in d.items() if v <= 8}), (Geo.distances(dense[0]), d)):
        got = {(r.chain, r.resno, r.n_chain, r.n_resno): r.distance for r in tiled_plan(found)}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_f22_half_sphere(dense):
    want, cb = around(dense[1], 13.0), {(r[1], r[2]): np.array(r[6:9]) for r in dense[1] if r[4] == "CB"}
    ca = {(r[1], r[2]): np.array(r[6:9]) for r in dense[1] if r[4] == "CA"}
    got = {(r.chain, r.resno): (r.hse_up, r.hse_down) for r in tiled_plan(Geo.half_sphere(dense[0]))}
    for k, (_, at) in want.items():
        if len(at):
            up = int((((at - ca[k]) * (cb[k] - ca[k])).sum(axis=1) > 0).sum())
            assert got[k] == (up, len(at) - up)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return {f"p{i:03d}": "".join(rng.choice(list("ACDEX" if i % 3 else "ACFG"), 15)) for i in range(n)}


def test_f9_f10_ngram_pairs_by_blocks(spark):
    motifs = words(200, 9) | {"q1": "SSSSSTTTTTSSSSS", "q2": "TTSSSSSTTTTTSSS"}  # two letters in common only
    sets = {i: {m[k : k + 3] for k in range(13)} - {m[k : k + 3] for k in range(13) if "X" in m[k : k + 3]} for i, m in motifs.items()}
    df = spark.createDataFrame(list(motifs.items()), "id string, motif string")
    for shared in (True, False):
        want = {(a, b): len(sets[a] & sets[b]) for a in motifs for b in motifs if a < b and len(sets[a] & sets[b]) >= 3 and (not shared or len(set(motifs[a]) & set(motifs[b]) - {"X"}) >= 3)}
        found = P.ngram_pairs(df, require_shared_aa=shared, block=32)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "gram#" not in plan
        assert {(r.id1, r.id2): r.matching for r in found.collect()} == want
        assert (("q1", "q2") in want) != shared


def test_f8_lsh_pairs_by_blocks(spark):
    motifs = words(150, 8) | {"q1": "ACACACACACACACA", "q2": "ACACACACACACACA"}
    df = spark.createDataFrame(list(motifs.items()), "id string, motif string")
    texts = df.select("motif").distinct()
    of = {}
    for r in P.lsh_bands(texts).collect():
        of.setdefault(r.motif, set()).add((r.band, r.value))
    want = {(a, b): len(of[motifs[a]] & of[motifs[b]]) for a in motifs for b in motifs if a < b and of[motifs[a]] & of[motifs[b]]}
    found = P.lsh_pairs(df, block=32)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.id1, r.id2): r.bands for r in found.collect()} == want and want["q1", "q2"] == 20


def test_f5_distance_sums_by_bits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 90, (130, 2)) if a != b} | {(100, 101)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {"alone": (0, 1)}
    for s in near:
        depth, todo = {s: 0}, [s]
        for x in todo:
            todo += [y for y in near[x] if y not in depth and not depth.update({y: depth[x] + 1})]
        want[f"n{s}"] = sum(depth.values()), len(depth)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in pairs], "a string, b string, confidence double")
    sources = spark.createDataFrame([(x,) for x in want], "source string")
    monkeypatch.setattr(G, "bfs", None)  # no row for a source and a node
    assert {r.source: (r.total, r.reached) for r in G.distance_sums(edges, sources, words=1, at_once=1).collect()} == want
    got = {r.node: r.closeness for r in G.closeness(edges, sources).collect()}
    assert all(np.isclose(got[x], (n - 1) ** 2 / t / (len(near) - 1) if t else 0) for x, (t, n) in want.items())
