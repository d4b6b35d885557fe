"""Operators that replace all-pairs or whole-state forms, against plain ones."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.functions import motif as X
from siteweave.operators import geometry as Geo
from siteweave.operators import graph as G
from siteweave.operators import graph_scale as S
from siteweave.operators import pairs as P
from siteweave.operators import selection as Q


def random_graph(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return pairs, spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in pairs], "a string, b string, confidence double")


def walks(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = {}
    for s in near:
        out[s], ring, d = {s: 0}, [s], 0
        while ring:
            d += 1
            ring = list({y for x in ring for y in near[x]} - set(out[s]))
            out[s].update(dict.fromkeys(ring, d))
    return out


def test_sketched_distances_are_near_exact(spark):
    pairs, e = random_graph(spark, 150, 260, 3)
    d = walks(pairs)
    hops = {int(r.node[1:]): r for r in S.sketched_hops(e).collect()}
    assert set(hops) == set(d)
    for x, row in hops.items():
        assert abs(row.reached - len(d[x])) <= 0.03 * len(d[x]) + 1 and abs(row.total - sum(d[x].values())) <= 0.03 * sum(d[x].values()) + 1
    n = len(d)
    exact = {x: (len(v) - 1) ** 2 / sum(v.values()) / (n - 1) for x, v in d.items()}
    top = [(r.node, r.closeness) for r in S.top_closeness(e, 5).orderBy("rank").collect()]
    want = sorted(((f"n{x}", c) for x, c in exact.items()), key=lambda p: (-p[1], p[0]))[:5]
    assert [t[0] for t in top] == [w[0] for w in want] and np.allclose([t[1] for t in top], [w[1] for w in want])
    paths = S.sketched_paths(e).first()
    every = [v for row in d.values() for v in row.values() if v]
    assert abs(paths.mean_path / np.mean(every) - 1) < 0.03 and paths.diameter <= max(every) and abs(paths.pairs / len(every) - 1) < 0.03
    assert 0 < paths.effective_diameter <= max(every)


def test_sampled_betweenness(spark):
    pairs, e = random_graph(spark, 24, 50, 5)
    exact = {r.node: r.betweenness for r in G.betweenness(e, G.symmetric(e).select(F.col("a").alias("source")).distinct()).collect()}
    whole = {r.node: r.betweenness for r in S.sampled_betweenness(e, 0.01, batch=32).collect()}
    assert all(math.isclose(v, exact.get(k, 0.0), abs_tol=1e-9) for k, v in whole.items())
    assert S.sources_for(10**6, 0.05, 0.1) == 3363 and S.sources_for(100, 0.05, 0.1) == 100
    n = len(whole)
    some = S.sampled_betweenness(e, 0.4, 0.1).collect()
    assert S.sources_for(n, 0.4, 0.1) < n
    assert max(abs(r.share - 2 * exact.get(r.node, 0.0) / (n - 1) / (n - 2)) for r in some) <= 0.4


@pytest.mark.parametrize("values", [[3.0], [1.0] * 50, [float(x) for x in range(3000)], [1e-300, 5e-324, 0.0, -1e300, 1e300, 1.7e308, -1.7e308, 2.0, 2.0, 2.0000000000000004] * 3])
def test_selection_equals_sorting(spark, values):
    rows = [(v,) for v in values] + [(None,), (float("nan"),)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "value double")
    ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
    assert Q.selected(df, ranks) == {r: sorted(values)[r] for r in ranks}
    if max(map(abs, values)) < 1e300:
        assert np.allclose(Q.percentiles(df, [0.1, 0.5, 0.99]), np.percentile(values, [10, 50, 99]))
    rows = Q.percentile_rows(df, [0, 33, 100])
    assert rows == [(p, min(len(values) - 1, len(values) * p // 100) + 1, sorted(values)[min(len(values) - 1, len(values) * p // 100)]) for p in (0, 33, 100)]


def test_selection_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "value double")
    assert Q.selected(df, [0]) == {} and Q.percentile_rows(df, [50]) == [] and Q.percentiles(df, [0.5]) == [None]


def plain_similarity(a, b):
    lower = [[int(v) for v in line.split()] for line in X.BLOSUM62.strip().splitlines()]
    at = X.BLOSUM_LETTERS.index
    mean = sum(lower[max(at(x), at(y))][min(at(x), at(y))] for x, y in zip(a, b, strict=True)) / 9
    return min(1.0, max(0.0, (mean + 20) / 40))


@pytest.mark.parametrize("block, n", [(512, 20), (3, 4)])
def test_trigram_matches_equal_all_pairs(spark, block, n):
    rng = random.Random(block)
    parts = ["".join(rng.choice("STARK") for _ in range(3)) for _ in range(6)]
    motifs = ["".join(rng.choice(parts) for _ in range(3)) for _ in range(90)]
    sites = [(f"s{k:03d}", m, float(k % 3 == 0), float(k % 100) if k % 7 else None) for k, m in enumerate(motifs)] + [("short", "STA", 1.0, 1.0), ("odd", "ST_RKSTAR", 1.0, 1.0), ("none", None, 1.0, 1.0)]
    df = spark.createDataFrame(sites, "site_id string, motif string, is_known double, accessibility double")
    usable = [s for s in sites if s[1] and len(s[1]) == 9 and "_" not in s[1]]
    want = []
    for q, m, *_ in usable:
        found = [(-plain_similarity(m, o), t) for t, o, known, access in usable if t != q and (known == 1.0 or (access or 0) > 50) and any(m[i : i + 3] == o[i : i + 3] for i in (0, 3, 6))]
        want += [(q, t, round(-s, 9), k + 1) for k, (s, t) in enumerate(sorted(x for x in found if -x[0] >= 0.4)[:n])]
    got = [(r.query_id, r.target_id, round(r.similarity, 9), r["rank"]) for r in P.trigram_matches(df, df, 0.4, n, block).collect()]
    assert sorted(got) == sorted(want)


def atoms(spark, n, seed, spread=40.0):
    rng = random.Random(seed)
    rows = [(f"S{k % 2}", "AB"[k % 3 == 0], k, rng.choice("ACDEFGHIKLMNPQRSTVWY"), "CA", "C", *(rng.uniform(-spread, spread) for _ in range(3)), 50.0) for k in range(n)]
    rows.append(("S9", "A", 1, "W", "CA", "C", 0.0, 0.0, 0.0, 50.0))
    return rows, spark.createDataFrame(rows, "structure_id string, chain string, resno int, aa string, atom string, element string, x double, y double, z double, bfactor double")


def test_nearest_by_type_equals_all_pairs(spark):
    rows, df = atoms(spark, 80, 2, 150.0)
    want = {}
    for s, c, r, *_, x, y, z, _ in rows:
        cell = want[s, c, r] = {}
        for s2, c2, r2, aa, _, _, x2, y2, z2, _ in rows:
            if (s, c) == (s2, c2) and r != r2:
                d = math.dist((x, y, z), (x2, y2, z2))
                for k in [aa, *(p for p, v in Geo.PROPERTIES.items() if aa in v)]:
                    cell[k] = min(d, cell.get(k, math.inf))
    got = Geo.nearest_by_type(df).collect()
    assert {(r.structure_id, r.chain, r.resno) for r in got} == {k for k, v in want.items() if v}
    for r in got:
        near = want[r.structure_id, r.chain, r.resno]
        assert all((r[f"nearest_{k}"] is None) == (k not in near) and math.isclose(r[f"nearest_{k}"] or 0, near.get(k, 0)) for k in (*X.AMINO, *Geo.PROPERTIES))


def test_secondary_distances_equal_all_pairs(spark):
    rows, df = atoms(spark, 40, 4, 60.0)
    kinds = ("helix", "strand", "turn", "coil")
    rng = random.Random(8)
    kind = {(s, c, r): rng.choice((*kinds[:3], None)) for s, c, r, *_ in rows}
    ss = spark.createDataFrame([(*k, v) for k, v in kind.items() if v], "structure_id string, chain string, resno int, ss_type string")
    for r in Geo.secondary_distances(df, ss).collect():
        at = next(x for x in rows if x[:3] == (r.structure_id, r.chain, r.resno))
        for k in kinds:
            others = [x for x in rows if x[0] == r.structure_id and x[:3] != at[:3] and kind[x[:3]] == k]
            near = min((math.dist(at[6:9], x[6:9]) for x in others), default=None)
            assert (r[f"spatial_{k}"] is None) == (near is None) and math.isclose(r[f"spatial_{k}"] or 0, near or 0)
            seq = min((abs(x[2] - r.resno) for x in rows if x[:2] == at[:2] and kind[x[:3]] == k), default=None)
            assert r[f"seq_{k}"] == seq


def test_rotated_coordinates_have_small_deviations(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for pair in range(3):
        a = rng.normal(size=(20, 3)) * 10
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        q *= np.linalg.det(q)
        b = (a + rng.normal(size=a.shape) * (0.5 * pair)) @ q.T + [5.0, -3.0, 1.0]
        ca, cb = a - a.mean(0), b - b.mean(0)
        u, _, v = np.linalg.svd(ca.T @ cb)
        r = u @ np.diag([1, 1, np.linalg.det(u @ v)]) @ v
        for k, d in enumerate(np.linalg.norm(ca - cb @ r.T, axis=1)):
            want[pair, k] = d
        rows += [(pair, k, *map(float, a[k]), *map(float, b[k])) for k in range(20)]
    df = spark.createDataFrame(rows, "pair_id int, resno int, ax double, ay double, az double, bx double, by double, bz double")
    got = {(r.pair_id, r.resno): r.deviation for r in Geo.residue_deviations(df).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    for r in Geo.superposition(df).collect():
        assert math.isclose(r.rmsd, np.sqrt(np.mean([d * d for (p, _), d in want.items() if p == r.pair_id])), abs_tol=1e-5)


def test_pca_projection_equals_svd(spark):
    rows, df = atoms(spark, 30, 6)
    got = {(r.structure_id, r.chain, r.resno): (r.pc1, r.pc2, r.pc3) for r in Geo.pca_projection(df).collect()}
    assert len(got) == len(rows)
    for s in ("S0", "S1"):
        keys = [x[:3] for x in rows if x[0] == s]
        c = np.array([x[6:9] for x in rows if x[0] == s])
        c -= c.mean(0)
        u, d, _ = np.linalg.svd(c, full_matrices=False)
        p = np.array([got[k] for k in keys])
        assert np.allclose(np.abs(p), np.abs(u * d), atol=1e-6)
    assert got["S9", "A", 1] == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(("n", "k", "shared", "block"), [(3, 2, 1, 1024), (3, 4, 2, 3), (2, 5, 3, 7), (3, 5, 3, 2), (2, 4, 4, 5)])
def test_similar_texts_equal_all_pairs(spark, n, k, shared, block):
    rng = random.Random(n * 100 + k)
    base = ["".join(rng.choice("ACDEFGHIKX") for _ in range(12)) for _ in range(12)]
    motifs = [m for b in base for m in [b, b, b.lower(), *("".join(rng.choice("ACDEFGHIKX") if rng.random() < 0.1 else x for x in b) for _ in range(8))]]
    motifs += ["", "A", "AAAAAAAAAAAA", "XXXXXXXXXXXX", None, "ACD"]
    texts = sorted({m.upper() for m in motifs if m is not None})
    grams = {m: {m[i : i + n] for i in range(len(m) - n + 1) if "X" not in m[i : i + n]} for m in texts}
    want = sorted((a, b, len(grams[a] & grams[b])) for a, b in itertools.combinations(texts, 2) if len(grams[a] & grams[b]) >= k)
    df = spark.createDataFrame([(f"i{j}", m) for j, m in enumerate(motifs)], "id string, motif string")
    assert len(want) > 20 and sorted(map(tuple, P.similar_texts(df, n, k, shared, block).collect())) == want
    assert P.text_members(df).count() == len(motifs) - 1
    assert P.similar_texts(df.limit(0), n, k, shared).isEmpty()
    with pytest.raises(ValueError, match="from 1 to k"):
        P.similar_texts(df, n, 1, 2)


@pytest.mark.parametrize("weighted", [False, True])
def test_shortest_paths_equal_dijkstra(spark, weighted):
    import heapq

    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(60), 2))): rng.randint(1, 1000) / 1000 for _ in range(90)}
    table = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", c) for (a, b), c in edges.items()], "a string, b string, confidence double")
    near = {}
    for (a, b), c in edges.items():
        w = 1.001 - c if weighted else 1.0
        near.setdefault(f"n{a:02}", {})[f"n{b:02}"] = w
        near.setdefault(f"n{b:02}", {})[f"n{a:02}"] = w

    def dijkstra(s):
        far, heap = {}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in far:
                continue
            far[x] = d
            for y, w in near.get(x, {}).items():
                if y not in far:
                    heapq.heappush(heap, (d + w, y))
        return far

    asked = [(f"n{a:02}", f"n{b:02}") for a in (0, 3, 7) for b in (*range(1, 60, 9), 3)] + [("n00", "zz"), ("zz", "n00"), ("n00", "n00"), ("n00", "n01"), (None, "n01")]
    got = {(r.source, r.target): r for r in G.shortest_paths(table, spark.createDataFrame(asked, "source string, target string"), weighted).collect()}
    far = {s: dijkstra(s) for s in {s for s, _ in asked if s in near}}
    assert set(got) == {(s, t) for s, t in asked if s in far and t in far[s]}
    for (s, t), r in got.items():
        assert abs(r.cost - far[s][t]) < 1e-9 and r.path[0] == s and r.path[-1] == t
        assert abs(sum(near[x][y] for x, y in itertools.pairwise(r.path)) - r.cost) < 1e-9
    if not weighted:
        short = G.shortest_paths(table, spark.createDataFrame(asked, "source string, target string"), hops=2).collect()
        assert {(r.source, r.target) for r in short} == {p for p, r in got.items() if r.cost <= 2}
