import math

from pyspark.sql import functions as F

from siteweave.functions import motif as X
from siteweave.operators import edges as E
from siteweave.operators import geometry as Geo
from siteweave.operators import graph as G
from siteweave.operators import lookup as L
from siteweave.operators import motif_stats as M
from siteweave.operators import pairs as P
from siteweave.operators import scores as S
from siteweave.sources import tables as T


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_motif_forms(spark):
    df = spark.createDataFrame([("ABCDEFG",), ("AB",), ("",), ("ABCDEFGHIJKLMNOPQ",)], "m string")
    got = [r[0] for r in df.select(X.standardize(F.col("m"), 3)).collect()]
    assert got == ["ABCDEFG", "XXABXXX", "XXXXXXX", "FGHIJKL"]
    assert [r[0] for r in df.select(X.central(F.col("m"), 4)).collect()][3] == "EFGHIJKLM"


def test_substitution_variants(spark):
    df = spark.createDataFrame([("AAX", "AAX"), ("AD", "AE"), ("A", "AA")], "a string, b string")
    score = lambda v: [r[0] for r in df.select(X.substitution_similarity(F.col("a"), F.col("b"), v)).collect()]
    assert score("mean") == [7 / 3, 3.0, 0.0]
    assert score("known") == [4.0, 3.0, 4.0]
    assert score("sum") == [8, 6, 4]
    cells = spark.createDataFrame([("W", "W", 11), ("y", "H", 2), ("B", "A", -2), ("Z", "Q", 3), ("B", "D", 4), ("Z", "B", 1), ("B", "X", -1), ("*", "A", -4), ("*", "*", 1), ("X", "X", -1), ("C", "E", -4)], "a string, b string, want int")
    assert cells.where(X.pair_score(F.upper("a"), F.upper("b")) != F.col("want")).count() == 0
    matrix = X.read_matrix("# note\n A D\nA 4 -2\nD -2 6\n")
    assert df.select(X.substitution_similarity(F.lit("AD"), F.lit("DD"), "sum", X.matrix_score(matrix))).first()[0] == 4


def test_structural_matches_both_directions(spark):
    e = spark.createDataFrame([("a", "b", 1.0, "qa", "tb"), ("b", "a", 2.0, "qb", "ta"), ("c", "a", 3.0, "qc", "ta2"), ("a", "a", 0.0, "q", "t")], "query_id string, target_id string, rmsd double, QueryX string, TargetX string")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    got = rows(E.structural_matches(e, ids).select("query_id", "target_id", "rmsd", "QueryX"))
    assert ("a", "b", 1.0, "qa") in got and ("b", "a", 2.0, "qb") in got and ("a", "c", 3.0, "ta2") in got
    assert len(got) == 4 and L.without_self(E.structural_matches(e, ids)).count() == 3


def test_sequence_matches_credit(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("c", "a", 0.5), ("a", "d", 0.1)], "id1 string, id2 string, similarity double")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(E.sequence_matches(e, ids)) == [("a", "b", 0.9), ("a", "c", 0.5), ("b", "a", 0.9)]
    assert rows(E.sequence_matches(e, ids, credit="id1")) == [("a", "b", 0.9), ("a", "c", 0.5)]


def test_percentiles_and_statistics(spark):
    s = spark.createDataFrame([("a", "K", 1.0), ("b", "K", 1.0), ("c", "K", 3.0), ("d", "K", None), ("e", "K", float("nan"))], "site_id string, kinase string, score double")
    got = {r.site_id: r.percentile for r in S.percentiles(s).collect()}
    assert got == {"a": 0.2, "b": 0.2, "c": 0.6, "d": 0.8, "e": 0.8}
    near = spark.createDataFrame([("q", x) for x in "abc"], "query_id string, site_id string")
    r = S.network_statistics(near, s).first()
    assert (r.mean_score, r.median_score, r.sample_size, r.scores) == (5 / 3, 1.0, 3, [1.0, 1.0, 3.0])


def test_pssm(spark):
    wide = spark.createDataFrame([("K", 2.0, 3.0, 4.0, 5.0)], "kinase string, `-5A` double, `-4A` double, `1A` double, `2A` double")
    motifs = spark.createDataFrame([("AAXXXSAAXX",), ("AXXXXSXXXX",), ("AAA",), ("aaxxxsaaxx",)], "motif string")
    got = {r.motif: r.score for r in S.pssm_scores(motifs, S.pssm_long(wide)).collect()}
    assert got["AAXXXSAAXX"] == 120.0 and math.isnan(got["AXXXXSXXXX"]) and math.isnan(got["AAA"]) and len(got) == 3


def test_scored_matches_default_type(spark):
    m = spark.createDataFrame([("q", "t1", "Y"), ("q", "t2", None), ("p", "t2", None)], "query_id string, target_id string, target_type string")
    s = spark.createDataFrame([("t1", "K", 0.5, "Y"), ("t2", "K", 0.7, "Y"), ("t2", "K", 0.1, "ST")], "site_id string, kinase string, score double, score_class string")
    assert rows(S.scored_matches(m, s).select("query_id", "target_id", "score")) == [("p", "t2", 0.1), ("q", "t1", 0.5), ("q", "t2", 0.7)]


def test_ngram_pairs_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(1)
    motifs = {f"i{k}": "".join(rng.choice("ACDX") for _ in range(rng.randint(2, 9))) for k in range(60)}
    grams = {i: {m[k : k + 3] for k in range(len(m) - 2) if "X" not in m[k : k + 3]} for i, m in motifs.items()}
    want = sorted((a, b, len(grams[a] & grams[b])) for a, b in itertools.combinations(sorted(motifs), 2) if len(grams[a] & grams[b]) >= 2)
    df = spark.createDataFrame(list(motifs.items()), "id string, motif string")
    assert sorted(map(tuple, P.ngram_pairs(df, 3, 2, False, 4).select("id1", "id2", "matching").collect())) == want


def test_neighbours_against_all_pairs(spark):
    import numpy as np

    xyz = np.random.default_rng(2).uniform(-15, 15, (80, 3))
    atoms = spark.createDataFrame([("s", "A", k, "A", "CA", "C", *map(float, p), 50.0) for k, p in enumerate(xyz)], "structure_id string, chain string, resno int, aa string, atom string, element string, x double, y double, z double, bfactor double")
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    assert Geo.neighbours(atoms, atoms, 10.0).count() == (d <= 100).sum()
    assert Geo.contacts(atoms, 8.0).count() == (np.triu(d <= 64, 1)).sum()
    eigen = sorted((r.eigenvalue for r in Geo.pca(atoms).collect()), reverse=True)
    assert np.allclose(eigen, np.linalg.eigvalsh(np.cov(xyz.T))[::-1])
    alone = spark.createDataFrame([("s", "A", 1, "A", "CA", "C", 0.0, 0.0, 0.0, 50.0)], atoms.schema)
    area = Geo.accessible_area(alone, 100).first()
    assert abs(max(v for v in area if isinstance(v, float)) - 4 * math.pi * (1.7 + 1.4) ** 2) < 1e-6
    covered = spark.createDataFrame([("s", "A", k, "A", "CA", "C", 0.0, 0.0, 0.1 * k, 50.0) for k in (1, 2)], atoms.schema)
    assert sum(max(v for v in r if isinstance(v, float)) for r in Geo.accessible_area(covered, 100).collect()) < 1.3 * 4 * math.pi * 3.1**2
    assert Geo.cavity_volume(atoms.limit(3)).count() == 3


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.9), ("c", "d", 0.7), ("x", "y", 0.9)], "a string, b string, confidence double")
    assert {r.node: r.component for r in G.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    path = G.shortest_paths(e, spark.createDataFrame([("a", "d"), ("a", "x")], "source string, target string")).collect()
    assert [(r.target, r.cost, r.path) for r in path] == [("d", 2.0, ["a", "c", "d"])]
    assert rows(G.cliques(e, 3)) == [(["a", "b", "c"], True)]
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "source string")
    assert {r.node: r.betweenness for r in G.betweenness(e, nodes).collect()} == {"a": 0.0, "b": 0.0, "c": 2.0, "d": 0.0}
    m = G.network_metrics(e).first()
    assert (m.n_nodes, m.n_edges, m.n_components, m.largest, m.diameter) == (6, 5, 2, 4, 2)
    assert rows(G.bridges(e, spark.createDataFrame([("a",), ("d",)], "id string"))) == [("a", "d", "c")]
    assert abs(sum(r.rank for r in G.pagerank(e).collect()) - 1) < 1e-6
    labels = {r[0]: r[1] for r in G.modules(e).collect()}
    assert labels["a"] == labels["b"] == labels["c"] != labels["x"] == labels["y"]
    assert G.eigenvector(e).count() == 6


def test_sources(spark, tmp_path):
    pdb = "ATOM      1  N   SER A   5      11.104   6.134  -6.504  1.00 90.00           N"
    a = T.pdb_atoms(spark.createDataFrame([("s", pdb), ("s", "REMARK")], "structure_id string, value string")).first()
    assert (a.chain, a.resno, a.aa, a.atom, a.x, a.bfactor, a.element) == ("A", 5, "S", "N", 11.104, 90.0, "N")
    cif = "loop_\n_struct_conf.conf_type_id\n_struct_conf.beg_auth_asym_id\n_struct_conf.beg_auth_seq_id\n_struct_conf.end_auth_seq_id\nHELX_P A 2 4\n#\n"
    assert rows(T.secondary_structure(spark.createDataFrame([("s", cif)], "structure_id string, content string"))) == [("s", "A", k, "helix") for k in (2, 3, 4)]
    lines = spark.createDataFrame([("P1", 1, "FT   MOD_RES         15"), ("P1", 2, 'FT                   /note="Phosphoserine"'), ("P1", 3, "SQ")], "acc string, line_no int, line string")
    assert rows(T.known_phosphosites(lines)) == [("P1", 15, "S")]
    left = spark.createDataFrame([("a", 1, None)], "site_id string, x int, y int")
    right = spark.createDataFrame([("a", None, 2), ("b", 3, 4)], "site_id string, x int, y int")
    assert rows(L.overlay(left, right, "site_id")) == [("a", 1, 2)] and L.overlay(left, right, "site_id", "full").count() == 2
    assert T.replace_table(right, "sw_t") == 2 and T.replace_table(right, "sw_t") == 2


def test_entry_imports():
    import __spark_entry__ as entry

    assert "network_statistics" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_lsh_pairs_are_all_pairs_of_a_bucket(spark):
    import itertools
    import random

    rng = random.Random(4)
    motifs = {f"i{k:02}": "".join(rng.choice("ACD") for _ in range(rng.randint(2, 7))) for k in range(40)} | {f"same{k}": "STYACDEF" for k in range(5)}
    df = spark.createDataFrame(list(motifs.items()), "id string, motif string")
    got = {(r.id1, r.id2): r.bands for r in P.lsh_pairs(df, least_bands=2, block=4).collect()}
    assert all(got.get(p) == 20 for p in itertools.combinations([f"same{k}" for k in range(5)], 2))
    held = {}
    for r in P.lsh_bands(df.where("length(motif) >= 3").select("motif").distinct()).collect():
        held.setdefault(r.motif, set()).add((r.band, r.value))
    shared = {p: len(held.get(motifs[p[0]], set()) & held.get(motifs[p[1]], set())) for p in itertools.combinations(sorted(motifs), 2)}
    assert got == {p: n for p, n in shared.items() if n >= 2}


def test_phosphosites_of_long_sequences(spark):
    import random

    rng = random.Random(3)
    proteins = {f"P{k}": "".join(rng.choice("ACDESTY") for _ in range(n)) for k, n in enumerate((1, 7, 15, 256, 257, 511, 2000))} | {"E": ""}
    docs = spark.createDataFrame([(k, "g", v) for k, v in proteins.items()], "uniprot_id string, gene string, sequence string")
    want = sorted((f"{k}_{i + 1}", v[i], i + 1, v[max(0, i - 7) : i + 8]) for k, v in proteins.items() for i in range(len(v)) if v[i] in "STY")
    assert sorted(map(tuple, M.phosphosites(docs).select("site_id", "residue", "resno", "motif").collect())) == want


def test_motif_profile_and_covering_patterns(spark):
    p = spark.createDataFrame([("DEDEDPRSPKKAAAA", "S")], "m string, t string").select(X.motif_profile(F.col("m"), F.col("t")).alias("p")).first().p
    assert (p.center, p.narrow, p.acidic_count, p.upstream_acidic, p.downstream_basic) == (7, "DPRSPKK", 5, 500 / 7, 200 / 7)
    assert {x.name: x.match for x in p.patterns} == {"CDK": "SPKK", "MAPK/ERK": "PRSP"} | {k: v for k, v in ((x.name, x.match) for x in p.patterns) if k not in ("CDK", "MAPK/ERK")}
    seq = spark.createDataFrame([("AAPRSPAKA", 5), ("AASQAA", 3), ("AAAA", 2)], "s string, k int").select(X.covering_patterns(F.col("s"), F.col("k")).alias("c")).collect()
    assert "CDK_consensus" in seq[0].c and "MAPK_consensus" in seq[0].c and seq[1].c == "ATM_ATR_consensus" and seq[2].c == "None"


def test_a_match_hides_what_overlaps_it(spark):
    """A plain left-to-right scan, on windows in which earlier matches hide later ones."""
    import random
    import re

    rng = random.Random(4)
    cases = [("".join(rng.choice("SSSTTPKE") for _ in range(rng.randint(1, 40))), 0) for _ in range(300)]
    cases = [(s, rng.randint(1, len(s))) for s, _ in cases] + [("SSTS", 4), ("STSTSTSTS", 5), ("S", 1)]
    want, hidden = [], 0
    for s, k in cases:
        lo = max(0, k - 11)
        window, centre = s[lo : k + 10], k - 1 - lo
        names = [n for n, p in X.CONSENSUS.items() if any(m.start() <= centre < m.end() for m in re.finditer(p, window))]
        loose = [n for n, p in X.CONSENSUS.items() if any((m := re.compile(p).match(window, o)) and m.end() > centre for o in range(centre + 1))]
        hidden += names != loose
        want.append(", ".join(names) or "None")
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, k int").select("i", X.covering_patterns(F.col("s"), F.col("k")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == want and hidden > 10


def test_families_and_preferred_motifs(spark):
    k = spark.createDataFrame([("LCK",), ("HCK",), ("yes1",), ("CDK3",), ("PRKCA",), ("CSNK2A1",), ("p38a",), ("PKACA",)], "kinase string")
    got = dict(map(tuple, k.select("kinase", S.family_of(F.col("kinase"))).collect()))
    assert got == {"LCK": "SRC", "HCK": "SRC", "yes1": "SRC", "CDK3": "Other", "PRKCA": "Other", "CSNK2A1": "CK", "p38a": "Other", "PKACA": "PKA"}
    motifs = dict(map(tuple, S.preferred_motif(k).select("kinase", "preferred_motif").collect()))
    assert motifs["p38a"] == "P-X-S/T-P" and motifs["LCK"].startswith("X-E/D") and motifs["CDK3"] == "Unknown"


def test_lsh_recall(spark):
    import random

    rng = random.Random(6)
    base = ["".join(rng.choice(X.AMINO) for _ in range(15)) for _ in range(40)]
    changed = [m[: (at := rng.randrange(15))] + rng.choice(X.AMINO) + m[at + 1 :] for m in base]
    motifs = {f"a{k:02}": m for k, m in enumerate(base)} | {f"b{k:02}": m for k, m in enumerate(changed)}
    features = {i: {f"{m[k + o]}{o}" for k in range(len(m) - 2) for o in range(3)} for i, m in motifs.items()}
    jaccard = lambda a, b: len(features[a] & features[b]) / len(features[a] | features[b])
    got = {(r.id1, r.id2): r.bands for r in P.lsh_pairs(spark.createDataFrame(list(motifs.items()), "id string, motif string")).collect()}
    near = [(f"a{k:02}", f"b{k:02}") for k in range(40) if jaccard(f"a{k:02}", f"b{k:02}") >= 0.75]
    assert len(near) > 20 and sum(p in got for p in near) >= 0.95 * len(near)
    assert any(1 < n < 20 for n in got.values())  # bands differ


def test_reports_of_a_site(spark):
    from siteweave.plans import reports as R

    ids = spark.createDataFrame([("P1_S5",)], "id string")
    structural = spark.createDataFrame([("P1_S5", "P2_T7", 1.0), ("P3_Y9", "P1_S5", 2.0), ("P1_S5", "P1_S5", 0.0)], "query_id string, target_id string, rmsd double")
    sequence = spark.createDataFrame([("P1_S5", "P2_T7", 0.9), ("P4_S2", "P1_S5", 0.7)], "id1 string, id2 string, similarity double")
    known = spark.createDataFrame([("P1_S5", "AAAASPAAA", "S", 1.0), ("P2_T7", "AAAATPAAA", "T", 0.0), ("P4_S2", "CCCCSPCCC", "S", None)], "site_id string, motif string, residue string, is_known double")
    notes = spark.createDataFrame([("P1_S5", 90.0), ("P3_Y9", 80.0)], "site_id string, plddt double")
    scores = spark.createDataFrame([("P2_T7", "AKT1", 0.9), ("P2_T7", "LCK", 0.5), ("P3_Y9", "LCK", 0.8), ("P4_S2", "AKT1", 0.3), ("P1_S5", "AKT1", 0.4)], "site_id string, kinase string, score double")
    detail = R.site_detail(ids, structural, sequence, notes, known, scores)
    assert {k: v.count() for k, v in detail.items()} == {
        "site": 1, "structural": 2, "sequence": 2, "nodes": 3, "links": 2, "frequencies": detail["frequencies"].count(), "consensus": 1, "conserved": detail["conserved"].count(), "alignment": 22,
        "kinases": 1, "families": 1, "heatmap": 4, "network_kinases": 1, "network_heatmap": 5,
    }
    routed = scores.withColumn("score_class", F.when(F.col("site_id") == "P3_Y9", "Y").otherwise("ST"))
    found = R.site_kinase_analysis(ids, structural, sequence, routed)
    assert {(r.target_id, r.match_type) for r in found["matches"].collect()} == {("P2_T7", "structural"), ("P3_Y9", "structural"), ("P2_T7", "sequence"), ("P4_S2", "sequence")}
    assert {r.kinase: r.score for r in found["medians"].collect()} == {"AKT1": 0.9, "LCK": 0.65}
    assert {r.family: r.score for r in found["families"].collect()} == {"AKT": 0.9, "SRC": 0.65}


def test_domains_and_sinks(spark, tmp_path):
    atoms = spark.createDataFrame([("s", "A", k, "A", "CA", "C", 5.0 * k + (100 if k > 4 else 0), 0.0, 0.0, 1.0) for k in range(7)], "structure_id string, chain string, resno int, aa string, atom string, element string, x double, y double, z double, bfactor double")
    assert rows(Geo.domains(atoms).select("resno", "n_residues", "domain")) == [(k, 5, 1) if k < 5 else (k, 2, 2) for k in range(7)]
    table = spark.createDataFrame([("a", "b", 0.5), ("c", "d", 0.7)], "id1 string, id2 string, similarity double")
    assert T.write_table(table, f"{tmp_path}/x.parquet") == 2 and T.write_table(table, f"{tmp_path}/x.csv", "csv") == 2 and T.write_table(table, f"{tmp_path}/sheet", "sheet") == 2
    schema = "id1 string, id2 string, similarity double"
    assert rows(T.read_either(spark, f"{tmp_path}/x", schema)) == rows(table)
    assert T.rebuild_edges(spark, f"{tmp_path}/x.csv", "sw_edges") == 2 and rows(spark.table("sw_edges")) == rows(table)


def test_protein_analysis_states(spark):
    from siteweave.plans import reports as R

    records = spark.createDataFrame([("P1", "TP53", "Tumour"), ("P2", "tp53", None), ("P3", None, "Bare")], "uniprot_id string, gene string, name string")
    sites = spark.createDataFrame([("P1_5", "P1"), ("P1_9", "P1"), ("P2_1", "P2")], "site_id string, uniprot_id string")
    edges = spark.createDataFrame([("P1_5", "P2_1", 1.0), ("P3_2", "P1_5", 2.0), ("P1_9", "P1_9", 0.0), ("P1_9", "P2_1", 9.0)], "query_id string, target_id string, rmsd double")
    notes = spark.createDataFrame([("P2_1", 80.0), ("Z_1", 1.0)], "site_id string, plddt double")
    known = spark.createDataFrame([("P3_2", "AAA"), ("Z_2", "CCC")], "site_id string, motif string")
    asked = spark.createDataFrame([("p1", "UniProt"), ("Tp53", "gene"), ("Tp53", "gene"), ("P3", "uniprot"), ("P9", "uniprot"), (None, "gene"), ("P1", "other")], "id string, id_type string")
    out = R.protein_analysis(asked, records, sites, edges, notes, known)
    got = {(r.id, r.id_type): (r.uniprot_id, r.gene, r.name, r.n_sites, r.n_matched_sites, r.n_matches, r.status) for r in out["summary"].collect()}
    assert got == {
        ("p1", "uniprot"): ("P1", "TP53", "Tumour", 2, 1, 2, "ok"), ("Tp53", "gene"): ("P1", "TP53", "Tumour", 2, 1, 2, "ok"), ("P3", "uniprot"): ("P3", "Unknown", "Bare", 0, 0, 0, "no sites"),
        ("P9", "uniprot"): (None, None, None, 0, 0, 0, "not found"), (None, "gene"): (None, None, None, 0, 0, 0, "not found"), ("P1", "other"): (None, None, None, 0, 0, 0, "not found"),
    }
    assert {(r.query_id, r.target_id, r.motif, r.plddt) for r in out["matches"].collect()} == {("P1_5", "P2_1", None, 80.0), ("P1_5", "P3_2", "AAA", None)}
    assert out["sites"].count() == 2
