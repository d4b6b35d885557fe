"""Registered queries of operators that need more than a composition: scans, selection, cliques, communities, rings, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteweave.functions import motif as X
from siteweave.operators import communities as C
from siteweave.operators import edges as E
from siteweave.operators import geometry as Geo
from siteweave.operators import graph as G
from siteweave.operators import graph_scale as GS
from siteweave.operators import motif_stats as M
from siteweave.operators import pairs as P
from siteweave.operators import scores as S
from siteweave.operators import selection as Q
from siteweave.plans import fixtures as fx
from siteweave.plans import reports as R
from siteweave.plans.more_queries import LETTERS, MATRIX
from siteweave.plans.queries import NEAR, STATS, query, register_raw, rounded, with_

# The letters around every site, ten on both sides, by chunks that overlap.
WINDOWS = """, fx_window AS (SELECT uniprot_id||'_'||(256*k+i) AS site_id, least(256*k+i, 11) AS pos, replace(substr(c,i,21),'-','') AS win FROM
    (SELECT uniprot_id, k, c, unnest(range(1, length(c)-19)) AS i FROM (SELECT uniprot_id, k, substr(p, 256*k+1, 276) AS c FROM
        (SELECT uniprot_id, '----------'||sequence||'----------' AS p, unnest(range(0, (length(sequence)-1)//256+1)) AS k FROM fx_protein)))
    WHERE substr(c,i+10,1) IN ('S','T','Y'))"""
# Written out, as a mark as long as each pattern; replacing goes from left to right and leaves out what overlaps.
MARKED = [
    ("PKA_consensus", "R[RK].S", 4), ("PKC_consensus", "[ST].[RK]", 3), ("CK2_consensus", "S..E", 4), ("CK1_consensus", "S..[ST]", 4), ("proline_directed", "[ST]P", 2), ("GSK3_consensus", "S...S", 5),
    ("acidic_directed", "S.[DE]", 3), ("basic_directed", "S.[RK]", 3), ("CDK_consensus", "[ST]P.[RK]", 4), ("MAPK_consensus", "P.[ST]P", 4), ("ATM_ATR_consensus", "[ST]Q", 2),
]
HITS = ", ".join(f"CASE WHEN substr(regexp_replace(win, '{p}', '{'#' * n}', 'g'), pos, 1)='#' THEN '{name}' END" for name, p, n in MARKED)


@query(f"{WINDOWS} SELECT site_id, coalesce(nullif(concat_ws(', ', {HITS}), ''), 'None') AS patterns FROM fx_window", "fx_protein")
def covering_patterns(spark, d):
    sites = M.phosphosites(fx.proteins(spark, d), 10)
    return sites.select("site_id", X.covering_patterns(F.col("motif"), F.least("resno", F.lit(11))).alias("patterns"))


# Graphs.


@query(
    f""", e AS (SELECT a.structure_id||':'||a.resno AS a, b.structure_id||':'||b.resno AS b FROM {NEAR}<=36), near AS (SELECT a, list(b) AS nb FROM e GROUP BY a),
    r(members, last, common) AS (SELECT [a], a, nb FROM near UNION ALL SELECT list_append(members, x), x, list_intersect(common, nb) FROM (SELECT members, common, last, unnest(common) AS x FROM r) JOIN near ON near.a=x WHERE x>last)
    SELECT array_to_string(members, ',') AS members, CAST(len(members) AS INT) AS size FROM r WHERE len(common)=0 AND len(members)>=3""",
    "fx_atom",
)
def contact_cliques(spark, d):
    """Maximal cliques of at least three residues of which any two lie within 6 A."""
    name = lambda resno: F.concat_ws(":", F.col("structure_id").cast("string"), F.col(resno).cast("string"))
    near = Geo.contacts(fx.atoms(spark, d), 6.0).select(name("resno").alias("a"), name("n_resno").alias("b"), F.lit(1.0).alias("confidence"))
    return C.maximal_cliques(near, 3).select(F.concat_ws(",", "members").alias("members"), "size")


@query()
def graph_louvain(spark, d):
    return C.louvain(fx.strong_interactions(spark, d))


@query()
def graph_spectral_clusters(spark, d):
    return C.spectral_clusters(fx.strong_interactions(spark, d))


@query()
def graph_path_figures(spark, d):
    return GS.sketched_paths(fx.strong_interactions(spark, d))


@query()
def graph_closest(spark, d):
    return GS.top_closeness(fx.strong_interactions(spark, d))


@query()
def graph_between(spark, d):
    return GS.sampled_betweenness(fx.strong_interactions(spark, d), 0.25)


# Order statistics of a continuous column.

POINTS = (0, 1, 10, 25, 33.3, 50, 75, 90, 95, 99, 100)


@query(
    f"""WITH v AS (SELECT CAST(embedding[1] AS DOUBLE) AS value, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE)) AS row, count(*) OVER () AS n FROM embeddings),
    p AS (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in POINTS)}]) AS percent) SELECT percent, row, value FROM p JOIN v ON row = least(n-1, CAST(floor(n*percent/100) AS BIGINT))+1"""
)
def percentile_rows(spark, d):
    values = spark.read.parquet(f"{d}/embeddings.parquet").select(F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return spark.createDataFrame([(float(p), r, v) for p, r, v in Q.percentile_rows(values, list(POINTS))], "percent double, row long, value double")


@query(
    """, f AS (SELECT min(map_ratio) AS lo, max(map_ratio) AS hi FROM fx_edge) SELECT CAST(least(floor((map_ratio-lo)/((hi-lo)/100)), 99) AS BIGINT) AS bin, count(*) AS count FROM fx_edge, f GROUP BY 1""",
    "fx_edge",
)
def score_histogram(spark, d):
    return P.distribution(fx.edges(spark, d).select(F.col("map_ratio").alias("score")), include_max=True)[1]


# Structures.

KINDS = ("helix", "strand", "turn")
SS = "CASE resno%5 WHEN 0 THEN 'helix' WHEN 2 THEN 'strand' WHEN 3 THEN 'turn' END"


@query(
    f""", s AS (SELECT *, {SS} AS ss FROM fx_atom) SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno,
        {", ".join(f"CAST(min(CASE WHEN b.ss='{k}' THEN abs(a.resno-b.resno) END) AS INT) AS seq_{k}" for k in KINDS)},
        {", ".join(f"round(sqrt(min(CASE WHEN b.ss='{k}' AND a.resno<>b.resno THEN (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) END)),6) AS spatial_{k}" for k in KINDS)}
        FROM s a JOIN s b ON a.structure_id=b.structure_id GROUP BY 1,2,3""",
    "fx_atom",
)
def secondary_distances(spark, d):
    atoms = fx.atoms(spark, d)
    kind = F.when(F.col("resno") % 5 == 0, "helix").when(F.col("resno") % 5 == 2, "strand").when(F.col("resno") % 5 == 3, "turn")
    found = Geo.secondary_distances(atoms, atoms.select("structure_id", "chain", "resno", kind.alias("ss_type")).where("ss_type IS NOT NULL"), KINDS)
    return rounded(found, *[f"spatial_{k}" for k in KINDS])


@query()
def pca_coordinates(spark, d):
    return Geo.pca_projection(fx.atoms(spark, d))


@query()
def residue_deviations(spark, d):
    """Each structure laid over the next one, residue by residue."""
    atoms = fx.atoms(spark, d)
    a = atoms.select(F.col("structure_id").alias("pair_id"), "resno", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = atoms.select((F.col("structure_id") - 1).alias("pair_id"), "resno", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return Geo.residue_deviations(a.join(b, ["pair_id", "resno"]))


# Matches and reports.

GATE = "(is_known=1.0 OR coalesce(accessibility>50, false))"


@query(
    f""", m AS (SELECT q.site_id AS query_id, t.site_id AS target_id, q.motif AS m1, t.motif AS m2 FROM fx_supp q JOIN fx_supp t ON q.site_id<>t.site_id AND substr(q.motif,1,3)=substr(t.motif,1,3) WHERE {GATE.replace("is_known", "t.is_known").replace("accessibility", "t.accessibility")}
        UNION SELECT q.site_id, t.site_id, q.motif, t.motif FROM fx_supp q JOIN fx_supp t ON q.site_id<>t.site_id AND substr(q.motif,4,3)=substr(t.motif,4,3) WHERE {GATE.replace("is_known", "t.is_known").replace("accessibility", "t.accessibility")}
        UNION SELECT q.site_id, t.site_id, q.motif, t.motif FROM fx_supp q JOIN fx_supp t ON q.site_id<>t.site_id AND substr(q.motif,7,3)=substr(t.motif,7,3) WHERE {GATE.replace("is_known", "t.is_known").replace("accessibility", "t.accessibility")}),
    l AS (SELECT m1, m2, sum(row[instr('{LETTERS}', substr(m2,p,1))]) AS s FROM (SELECT DISTINCT m1, m2, unnest(range(1,10)) AS p FROM m) JOIN {MATRIX} ON i=instr('{LETTERS}', substr(m1,p,1))-1 GROUP BY 1,2),
    r AS (SELECT query_id, target_id, (s/9.0::DOUBLE+20)/40 AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, target_id) AS rank FROM m JOIN l USING (m1, m2) WHERE (s/9.0::DOUBLE+20)/40>=0.4)
    SELECT query_id, target_id, round(similarity,6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank<=20""",
    "fx_score", "fx_supp",
)
def trigram_matches(spark, d):
    s = fx.supplement(spark, d)
    return rounded(P.trigram_matches(s.select("site_id", "motif"), s), "similarity").select("query_id", "target_id", "similarity", "rank")


REQUESTS = "(SELECT DISTINCT site_id AS id, CAST(3+p%3 AS INT) AS top_n, CASE WHEN p%2=0 THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS similarity, CASE WHEN p%3=0 THEN 3.0::DOUBLE ELSE 1.5::DOUBLE END AS rmsd FROM (SELECT site_id, CAST(regexp_extract(site_id,'P(\\d+)_',1) AS INT) AS p FROM fx_score))"
ASKED = f""", q AS {REQUESTS}, near_sites AS (SELECT DISTINCT * FROM (SELECT id AS query_id, id AS site_id FROM q
    UNION ALL SELECT query_id, target_id FROM fx_edge e JOIN q ON id=query_id WHERE e.similarity>=q.similarity UNION ALL SELECT target_id, query_id FROM fx_edge e JOIN q ON id=target_id WHERE e.similarity>=q.similarity
    UNION ALL SELECT query_id, target_id FROM fx_edge e JOIN q ON id=query_id WHERE e.rmsd<=q.rmsd)),
    scored AS (SELECT query_id, kinase, sum(CAST(round(score*100) AS BIGINT)) AS s, count(*) AS n FROM near_sites JOIN fx_score USING (site_id) WHERE score>0 GROUP BY 1,2 HAVING count(*)>=2)"""


def _requests(spark, d):
    p = F.regexp_extract("id", r"P(\d+)_", 1).cast("int")
    return fx.ids(spark, d).select("id", (3 + p % 3).alias("top_n"), F.when(p % 2 == 0, 0.6).otherwise(0.8).alias("similarity"), F.when(p % 3 == 0, 3.0).otherwise(1.5).alias("rmsd"))


def _report(spark, d):
    exact = fx.scores(spark, d).withColumn("score", F.col("score").cast("decimal(12,2)"))
    return R.network_kinase_report(_requests(spark, d), fx.sequence_edges(spark, d), fx.edges(spark, d), exact)


@query(f"{ASKED} SELECT query_id, count(*) AS n_sites FROM near_sites GROUP BY 1", "fx_edge", "fx_score")
def request_site_counts(spark, d):
    return _report(spark, d)["counts"]


@query(
    f"{ASKED}, m AS (SELECT query_id, kinase, (s*20000+n)//(2*n) AS mean FROM scored) SELECT query_id, kinase, mean/1000000.0::DOUBLE AS mean_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mean DESC, kinase) AS rank FROM m) JOIN q ON id=query_id WHERE rank<=top_n",
    "fx_edge", "fx_score",
)
def request_top_kinases(spark, d):
    return _report(spark, d)["top_kinases"].select("query_id", "kinase", F.col("mean_score").cast("double").alias("mean_score"), "rank")


@query(
    """SELECT site_id, uniprot_id, CAST(resno AS INT) AS resno, CASE WHEN p%3=0 THEN 'AKT1, PKA' WHEN q%2=0 THEN 'PKA' ELSE '' END AS known_kinases, (p%3=0 OR q%2=0) AS is_known_kinase FROM (SELECT *, CAST(substr(uniprot_id,2) AS INT) AS p, resno AS q FROM fx_supp)""",
    "fx_score", "fx_supp",
)
def protein_page(spark, d):
    s = fx.supplement(spark, d)
    atoms = fx.atoms(spark, d).withColumn("structure_id", F.concat(F.lit("P"), "structure_id"))
    return R.protein_page(s.select("site_id", "uniprot_id", "resno", "residue", "motif"), atoms, s).select("site_id", "uniprot_id", "resno", "known_kinases", "is_known_kinase")


@query("SELECT site_id, kinase, CASE WHEN r<=5 THEN score ELSE 0.0::DOUBLE END AS first, CASE WHEN k<=5 THEN round(1-score,2) ELSE 0.0::DOUBLE END AS second FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, kinase) AS r, row_number() OVER (PARTITION BY site_id ORDER BY round(1-score,2) DESC, kinase) AS k FROM fx_score) WHERE r<=5 OR k<=5", "fx_score")
def site_type_comparison(spark, d):
    s = fx.scores(spark, d)
    typed = s.withColumn("score_type", F.lit("first")).unionByName(s.withColumns({"score_type": F.lit("second"), "score": F.round(1 - F.col("score"), 2)}))
    return R.site_kinase_page(fx.ids(spark, d), fx.supplement(spark, d), typed, 5)["comparison"]


@query()
def similar_motif_texts(spark, d):
    """All sites of whole sequences: pairs of different motif texts of 15 letters with ten common 3-mers."""
    return P.similar_texts(fx.sites(spark, d).where("length(motif) = 15"))


@query(
    """, r(node, depth) AS (SELECT 'S1', 0 UNION SELECT s.b, r.depth+1 FROM r JOIN sym s ON s.a=r.node WHERE r.depth<6), d AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1),
    p AS (SELECT x.node, min(s.a) AS previous FROM d x JOIN sym s ON s.b=x.node JOIN d y ON y.node=s.a AND y.depth=x.depth-1 GROUP BY 1),
    w(target, node, path, depth) AS (SELECT node, node, node, depth FROM d WHERE node LIKE 'S%' UNION ALL SELECT w.target, p.previous, p.previous||','||w.path, w.depth FROM w JOIN p ON p.node=w.node)
    SELECT 'S1' AS source, target, CAST(depth AS DOUBLE) AS cost, path FROM w WHERE node='S1'""",
    "fx_inter", "fx_strong", "sym",
)
def graph_shortest_paths(spark, d):
    """From one supplier to every other, six steps at most."""
    e = fx.strong_interactions(spark, d)
    pairs = e.select(F.lit("S1").alias("source"), F.col("b").alias("target")).distinct()
    return G.shortest_paths(e, pairs, hops=6).select("source", "target", "cost", F.concat_ws(",", "path").alias("path"))


@query(
    """, rec AS (SELECT 'P'||p_partkey AS uniprot_id, CASE WHEN p_partkey%5<>0 THEN p_name||' '||p_partkey%50 END AS gene, CASE WHEN p_partkey%3<>0 THEN p_type END AS name FROM part),
    q AS (SELECT uniprot_id AS id, 'uniprot' AS id_type FROM rec UNION SELECT gene, 'gene' FROM rec WHERE gene IS NOT NULL UNION SELECT 'P'||s_suppkey||'X', 'uniprot' FROM supplier),
    f AS (SELECT id, id_type, CASE id_type WHEN 'gene' THEN (SELECT min(uniprot_id) FROM rec WHERE gene=id) ELSE (SELECT uniprot_id FROM rec WHERE uniprot_id=id) END AS uniprot_id FROM q),
    m AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, target_id, rmsd, row_number() OVER (PARTITION BY query_id, target_id ORDER BY dir, rmsd) AS k FROM (
        SELECT query_id, target_id, rmsd, 0 AS dir FROM fx_edge WHERE rmsd<=2 UNION ALL SELECT target_id, query_id, rmsd, 1 FROM fx_edge WHERE rmsd<=2)) WHERE k=1 AND rmsd>=0.01 GROUP BY 1),
    t AS (SELECT uniprot_id, count(*) AS a, count(n) AS b, CAST(sum(n) AS BIGINT) AS c FROM fx_supp LEFT JOIN m ON query_id=site_id GROUP BY 1)
    SELECT id, id_type, uniprot_id, CASE WHEN uniprot_id IS NOT NULL THEN coalesce(gene,'Unknown') END AS gene, CASE WHEN uniprot_id IS NOT NULL THEN coalesce(name,'Unknown Protein') END AS name,
        coalesce(a,0) AS n_sites, coalesce(b,0) AS n_matched_sites, coalesce(c,0) AS n_matches, CASE WHEN uniprot_id IS NULL THEN 'not found' WHEN coalesce(a,0)=0 THEN 'no sites' ELSE 'ok' END AS status
    FROM f LEFT JOIN rec USING (uniprot_id) LEFT JOIN t USING (uniprot_id)""",
    "fx_edge", "fx_score", "fx_supp",
)
def protein_analysis(spark, d):
    """Every part by accession and by gene, and accessions that nothing has."""
    p = F.col("p_partkey")
    gene = F.when(p % 5 != 0, F.concat_ws(" ", "p_name", (p % 50).cast("string")))
    records = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("P"), p).alias("uniprot_id"), gene.alias("gene"), F.when(p % 3 != 0, F.col("p_type")).alias("name"))
    unknown = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("P"), "s_suppkey", F.lit("X")).alias("id"), F.lit("uniprot").alias("id_type"))
    asked = records.select(F.col("uniprot_id").alias("id"), F.lit("uniprot").alias("id_type")).union(records.where("gene IS NOT NULL").select("gene", F.lit("gene"))).union(unknown)
    s = fx.supplement(spark, d)
    out = R.protein_analysis(asked, records, s.select("site_id", "uniprot_id"), fx.edges(spark, d), s.select("site_id", "plddt"), s.select("site_id", "motif", "residue"), 2.0)["summary"]
    return out.select("id", "id_type", "uniprot_id", "gene", "name", "n_sites", "n_matched_sites", "n_matches", "status")


@query()
def network_heatmap(spark, d):
    """The three best kinases by mean of every request and their scores at all its similar sites."""
    exact = fx.scores(spark, d).withColumn("score", F.col("score").cast("decimal(12,2)"))
    similar = E.similar_sites(fx.ids(spark, d), fx.sequence_edges(spark, d), fx.edges(spark, d))
    return S.network_heatmap(similar, exact, 3).select("query_id", "site_id", "kinase", "rank", F.col("score").cast("double").alias("score"))


register_raw(
    "network_heatmap",
    with_(
        f"{STATS}, best AS (SELECT * FROM (SELECT query_id, kinase, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m DESC, kinase) AS INT) AS rank FROM stats) WHERE rank<=3)",
        "SELECT b.query_id, n.site_id, b.kinase, b.rank, coalesce(s.score, 0.0::DOUBLE) AS score FROM best b JOIN near_sites n USING (query_id) LEFT JOIN fx_score s ON s.site_id=n.site_id AND s.kinase=b.kinase",
        "fx_edge", "fx_score",
    ),
)


@query(
    """, t AS (SELECT DISTINCT query_id, target_id AS site_id FROM fx_edge WHERE rmsd<=2), a AS (SELECT query_id, kinase, (sum(CAST(round(score*100) AS BIGINT))*20000+count(*))//(2*count(*)) AS m FROM t JOIN fx_score USING (site_id) GROUP BY 1,2),
    best AS (SELECT * FROM (SELECT query_id, kinase, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m DESC, kinase) AS INT) AS rank FROM a) WHERE rank<=3)
    SELECT b.query_id, t.site_id, b.kinase, b.rank, coalesce(s.score, 0.0::DOUBLE) AS score FROM best b JOIN t USING (query_id) LEFT JOIN fx_score s ON s.site_id=t.site_id AND s.kinase=b.kinase""",
    "fx_edge", "fx_score",
)
def mean_heatmap(spark, d):
    """The three best kinases by mean over the targets of every site, and their scores at each target."""
    exact = fx.scores(spark, d).withColumn("score", F.col("score").cast("decimal(12,2)"))
    return S.heatmap(fx.edges(spark, d).where("rmsd <= 2"), exact, 3, "mean").select("query_id", "site_id", "kinase", "rank", F.col("score").cast("double").alias("score"))
