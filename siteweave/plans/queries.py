"""Registered queries of the site operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions import motif as X
from siteweave.operators import edges as E
from siteweave.operators import geometry as Geo
from siteweave.operators import graph as G
from siteweave.operators import lookup as L
from siteweave.operators import motif_stats as M
from siteweave.operators import pairs as P
from siteweave.operators import scores as S
from siteweave.plans import fixtures as fx
from siteweave.plans import reports as R
from siteweave.plans.fixtures import sql
from siteweave.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None, *names: str):
    def register(f):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLE_SQL[f.__name__] = sql(body, *names) if names else body
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


SIMILAR = """near_sites AS (SELECT DISTINCT * FROM (
    SELECT DISTINCT site_id AS query_id, site_id FROM fx_score
    UNION ALL SELECT query_id, target_id FROM fx_edge WHERE similarity>=0.6 AND query_id IN (SELECT site_id FROM fx_score)
    UNION ALL SELECT target_id, query_id FROM fx_edge WHERE similarity>=0.6 AND target_id IN (SELECT site_id FROM fx_score)
    UNION ALL SELECT query_id, target_id FROM fx_edge WHERE rmsd<=3.0 AND query_id IN (SELECT site_id FROM fx_score)))"""
#: The mean to six digits, halves up, in whole numbers.
STATS = f"""{SIMILAR}, stats AS (SELECT query_id, kinase, ((sum(CAST(round(score*100) AS BIGINT))*20000+count(*))//(2*count(*)))/1000000.0::DOUBLE AS m, median(score) AS md, max(score) AS mx, min(score) AS mn, count(*) AS n
    FROM near_sites JOIN fx_score USING (site_id) WHERE score>0 GROUP BY 1,2 HAVING count(*)>=2)"""


def with_(ctes: str, body: str, *names: str) -> str:
    head = sql("", *names)
    return f"{head}, {ctes} {body}"


def register_raw(name: str, text: str) -> None:
    ORACLE_SQL[name] = text


@query()
def network_kinases(spark: SparkSession, d: str) -> DataFrame:
    out = R.network_kinases(fx.ids(spark, d), fx.sequence_edges(spark, d), fx.edges(spark, d), fx.scores(spark, d))
    return rounded(out, "mean_score", "median_score", "score_range").select("query_id", "kinase", "mean_score", "median_score", "max_score", "min_score", "score_range", "sample_size")


# ranks of equal means may differ in the last bits between engines, so whole statistics are compared, not the cut
@query()
def network_statistics(spark: SparkSession, d: str) -> DataFrame:
    similar = E.similar_sites(fx.ids(spark, d), fx.sequence_edges(spark, d), fx.edges(spark, d))
    tenths = fx.scores(spark, d).withColumn("score", F.col("score").cast("decimal(12,2)"))  # means of decimals are rounded exactly
    out = S.network_statistics(similar, tenths, with_scores=False)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("mean_score", "max_score", "min_score", "score_range")})
    return rounded(out, "mean_score", "median_score", "score_range").select("query_id", "kinase", "mean_score", "median_score", "max_score", "min_score", "score_range", "sample_size")


register_raw("network_statistics", with_(STATS, "SELECT query_id, kinase, round(m,6) AS mean_score, round(md,6) AS median_score, mx AS max_score, mn AS min_score, round(mx-mn,6) AS score_range, n AS sample_size FROM stats", "fx_edge", "fx_score"))


@query()
def similar_sites(spark, d):
    return E.similar_sites(fx.ids(spark, d), fx.sequence_edges(spark, d), fx.edges(spark, d))


register_raw("similar_sites", with_(SIMILAR, "SELECT * FROM near_sites", "fx_edge", "fx_score"))


@query(
    """SELECT query_id, target_id, rmsd FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target_id ORDER BY dir, rmsd) AS n FROM (
        SELECT query_id, target_id, rmsd, 0 AS dir FROM fx_edge WHERE rmsd<=5 UNION ALL SELECT target_id, query_id, rmsd, 1 FROM fx_edge WHERE rmsd<=5)
        WHERE query_id IN (SELECT site_id FROM fx_score)) WHERE n=1""",
    "fx_edge", "fx_score",
)
def structural_matches(spark, d):
    return E.structural_matches(fx.edges(spark, d), fx.ids(spark, d)).select("query_id", "target_id", "rmsd")


@query("SELECT query_id, target_id, rmsd FROM fx_edge WHERE rmsd<=2 AND target_id IN (SELECT site_id FROM fx_score)", "fx_edge", "fx_score")
def structural_matches_by_target(spark, d):
    return E.structural_matches_by_target(fx.edges(spark, d), fx.ids(spark, d), 2.0).select("query_id", "target_id", "rmsd")


SEQ = """(SELECT query_id, target_id, similarity FROM fx_edge WHERE similarity>=0.4 AND query_id IN (SELECT site_id FROM fx_score)
    UNION ALL SELECT target_id, query_id, similarity FROM fx_edge WHERE similarity>=0.4 AND target_id IN (SELECT site_id FROM fx_score))"""


@query(f"SELECT query_id, target_id, similarity FROM {SEQ}", "fx_edge", "fx_score")
def sequence_matches(spark, d):
    return E.sequence_matches(fx.sequence_edges(spark, d), fx.ids(spark, d))


@query(
    f"""SELECT query_id, target_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, target_id) AS rank FROM
        (SELECT query_id, target_id, max(similarity) AS similarity FROM {SEQ} GROUP BY 1,2)) WHERE rank<=5""",
    "fx_edge", "fx_score",
)
def top_sequence_matches(spark, d):
    found = E.sequence_matches(fx.sequence_edges(spark, d), fx.ids(spark, d)).groupBy("query_id", "target_id").agg(F.max("similarity").alias("similarity"))
    return E.top_matches(found, 5)


@query("SELECT query_id, kinase, round(median(score),6) AS score FROM fx_edge JOIN fx_score ON target_id=site_id WHERE rmsd<=5 GROUP BY 1,2", "fx_edge", "fx_score")
def match_kinase_medians(spark, d):
    return rounded(S.kinase_statistic(fx.edges(spark, d).where("rmsd <= 5"), fx.scores(spark, d)), "score")


@query("SELECT site_id, kinase, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, kinase) AS rank FROM fx_score) WHERE rank<=3", "fx_score")
def top_kinases(spark, d):
    return S.top_kinases(fx.scores(spark, d), 3)


@query("SELECT site_id, kinase, score, round((rank() OVER (PARTITION BY kinase ORDER BY score))::DOUBLE / count(*) OVER (PARTITION BY kinase), 6) AS percentile FROM fx_score", "fx_score")
def score_percentiles(spark, d):
    return rounded(S.percentiles(fx.scores(spark, d)), "percentile")


NAMES = ["CDK1", "ERK2", "GSK3B", "CK2A1", "PKCA", "LCK", "ATM", "HCK", "YES1", "CDK3", "PRKCA", "p38a", "AURKB"]
NAMED = "CASE kinase " + " ".join(f"WHEN 'K{k}' THEN '{name}'" for k, name in enumerate(NAMES)) + " END"


@query(
    """SELECT site_id, CASE kinase WHEN 'K0' THEN 'CDK' WHEN 'K1' THEN 'MAPK' WHEN 'K2' THEN 'GSK' WHEN 'K3' THEN 'CK' WHEN 'K4' THEN 'PKC' WHEN 'K5' THEN 'SRC' WHEN 'K6' THEN 'ATM/ATR'
        WHEN 'K7' THEN 'SRC' WHEN 'K8' THEN 'SRC' WHEN 'K12' THEN 'AURORA' ELSE 'Other' END AS family, round(sum(score),6) AS score FROM fx_score GROUP BY 1,2""",
    "fx_score",
)
def kinase_families(spark, d):
    return rounded(S.family_totals(fx.scores(spark, d).withColumn("kinase", F.expr(NAMED))), "score")


@query(
    """, sites AS (SELECT DISTINCT site_id, split_part(site_id,'_',1) AS uniprot_id FROM fx_score), med AS (SELECT uniprot_id, kinase, median(score) AS score FROM sites JOIN fx_score USING (site_id) GROUP BY 1,2)
    SELECT uniprot_id, kinase, round(score,6) AS score, round((SELECT sum(m2.score) FROM med m2 WHERE m2.kinase=med.kinase)/(SELECT count(DISTINCT uniprot_id) FROM sites),6) AS mean_score FROM med""",
    "fx_score",
)
def protein_heatmap(spark, d):
    sites = fx.scores(spark, d).select("site_id", X.uniprot_of(F.col("site_id")).alias("uniprot_id")).distinct()
    return rounded(S.protein_heatmap(sites, fx.scores(spark, d), 20), "score", "mean_score")


@query("SELECT site_id, uniprot_id, gene, residue, CAST(resno AS INT) AS resno, motif FROM fx_site", "fx_protein", "fx_site")
def phosphosites(spark, d):
    return fx.sites(spark, d)


@query(
    """SELECT site_id, lpad(right(b, least(7,length(b))),7,'X')||c||rpad(left(a,7),7,'X') AS standard, CASE WHEN length(motif)>=9 THEN substr(motif, length(motif)//2+1-4, 9) END AS central,
        round(length(regexp_replace(motif,'[^DE]','','g'))*100.0/length(motif),6) AS acidic FROM
        (SELECT *, substr(motif,1,length(motif)//2) AS b, substr(motif,length(motif)//2+1,1) AS c, substr(motif,length(motif)//2+2) AS a FROM fx_site)""",
    "fx_protein", "fx_site",
)
def motif_forms(spark, d):
    m = F.col("motif")
    return rounded(fx.sites(spark, d).select("site_id", X.standardize(m).alias("standard"), X.central(m).alias("central"), X.group_percent(m, "DE").alias("acidic")), "acidic")


CELLS = """, cells AS (SELECT gene AS query_id, p-8 AS position, substr(motif,p,1) AS aa FROM (SELECT gene, motif, unnest(range(1,16)) AS p FROM fx_site WHERE length(motif)=15)),
    counts AS (SELECT query_id, position, aa, count(*) AS n FROM cells GROUP BY 1,2,3)"""


def _motifs(spark, d):
    return fx.sites(spark, d).where("length(motif) = 15").select(F.col("gene").alias("query_id"), "motif")


@query(f'{CELLS} SELECT query_id, CAST(position AS INT) AS position, aa, n AS "count", round(n*100.0/sum(n) OVER (PARTITION BY query_id, position),6) AS percent FROM counts', "fx_protein", "fx_site")
def motif_frequencies(spark, d):
    return rounded(M.frequencies(_motifs(spark, d)), "percent")


@query(
    f"""{CELLS} SELECT query_id, string_agg(aa,'' ORDER BY position) AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY query_id, position ORDER BY (aa='X')::INT, n DESC, aa) AS r FROM counts) WHERE r=1 GROUP BY 1""",
    "fx_protein", "fx_site",
)
def motif_consensus(spark, d):
    return M.consensus(_motifs(spark, d))


BACK = "(VALUES " + ", ".join(f"('{a}', CAST({v} AS DOUBLE))" for a, v in X.BACKGROUND.items()) + ") AS bg(aa, e)"


@query(
    f"""{CELLS} SELECT query_id, CAST(position AS INT) AS position, aa, n AS "count", round(o,6) AS observed, e AS expected, round(o/e,6) AS ratio FROM
        (SELECT *, n::DOUBLE/sum(n) OVER (PARTITION BY query_id, position) AS o FROM counts WHERE position<>0 AND aa<>'X') JOIN {BACK} USING (aa)""",
    "fx_protein", "fx_site",
)
def motif_enrichment(spark, d):
    return rounded(M.enrichment(_motifs(spark, d)), "observed", "ratio")


@query('SELECT length(sequence) AS length, count(*) AS "count" FROM fx_protein GROUP BY 1', "fx_protein")
def sequence_lengths(spark, d):
    return M.length_distribution(fx.proteins(spark, d), "sequence")


def _firsts(spark, d):
    return fx.first_motifs(spark, d)


GRAMS = """, g AS (SELECT * FROM (SELECT DISTINCT id, motif, substr(motif,p,3) AS gram FROM (SELECT id, motif, unnest(range(1,14)) AS p FROM fx_motif)) WHERE gram NOT LIKE '%X%'),
    p AS (SELECT a.id AS id1, b.id AS id2, any_value(a.motif) AS m1, any_value(b.motif) AS m2, CAST(count(*) AS INT) AS matching FROM g a JOIN g b ON a.gram=b.gram AND a.id<b.id GROUP BY 1,2 HAVING count(*)>=3)"""
SHARED = "len([a for a in list_intersect(list_distinct(string_split(m1,'')), list_distinct(string_split(m2,''))) if a<>'X'])>=3"


@query()
def ngram_pairs(spark, d):
    """The motifs of the proteins' first tyrosines against each other: three shared 3-mers and letters."""
    return P.ngram_pairs(_firsts(spark, d)).select("id1", "id2", "matching")


@query()
def ngram_pairs_plain(spark, d):
    """The same without the condition on shared letters."""
    return P.ngram_pairs(_firsts(spark, d), require_shared_aa=False).select("id1", "id2", "matching")


register_raw("ngram_pairs", sql(f"{GRAMS} SELECT id1, id2, matching FROM p WHERE {SHARED}", "fx_protein", "fx_site", "fx_motif"))
register_raw("ngram_pairs_plain", sql(f"{GRAMS} SELECT id1, id2, matching FROM p", "fx_protein", "fx_site", "fx_motif"))


@query(
    """, k AS (SELECT DISTINCT aa FROM (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY','')) AS aa) WHERE aa<>''),
    w AS (SELECT 'K'||k AS kinase, p AS position, aa, (2 + (k*7 + (p+5)*3 + ascii(aa)) % 11)::DOUBLE/4 AS weight FROM (SELECT unnest(range(0,13)) AS k), (SELECT unnest([-5,-4,-3,-2,-1,1,2,3,4]) AS p), k),
    m AS (SELECT DISTINCT substr(motif,3,10) AS motif FROM fx_site WHERE length(motif)=15),
    c AS (SELECT motif, p-6 AS position, substr(motif,p,1) AS aa FROM (SELECT motif, unnest(range(1,11)) AS p FROM m))
    SELECT motif, kinase, product(weight) AS score FROM c JOIN w USING (position, aa) GROUP BY 1,2""",
    "fx_protein", "fx_site",
)
def pssm_scores(spark, d):
    ten = fx.sites(spark, d).where("length(motif) = 15").select(F.substring("motif", 3, 10).alias("motif"))
    k = spark.range(13).select(F.col("id").alias("k"))
    cells = k.select("k", F.explode(F.array(*[F.lit(p) for p in (-5, -4, -3, -2, -1, 1, 2, 3, 4)])).alias("position")).select("*", F.explode(F.array(*map(F.lit, X.AMINO))).alias("aa"))
    weight = (2 + F.pmod(F.col("k") * 7 + (F.col("position") + 5) * 3 + F.ascii("aa"), F.lit(11))) / 4.0  # products of quarters are exact in any order
    pssm = cells.select(F.concat(F.lit("K"), "k").alias("kinase"), "position", "aa", weight.alias("weight"))
    return S.pssm_scores(ten, pssm)


NEAR = "fx_atom a JOIN fx_atom b ON a.structure_id=b.structure_id AND a.resno<>b.resno AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


@query(
    f"""SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, count(n.r) AS n_neighbours, round(greatest(0,least(100,(30-count(n.r))/30*100.0)),6) AS surface_accessibility FROM fx_atom a
        LEFT JOIN (SELECT a.structure_id AS s, a.resno AS q, b.resno AS r FROM {NEAR}<=100) n ON a.structure_id=n.s AND a.resno=n.q GROUP BY 1,2,3""",
    "fx_atom",
)
def residue_neighbours(spark, d):
    return rounded(Geo.neighbour_counts(fx.atoms(spark, d)), "surface_accessibility")


@query(f"SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, b.chain AS n_chain, CAST(b.resno AS INT) AS n_resno, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)),6) AS distance FROM {NEAR}<=64 WHERE a.resno<b.resno", "fx_atom")
def contact_map(spark, d):
    return rounded(Geo.contacts(fx.atoms(spark, d)), "distance")


@query(
    """SELECT structure_id, chain, CAST(resno AS INT) AS resno, round(bfactor,6) AS plddt, round(avg(CASE WHEN bfactor>0 THEN bfactor END) OVER (PARTITION BY structure_id, chain ORDER BY resno ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING),6) AS motif_plddt FROM fx_atom""",
    "fx_atom",
)
def motif_confidence(spark, d):
    return rounded(Geo.motif_plddt(Geo.residue_plddt(fx.atoms(spark, d))), "plddt", "motif_plddt")


@query(f"SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, count(*) FILTER (b.aa IN ('D','E')) AS negative_count, count(*) FILTER (b.aa IN ('K','R','H')) AS positive_count FROM {NEAR}<=100 GROUP BY 1,2,3", "fx_atom")
def pocket_charges(spark, d):
    return Geo.pocket(fx.atoms(spark, d)).select("structure_id", "chain", "resno", "negative_count", "positive_count")


@query("SELECT a AS node, count(*) AS degree FROM sym GROUP BY 1", "fx_inter", "fx_strong", "sym")
def graph_degrees(spark, d):
    return G.degrees(fx.strong_interactions(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (confidence>=0.9) AS high, count(*) FILTER (confidence>=0.7 AND confidence<0.9) AS medium, count(*) FILTER (confidence<0.7) AS low FROM fx_inter", "fx_inter")
def confidence_bands(spark, d):
    return G.confidence_bands(fx.interactions(spark, d))


@query(
    """, r(node, depth) AS (SELECT 'S1', 0 UNION SELECT s.b, r.depth+1 FROM r JOIN sym s ON s.a=r.node WHERE r.depth<3) SELECT 'S1' AS source, node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""",
    "fx_inter", "fx_strong", "sym",
)
def graph_depths(spark, d):
    return G.bfs(fx.strong_interactions(spark, d), spark.createDataFrame([("S1",)], "source string"), 3)


@query(
    """, w AS (SELECT DISTINCT a FROM sym WHERE a LIKE 'C%') SELECT b AS node, count(*) AS n FROM sym WHERE a IN (SELECT a FROM w) AND b NOT IN (SELECT a FROM w) GROUP BY 1 HAVING count(*)>1""",
    "fx_inter", "fx_strong", "sym",
)
def common_interactors(spark, d):
    e = fx.strong_interactions(spark, d)
    listed = e.select(F.col("a").alias("id")).distinct()
    return G.common_interactors(e, listed).select("node", "n")


@query(
    """, r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM sym UNION (SELECT s.b, min(r.component) FROM r JOIN sym s ON s.a=r.node JOIN recurring.r o ON o.node=s.b WHERE r.component<o.component GROUP BY s.b)) SELECT node, component FROM r""",
    "fx_inter", "fx_strong", "sym",
)
def graph_components(spark, d):
    return G.components(fx.strong_interactions(spark, d))


@query()
def graph_pagerank(spark, d):
    return rounded(G.pagerank(fx.strong_interactions(spark, d)), "rank")


@query()
def graph_modules(spark, d):
    return G.modules(fx.strong_interactions(spark, d))


@query(
    """, t AS (SELECT DISTINCT target_id AS a FROM fx_edge WHERE rmsd<=1) SELECT least(query_id,target_id) AS a, greatest(query_id,target_id) AS b, max(similarity) AS weight FROM fx_edge
    WHERE similarity>=0.9 AND query_id<>target_id AND query_id IN (SELECT a FROM t) AND target_id IN (SELECT a FROM t) GROUP BY 1,2""",
    "fx_edge",
)
def two_hop_links(spark, d):
    e = fx.edges(spark, d)
    near = e.select(F.col("query_id").alias("a"), F.col("target_id").alias("b"), "similarity")
    return E.connected_matches(e.where("rmsd <= 1"), near, "similarity", 0.9)[1]


@query("SELECT * FROM (SELECT least(query_id,target_id) AS a, greatest(query_id,target_id) AS b, max(similarity) AS value FROM fx_edge WHERE similarity>0 GROUP BY 1,2)", "fx_edge")
def protein_network_links(spark, d):
    e = fx.edges(spark, d)
    sites = e.select(F.col("query_id").alias("site_id"), F.lit("S").alias("residue")).distinct()
    _, links = E.protein_network(sites, e.withColumn("target_type", F.lit("S")), "similarity", True)
    return links.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "value")


@query("SELECT uniprot_id, gene, count(*) AS n_sites, count(*) FILTER (residue='Y') AS n_tyrosine FROM fx_site GROUP BY 1,2", "fx_protein", "fx_site")
def protein_sites(spark, d):
    return fx.sites(spark, d).groupBy("uniprot_id", "gene").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("residue") == "Y").alias("n_tyrosine"))


@query("SELECT site_id, score FROM fx_score WHERE kinase='K3' AND score>=0.9", "fx_score")
def high_scores(spark, d):
    return L.at_least(fx.scores(spark, d).where("kinase = 'K3'").select("site_id", "score"), "score", 0.9)


@query(
    """, h AS (SELECT DISTINCT site_id FROM fx_score), q AS (SELECT DISTINCT query_id, target_id FROM fx_edge WHERE rmsd<=3),
    s AS (SELECT DISTINCT query_id, target_id FROM (SELECT query_id, target_id FROM fx_edge WHERE similarity>=0.8 UNION ALL SELECT target_id, query_id FROM fx_edge WHERE similarity>=0.8) WHERE query_id IN (SELECT site_id FROM h)),
    a AS (SELECT query_id, count(*) AS n, count(site_id) AS k FROM q LEFT JOIN h ON target_id=site_id GROUP BY 1), b AS (SELECT query_id, count(*) AS n, count(site_id) AS k FROM s LEFT JOIN h ON target_id=site_id GROUP BY 1)
    SELECT query_id, coalesce(a.n,0) AS structural_matched, coalesce(a.k,0) AS structural_processed, coalesce(b.n,0) AS sequence_matched, coalesce(b.k,0) AS sequence_processed FROM a FULL JOIN b USING (query_id)""",
    "fx_edge", "fx_score",
)
def match_report(spark, d):
    close = E.parsed_target(fx.edges(spark, d).where("rmsd <= 3"), "S").select("query_id", "target_id", "target_type")
    near = E.parsed_target(E.sequence_matches(fx.sequence_edges(spark, d), fx.ids(spark, d), 0.8), "S").select("query_id", "target_id", "target_type")
    scores = fx.scores(spark, d).withColumn("score_class", F.lit("ST"))
    return S.match_report(close, near, scores).select("query_id", "structural_matched", "structural_processed", "sequence_matched", "sequence_processed")


@query(
    f"""SELECT count(*) AS n, round(avg(similarity),6) AS mean, min(similarity) AS least, max(similarity) AS most,
        {", ".join(f"round(quantile_cont(similarity, {p}),6) AS p{round(p * 100)}" for p in P.POINTS)} FROM fx_edge""",
    "fx_edge",
)
def score_distribution(spark, d):
    facts, _ = P.distribution(fx.edges(spark, d).select(F.col("similarity").alias("score")))
    at = [F.get("percentiles", F.lit(k)).alias(f"p{round(p * 100)}") for k, p in enumerate(P.POINTS)]
    return rounded(facts.select("n", "mean", "least", "most", *at), "mean", *[f"p{round(p * 100)}" for p in P.POINTS])


@query("SELECT 'edges' AS \"table\", (SELECT count(*) FROM fx_edge) AS n UNION ALL SELECT 'scores', (SELECT count(*) FROM fx_score)", "fx_edge", "fx_score")
def table_counts(spark, d):
    return T.row_counts({"edges": fx.edges(spark, d), "scores": fx.scores(spark, d)})


@query()
def residue_features(spark, d):
    return Geo.residue_features(fx.atoms(spark, d))


@query()
def lsh_pairs(spark, d):
    return P.lsh_pairs(_firsts(spark, d))


@query()
def protein_table(spark, d):
    return R.protein_table(fx.sites(spark, d))
