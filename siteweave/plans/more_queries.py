"""More registered queries of the site operators: one for each operator that SQL can show, with its DuckDB twin."""

from __future__ import annotations

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
from siteweave.plans.queries import NAMED, NAMES, query, rounded
from siteweave.sources import tables as T

SITES = ("fx_score", "fx_supp")
LINKS = ("fx_edge", "fx_score", "fx_supp")


# Lookups: the requests are the sites of the score table.


@query("SELECT site_id, uniprot_id, residue, upper(motif) AS motif FROM fx_supp", *SITES)
def site_lookup(spark, d):
    return L.site_lookup(fx.supplement(spark, d).withColumn("motif", F.lower("motif")), fx.ids(spark, d)).select("site_id", "uniprot_id", "residue", "motif")


@query(", w AS (SELECT DISTINCT 'P'||l_suppkey AS uniprot_id FROM lineitem) SELECT uniprot_id, site_id, resno FROM w LEFT JOIN fx_supp USING (uniprot_id)", *SITES)
def sites_of_proteins(spark, d):
    wanted = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("P"), "l_suppkey").alias("id")).distinct()
    return L.sites_of(fx.supplement(spark, d), wanted, "uniprot_id").select("uniprot_id", "site_id", "resno")


@query("SELECT uniprot_id, string_agg(site_id, ',' ORDER BY site_id) AS site_ids FROM fx_supp GROUP BY 1", *SITES)
def grouped_sites(spark, d):
    s = fx.supplement(spark, d)
    return L.grouped_sites(s, s.select(F.col("uniprot_id").alias("id")).distinct(), "uniprot_id").select("uniprot_id", F.concat_ws(",", "site_ids").alias("site_ids"))


@query("SELECT site_id, residue, plddt FROM fx_supp WHERE residue='T'", *SITES)
def sites_by_residue(spark, d):
    return L.where_equal(fx.supplement(spark, d), "residue", "T").select("site_id", "residue", "plddt")


@query("SELECT site_id, accessibility FROM fx_supp WHERE accessibility>=80", *SITES)
def exposed_sites(spark, d):
    return L.at_least(fx.supplement(spark, d), "accessibility", 80).select("site_id", "accessibility")


@query("SELECT site_id, kinase_1 AS label, kinase_1 IS NOT NULL AND kinase_1<>'unlabeled' AS is_known FROM fx_supp", *SITES)
def known_kinase_flags(spark, d):
    return L.known_kinase(fx.supplement(spark, d).withColumnRenamed("kinase_1", "label"))


@query(
    """SELECT site_id, CASE WHEN p AND q THEN 'AKT1, PKA' WHEN p THEN 'AKT1, PKA' WHEN q THEN 'PKA' ELSE '' END AS kinases, coalesce(kinase_1, kinase_2) AS first FROM
        (SELECT *, coalesce(kinase_1 LIKE 'AKT1%', false) AS p, kinase_2 IS NOT NULL AS q FROM fx_supp)""",
    *SITES,
)
def known_kinases(spark, d):
    return fx.supplement(spark, d).select("site_id", X.known_kinases(F.col("kinase_1"), F.col("kinase_2")).alias("kinases"), X.first_kinase(F.col("kinase_1"), F.col("kinase_2")).alias("first"))


@query("SELECT site_id FROM fx_supp WHERE is_known=1 OR accessibility>50", *SITES)
def candidate_sites(spark, d):
    return fx.supplement(spark, d).where(L.candidate_gate(F.col("is_known"), F.col("accessibility"))).select("site_id")


@query(
    """, w AS (SELECT motif[1:8]||'_' AS motif FROM fx_supp WHERE plddt<60 UNION ALL SELECT motif||'x' FROM fx_supp WHERE plddt>=60 UNION ALL SELECT motif FROM fx_supp)
    SELECT count(*) AS n, count(*) FILTER (length(motif)<>10) AS bad_length, count(*) FILTER (NOT regexp_matches(motif,'^[A-Za-z]*$')) AS bad_letters,
        count(*) FILTER (upper(substr(motif,6,1)) NOT IN ('S','T','Y')) AS bad_centre, count(*) FILTER (regexp_matches(motif,'^[A-Za-z]{10}$')) AS valid FROM w""",
    *SITES,
)
def motif_validity(spark, d):
    s = fx.supplement(spark, d)
    rows = s.where("plddt < 60").select(F.concat(F.substring("motif", 1, 8), F.lit("_")).alias("motif")).unionAll(s.where("plddt >= 60").select(F.concat("motif", F.lit("x")))).unionAll(s.select("motif"))
    return L.motif_validity(rows)


@query(
    """SELECT query_id, target_id, rmsd FROM fx_edge WHERE rmsd>=0.01""", "fx_edge")
def matches_without_self(spark, d):
    return L.without_self(fx.edges(spark, d)).select("query_id", "target_id", "rmsd")


@query(
    """SELECT s.site_id, s.residue, coalesce(t.motif, s.motif) AS motif, t.plddt AS extra FROM fx_supp s LEFT JOIN (SELECT site_id, CASE WHEN resno%2=0 THEN 'NEW' END AS motif, plddt FROM fx_supp WHERE is_known=1) t USING (site_id)""",
    *SITES,
)
def overlaid_sites(spark, d):
    s = fx.supplement(spark, d)
    right = s.where("is_known = 1").select("site_id", F.when(F.col("resno") % 2 == 0, "NEW").alias("motif"), F.col("plddt").alias("extra"))
    return L.overlay(s.select("site_id", "residue", "motif"), right, "site_id").select("site_id", "residue", "motif", "extra")


@query(
    """, a AS (SELECT site_id, plddt, motif AS am FROM fx_supp WHERE residue<>'Y'), s AS (SELECT site_id, motif, is_known FROM fx_supp WHERE residue<>'S')
    SELECT site_id, plddt, is_known, coalesce(motif, am) AS motif FROM a FULL JOIN s USING (site_id)""",
    *SITES,
)
def comprehensive_sites(spark, d):
    s = fx.supplement(spark, d)
    return L.comprehensive(s.where("residue <> 'Y'").select("site_id", "plddt", "motif"), s.where("residue <> 'S'").select("site_id", "motif", "is_known"), fx.ids(spark, d)).select("site_id", "plddt", "is_known", "motif")


@query("SELECT query_id, target_id, rmsd, s.motif, s.plddt FROM (SELECT * FROM fx_edge WHERE rmsd<=2) LEFT JOIN fx_supp s ON target_id=site_id", *LINKS)
def enriched_matches(spark, d):
    s = fx.supplement(spark, d)
    return L.enrich_matches(fx.edges(spark, d).where("rmsd <= 2"), s.select("site_id", "plddt"), s.select("site_id", "motif")).select("query_id", "target_id", "rmsd", "motif", "plddt")


@query("SELECT query_id, target_id, similarity, upper(s.motif) AS motif, s.residue AS site_type, coalesce(s.is_known=1, false) AS is_known FROM (SELECT * FROM fx_edge WHERE similarity>=0.9) LEFT JOIN fx_supp s ON target_id=site_id", *LINKS)
def enriched_sequence_matches(spark, d):
    near = fx.edges(spark, d).where("similarity >= 0.9").select("query_id", "target_id", "similarity")
    return L.enrich_sequence_matches(near, fx.supplement(spark, d)).select("query_id", "target_id", "similarity", "motif", "site_type", "is_known")


@query(
    """SELECT site_id, NULL AS source_site, false AS is_target, NULL AS match_type FROM fx_supp UNION ALL SELECT target_id, query_id, true, 'structural' FROM fx_edge WHERE rmsd<=1
        UNION ALL SELECT target_id, query_id, true, 'sequence' FROM fx_edge WHERE similarity>=0.9""",
    *LINKS,
)
def combined_sites(spark, d):
    e = fx.edges(spark, d)
    return L.combined_sites(fx.supplement(spark, d), e.where("rmsd <= 1"), e.where("similarity >= 0.9"))


# Edges.


@query("SELECT query_id, target_id, split_part(target_id,'_',1) AS target_uniprot, 'S' AS target_type, CAST(split_part(target_id,'_',2) AS INT) AS target_number, 'S'||split_part(target_id,'_',2) AS target_site FROM fx_edge", "fx_edge")
def parsed_targets(spark, d):
    return E.parsed_target(fx.edges(spark, d), "S").select("query_id", "target_id", "target_uniprot", "target_type", "target_number", "target_site")


@query("SELECT query_id, target_id, rmsd FROM fx_edge WHERE rmsd<=3 AND query_id IN (SELECT site_id FROM fx_score)", "fx_edge", "fx_score")
def structural_matches_directed(spark, d):
    return E.structural_matches(fx.edges(spark, d), fx.ids(spark, d), 3.0, directed=True).select("query_id", "target_id", "rmsd")


@query(
    """SELECT query_id, target_id, similarity FROM fx_edge WHERE similarity>=0.6 AND query_id IN (SELECT site_id FROM fx_score)
        UNION ALL SELECT target_id, query_id, similarity FROM fx_edge WHERE similarity>=0.6 AND target_id IN (SELECT site_id FROM fx_score) AND query_id NOT IN (SELECT site_id FROM fx_score)""",
    "fx_edge", "fx_score",
)
def sequence_matches_credited(spark, d):
    return E.sequence_matches(fx.sequence_edges(spark, d), fx.ids(spark, d), 0.6, "id1")


@query("SELECT query_id, target_id, rmsd, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rmsd, target_id) AS rank FROM fx_edge) WHERE rank<=10", "fx_edge")
def top_structural_matches(spark, d):
    return E.top_matches(fx.edges(spark, d), 10, "rmsd", descending=False).select("query_id", "target_id", "rmsd", "rank")


@query("SELECT query_id, source, target, value FROM (SELECT query_id, query_id AS source, target_id AS target, similarity AS value FROM fx_edge)", "fx_edge")
def star_links(spark, d):
    return E.star_network(fx.edges(spark, d), "similarity")[1]


@query("SELECT DISTINCT query_id, query_id AS id, 'site' AS type FROM fx_edge UNION ALL SELECT query_id, target_id, 'match' FROM fx_edge", "fx_edge")
def star_nodes(spark, d):
    return E.star_network(fx.edges(spark, d), "similarity")[0]


NETWORK = """, own AS (SELECT DISTINCT query_id FROM fx_edge), l AS (SELECT query_id AS source, target_id AS target, rmsd AS value FROM fx_edge WHERE query_id<>target_id)"""


@query(f"{NETWORK} SELECT id, CASE WHEN id IN (SELECT query_id FROM own) THEN 'protein' ELSE 'match' END AS type FROM (SELECT source AS id FROM l UNION SELECT target FROM l)", "fx_edge")
def protein_network_nodes(spark, d):
    e = fx.edges(spark, d)
    return E.protein_network(e.select(F.col("query_id").alias("site_id"), F.lit("S").alias("residue")).distinct(), e.withColumn("target_type", F.lit("T")), "rmsd", False)[0]


@query(
    f"""{NETWORK}, n AS (SELECT id, CASE WHEN id IN (SELECT query_id FROM own) THEN 'protein' ELSE 'match' END AS type FROM (SELECT source AS id FROM l UNION SELECT target FROM l))
    SELECT id, type FROM n WHERE type='protein' OR id IN (SELECT source FROM l WHERE value<=1 UNION SELECT target FROM l WHERE value<=1)""",
    "fx_edge",
)
def filtered_network_nodes(spark, d):
    e = fx.edges(spark, d)
    nodes, links = E.protein_network(e.select(F.col("query_id").alias("site_id"), F.lit("S").alias("residue")).distinct(), e.withColumn("target_type", F.lit("T")), "rmsd", False)
    return E.filtered_network(nodes, links, 1.0, above=False)[0]


@query("SELECT split_part(s,'_',1) AS uniprot_id, string_agg(s, ',' ORDER BY s) AS site_ids, count(*) AS n FROM (SELECT query_id AS s FROM fx_edge UNION SELECT target_id FROM fx_edge) GROUP BY 1", "fx_edge")
def sites_of_edges(spark, d):
    return E.sites_of_edges(fx.edges(spark, d)).withColumn("site_ids", F.concat_ws(",", "site_ids"))


# Scores.


@query(
    """, w AS (SELECT site_id, max(score) FILTER (kinase='K0') AS K0, max(score) FILTER (kinase='K1') AS K1 FROM fx_score GROUP BY 1)
    SELECT site_id, 'K0' AS kinase, coalesce(K0, 0.0) AS score FROM w UNION ALL SELECT site_id, 'K1', coalesce(K1, 0.0) FROM w""",
    "fx_score",
)
def long_scores(spark, d):
    wide = fx.scores(spark, d).groupBy("site_id").pivot("kinase", ["K0", "K1"]).agg(F.max("score"))
    return S.to_long(wide, ["site_id"], 0.0)


@query(
    """, m AS (SELECT query_id, kinase, median(score) AS s FROM (SELECT DISTINCT query_id, target_id FROM fx_edge WHERE rmsd<=2) JOIN fx_score ON target_id=site_id GROUP BY 1,2),
    t AS (SELECT query_id, kinase, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, kinase) AS INT) AS rank FROM m QUALIFY rank<=5)
    SELECT t.query_id, t.kinase, t.rank, x.target_id AS site_id, coalesce(score, 0.0) AS score FROM t JOIN (SELECT DISTINCT query_id, target_id FROM fx_edge WHERE rmsd<=2) x USING (query_id)
        LEFT JOIN fx_score f ON f.site_id=x.target_id AND f.kinase=t.kinase""",
    "fx_edge", "fx_score",
)
def match_heatmap(spark, d):
    return S.heatmap(fx.edges(spark, d).where("rmsd <= 2"), fx.scores(spark, d), 5)


WORDS = "CASE kinase WHEN 'K0' THEN 'S/T-P-X-K/R' WHEN 'K1' THEN 'P-X-S/T-P' WHEN 'K2' THEN 'S/T-X-X-X-pS' WHEN 'K3' THEN 'S/T-X-X-E/D' WHEN 'K4' THEN 'S/T-X-K/R' WHEN 'K5' THEN 'X-E/D-E/D-X-Y-Φ-X-X' WHEN 'K6' THEN 'S/T-Q' WHEN 'K11' THEN 'P-X-S/T-P' ELSE 'Unknown' END"
SHOWN = "CASE kinase " + " ".join(f"WHEN 'K{k}' THEN '{name}'" for k, name in enumerate(NAMES)) + " END"


@query(f"SELECT site_id, {SHOWN} AS kinase, score, {WORDS} AS preferred_motif FROM fx_score", "fx_score")
def preferred_motifs(spark, d):
    return S.preferred_motif(fx.scores(spark, d).withColumn("kinase", F.expr(NAMED))).select("site_id", "kinase", "score", "preferred_motif")


@query(
    """, t AS (SELECT DISTINCT kinase FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, kinase) AS r FROM fx_score) WHERE r<=2)
    SELECT s.site_id, t.kinase, coalesce(f.score, 0.0) AS score FROM (SELECT DISTINCT site_id FROM fx_score) s CROSS JOIN t LEFT JOIN fx_score f USING (site_id, kinase)""",
    "fx_score",
)
def compared_sites(spark, d):
    return S.compare_sites(fx.scores(spark, d), 2)


@query(
    """, a AS (SELECT query_id, kinase, median(score) AS s FROM fx_edge JOIN fx_score ON target_id=site_id WHERE rmsd<=2 GROUP BY 1,2), b AS (SELECT query_id, kinase, median(score) AS q FROM fx_edge JOIN fx_score ON target_id=site_id WHERE similarity>=0.6 GROUP BY 1,2)
    SELECT query_id, kinase, round(coalesce(s,0),6) AS structural, round(coalesce(q,0),6) AS sequence, round((coalesce(s,0)+coalesce(q,0))/2,6) AS combined FROM a FULL JOIN b USING (query_id, kinase)""",
    "fx_edge", "fx_score",
)
def combined_ranking(spark, d):
    e, s = fx.edges(spark, d), fx.scores(spark, d)
    return rounded(S.combined_ranking(S.kinase_statistic(e.where("rmsd <= 2"), s), S.kinase_statistic(e.where("similarity >= 0.6"), s)).drop("rank"), "structural", "sequence", "combined")


ROUTED = """, m AS (SELECT e.*, p.residue AS t FROM fx_edge e LEFT JOIN fx_supp p ON target_id=site_id),
    u AS (SELECT query_id, t AS usual FROM (SELECT query_id, t, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, t) AS r FROM m WHERE t IS NOT NULL GROUP BY 1,2) WHERE r=1),
    f AS (SELECT *, CASE WHEN kinase IN ('K0','K1') THEN 'Y' ELSE 'ST' END AS score_class FROM fx_score),
    k AS (SELECT m.query_id, m.target_id, m.rmsd, m.similarity, coalesce(t, usual, 'S') AS target_type FROM m LEFT JOIN u USING (query_id))"""


@query(
    f"""{ROUTED} SELECT query_id, target_id, target_type, kinase, score, match_type FROM (SELECT *, 'structural' AS match_type FROM k WHERE rmsd<=1 UNION ALL SELECT *, 'sequence' FROM k WHERE similarity>=0.9)
        JOIN f ON f.site_id=target_id AND f.score_class=CASE WHEN target_type='Y' THEN 'Y' ELSE 'ST' END""",
    *LINKS,
)
def tagged_matches(spark, d):
    e = fx.edges(spark, d).join(fx.supplement(spark, d).select(F.col("site_id").alias("target_id"), F.col("residue").alias("target_type")), "target_id", "left")
    counts = e.where("target_type IS NOT NULL").groupBy("query_id", "target_type").count()
    usual = counts.groupBy("query_id").agg(F.min_by("target_type", F.struct(-F.col("count"), F.col("target_type"))).alias("usual"))
    e = e.join(usual, "query_id", "left").withColumn("target_type", F.coalesce("target_type", "usual", F.lit("S")))
    s = fx.scores(spark, d).withColumn("score_class", F.when(F.col("kinase").isin("K0", "K1"), "Y").otherwise("ST"))
    return S.tagged_matches(e.where("rmsd <= 1"), e.where("similarity >= 0.9"), s).select("query_id", "target_id", "target_type", "kinase", "score", "match_type")


@query(
    """, a AS (SELECT query_id AS site_id, count(*) AS n FROM fx_edge WHERE rmsd<=2 GROUP BY 1), b AS (SELECT query_id AS site_id, count(*) AS n FROM fx_edge WHERE similarity>=0.9 GROUP BY 1)
    SELECT site_id, coalesce(a.n,0) AS n_structural, coalesce(b.n,0) AS n_sequence FROM fx_supp LEFT JOIN a USING (site_id) LEFT JOIN b USING (site_id) WHERE coalesce(a.n,0)>0 OR coalesce(b.n,0)>0""",
    *LINKS,
)
def sites_with_matches(spark, d):
    e = fx.edges(spark, d)
    return S.sites_with_matches(fx.supplement(spark, d), e.where("rmsd <= 2"), e.where("similarity >= 0.9"))


# Motifs.


def _best(spark, d):
    return fx.sites(spark, d).select("site_id", "residue", "resno", "motif")


@query(
    """SELECT site_id, repeat('X', CAST(greatest(0, 8-resno) AS INT))||motif AS padded, CASE WHEN length(motif)>=9 THEN substr(motif, CAST(floor(length(motif)/2.0-4+0.5) AS INT), 9) END AS central,
        CASE WHEN residue IN ('S','T','Y') THEN 'sty' END AS class FROM fx_site""",
    "fx_protein", "fx_site",
)
def motif_variants(spark, d):
    m = F.col("motif")
    return _best(spark, d).select("site_id", X.standardize_at(m, F.col("resno")).alias("padded"), X.central_sql(m).alias("central"), X.residue_class(F.col("residue")).alias("class"))


SIDES = "(SELECT *, substr(motif, greatest(1, length(motif)//2+1-5), length(motif)//2+1-greatest(1, length(motif)//2+1-5))||substr(motif, length(motif)//2+2, 5) AS side FROM fx_site)"
SCALE = "(VALUES " + ", ".join(f"('{a}', CAST({v} AS DOUBLE))" for a, v in X.HYDROPATHY.items()) + ") AS h(aa, v)"


@query(
    f"""SELECT site_id, CASE WHEN length(side)>0 THEN round(length(regexp_replace(side,'[^DE]','','g'))*100.0/length(side),6) ELSE 0.0 END AS acidic,
        CASE WHEN length(side)>0 THEN round(length(regexp_replace(side,'[^KRH]','','g'))*100.0/length(side),6) ELSE 0.0 END AS basic,
        CASE WHEN length(side)>0 THEN round(length(regexp_replace(side,'[^FWY]','','g'))*100.0/length(side),6) ELSE 0.0 END AS aromatic FROM {SIDES}""",
    "fx_protein", "fx_site",
)
def flank_shares(spark, d):
    m = F.col("motif")
    return rounded(_best(spark, d).select("site_id", X.flank_percent(m, "DE").alias("acidic"), X.flank_percent(m, "KRH").alias("basic"), X.flank_percent(m, "FWY").alias("aromatic")), "acidic", "basic", "aromatic")


@query(
    """, p AS (SELECT site_id, motif, residue, CASE WHEN substr(motif,8,1)=residue THEN 7 ELSE length(motif)//2 END AS c FROM fx_site), q AS (SELECT *, substr(motif,1,c) AS b, substr(motif,c+2) AS a FROM p)
    SELECT site_id, CAST(c AS INT) AS center, length(regexp_replace(b||a,'[^STYCNQ]','','g')) AS polar_count, round(CASE WHEN length(b)>0 THEN length(regexp_replace(b,'[^DE]','','g'))*100.0/length(b) ELSE 0 END,6) AS upstream_acidic,
        round(CASE WHEN length(a)>0 THEN length(regexp_replace(a,'[^KRH]','','g'))*100.0/length(a) ELSE 0 END,6) AS downstream_basic, substr(motif, greatest(1,c-2), c+4-greatest(0,c-3)) AS narrow,
        concat_ws(',', """
    + ", ".join(f"CASE WHEN regexp_matches(motif,'{p}') THEN '{k}:'||regexp_extract(motif,'{p}') END" for k, (p, _) in X.RECOGNITION.items())
    + ") AS patterns FROM q",
    "fx_protein", "fx_site",
)
def motif_profiles(spark, d):
    p = _best(spark, d).select("site_id", X.motif_profile(F.col("motif"), F.col("residue")).alias("p"))
    shown = F.concat_ws(",", F.transform("p.patterns", lambda x: F.concat(x["name"], F.lit(":"), x["match"])))
    return p.select("site_id", "p.center", "p.polar_count", F.round("p.upstream_acidic", 6).alias("upstream_acidic"), F.round("p.downstream_basic", 6).alias("downstream_basic"), "p.narrow", shown.alias("patterns"))


CELLS = """, cells AS (SELECT gene AS query_id, unnest(range(1,16)) AS p, motif FROM fx_site WHERE length(motif)=15), letters AS (SELECT query_id, p-8 AS position, substr(motif,p,1) AS aa FROM cells)"""


def _motifs(spark, d):
    return fx.sites(spark, d).where("length(motif) = 15").select(F.col("gene").alias("query_id"), "motif")


@query(
    f"""{CELLS}, n AS (SELECT query_id, position, aa, count(*) AS k FROM letters GROUP BY 1,2,3), s AS (SELECT *, round(k*100.0/sum(k) OVER (PARTITION BY query_id, position),6) AS percent FROM n)
    SELECT query_id, CAST(position AS INT) AS position, aa, k AS "count", percent FROM s WHERE percent>=10 AND aa<>'X' AND position<>0""",
    "fx_protein", "fx_site",
)
def conserved_letters(spark, d):
    return rounded(M.conserved(_motifs(spark, d), least=10.0), "percent")


GROUPED = "CASE WHEN aa IN ('D','E') THEN 'acidic' WHEN aa IN ('K','R','H') THEN 'basic' WHEN aa IN ('S','T','Y','C','N','Q') THEN 'polar' ELSE 'nonpolar' END"


@query(
    f"""{CELLS}, n AS (SELECT query_id, CASE WHEN position<0 THEN 'N' ELSE 'C' END AS side, {GROUPED} AS "group", count(*) AS k FROM letters WHERE position<>0 GROUP BY 1,2,3)
    SELECT query_id, side, "group", k AS "count", round(k*100.0/sum(k) OVER (PARTITION BY query_id, side),6) AS percent FROM n""",
    "fx_protein", "fx_site",
)
def terminal_groups(spark, d):
    return rounded(M.terminal_groups(_motifs(spark, d)), "percent")


@query(
    f"""{CELLS}, n AS (SELECT query_id, CASE WHEN position<0 THEN 'N' ELSE 'C' END AS side, {GROUPED} AS "group", count(*) AS k FROM letters WHERE position<>0 AND abs(position)<=5 GROUP BY 1,2,3)
    SELECT query_id, side, "group", k AS "count", round(o,6) AS observed, round(o/CASE "group" WHEN 'polar' THEN 0.3::DOUBLE WHEN 'nonpolar' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END,6) AS ratio
        FROM (SELECT *, k::DOUBLE/sum(k) OVER (PARTITION BY query_id, side) AS o FROM n)""",
    "fx_protein", "fx_site",
)
def terminus_enrichment(spark, d):
    return rounded(M.terminus_enrichment(_motifs(spark, d)), "observed", "ratio")


@query("SELECT min(length(sequence)) AS shortest, max(length(sequence)) AS longest, (SELECT length(sequence) FROM fx_protein GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common FROM fx_protein", "fx_protein")
def sequence_length_stats(spark, d):
    return M.length_stats(fx.proteins(spark, d), "sequence")


LETTERS = "ARNDCQEGHILKMFPSTWYV"
# BLOSUM62 over these letters, written out so that the SQL does not lean on the code it checks.
MATRIX = """(SELECT unnest(range(0,20)) AS i, unnest([
    [4,-1,-2,-2,0,-1,-1,0,-2,-1,-1,-1,-1,-2,-1,1,0,-3,-2,0], [-1,5,0,-2,-3,1,0,-2,0,-3,-2,2,-1,-3,-2,-1,-1,-3,-2,-3],
    [-2,0,6,1,-3,0,0,0,1,-3,-3,0,-2,-3,-2,1,0,-4,-2,-3], [-2,-2,1,6,-3,0,2,-1,-1,-3,-4,-1,-3,-3,-1,0,-1,-4,-3,-3],
    [0,-3,-3,-3,9,-3,-4,-3,-3,-1,-1,-3,-1,-2,-3,-1,-1,-2,-2,-1], [-1,1,0,0,-3,5,2,-2,0,-3,-2,1,0,-3,-1,0,-1,-2,-1,-2],
    [-1,0,0,2,-4,2,5,-2,0,-3,-3,1,-2,-3,-1,0,-1,-3,-2,-2], [0,-2,0,-1,-3,-2,-2,6,-2,-4,-4,-2,-3,-3,-2,0,-2,-2,-3,-3],
    [-2,0,1,-1,-3,0,0,-2,8,-3,-3,-1,-2,-1,-2,-1,-2,-2,2,-3], [-1,-3,-3,-3,-1,-3,-3,-4,-3,4,2,-3,1,0,-3,-2,-1,-3,-1,3],
    [-1,-2,-3,-4,-1,-2,-3,-4,-3,2,4,-2,2,0,-3,-2,-1,-2,-1,1], [-1,2,0,-1,-3,1,1,-2,-1,-3,-2,5,-1,-3,-1,0,-1,-3,-2,-2],
    [-1,-1,-2,-3,-1,0,-2,-3,-2,1,2,-1,5,0,-2,-1,-1,-1,-1,1], [-2,-3,-3,-3,-2,-3,-3,-3,-1,0,0,-3,0,6,-4,-2,-2,1,3,-1],
    [-1,-2,-2,-1,-3,-1,-1,-2,-2,-3,-3,-1,-2,-4,7,-1,-1,-4,-3,-2], [1,-1,1,0,-1,0,0,0,-1,-2,-2,0,-1,-2,-1,4,1,-3,-2,-2],
    [0,-1,0,-1,-1,-1,-1,-2,-2,-1,-1,-1,-1,-2,-1,1,5,-2,-2,0], [-3,-3,-4,-4,-2,-2,-3,-2,-2,-3,-2,-3,-1,1,-4,-3,-2,11,2,-3],
    [-2,-2,-2,-3,-2,-1,-2,-3,2,-1,-1,-2,-1,3,-3,-2,-2,2,7,-1], [0,-3,-3,-3,-1,-2,-2,-3,-3,3,1,-2,1,-1,-2,-2,0,-3,-1,4]]) AS row)"""
PAIRED = f"""(SELECT query_id, target_id, a, b, sum(row[j+1]) AS total, count(*) AS n FROM (SELECT query_id, target_id, a, b, instr('{LETTERS}', substr(a,p,1))-1 AS i, instr('{LETTERS}', substr(b,p,1))-1 AS j FROM
    (SELECT DISTINCT query_id, target_id, x.motif AS a, y.motif AS b, unnest(range(1,10)) AS p FROM fx_edge JOIN fx_supp x ON x.site_id=query_id JOIN fx_supp y ON y.site_id=target_id WHERE similarity>=0.8)) JOIN {MATRIX} USING (i) GROUP BY ALL)"""


@query(f"SELECT query_id, target_id, CAST(total AS INT) AS total, round(total::DOUBLE/n,6) AS mean, round(greatest(0, least(1, (total::DOUBLE/n+20)/40)),6) AS normalized FROM {PAIRED}", *LINKS)
def motif_similarities(spark, d):
    m = fx.supplement(spark, d).select("site_id", "motif")
    pairs = fx.edges(spark, d).where("similarity >= 0.8").select("query_id", "target_id").join(m.select(F.col("site_id").alias("query_id"), F.col("motif").alias("a")), "query_id").join(m.select(F.col("site_id").alias("target_id"), F.col("motif").alias("b")), "target_id")
    mean = X.substitution_similarity(F.col("a"), F.col("b"))
    return rounded(pairs.select("query_id", "target_id", X.substitution_similarity(F.col("a"), F.col("b"), "sum").alias("total"), mean.alias("mean"), X.normalized_similarity(mean).alias("normalized")), "mean", "normalized")


@query(f"SELECT least(query_id,target_id) AS id1, greatest(query_id,target_id) AS id2, round(max(total::DOUBLE/n),6) AS score FROM {PAIRED} WHERE total::DOUBLE/n>=0.3 GROUP BY 1,2", *LINKS)
def combined_pairs(spark, d):
    m = fx.supplement(spark, d).select("site_id", "motif")
    pairs = fx.edges(spark, d).where("similarity >= 0.8").select("query_id", "target_id").join(m.select(F.col("site_id").alias("query_id"), F.col("motif").alias("motif1")), "query_id").join(m.select(F.col("site_id").alias("target_id"), F.col("motif").alias("motif2")), "target_id")
    return rounded(P.combine_pairs(pairs.select(F.least("query_id", "target_id").alias("id1"), F.greatest("query_id", "target_id").alias("id2"), "motif1", "motif2")), "score")


@query(
    """SELECT source, count(*) AS total, count(*) FILTER (score>=0.5) AS n_50, round(count(*) FILTER (score>=0.9)*100.0/count(*),6) AS pct_90 FROM (SELECT split_part(query_id,'_',2) AS source, similarity AS score FROM fx_edge) GROUP BY ROLLUP (source)""",
    "fx_edge",
)
def pair_summary(spark, d):
    rows = fx.edges(spark, d).select(F.split_part("query_id", F.lit("_"), F.lit(2)).alias("source"), F.col("similarity").alias("score"))
    return rounded(P.summary(rows).select("source", "total", "n_50", "pct_90"), "pct_90")


# Structures with all their atoms.

FULL = ("fx_residue", "fx_full")
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
OTHER = "a.structure_id=b.structure_id AND a.resno<>b.resno"
HYDROXYL = "(SELECT * FROM fx_full WHERE atom IN ('OG','OG1','OH'))"


@query(
    f"""SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, round(1.0::DOUBLE/(1.0+count(b.atom)/10.0::DOUBLE),6) AS hydroxyl_exposure, count(b.atom) FILTER (b.atom IN ('N','CA','C','O')) AS backbone_contacts FROM {HYDROXYL} a
        LEFT JOIN fx_full b ON {OTHER} AND {D2}<=16 GROUP BY 1,2,3""",
    *FULL,
)
def hydroxyl_exposures(spark, d):
    return rounded(Geo.hydroxyl_exposure(fx.whole_atoms(spark, d)), "hydroxyl_exposure")


@query(f"SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, count(b.atom) AS hydrogen_bonds FROM {HYDROXYL} a LEFT JOIN fx_full b ON {OTHER} AND b.atom[1] IN ('N','O') AND {D2}<=12.25 GROUP BY 1,2,3", *FULL)
def hydrogen_bonds(spark, d):
    return Geo.hydrogen_bonds(fx.whole_atoms(spark, d))


@query(
    f""", n AS (SELECT a.structure_id, a.chain, a.resno, b.resno AS n_resno, b.aa AS n_aa, sqrt(min({D2})) AS distance FROM fx_full a JOIN fx_full b ON {OTHER} AND a.atom='CA' AND {D2}<=100 GROUP BY 1,2,3,4,5)
    SELECT structure_id, chain, CAST(resno AS INT) AS resno, CAST(n_resno AS INT) AS n_resno, n_aa, round(distance,6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY structure_id, chain, resno ORDER BY distance, n_resno)<=10""",
    *FULL,
)
def nearest_residues(spark, d):
    return rounded(Geo.nearest_residues(fx.whole_atoms(spark, d)).drop("rank"), "distance")


@query(
    f""", n AS (SELECT DISTINCT a.structure_id, a.chain, a.resno, b.resno AS n_resno, b.aa AS n_aa FROM fx_full a JOIN fx_full b ON {OTHER} AND a.atom='CA' AND {D2}<=25)
    SELECT structure_id, chain, CAST(resno AS INT) AS resno, """
    + ", ".join(f"count(*) FILTER (contains('{v}', n_aa)) AS {k}_count" for k, v in Geo.PROPERTIES.items())
    + " FROM n GROUP BY 1,2,3",
    *FULL,
)
def contact_groups(spark, d):
    return Geo.contact_groups(fx.whole_atoms(spark, d))


@query(
    f""", own AS (SELECT structure_id, chain, resno, avg(bfactor) AS b FROM fx_full GROUP BY 1,2,3), n AS (SELECT DISTINCT a.structure_id, a.chain, a.resno, b.resno AS r FROM fx_full a JOIN fx_full b ON {OTHER} AND a.atom='CA' AND {D2}<=100),
    m AS (SELECT n.structure_id, n.chain, n.resno, avg(b) AS around FROM n JOIN own ON own.structure_id=n.structure_id AND own.resno=n.r GROUP BY 1,2,3)
    SELECT structure_id, chain, CAST(resno AS INT) AS resno, round(b,6) AS plddt, round(around,6) AS neighbour_mean, round(CASE WHEN around>0 THEN b/around END,6) AS ratio FROM own LEFT JOIN m USING (structure_id, chain, resno)""",
    *FULL,
)
def b_factor_stats(spark, d):
    return rounded(Geo.b_factor_stats(fx.whole_atoms(spark, d)), "plddt", "neighbour_mean", "ratio")


FRAME = """, f AS (SELECT structure_id, chain, resno, max(CASE WHEN atom='CA' THEN x END) AS x, max(CASE WHEN atom='CA' THEN y END) AS y, max(CASE WHEN atom='CA' THEN z END) AS z, """ + ", ".join(
    f"coalesce(max(CASE WHEN atom='CB' THEN {c} END), 2*max(CASE WHEN atom='CA' THEN {c} END)-(max(CASE WHEN atom='N' THEN {c} END)+max(CASE WHEN atom='C' THEN {c} END))/2)-max(CASE WHEN atom='CA' THEN {c} END) AS v{c}" for c in "xyz"
) + " FROM fx_full GROUP BY 1,2,3)"


@query(
    f"""{FRAME} SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, count(*) FILTER (s>0) AS hse_up, count(*) FILTER (s<=0) AS hse_down FROM
        (SELECT a.structure_id, a.chain, a.resno, (b.x-a.x)*vx+(b.y-a.y)*vy+(b.z-a.z)*vz AS s FROM f a JOIN fx_full b ON {OTHER} AND {D2}<=169) a GROUP BY 1,2,3""",
    *FULL,
)
def half_spheres(spark, d):
    return Geo.half_sphere(fx.whole_atoms(spark, d)).select("structure_id", "chain", "resno", "hse_up", "hse_down")


@query(f"SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, b.chain AS n_chain, CAST(b.resno AS INT) AS n_resno, round(sqrt({D2}),6) AS distance FROM fx_atom a JOIN fx_atom b ON a.structure_id=b.structure_id AND a.resno<b.resno", "fx_atom")
def distance_matrix(spark, d):
    return rounded(Geo.distances(fx.atoms(spark, d)), "distance")


@query(
    f"""SELECT a.structure_id, a.chain, CAST(a.resno AS INT) AS resno, round(sqrt(min({D2}) FILTER (b.aa='S')),6) AS "nearest_S", round(sqrt(min({D2}) FILTER (b.aa IN ('D','E'))),6) AS nearest_negative
        FROM fx_atom a JOIN fx_atom b ON {OTHER} GROUP BY 1,2,3""",
    "fx_atom",
)
def nearest_by_type(spark, d):
    return rounded(Geo.nearest_by_type(fx.atoms(spark, d)).select("structure_id", "chain", "resno", "nearest_S", "nearest_negative"), "nearest_S", "nearest_negative")


@query(
    f"""SELECT structure_id, chain, CAST(resno AS INT) AS resno, count(*) FILTER (aa='K') AS "count_K", count(*) FILTER (aa IN ('F','W','Y','H')) AS count_aromatic FROM
        (SELECT DISTINCT a.structure_id, a.chain, a.resno, b.resno AS r, b.aa FROM fx_atom a JOIN fx_atom b ON {OTHER} AND {D2}<=100) GROUP BY 1,2,3""",
    "fx_atom",
)
def counts_by_type(spark, d):
    return Geo.counts_by_type(fx.atoms(spark, d)).select("structure_id", "chain", "resno", "count_K", "count_aromatic")


@query(
    """SELECT structure_id, CAST(resno AS INT) AS resno, """
    + "||".join(f"coalesce({'lead' if k > 0 else 'lag'}(aa,{abs(k)}) OVER w,'X')" if k else "aa" for k in range(-7, 8))
    + " AS motif FROM fx_atom WINDOW w AS (PARTITION BY structure_id ORDER BY resno)",
    "fx_atom",
)
def residue_motifs(spark, d):
    return Geo.residue_motifs(fx.atoms(spark, d)).select("structure_id", "resno", "motif")


# Graphs and reports.

GRAPH = ("fx_inter", "fx_strong", "sym")


@query("SELECT a, b, confidence FROM fx_strong WHERE a IN (SELECT a FROM fx_strong WHERE confidence>=1) AND b IN (SELECT b FROM fx_strong WHERE confidence>=1)", "fx_inter", "fx_strong")
def induced_edges(spark, d):
    e = fx.strong_interactions(spark, d)
    sure = e.where("confidence >= 1")
    return G.subnetwork(e, sure.select(F.col("a").alias("id")).union(sure.select("b")).distinct())


@query(
    """, w AS (SELECT DISTINCT a FROM sym WHERE a LIKE 'S%') SELECT DISTINCT p.a AS source, q.a AS target, p.b AS node FROM sym p JOIN sym q ON p.b=q.b AND p.a<q.a WHERE p.a IN (SELECT a FROM w) AND q.a IN (SELECT a FROM w) AND p.b NOT IN (SELECT a FROM w)""",
    *GRAPH,
)
def supplier_bridges(spark, d):
    e = fx.strong_interactions(spark, d)
    return G.bridges(e, e.select(F.col("b").alias("id")).distinct()).select("source", "target", "node")


@query("SELECT site_id, residue, resno, uniprot_id FROM fx_supp ORDER BY uniprot_id, resno", *SITES)
def ordered_sites(spark, d):
    return L.in_order(fx.supplement(spark, d)).select("site_id", "residue", "resno", "uniprot_id")


@query("SELECT count(*) AS n FROM fx_supp", *SITES)
def verified_rows(spark, d):
    return T.row_counts({"supplement": fx.supplement(spark, d)}).select("n")


@query(
    """, t AS (SELECT site_id, kinase, score, CAST(row_number() OVER (PARTITION BY site_id ORDER BY score DESC, kinase) AS INT) AS rank FROM fx_score QUALIFY rank<=10)
    SELECT site_id, kinase, score, rank FROM t""",
    "fx_score",
)
def site_kinases(spark, d):
    return R.site_kinases(fx.scores(spark, d))[0]
