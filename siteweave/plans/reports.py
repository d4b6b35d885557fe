"""Served analyses: each takes a table of requests, so that one job answers many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.functions.motif import flank_percent, hydrophobicity, known_kinases
from siteweave.operators import edges as E
from siteweave.operators import geometry as Geo
from siteweave.operators import graph as G
from siteweave.operators import lookup as L
from siteweave.operators import motif_stats as M
from siteweave.operators import scores as S


def network_kinases(ids: DataFrame, sequence: DataFrame, structural: DataFrame, scores: DataFrame, n: int = 10, least: float = 0.6, rmsd: float = 3.0) -> DataFrame:
    """Top kinases by mean score over each request's similar sites."""
    similar = E.similar_sites(ids, sequence, structural, least, rmsd)
    return S.top_kinases(S.network_statistics(similar, scores, with_scores=False), n, "query_id", "mean_score")


def network_kinase_report(requests: DataFrame, sequence: DataFrame, structural: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """Network kinases as served: ``requests(id, top_n, similarity, rmsd)``, a row a site with its own bounds; ask again with others.

    Top kinases by mean, the heatmap of them over all similar sites, family totals of all
    means, and how many sites are similar.
    """
    asked = requests.select(F.col("id").alias("query_id"), "top_n")
    similar = E.similar_sites_by_request(requests, sequence, structural)
    means = S.network_statistics(similar, scores, with_scores=False)
    order = W.partitionBy("query_id").orderBy(F.desc("mean_score"), "kinase")
    top = means.join(asked, "query_id").withColumn("rank", F.row_number().over(order)).where("rank <= top_n").drop("top_n")
    grid = top.select("query_id", "kinase", "rank").join(similar, "query_id").join(scores, ["site_id", "kinase"], "left")
    families = S.family_totals(means.select("query_id", "kinase", F.col("mean_score").alias("score")), "query_id")
    counts = similar.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return {"top_kinases": top, "heatmap": grid.withColumn("score", F.coalesce("score", F.lit(0.0))), "families": families, "counts": counts}


def protein_page(sites: DataFrame, atoms: DataFrame, supplement: DataFrame) -> DataFrame:
    """The protein page whole: ``protein_table`` with each site's confidence and that of its motif, its neighbours and
    accessibility by the structure, and its known kinases. ``atoms.structure_id`` is the protein; sites without structure keep nulls.
    """
    place = {"structure_id": "uniprot_id"}
    confidence = Geo.motif_plddt(Geo.residue_plddt(atoms)).withColumnsRenamed(place | {"plddt": "site_plddt"}).drop("chain")
    around = Geo.neighbour_counts(atoms).withColumnsRenamed(place | {"n_neighbours": "nearby_count"}).drop("chain")
    known = supplement.select("site_id", known_kinases(*[F.col(c) for c in supplement.columns if c.lower().startswith("kinase_")]).alias("known_kinases"))
    out = protein_table(sites).join(confidence, ["uniprot_id", "resno"], "left").join(around, ["uniprot_id", "resno"], "left")
    return out.join(known, "site_id", "left").withColumn("is_known_kinase", F.coalesce(F.col("known_kinases") != "", F.lit(False)))


def protein_table(sites: DataFrame, supplement: DataFrame | None = None) -> DataFrame:
    """The protein page: a row a site with flank composition and hydropathy, supplement over it."""
    m = F.col("motif")
    out = sites.withColumns({"acidic_percent": flank_percent(m, "DE"), "basic_percent": flank_percent(m, "KRH"), "aromatic_percent": flank_percent(m, "FWY"), "hydrophobicity": hydrophobicity(m)})
    return L.overlay(out, supplement, "site_id") if supplement is not None else out


def structural_report(sites: DataFrame, edges: DataFrame, annotations: DataFrame, supplement: DataFrame, rmsd: float = 5.0) -> DataFrame:
    """Sites of proteins with their enriched structural matches."""
    found = L.without_self(E.structural_matches(edges, sites.select(F.col("site_id").alias("id")), rmsd))
    return L.enrich_matches(E.parsed_target(found, "S"), annotations, supplement)


def sequence_report(ids: DataFrame, edges: DataFrame, supplement: DataFrame, n: int = 200, least: float = 0.4) -> DataFrame:
    """Best sequence matches with motif and known flag."""
    return L.enrich_sequence_matches(E.top_matches(E.parsed_target(E.sequence_matches(edges, ids, least), None), n), supplement)


def conservation_report(matches: DataFrame, n: int = 20) -> dict[str, DataFrame]:
    """Frequencies, consensus and conserved letters of ``matches(query_id, rank, target_id, motif)``, with the rows of their alignment."""
    return {"frequencies": M.frequencies(matches), "consensus": M.consensus(matches), "conserved": M.conserved(matches), "alignment": M.alignment(matches, n)}


def phosphosite_report(sites: DataFrame, supplement: DataFrame, annotations: DataFrame, structural: DataFrame, sequence: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """The protein report: sites, both kinds of matches, combined sites and kinase counts, lazily."""
    ids = sites.select(F.col("site_id").alias("id"))
    close = structural_report(sites, structural, annotations, supplement)
    near = L.without_tyrosine(sequence_report(ids, sequence, supplement).withColumn("target_site", F.coalesce("target_site", F.lit(""))))
    return {"sites": L.overlay(sites, supplement, "site_id"), "structural": close, "sequence": near, "combined": L.combined_sites(sites, close, near), "kinases": S.match_report(close, near, scores)}


def protein_analysis(requests: DataFrame, records: DataFrame, sites: DataFrame, edges: DataFrame, annotations: DataFrame, supplement: DataFrame, rmsd: float = 5.0) -> dict[str, DataFrame]:
    """Proteins asked for by accession or gene: what they are, their sites, the enriched matches of every site, and a roll-up.

    ``requests(id, id_type)``, ``id_type`` "uniprot" or "gene" in any case; ``records(uniprot_id, gene,
    name)``; ``sites(site_id, uniprot_id)``. A gene is sought in any case and stands for the smallest accession that
    has it. A missing gene or name reads "Unknown" and "Unknown Protein". A request that
    finds no protein keeps a row of the roll-up with status "not found"; one whose protein has no
    sites reads "no sites". Requests that repeat count once; those without an id or of another type are not found.
    """
    asked = requests.select("id", F.lower("id_type").alias("id_type")).distinct()
    described = records.groupBy("uniprot_id").agg(F.min(F.struct("gene", "name")).alias("r")).select("uniprot_id", "r.gene", "r.name")
    by_gene = described.where("gene IS NOT NULL").groupBy(F.upper("gene").alias("key")).agg(F.min("uniprot_id").alias("uniprot_id")).withColumn("id_type", F.lit("gene"))
    known = by_gene.unionByName(described.select(F.upper("uniprot_id").alias("key"), "uniprot_id", F.lit("uniprot").alias("id_type")))
    found = asked.withColumn("key", F.upper("id")).join(known, ["key", "id_type"], "left").drop("key")
    info = found.join(described, "uniprot_id", "left").select("id", "id_type", "uniprot_id", F.when(F.col("uniprot_id").isNotNull(), F.coalesce("gene", F.lit("Unknown"))).alias("gene"), F.when(F.col("uniprot_id").isNotNull(), F.coalesce("name", F.lit("Unknown Protein"))).alias("name"))
    wanted = info.where("uniprot_id IS NOT NULL").select("uniprot_id").distinct()
    own = sites.join(wanted, "uniprot_id", "left_semi")
    matches = structural_report(own, edges, annotations, supplement, rmsd)
    a_site = matches.groupBy(F.col("query_id").alias("site_id")).agg(F.count(F.lit(1)).alias("n"))
    totals = own.select("uniprot_id", "site_id").distinct().join(a_site, "site_id", "left").groupBy("uniprot_id").agg(F.count(F.lit(1)).alias("n_sites"), F.count("n").alias("n_matched_sites"), F.sum("n").alias("n_matches"))
    counted = info.join(totals, "uniprot_id", "left").fillna(0, ["n_sites", "n_matched_sites", "n_matches"])
    status = F.when(F.col("uniprot_id").isNull(), "not found").when(F.col("n_sites") == 0, "no sites").otherwise("ok")
    return {"info": info, "sites": L.overlay(own, supplement, "site_id"), "matches": matches, "summary": counted.withColumn("status", status)}


def site_kinase_analysis(ids: DataFrame, structural: DataFrame, sequence: DataFrame, scores: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Kinases by the matches of sites: tagged scored matches, counts, medians, heatmap and family totals.

    ``scores`` has a ``score_class``.
    """
    close = L.without_self(E.structural_matches(structural, ids))
    close, near = E.parsed_target(close, None), E.parsed_target(E.sequence_matches(sequence, ids), None)
    plain = scores.drop("score_class")
    medians = S.kinase_statistic(close, plain)
    return {
        "matches": S.tagged_matches(close, near, scores),
        "counts": S.match_report(close, near, scores),
        "medians": S.preferred_motif(S.top_kinases(medians, n, "query_id")),
        "heatmap": S.heatmap(close, plain, n),
        "families": S.family_totals(medians, "query_id"),
        "combined": S.combined_ranking(medians, S.kinase_statistic(near, plain)),
    }


def site_detail(ids: DataFrame, structural: DataFrame, sequence: DataFrame, annotations: DataFrame, supplement: DataFrame, scores: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """The page of a site: what is known of it, enriched matches of both kinds, star networks, motif statistics, kinases and network kinases."""
    close = L.without_self(E.structural_matches(structural, ids))
    near = sequence_report(ids, sequence, supplement)
    motifs = near.where("motif IS NOT NULL").select("query_id", "rank", "target_id", "motif")
    similar = E.similar_sites(ids, sequence, structural)
    star_nodes, star_links = E.star_network(near, "similarity")
    return {
        "site": L.comprehensive(annotations, supplement, ids, keep_unknown=True),
        "structural": L.enrich_matches(E.parsed_target(close, "S"), annotations, supplement),
        "sequence": near,
        "nodes": star_nodes,
        "links": star_links,
        **conservation_report(motifs),
        "kinases": S.top_kinases(L.by_ids(scores, ids, "site_id"), n),
        "families": S.family_totals(L.by_ids(scores, ids, "site_id")),
        "heatmap": S.heatmap(close, scores, n, "mean"),
        "network_kinases": S.top_kinases(S.network_statistics(similar, scores, with_scores=False), n, "query_id", "mean_score"),
        "network_heatmap": S.network_heatmap(similar, scores, n),
    }


def site_kinase_page(ids: DataFrame, supplement: DataFrame, typed_scores: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Kinases of sites as served: top kinases and family totals of every score type, known kinases, and the types compared.

    ``typed_scores(site_id, score_type, kinase, score)``.
    """
    asked = L.by_ids(typed_scores, ids, "site_id")
    order = W.partitionBy("site_id", "score_type").orderBy(F.desc("score"), "kinase")
    top = asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    families = asked.groupBy("site_id", "score_type", S.family_of(F.col("kinase")).alias("family")).agg(F.sum("score").alias("score"))
    known = L.by_ids(supplement, ids, "site_id").select("site_id", known_kinases(*[F.col(c) for c in supplement.columns if c.lower().startswith("kinase_")]).alias("known_kinases"))
    types = sorted(row[0] for row in typed_scores.select("score_type").distinct().collect())  # structure, sequence
    return {"top_kinases": top, "families": families, "known": known, "comparison": S.compare_types(asked, types, n)}


def site_kinases(scores: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Top kinases of sites and their family totals."""
    return S.top_kinases(scores, n), S.family_totals(scores)


def protein_list_network(edges: DataFrame, proteins: DataFrame, depth: int = 2, least: float = 0.7) -> dict[str, DataFrame]:
    """Nodes and edges around a list, the common interactors and both counts."""
    nodes, links = G.grow(edges, proteins.select(F.col("id").alias("source")), depth, least)
    counts = nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(links.agg(F.count(F.lit(1)).alias("n_edges")))  # single rows
    return {"nodes": nodes, "edges": links, "common": G.common_interactors(edges, proteins), "counts": counts}
