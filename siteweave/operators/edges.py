"""Similarity edges: searches, closures and node/link tables.

Structural edges are ``query_id, target_id, rmsd, ...``; sequence edges are undirected
``id1, id2, similarity``. Every search takes a table of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.functions.motif import residue_number_of, residue_type_of, uniprot_of


def parsed_target(matches: DataFrame, default_type: str | None) -> DataFrame:
    """Target id split into protein, residue type and number; a missing letter gets the default."""
    t = F.col("target_id")
    kind = residue_type_of(t, default_type)
    return matches.withColumns({"target_uniprot": uniprot_of(t), "target_type": kind, "target_number": residue_number_of(t), "target_site": F.concat(F.coalesce(kind, F.lit("")), residue_number_of(t).cast("string"))})


def structural_matches(edges: DataFrame, ids: DataFrame, rmsd: float = 5.0, directed: bool = False, parity: bool = False) -> DataFrame:
    """Structural matches of the ids up to ``rmsd``.

    ``directed``: stored direction only. Otherwise reverse rows are swapped and added, and
    of equal (query, target) the forward row wins, then the smaller rmsd. Query/Target
    properties are swapped with the ids unless ``parity``.
    """
    wanted = ids.select(F.col("id").alias("query_id"))
    close = edges.where(F.col("rmsd") <= rmsd)
    forward = close.join(wanted, "query_id", "left_semi")
    if directed:
        return forward
    names = {"query_id": "target_id", "target_id": "query_id"}
    if not parity:
        names |= {c: "Target" + c[5:] for c in edges.columns if c.startswith("Query") and "Target" + c[5:] in edges.columns}
        names |= {v: k for k, v in names.items()}
    swapped = close.select(*[F.col(c).alias(names.get(c, c)) for c in edges.columns])
    both = forward.withColumn("_dir", F.lit(0)).unionByName(swapped.join(wanted, "query_id", "left_semi").withColumn("_dir", F.lit(1)))
    first = W.partitionBy("query_id", "target_id").orderBy("_dir", "rmsd")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_dir")


def structural_matches_by_target(edges: DataFrame, ids: DataFrame, rmsd: float = 5.0) -> DataFrame:
    return edges.where(F.col("rmsd") <= rmsd).join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")


def sequence_matches(edges: DataFrame, ids: DataFrame, least: float = 0.4, credit: str = "both") -> DataFrame:
    """Sequence matches of the ids from either end of an edge.

    If both ends are queried both get the row; with ``credit='id1'`` only the first.
    """
    near = edges.where(F.col("similarity") >= least)
    wanted = ids.select(F.col("id"))
    first = near.join(wanted, near["id1"] == wanted["id"], "left_semi").select(F.col("id1").alias("query_id"), F.col("id2").alias("target_id"), "similarity")
    second = near.join(wanted, near["id2"] == wanted["id"], "left_semi")
    if credit == "id1":
        second = second.join(wanted, second["id1"] == wanted["id"], "left_anti")
    second = second.where("id1 <> id2").select(F.col("id2").alias("query_id"), F.col("id1").alias("target_id"), "similarity")
    return first.unionByName(second)


def top_matches(matches: DataFrame, n: int, by: str = "similarity", descending: bool = True, key: str = "query_id") -> DataFrame:
    """The n best matches of each query, ties to the smaller target id."""
    order = F.desc(by) if descending else F.asc(by)
    return matches.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(order, "target_id"))).where(F.col("rank") <= n)


def keep_first(table: DataFrame, keys: list[str], order: list) -> DataFrame:
    return table.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def similar_sites(ids: DataFrame, sequence: DataFrame, structural: DataFrame, least: float = 0.6, rmsd: float = 3.0) -> DataFrame:
    """Each id itself, its sequence targets and its structural targets, distinct."""
    own = ids.select(F.col("id").alias("query_id"), F.col("id").alias("site_id"))
    near = sequence_matches(sequence, ids, least).select("query_id", F.col("target_id").alias("site_id"))
    close = structural_matches(structural, ids, rmsd, directed=True).select("query_id", F.regexp_replace("target_id", r"_[STY](\d+)$", "_$1").alias("site_id"))
    return own.union(near).union(close).distinct()


def similar_sites_by_request(requests: DataFrame, sequence: DataFrame, structural: DataFrame) -> DataFrame:
    """``similar_sites`` with the bounds of each request: ``requests(id, similarity, rmsd)``.

    The edges pass the loosest bounds of all requests first, then each request's own.
    """
    loosest = requests.agg(F.min("similarity").alias("s"), F.max("rmsd").alias("r")).first()
    own = requests.select(F.col("id").alias("query_id"), F.col("id").alias("site_id"))
    if loosest.s is None:
        return own
    asked = requests.select(F.col("id").alias("query_id"), F.col("similarity").alias("_s"), F.col("rmsd").alias("_r"))
    ids = requests.select("id").distinct()
    near = sequence_matches(sequence, ids, loosest.s).join(asked, "query_id").where("similarity >= _s").select("query_id", F.col("target_id").alias("site_id"))
    close = structural_matches(structural, ids, loosest.r, directed=True).join(asked, "query_id").where("rmsd <= _r").select("query_id", F.regexp_replace("target_id", r"_[STY](\d+)$", "_$1").alias("site_id"))
    return own.union(near).union(close).distinct()


def connected_matches(matches: DataFrame, edges: DataFrame, weight: str, bound: float, above: bool = True, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two-hop closure: links from sites to targets, and edges among the targets.

    ``edges(a, b, weight)`` is undirected; self loops go and each pair stays once.
    ``parity`` links a target only to the query that ranks it first.
    """
    links = matches.select("query_id", "target_id", F.col(weight).alias("weight"))
    if parity:
        links = keep_first(links, ["target_id"], [F.desc("weight") if above else F.asc("weight"), "query_id"])
    targets = links.select(F.col("target_id").alias("a")).distinct()
    near = edges.where((F.col(weight) >= bound) if above else (F.col(weight) <= bound)).where("a <> b")
    among = near.join(targets, "a", "left_semi").join(targets.withColumnRenamed("a", "b"), "b", "left_semi")
    pairs = among.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(weight).alias("weight"))
    return links, pairs.groupBy("a", "b").agg((F.max if above else F.min)("weight").alias("weight"))


def star_network(matches: DataFrame, weight: str) -> tuple[DataFrame, DataFrame]:
    """Node and link tables around each query: targets once, no self."""
    links = keep_first(matches.where("query_id <> target_id"), ["query_id", "target_id"], [F.col(weight)]).select("query_id", F.col("query_id").alias("source"), F.col("target_id").alias("target"), F.col(weight).alias("value"))
    nodes = links.select("query_id", F.col("query_id").alias("id"), F.lit("site").alias("type")).distinct().union(links.select("query_id", F.col("target").alias("id"), F.lit("match").alias("type")))
    return nodes, links


def protein_network(sites: DataFrame, matches: DataFrame, weight: str, undirected: bool) -> tuple[DataFrame, DataFrame]:
    """Links from a protein's sites to their targets, tyrosine dropped at both ends.

    Self links go; the undirected form keeps positive weights and each pair once. Only
    nodes that are linked stay. ``sites(site_id, residue)``, ``matches(..., target_type)``.
    """
    own = sites.where(F.coalesce(F.col("residue"), F.lit("")) != "Y").select(F.col("site_id").alias("query_id"))
    links = matches.join(own, "query_id", "left_semi").where(F.coalesce(F.col("target_type"), F.lit("")) != "Y").where("query_id <> target_id")
    links = links.select(F.col("query_id").alias("source"), F.col("target_id").alias("target"), F.col(weight).alias("value"))
    if undirected:
        ends = {"_a": F.least("source", "target"), "_b": F.greatest("source", "target")}
        links = keep_first(links.where("value > 0").withColumns(ends), ["_a", "_b"], [F.desc("value"), "source"]).drop("_a", "_b")
    ends = links.select(F.col("source").alias("id")).union(links.select("target")).distinct()
    protein = own.withColumnRenamed("query_id", "id").withColumn("_own", F.lit(True))
    nodes = ends.join(protein, "id", "left").select("id", F.when(F.col("_own"), "protein").otherwise("match").alias("type"))
    return nodes, links


def filtered_network(nodes: DataFrame, links: DataFrame, bound: float, above: bool) -> tuple[DataFrame, DataFrame]:
    """Links within a bound; protein nodes stay, match nodes only if still linked."""
    kept = links.where(F.col("value") >= bound if above else F.col("value") <= bound)
    ends = kept.select(F.col("source").alias("id")).union(kept.select("target")).distinct()
    return nodes.where("type = 'protein'").unionByName(nodes.where("type <> 'protein'").join(ends, "id", "left_semi")), kept


def sites_of_edges(edges: DataFrame, a: str = "query_id", b: str = "target_id") -> DataFrame:
    """Distinct sites of both ends, listed by protein."""
    sites = edges.select(F.col(a).alias("site_id")).union(edges.select(b)).distinct().withColumn("uniprot_id", F.regexp_extract("site_id", r"^([A-Z0-9_]+)_(\d+)", 1))
    return sites.where("uniprot_id <> ''").groupBy("uniprot_id").agg(F.sort_array(F.collect_list("site_id")).alias("site_ids"), F.count(F.lit(1)).alias("n"))
