"""Kinase scores: long and wide forms, rankings, statistics over similar sites, PSSM scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.functions.motif import AMINO

# Members of the kinase families, tried in this order as parts of the name in capitals (so "p38" finds nothing).
FAMILIES = {
    "CDK": ["CDK1", "CDK2", "CDK4", "CDK5", "CDK6", "CDK7", "CDK8", "CDK9"],
    "MAPK": ["ERK1", "ERK2", "p38", "JNK1", "JNK2", "JNK3"],
    "GSK": ["GSK3", "GSK3A", "GSK3B"],
    "CK": ["CK1", "CK2", "CSNK1", "CSNK2"],
    "PKC": ["PKC", "PKCALPHA", "PKCBETA", "PKCDELTA", "PKCEPSILON", "PKCGAMMA", "PKCZETA"],
    "PKA": ["PKA", "PKACA", "PKACB", "PKACG"],
    "AKT": ["AKT", "AKT1", "AKT2", "AKT3"],
    "SRC": ["SRC", "FYN", "LCK", "LYN", "HCK", "FGR", "BLK", "YES"],
    "CAMK": ["CAMK", "CAMK1", "CAMK2", "CAMK4"],
    "ATM/ATR": ["ATM", "ATR", "DNAPK"],
    "PLK": ["PLK1", "PLK2", "PLK3", "PLK4"],
    "AURORA": ["AURKA", "AURKB", "AURKC"],
}
# The substrate motif of kinases whose name contains a word in any case, first hit wins.
PREFERRED = {
    "CDK1": "S/T-P-X-K/R", "CDK2": "S/T-P-X-K/R", "CDK5": "S/T-P-X-K/R", "ERK1": "P-X-S/T-P", "ERK2": "P-X-S/T-P", "MAPK": "P-X-S/T-P",
    "p38": "P-X-S/T-P", "JNK": "P-X-S/T-P", "PKA": "R-R-X-S/T", "PKG": "R-R-X-S/T", "PKC": "S/T-X-K/R", "CK1": "pS-X-X-S/T",
    "CK2": "S/T-X-X-E/D", "GSK3": "S/T-X-X-X-pS", "PLK": "D/E-X-S/T-Φ", "AKT": "R-X-R-X-X-S/T", "CAMK2": "R-X-X-S/T", "AURORA": "R-X-S/T",
    "ATM": "S/T-Q", "ATR": "S/T-Q", "DNAPK": "S/T-Q", "SRC": "X-E/D-E/D-X-Y-Φ-X-X", "FYN": "X-E/D-E/D-X-Y-Φ-X-X", "LCK": "X-E/D-E/D-X-Y-Φ-X-X",
}


def to_long(wide: DataFrame, keys: list[str], fill: float | None = None, value: str = "score") -> DataFrame:
    """Wide kinase columns to ``kinase, score`` rows; NaN and NULL filled, or dropped."""
    kinases = [c for c in wide.columns if c not in keys]
    out = wide.unpivot(keys, [F.col(f"`{c}`").cast("double").alias(c) for c in kinases], "kinase", value)
    clean = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return out.withColumn(value, F.coalesce(clean, F.lit(fill))) if fill is not None else out.withColumn(value, clean).where(F.col(value).isNotNull())


def to_map(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kinase", "score")))).alias("scores"))


def kinase_names(wide: DataFrame, keys: list[str], default: list[str]) -> DataFrame:
    names = sorted(c for c in wide.columns if c not in keys) or default
    return wide.sparkSession.createDataFrame([(n,) for n in names], "kinase string")


def top_kinases(scores: DataFrame, n: int, key: str = "site_id", by: str = "score") -> DataFrame:
    """The n best kinases of each key, ties by name."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(by), "kinase"))).where(F.col("rank") <= n)


def top_percentile_kinases(requests: DataFrame, st: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Top kinases of ``requests(site_id, residue)`` from the table of their residue type; S if unknown."""
    kind = F.coalesce(F.nullif(F.regexp_extract("site_id", r"_([STY])\d+$", 1), F.lit("")), F.col("residue"), F.lit("S"))
    asked = requests.select("site_id", F.when(kind == "Y", "Y").otherwise("ST").alias("score_class"))
    both = st.withColumn("score_class", F.lit("ST")).unionByName(y.withColumn("score_class", F.lit("Y")))
    return top_kinases(asked.join(both, ["site_id", "score_class"]), n)


def network_statistics(similar: DataFrame, scores: DataFrame, least: int = 2, with_scores: bool = True) -> DataFrame:
    """Per query and kinase over its similar sites: positive scores only, at least ``least`` of them.

    All scores in order come too, a list as long as a hub has similar sites, unless
    ``with_scores`` is off, as in the reports.
    Means are those of doubles; cast the scores to a decimal for exactly rounded ones.
    """
    found = similar.join(scores.where("score > 0"), "site_id")
    listed = [F.sort_array(F.collect_list("score")).alias("scores")] if with_scores else []
    out = found.groupBy("query_id", "kinase").agg(
        F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.count(F.lit(1)).alias("sample_size"), *listed,
    )
    return out.where(F.col("sample_size") >= least).withColumn("score_range", F.col("max_score") - F.col("min_score"))


def kinase_statistic(matches: DataFrame, scores: DataFrame, statistic: str = "median", distinct: bool = False) -> DataFrame:
    """Median or mean score of each kinase over the targets of a query.

    ``distinct`` counts a target once, however often it is matched.
    """
    targets = matches.select("query_id", F.col("target_id").alias("site_id"))
    targets = targets.distinct() if distinct else targets
    function = {"median": F.median, "mean": F.avg}[statistic]
    return targets.join(scores, "site_id").groupBy("query_id", "kinase").agg(function("score").alias("score"))


def heatmap(matches: DataFrame, scores: DataFrame, n: int, statistic: str = "median") -> DataFrame:
    """Complete grid of a query's top-n kinases and its distinct targets; missing scores are 0."""
    top = top_kinases(kinase_statistic(matches, scores, statistic, distinct=True), n, "query_id").select("query_id", "kinase", "rank")
    sites = matches.select("query_id", F.col("target_id").alias("site_id")).distinct()
    return top.join(sites, "query_id").join(scores, ["site_id", "kinase"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def network_heatmap(similar: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    top = top_kinases(network_statistics(similar, scores, with_scores=False), n, "query_id", "mean_score").select("query_id", "kinase", "rank")
    return top.join(similar, "query_id").join(scores, ["site_id", "kinase"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def protein_heatmap(sites: DataFrame, scores: DataFrame, n: int = 20) -> DataFrame:
    """Median by protein and kinase, then the mean over all proteins with missing as 0; top n kinases."""
    proteins = sites.select("uniprot_id").distinct()
    medians = sites.join(scores, "site_id").groupBy("uniprot_id", "kinase").agg(F.median("score").alias("score"))
    means = medians.groupBy("kinase").agg(F.sum("score").alias("total")).crossJoin(F.broadcast(proteins.agg(F.count(F.lit(1)).alias("n"))))
    top = means.select("kinase", (F.col("total") / F.col("n")).alias("mean_score")).orderBy(F.desc("mean_score"), "kinase").limit(n)
    return medians.join(F.broadcast(top), "kinase")  # n rows


def family_of(kinase: Column) -> Column:
    pairs = [(word, family) for family, words in FAMILIES.items() for word in words]
    return reduce(lambda c, x: c.when(F.upper(kinase).contains(x[0]), x[1]), pairs[1:], F.when(F.upper(kinase).contains(pairs[0][0]), pairs[0][1])).otherwise("Other")


def family_totals(scores: DataFrame, key: str = "site_id") -> DataFrame:
    return scores.groupBy(key, family_of(F.col("kinase")).alias("family")).agg(F.sum("score").alias("score"))


def preferred_motif(top: DataFrame) -> DataFrame:
    name = F.upper("kinase")
    words = [(word.upper(), motif) for word, motif in PREFERRED.items()]
    chain = reduce(lambda c, x: c.when(name.contains(x[0]), x[1]), words[1:], F.when(name.contains(words[0][0]), words[0][1]))
    return top.withColumn("preferred_motif", chain.otherwise("Unknown"))


def compare_sites(scores: DataFrame, n: int) -> DataFrame:
    """Union of the sites' top-n kinases by site, missing 0."""
    kinases = top_kinases(scores, n).select("kinase").distinct()
    grid = scores.select("site_id").distinct().crossJoin(F.broadcast(kinases))  # kinases: a fixed, small set
    return grid.join(scores, ["site_id", "kinase"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def compare_types(scores: DataFrame, types: list[str], n: int) -> DataFrame:
    """Union of top-n kinases of every score type; value by type, 0 outside a type's top n.

    ``scores(site_id, score_type, kinase, score)``.
    """
    rank = F.row_number().over(W.partitionBy("site_id", "score_type").orderBy(F.desc("score"), "kinase"))
    return scores.withColumn("_n", rank).where(F.col("_n") <= n).groupBy("site_id", "kinase").pivot("score_type", types).agg(F.first("score")).fillna(0.0, types)


def combined_ranking(structural: DataFrame, sequence: DataFrame) -> DataFrame:
    """Mean of two scores per kinase, a missing one counts 0, best first."""
    a, b = structural.withColumnRenamed("score", "structural"), sequence.withColumnRenamed("score", "sequence")
    out = a.join(b, ["query_id", "kinase"], "full").fillna(0.0, ["structural", "sequence"])
    out = out.withColumn("combined", (F.col("structural") + F.col("sequence")) / 2)
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("combined"), "kinase")))


def scored_matches(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """Matches with the scores of their target, routed to the S/T or Y table.

    A missing residue type becomes the most frequent one of the query's matches (ties by
    letter), S if there is none. Matches without scores go. ``scores`` has ``score_class``.
    """
    counts = matches.where("target_type IS NOT NULL").groupBy("query_id", "target_type").count()
    usual = counts.groupBy("query_id").agg(F.min_by("target_type", F.struct(-F.col("count"), F.col("target_type"))).alias("_usual"))
    kind = F.coalesce("target_type", "_usual", F.lit("S"))
    routed = matches.join(usual, "query_id", "left").withColumn("target_type", kind).drop("_usual").withColumn("score_class", F.when(F.col("target_type") == "Y", "Y").otherwise("ST"))
    return routed.join(scores.withColumnRenamed("site_id", "target_id"), ["target_id", "score_class"])


def tagged_matches(structural: DataFrame, sequence: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored matches of both kinds in one table, marked by ``match_type``."""
    shared = ["query_id", "target_id", "target_type"]
    both = [scored_matches(m.select(*shared), scores).withColumn("match_type", F.lit(kind)) for m, kind in ((structural, "structural"), (sequence, "sequence"))]
    return both[0].unionByName(both[1])


def match_report(structural: DataFrame, sequence: DataFrame, scores: DataFrame) -> DataFrame:
    """Matched and scored targets by query for both kinds of match."""
    def counts(matches: DataFrame, kind: str) -> DataFrame:
        scored = scored_matches(matches, scores).select("query_id", "target_id").distinct().withColumn("_hit", F.lit(1))
        both = matches.select("query_id", "target_id").distinct().join(scored, ["query_id", "target_id"], "left")
        return both.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"{kind}_matched"), F.count("_hit").alias(f"{kind}_processed"))

    names = [f"{k}_{c}" for k in ("structural", "sequence") for c in ("matched", "processed")]
    return counts(structural, "structural").join(counts(sequence, "sequence"), "query_id", "full").fillna(0, names)


def sites_with_matches(sites: DataFrame, structural: DataFrame, sequence: DataFrame) -> DataFrame:
    n = lambda m, name: m.groupBy(F.col("query_id").alias("site_id")).agg(F.count(F.lit(1)).alias(name))
    out = sites.select("site_id").join(n(structural, "n_structural"), "site_id", "left").join(n(sequence, "n_sequence"), "site_id", "left").fillna(0, ["n_structural", "n_sequence"])
    return out.where("n_structural > 0 OR n_sequence > 0")


def percentiles(scores: DataFrame, by: str = "kinase", value: str = "score", ranges: int = 64) -> DataFrame:
    """Share of the kinase's values that are smaller, plus one: ties share the low rank.

    NULL counts as NaN; NaN sorts last and counts in n. Values of one kinase are counted,
    then ranked within ``ranges`` ranges of its values, and what lies in the ranges before is
    added: no kinase is sorted in one task, however many different values it has.
    """
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    counted = scores.withColumn(value, x).groupBy(by, value).count()
    cuts = counted.groupBy(by).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 1000).alias("_cuts"))  # a row a kinase
    placed = counted.join(cuts, by).withColumn("_range", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(by, "_range").agg(F.sum("count").alias("held"))  # at most ``ranges`` rows a kinase
    earlier = W.partitionBy(by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(by, "_range", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("_before"), F.sum("held").over(W.partitionBy(by)).alias("_total"))
    inside = F.sum("count").over(W.partitionBy(by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranked = placed.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, [by, "_range"])
    ranks = ranked.select(F.col(by).alias("_by"), F.col(value).alias("_x"), ((F.col("_before") + F.col("_inside") + 1) / F.col("_total")).alias("percentile"))
    rows = scores.withColumn(value, x)
    return rows.join(ranks, (rows[by] == ranks["_by"]) & (rows[value] == ranks["_x"])).drop("_by", "_x")


def pssm_long(wide: DataFrame, kinase: str = "kinase") -> DataFrame:
    """Columns such as ``-3R`` to ``kinase, position, aa, weight``; of names that differ in case the last wins."""
    named = {c: (c[:-1], c[-1].upper()) for c in wide.columns if c != kinase and c[:-1].lstrip("-").isdigit()}
    last = {v: c for c, v in named.items()}
    rows = F.array(*[F.struct(F.lit(int(p)).alias("position"), F.lit(a).alias("aa"), F.col(f"`{c}`").cast("double").alias("weight")) for (p, a), c in last.items()])
    return wide.select(kinase, F.explode(rows).alias("r")).select(kinase, "r.*")


def pssm_scores(motifs: DataFrame, pssm: DataFrame, column: str = "motif", least: int = 4) -> DataFrame:
    """Product of weights at -5..-1 and 1..4 for every kinase and different motif.

    Letters without a weight are skipped; fewer than ``least`` weights or a length other
    than 10 give NaN. ``pssm`` holds some 300 kinases x 9 positions x 20 letters: fixed.
    """
    different = motifs.select(F.upper(column).alias("motif")).where(F.col("motif").isNotNull()).distinct()
    places = [-5, -4, -3, -2, -1, 1, 2, 3, 4]
    at = F.lit(len(AMINO)) * F.array_position(F.array(*map(F.lit, places)), F.col("position")) + F.instr(F.lit(AMINO), F.col("aa")) - len(AMINO)
    known = pssm.where(F.col("position").isin(places) & (F.instr(F.lit(AMINO), F.col("aa")) > 0))
    cells = known.groupBy("kinase").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), "weight"))).alias("cells"))
    names = pssm.select("kinase").distinct().join(cells, "kinase", "left")
    slots = F.sequence(F.lit(1), F.lit(len(AMINO) * len(places)))
    weights = names.select("kinase", F.transform(slots, lambda k: F.element_at("cells", k)).alias("w"))  # a row a kinase
    score, n = F.lit(1.0), F.lit(0)
    for k, p in enumerate(places):
        letter = F.instr(F.lit(AMINO), F.substring("motif", p + 6, 1))
        weight = F.when(letter > 0, F.get("w", F.lit(k * len(AMINO)) + letter - 1))
        score, n = score * F.coalesce(weight, F.lit(1.0)), n + weight.isNotNull().cast("int")
    score = F.when((F.length("motif") == 10) & (n >= least), score).otherwise(F.lit(float("nan")))
    return different.crossJoin(F.broadcast(weights)).select("motif", "kinase", score.alias("score"))
