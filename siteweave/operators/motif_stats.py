"""Statistics of motifs around matched sites: conservation, distribution, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.functions.motif import ACIDIC, BACKGROUND, BASIC, residue_class, standardize

# Group background used for the termini.
GROUP_BACKGROUND = {"polar": 0.30, "nonpolar": 0.50, "acidic": 0.10, "basic": 0.10}


def phosphosites(proteins: DataFrame, w: int = 7, chunk: int = 256) -> DataFrame:
    """S, T and Y of ``proteins(uniprot_id, gene, sequence)`` with their number from 1 and their unpadded motif of ``w`` letters a side.

    Sequences are cut into chunks that overlap by ``w`` letters a side, so that a row never
    carries a whole sequence and a long protein is spread over many rows.
    """
    pad = "-" * w
    parts = F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / chunk).cast("int"))
    chunks = proteins.where(F.length("sequence") > 0).select("uniprot_id", "gene", F.concat(F.lit(pad), "sequence", F.lit(pad)).alias("padded"), F.explode(parts).alias("k"))
    chunks = chunks.select("uniprot_id", "gene", "k", F.substring("padded", F.col("k") * chunk + 1, F.lit(chunk + 2 * w)).alias("text"))
    places = F.sequence(F.lit(1), F.length("text") - 2 * w)
    sites = chunks.select("uniprot_id", "gene", "k", "text", F.explode(F.filter(places, lambda i: F.col("text").substr(i + w, F.lit(1)).isin("S", "T", "Y"))).alias("i"))
    resno = (F.col("k") * chunk + F.col("i")).cast("int")
    motif = F.replace(F.col("text").substr(F.col("i"), F.lit(2 * w + 1)), F.lit("-"), F.lit(""))
    return sites.select(F.concat_ws("_", "uniprot_id", resno.cast("string")).alias("site_id"), "uniprot_id", "gene", F.col("text").substr(F.col("i") + w, F.lit(1)).alias("residue"), resno.alias("resno"), motif.alias("motif"))


def positions(motifs: DataFrame, w: int | None = 7) -> DataFrame:
    """``query_id, position, aa``: standardised motifs around 0, or raw ones from 1 if ``w`` is None."""
    m = F.upper("motif") if w is None else standardize(F.upper("motif"), w)
    shift = 1 if w is None else -w
    rows = motifs.where(F.col("motif").isNotNull() & (F.col("motif") != "")).select("query_id", F.posexplode(F.split(m, "")).alias("at", "aa")).where("aa <> ''")
    return rows.select("query_id", (F.col("at") + shift).alias("position"), "aa")


def frequencies(motifs: DataFrame, w: int | None = 7) -> DataFrame:
    """Count and percent of each letter at each position; X counts."""
    counts = positions(motifs, w).groupBy("query_id", "position", "aa").count()
    total = F.sum("count").over(W.partitionBy("query_id", "position"))
    return counts.withColumn("percent", F.col("count") * 100.0 / total)


def conserved(motifs: DataFrame, w: int | None = 7, least: float = 50.0) -> DataFrame:
    """Letters at or above ``least`` percent; the centre of standardised motifs is skipped."""
    out = frequencies(motifs, w).where((F.col("percent") >= least) & (F.col("aa") != "X"))
    return out if w is None else out.where("position <> 0")


def consensus(motifs: DataFrame, w: int | None = 7) -> DataFrame:
    """Most frequent letter at every position, joined; X only where nothing else occurs, ties by letter."""
    order = [(F.col("aa") == "X").cast("int"), F.desc("count"), F.col("aa")]
    top = frequencies(motifs, w).withColumn("_n", F.row_number().over(W.partitionBy("query_id", "position").orderBy(*order))).where("_n = 1")
    listed = F.sort_array(F.collect_list(F.struct("position", "aa")))
    return top.groupBy("query_id").agg(F.concat_ws("", F.transform(listed, lambda r: r["aa"])).alias("consensus"))


def _group(aa):
    return F.when(F.lit(ACIDIC).contains(aa), "acidic").when(F.lit(BASIC).contains(aa), "basic").when(F.lit("STYCNQ").contains(aa), "polar").when(F.lit("AVLIMFWPG").contains(aa), "nonpolar")


def terminal_groups(motifs: DataFrame, w: int = 7) -> DataFrame:
    """Percent of residue groups before and after the centre; X does not count."""
    rows = positions(motifs, w).where("position <> 0 AND aa <> 'X'").withColumn("group", _group(F.col("aa"))).where("group IS NOT NULL")
    counts = rows.groupBy("query_id", F.when(F.col("position") < 0, "N").otherwise("C").alias("side"), "group").count()
    return counts.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(W.partitionBy("query_id", "side")))


def enrichment(motifs: DataFrame, background: dict[str, float] = BACKGROUND, w: int = 7, by_position: bool = True) -> DataFrame:
    """Observed share over expected share, centre and X left out.

    The denominator counts all letters but X, also those without a background.
    """
    rows = positions(motifs, w).where("position <> 0 AND aa <> 'X'")
    keys = ["query_id", "position"] if by_position else ["query_id"]
    counts = rows.groupBy(*keys, "aa").count()
    observed = F.col("count") / F.sum("count").over(W.partitionBy(*keys))
    table = F.create_map(*[F.lit(x) for kv in background.items() for x in kv])
    out = counts.withColumns({"observed": observed, "expected": F.element_at(table, F.col("aa"))}).where("expected IS NOT NULL")
    return out.withColumn("ratio", F.col("observed") / F.col("expected"))


def terminus_enrichment(motifs: DataFrame, reach: int = 5) -> DataFrame:
    """Group shares at -5..-1 and 1..5 over the fixed group background."""
    rows = positions(motifs).where((F.col("position") != 0) & (F.abs("position") <= reach)).withColumn("group", _group(F.col("aa"))).where("group IS NOT NULL")
    counts = rows.groupBy("query_id", F.when(F.col("position") < 0, "N").otherwise("C").alias("side"), "group").count()
    table = F.create_map(*[F.lit(x) for kv in GROUP_BACKGROUND.items() for x in kv])
    share = F.col("count") / F.sum("count").over(W.partitionBy("query_id", "side"))
    return counts.withColumn("observed", share).withColumn("ratio", F.col("observed") / F.element_at(table, F.col("group")))


def length_distribution(table: DataFrame, column: str) -> DataFrame:
    return table.groupBy(F.length(column).alias("length")).count().orderBy("length")


def length_stats(table: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return table.where(F.col(column).isNotNull()).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.mode(n, True).alias("most_common"))


def alignment(matches: DataFrame, n: int, w: int = 5) -> DataFrame:
    """Letter rows of a query's best ``n`` motifs, standardised and trimmed, with the class of each letter.

    ``matches(query_id, rank, target_id, motif)``; rank 0 is the query's own motif.
    """
    cut = F.substring(standardize(F.upper("motif"), 7), 8 - w, 2 * w + 1)
    rows = matches.where(F.col("rank") <= n).select("query_id", "rank", "target_id", F.posexplode(F.split(cut, "")).alias("at", "aa"))
    return rows.select("query_id", "rank", "target_id", (F.col("at") - w).alias("position"), "aa", residue_class(F.col("aa")).alias("class"))
