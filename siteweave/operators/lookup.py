"""Point and batch lookups, filters, projections and site enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.motif import clean_number, first_kinase, is_known_kinase


def by_ids(table: DataFrame, ids: DataFrame, key: str, id_column: str = "id") -> DataFrame:
    """Rows whose key is among the ids: one semi join for one id or for millions."""
    return table.join(ids.select(F.col(id_column).alias(key)), key, "left_semi")


def site_lookup(sites: DataFrame, ids: DataFrame) -> DataFrame:
    """Sites by id, motif in upper case."""
    return by_ids(sites, ids, "site_id").withColumn("motif", F.upper("motif"))


def sites_of(sites: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Sites by protein, gene or any key; a key without sites keeps one row of NULLs."""
    return wanted.select(F.col("id").alias(key)).join(sites, key, "left")


def grouped_sites(sites: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row a key with its ordered site list, empty where there is none."""
    found = sites.groupBy(key).agg(F.sort_array(F.collect_list("site_id")).alias("site_ids"))
    return wanted.select(F.col("id").alias(key)).join(found, key, "left").withColumn("site_ids", F.coalesce("site_ids", F.array().cast("array<string>")))


def where_equal(table: DataFrame, column: str, value: object) -> DataFrame:
    return table.where(F.col(column) == value)


def at_least(table: DataFrame, column: str, bound: float, limit: int | None = None, tie: str = "site_id") -> DataFrame:
    """Rows at or above a bound, greatest first (confidence, exposure, one kinase's score)."""
    out = table.where(F.col(column) >= bound).orderBy(F.desc(column), tie)
    return out.limit(limit) if limit is not None else out


def kinase_column(st: DataFrame, y: DataFrame, kinase: str, bound: float = 0.9, limit: int = 100) -> DataFrame:
    """Sites by one kinase of the wide tables; ``_TYR`` and tyrosine names read the Y table."""
    source = y if kinase.endswith("_TYR") or kinase in y.columns and kinase not in st.columns else st
    return at_least(source.select("site_id", F.col(f"`{kinase}`").alias("score")), "score", bound, limit)


def known_kinase(scores: DataFrame) -> DataFrame:
    return scores.select("site_id", "label", is_known_kinase(F.col("label")).alias("is_known"))


def without_self(matches: DataFrame, rmsd: str = "rmsd", least: float = 0.01, strict: bool = False) -> DataFrame:
    """Self matches dropped: rmsd below ``least``, or not above it."""
    return matches.where(F.col(rmsd) > least if strict else F.col(rmsd) >= least)


def without_tyrosine(matches: DataFrame, column: str = "target_site") -> DataFrame:
    return matches.where(~F.col(column).startswith("Y"))


def motif_validity(motifs: DataFrame, column: str = "motif") -> DataFrame:
    """Counts of motifs by what is wrong with them: length, letters, centre."""
    m = F.col(column)
    return motifs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.length(m) != 10).alias("bad_length"),
        F.count_if(~m.rlike("^[A-Za-z]*$")).alias("bad_letters"),
        F.count_if(~F.upper(F.substring(m, 6, 1)).isin("S", "T", "Y")).alias("bad_centre"),
        F.count_if(m.rlike("^[A-Za-z]{10}$")).alias("valid"),
    )


def usable_motif(motif: Column) -> Column:
    return motif.isNotNull() & (F.length(motif) == 9) & ~motif.contains("_") & ~motif.contains("?")


def candidate_gate(known: Column, accessibility: Column, least: float = 50.0) -> Column:
    """Known sites, and unknown ones that are accessible."""
    return F.coalesce(known.cast("double") == 1.0, F.lit(False)) | F.coalesce(accessibility > least, F.lit(False))


def report_projection(annotations: DataFrame) -> DataFrame:
    """Annotation columns under report names; contact shares over at least one neighbour."""
    n = F.greatest(F.lit(1), F.col("NeighborCount"))
    share = lambda c: F.col(c) / n * 100.0
    return annotations.select(
        F.col("PhosphositeID").alias("site_id"), F.col("Site").alias("site"), F.col("ResidueNumber").alias("resno"), F.upper("Motif").alias("motif"),
        F.col("pLDDT").alias("mean_plddt"), F.col("NeighborCount").alias("nearby_count"), (F.col("HydroxylExposure") * 100.0).alias("surface_accessibility"),
        share("negative_count").alias("acidic_percent"), share("positive_count").alias("basic_percent"), share("polar_count").alias("polar_percent"), share("hydrophobic_count").alias("hydrophobic_percent"),
    )


def overlay(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join where non-null values of ``right`` win in columns that both have.

    ``how='full'`` gives the union of both tables' rows.
    """
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    out = left.join(r, key, how)
    own = [F.coalesce(f"_r_{c}", c).alias(c) if c in shared else F.col(c) for c in left.columns if c != key]
    more = [F.col(f"_r_{c}").alias(c) for c in right.columns if c != key and c not in left.columns]
    return out.select(key, *own, *more)


def comprehensive(annotations: DataFrame, supplement: DataFrame, ids: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """All that is known of the ids; unknown ids are left out unless asked for."""
    out = overlay(by_ids(annotations, ids, "site_id"), by_ids(supplement, ids, "site_id"), "site_id", "full")
    return ids.select(F.col("id").alias("site_id")).join(out, "site_id", "left") if keep_unknown else out


def enrich_matches(matches: DataFrame, annotations: DataFrame | None, supplement: DataFrame) -> DataFrame:
    """Matches with what is known of their target: annotation first, supplement over it.

    Both tables are cut to the targets before they meet, so their join is no larger than the matches.
    """
    targets = matches.select(F.col("target_id").alias("id")).distinct()
    info = by_ids(supplement, targets, "site_id")
    info = info if annotations is None else overlay(by_ids(annotations, targets, "site_id"), info, "site_id", "full")
    return matches.join(info.withColumnRenamed("site_id", "target_id"), "target_id", "left")


def enrich_sequence_matches(matches: DataFrame, supplement: DataFrame) -> DataFrame:
    """Sequence matches with motif (own one first), site type and known flag of the target."""
    s = supplement.select(F.col("site_id").alias("target_id"), F.col("motif").alias("_motif"), F.col("residue").alias("_type"), "is_known")
    own = F.nullif(F.trim(F.col("motif")), F.lit("")) if "motif" in matches.columns else F.lit(None)
    out = matches.withColumn("_own", own).drop("motif").join(s, "target_id", "left")
    kind = F.coalesce("_type", "site_type") if "site_type" in matches.columns else F.col("_type")
    return out.withColumn("motif", F.upper(F.coalesce("_own", "_motif"))).withColumn("site_type", kind).withColumn("is_known", F.coalesce(F.col("is_known").cast("double") == 1.0, F.lit(False))).drop("_own", "_motif", "_type")


def motif_of(table: DataFrame) -> Column:
    """The site motif with its fallback."""
    return first_kinase(*[F.col(f"`{c}`") for c in ("SITE_+/-7_AA", "motif") if c in table.columns])


def without_columns(table: DataFrame, *columns: str) -> DataFrame:
    return table.drop(*columns)


def sanitized(table: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """NaN and NULL replaced by column defaults."""
    return table.withColumns({c: clean_number(F.col(c), v) for c, v in defaults.items()})


def as_json(table: DataFrame) -> DataFrame:
    return table.select(F.to_json(F.struct("*")).alias("json"))


def in_order(sites: DataFrame) -> DataFrame:
    """Sites by protein and residue number."""
    return sites.orderBy("uniprot_id", "resno", "site_id")


def combined_sites(sites: DataFrame, structural: DataFrame, sequence: DataFrame) -> DataFrame:
    """Own sites and the targets of both kinds of match, marked by where they come from."""
    def of(matches: DataFrame, kind: str) -> DataFrame:
        return matches.select(F.col("target_id").alias("site_id"), F.col("query_id").alias("source_site"), F.lit(True).alias("is_target"), F.lit(kind).alias("match_type"))

    own = sites.select("site_id", F.lit(None).cast("string").alias("source_site"), F.lit(False).alias("is_target"), F.lit(None).cast("string").alias("match_type"))
    return own.unionByName(of(structural, "structural")).unionByName(of(sequence, "sequence"))
