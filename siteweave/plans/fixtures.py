"""Domain tables derived from the driver's star schema, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.operators.motif_stats import phosphosites


def edges(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("P"), "l_suppkey", F.lit("_"), "l_linenumber").alias("query_id"),
        F.concat(F.lit("P"), "l_partkey", F.lit("_"), 1 + F.col("l_suppkey") % 7).alias("target_id"),
        F.round(F.col("l_discount") * 100, 2).alias("rmsd"), F.round(1 - F.col("l_tax") * 10, 2).alias("similarity"), (F.col("l_quantity") / 50).alias("map_ratio"),
    )
    return rows.where("query_id <> target_id").groupBy("query_id", "target_id").agg(F.min("rmsd").alias("rmsd"), F.max("similarity").alias("similarity"), F.max("map_ratio").alias("map_ratio"))


def sequence_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(F.col("query_id").alias("id1"), F.col("target_id").alias("id2"), "similarity")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return (
        spark.read.parquet(f"{d}/lineitem.parquet")
        .groupBy(F.concat(F.lit("P"), "l_partkey", F.lit("_"), "l_linenumber").alias("site_id"), F.concat(F.lit("K"), F.col("l_orderkey") % 13).alias("kinase"))
        .agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("score"))
    )


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Every site of the score table is a request."""
    return scores(spark, d).select(F.col("site_id").alias("id")).distinct()


def atoms(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    v = F.col("embedding")
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("label").alias("structure_id"), F.lit("A").alias("chain"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("resno"),
        F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (1 + F.col("vec_id") % 20).cast("int"), F.lit(1)).alias("aa"), F.lit("CA").alias("atom"), F.lit("C").alias("element"),
        *[(F.get(v, F.lit(k)).cast("double") * 40).alias(c) for k, c in enumerate("xyz")], (50 + 50 * F.abs(F.get(v, F.lit(3)).cast("double"))).alias("bfactor"),
    )


def interactions(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .groupBy(F.concat(F.lit("C"), "o_custkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b"))
        .agg(F.max(F.round(F.col("l_discount") * 10, 2)).alias("confidence"))
    )


def strong_interactions(spark: SparkSession, d: str) -> DataFrame:
    return interactions(spark, d).where("confidence >= 0.9")


def whole_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Every residue with its backbone, CB and, but for glycine, the first atom of its side chain beyond."""
    from pyspark.sql import Window as W

    aa = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (1 + F.col("vec_id") % 20).cast("int"), F.lit(1))
    last = F.when(F.col("aa") == "S", "OG").when(F.col("aa") == "T", "OG1").when(F.col("aa") == "Y", "OH").otherwise("CG")
    at = lambda k, c: F.get("v", F.lit(c)).cast("double") * 40 + F.get("v", F.lit(4 + 3 * k + c)).cast("double") * 4
    atoms = F.array(*[F.struct((last if name is None else F.lit(name)).alias("atom"), *[at(k, c).alias("xyz"[c]) for c in range(3)], (50 + 50 * F.abs(F.get("v", F.lit(3 + k)).cast("double"))).alias("bfactor")) for k, name in enumerate(("N", "CA", "C", "O", "CB", None))])
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("structure_id"), F.lit("A").alias("chain"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("resno"), aa.alias("aa"), F.col("embedding").alias("v"))
    rows = rows.select("structure_id", "chain", "resno", "aa", F.explode(atoms).alias("a")).where("NOT (aa = 'G' AND a.atom IN ('CB', 'CG'))")
    return rows.select("structure_id", "chain", "resno", "aa", "a.atom", F.substring("a.atom", 1, 1).alias("element"), "a.x", "a.y", "a.z", "a.bfactor")


def supplement(spark: SparkSession, d: str) -> DataFrame:
    """What is known of the sites of the score table: residue, motif, known flag, accessibility, confidence, kinases."""
    p, q = (F.regexp_extract("site_id", r"P(\d+)_(\d+)", k).cast("int") for k in (1, 2))
    s = scores(spark, d).select("site_id").distinct().select("site_id", p.alias("p"), q.alias("q"))
    return s.select(
        "site_id", F.concat(F.lit("P"), "p").alias("uniprot_id"), F.col("q").alias("resno"), F.substring(F.lit("STY"), 1 + (F.col("p") + F.col("q")) % 3, F.lit(1)).alias("residue"),
        F.substring(F.lit("ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY"), 1 + (F.col("p") * 7 + F.col("q")) % 20, F.lit(9)).alias("motif"), F.when((F.col("p") + F.col("q")) % 4 == 0, 1.0).otherwise(0.0).alias("is_known"),
        F.when(F.col("p") % 17 != 0, ((F.col("p") * 13 + F.col("q") * 7) % 101).cast("double")).alias("accessibility"), (50 + (F.col("p") * 11 + F.col("q")) % 50).cast("double").alias("plddt"),
        F.when(F.col("p") % 3 == 0, "AKT1, PKA").when(F.col("p") % 3 == 1, "unlabeled").alias("kinase_1"), F.when(F.col("q") % 2 == 0, "PKA").alias("kinase_2"),
    )


def proteins(spark: SparkSession, d: str) -> DataFrame:
    t = F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "BJOUXZ", "")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.where(F.length(t) >= 15).select(F.concat(F.lit("D"), "doc_id").alias("uniprot_id"), F.upper("source").alias("gene"), t.alias("sequence"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """S, T and Y of the proteins with their unpadded motifs of seven letters on both sides."""
    return phosphosites(proteins(spark, d))


def first_motifs(spark: SparkSession, d: str) -> DataFrame:
    """Of each protein with a tyrosine the motif of its first one, padded to 15 letters."""
    s = sites(spark, d).where("residue = 'Y'").groupBy("uniprot_id").agg(F.min_by(F.struct("motif", "resno"), "resno").alias("s"))
    left = F.repeat(F.lit("X"), F.greatest(F.lit(0), 8 - F.col("s.resno")))
    return s.select(F.col("uniprot_id").alias("id"), F.rpad(F.concat(left, "s.motif"), 15, "X").alias("motif"))


SQL = {
    "fx_edge": """SELECT * FROM (SELECT 'P'||l_suppkey||'_'||l_linenumber AS query_id, 'P'||l_partkey||'_'||(1+l_suppkey%7) AS target_id,
        min(round(l_discount*100,2)) AS rmsd, max(round(1-l_tax*10,2)) AS similarity, max(l_quantity/50) AS map_ratio FROM lineitem GROUP BY 1,2) WHERE query_id<>target_id""",
    "fx_score": "SELECT 'P'||l_partkey||'_'||l_linenumber AS site_id, 'K'||(l_orderkey%13) AS kinase, max(round(l_discount*10,2)) AS score FROM lineitem GROUP BY 1,2",
    "fx_atom": """SELECT label AS structure_id, 'A' AS chain, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS resno, substr('ACDEFGHIKLMNPQRSTVWY', CAST(1+vec_id%20 AS INT), 1) AS aa,
        CAST(embedding[1] AS DOUBLE)*40 AS x, CAST(embedding[2] AS DOUBLE)*40 AS y, CAST(embedding[3] AS DOUBLE)*40 AS z, 50+50*abs(CAST(embedding[4] AS DOUBLE)) AS bfactor FROM embeddings""",
    "fx_inter": """SELECT 'C'||o_custkey AS a, 'S'||l_suppkey AS b, max(round(l_discount*10,2)) AS confidence FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2""",
    "fx_strong": "SELECT a, b, confidence FROM fx_inter WHERE confidence>=0.9",
    "fx_full": "SELECT * FROM (" + " UNION ALL ".join(f"""SELECT structure_id, chain, resno, aa, {f"'{name}'" if name else "CASE aa WHEN 'S' THEN 'OG' WHEN 'T' THEN 'OG1' WHEN 'Y' THEN 'OH' ELSE 'CG' END"} AS atom,
        {", ".join(f"CAST(v[{c + 1}] AS DOUBLE)*40+CAST(v[{5 + 3 * k + c}] AS DOUBLE)*4 AS {'xyz'[c]}" for c in range(3))}, 50+50*abs(CAST(v[{4 + k}] AS DOUBLE)) AS bfactor FROM fx_residue""" for k, name in enumerate(("N", "CA", "C", "O", "CB", None))) + ") WHERE NOT (aa='G' AND atom IN ('CB','CG'))",
    "fx_residue": """SELECT label AS structure_id, 'A' AS chain, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS resno, substr('ACDEFGHIKLMNPQRSTVWY', CAST(1+vec_id%20 AS INT), 1) AS aa, embedding AS v FROM embeddings""",
    "fx_supp": """SELECT site_id, 'P'||p AS uniprot_id, q AS resno, substr('STY', 1+(p+q)%3, 1) AS residue, substr('ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY', 1+(p*7+q)%20, 9) AS motif,
        CASE WHEN (p+q)%4=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_known, CASE WHEN p%17<>0 THEN CAST((p*13+q*7)%101 AS DOUBLE) END AS accessibility, CAST(50+(p*11+q)%50 AS DOUBLE) AS plddt,
        CASE p%3 WHEN 0 THEN 'AKT1, PKA' WHEN 1 THEN 'unlabeled' END AS kinase_1, CASE WHEN q%2=0 THEN 'PKA' END AS kinase_2 FROM
        (SELECT DISTINCT site_id, CAST(regexp_extract(site_id,'P(\\d+)_(\\d+)',1) AS INT) AS p, CAST(regexp_extract(site_id,'P(\\d+)_(\\d+)',2) AS INT) AS q FROM fx_score)""",
    "sym": "SELECT a, b, max(confidence) AS confidence FROM (SELECT a,b,confidence FROM fx_strong UNION ALL SELECT b,a,confidence FROM fx_strong) WHERE a<>b GROUP BY 1,2",
    "fx_protein": """SELECT 'D'||doc_id AS uniprot_id, upper(source) AS gene, t AS sequence FROM
        (SELECT *, translate(upper(regexp_replace(text,'[^A-Za-z]','','g')),'BJOUXZ','') AS t FROM documents) WHERE length(t)>=15""",
    "fx_site": """SELECT uniprot_id||'_'||(256*k+i) AS site_id, uniprot_id, gene, substr(c,i+7,1) AS residue, 256*k+i AS resno, replace(substr(c,i,15),'-','') AS motif FROM
        (SELECT uniprot_id, gene, k, c, unnest(range(1, length(c)-13)) AS i FROM (SELECT uniprot_id, gene, k, substr(p, 256*k+1, 270) AS c FROM
            (SELECT uniprot_id, gene, '-------'||sequence||'-------' AS p, unnest(range(0, (length(sequence)-1)//256+1)) AS k FROM fx_protein)))
        WHERE substr(c,i+7,1) IN ('S','T','Y')""",
    "fx_motif": """SELECT uniprot_id AS id, rpad(repeat('X', CAST(greatest(0, 8-resno) AS INT))||motif, 15, 'X') AS motif FROM
        (SELECT *, row_number() OVER (PARTITION BY uniprot_id ORDER BY resno) AS r FROM fx_site WHERE residue='Y') WHERE r=1""",
}


def sql(body: str, *names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body
