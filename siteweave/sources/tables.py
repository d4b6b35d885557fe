"""Sources and sinks: tables, structures, protein records, restartable and guarded writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteweave.functions.motif import normalized_text

# Three-letter residue names.
THREE = dict(zip("ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split(), "ACDEFGHIKLMNPQRSTVWY", strict=True))


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON, CSV (header) or feather by suffix. Feather is read file by file in tasks."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("feather", "arrow"):
        return read_feather(spark, path, schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "gz", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("quote", '"').csv(path)
    return getattr(reader, {"orc": "orc", "json": "json", "jsonl": "json"}.get(kind, "parquet"))(path)


def read_either(spark: SparkSession, base: str, schema: StructType | str, kinds: tuple[str, ...] = ("feather", "parquet")) -> DataFrame:
    """The first of ``base.feather``, ``base.parquet`` that is there."""
    from pyspark.errors import AnalysisException

    for kind in kinds[:-1]:
        try:
            spark.read.format("binaryFile").load(f"{base}.{kind}")
        except AnalysisException:  # no such path
            continue
        return read_table(spark, f"{base}.{kind}", schema)
    return read_table(spark, f"{base}.{kinds[-1]}", schema)


def read_feather(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Arrow files to rows, one task a file; convert to Parquet once for repeated use."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.feather as feather

        for pdf in batches:
            for content in pdf["content"]:
                yield feather.read_feather(io.BytesIO(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def named_by_position(table: DataFrame, *names: str) -> DataFrame:
    """First columns under canonical names; the others go."""
    return table.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(table.columns, names, strict=False)])


def sequence_edges(table: DataFrame) -> DataFrame:
    return named_by_position(table, "id1", "id2", "similarity").withColumn("similarity", F.col("similarity").cast("double"))


def kinase_scores(table: DataFrame) -> DataFrame:
    """The first column becomes ``site_id``."""
    return table.withColumnRenamed(table.columns[0], "site_id")


def without_index(table: DataFrame) -> DataFrame:
    """CSV index columns dropped (unnamed first column)."""
    return table.drop(*[c for c in table.columns if c in ("_c0", "") or c.startswith("Unnamed:")])


def motif_list(table: DataFrame, column: str = "Fourmer") -> DataFrame:
    return table.select(F.col(column).alias("motif"))


def read_pairs_h5(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """Compound (id1, id2, similarity) datasets in row ranges; needs h5py on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import h5py

        for pdf in batches:
            for content in pdf["content"]:
                with h5py.File(io.BytesIO(content)) as file:
                    data = file[next(iter(file))]
                    for at in range(0, len(data), rows):
                        part = data[at : at + rows]
                        text = lambda c: [x.decode("utf-8") if isinstance(x, bytes) else x for x in c]
                        yield pd.DataFrame({"id1": text(part[part.dtype.names[0]]), "id2": text(part[part.dtype.names[1]]), "similarity": part[part.dtype.names[2]].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "id1 string, id2 string, similarity double")


def structure_files(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One file a structure, CIF before PDB; the id comes from the file name."""
    name = F.element_at(F.split("path", "/"), -1)
    model = F.regexp_extract(name, r"AF-(.*?)-F", 1)
    files = spark.read.format("binaryFile").load(path).select("path", F.when(model != "", model).otherwise(F.regexp_extract(name, r"^([^.]+)", 1)).alias("structure_id"), F.lower(name).contains(".cif").alias("is_cif"))
    best = files.withColumn("_n", F.row_number().over(W.partitionBy("structure_id").orderBy(F.desc("is_cif"), "path"))).where("_n = 1").drop("_n")
    return best.orderBy("structure_id").limit(limit) if limit is not None else best


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of PDB text ``structure_id, value`` by fixed columns; hetero atoms are marked."""
    cut = lambda start, n: F.trim(F.substring("value", start, n))
    rows = lines.where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    atoms = rows.select(
        "structure_id", cut(22, 1).alias("chain"), cut(23, 4).cast("int").alias("resno"), cut(18, 3).alias("resname"), cut(13, 4).alias("atom"),
        F.when(cut(77, 2) != "", cut(77, 2)).otherwise(F.regexp_extract(cut(13, 4), "([A-Z])", 1)).alias("element"),
        cut(31, 8).cast("double").alias("x"), cut(39, 8).cast("double").alias("y"), cut(47, 8).cast("double").alias("z"), cut(61, 6).cast("double").alias("bfactor"),
        F.col("value").startswith("HETATM").alias("hetero"),
    )
    table = F.create_map(*[F.lit(x) for kv in THREE.items() for x in kv])
    return atoms.withColumn("aa", F.coalesce(F.element_at(table, F.col("resname")), F.lit("X")))


def plddt(atoms: DataFrame, last_atom: bool = False) -> DataFrame:
    """B-factor of each residue: mean of its atoms, or the last atom's as the PDB path has it."""
    value = F.max_by("bfactor", "atom") if last_atom else F.avg("bfactor")
    return atoms.groupBy("structure_id", "chain", "resno").agg(value.alias("plddt"))


def secondary_structure(files: DataFrame) -> DataFrame:
    """Helix and strand residues of mmCIF texts ``structure_id, content``, a row a residue."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for sid, text in zip(pdf["structure_id"], pdf["content"], strict=True):
                names: list[str] = []
                for line in (text or "").splitlines():
                    if line.startswith(("loop_", "#")):
                        names = []
                    elif line.startswith(("_struct_conf.", "_struct_sheet_range.")):
                        names.append(line.split()[0])
                    elif names and not line.startswith("_"):
                        row = dict(zip([n.split(".")[1] for n in names], line.split(), strict=False))
                        if {"beg_auth_asym_id", "beg_auth_seq_id", "end_auth_seq_id"} <= row.keys() and row["beg_auth_seq_id"].lstrip("-").isdigit() and row["end_auth_seq_id"].lstrip("-").isdigit():
                            code = row.get("conf_type_id", "STRN").upper()
                            kind = "helix" if code.startswith("HELX") else "turn" if code.startswith("TURN") else "strand" if code.startswith("STRN") else "coil"
                            found.append((sid, row["beg_auth_asym_id"], int(row["beg_auth_seq_id"]), int(row["end_auth_seq_id"]), kind))
            yield pd.DataFrame(found, columns=["structure_id", "chain", "start", "stop", "ss_type"])

    rows = files.select("structure_id", F.col("content").cast("string").alias("content")).mapInPandas(ranges, "structure_id string, chain string, start int, stop int, ss_type string")
    return rows.where("start <= stop").select("structure_id", "chain", F.explode(F.sequence("start", "stop")).alias("resno"), "ss_type").groupBy("structure_id", "chain", "resno").agg(F.min("ss_type").alias("ss_type"))


def chain_summary(atoms: DataFrame) -> DataFrame:
    """Residues, atoms and sequence of every chain."""
    residues = atoms.groupBy("structure_id", "chain", "resno").agg(F.min("aa").alias("aa"), F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("resno", "aa")))
    return residues.groupBy("structure_id", "chain").agg(F.count(F.lit(1)).alias("n_residues"), F.sum("n").alias("n_atoms"), F.concat_ws("", F.transform(listed, lambda r: r["aa"])).alias("sequence"))


def coordinates(atoms: DataFrame, atom: str = "CA", chain: str | None = None, hetero: bool = False) -> DataFrame:
    out = atoms.where(F.col("atom") == atom)
    out = out.where(F.col("chain") == chain) if chain is not None else out
    out = out.where("NOT hetero") if not hetero and "hetero" in atoms.columns else out
    return out.select("structure_id", "chain", "resno", "x", "y", "z")


def known_phosphosites(lines: DataFrame) -> DataFrame:
    """Sites of UniProt text ``acc, line_no, line``: a MOD_RES line and the note on the next."""
    following = F.lead("line").over(W.partitionBy("acc").orderBy("line_no"))
    text = F.concat_ws(" ", "line", following)
    kind = F.when(text.contains("Phosphoserine"), "S").when(text.contains("Phosphothreonine"), "T").when(text.contains("Phosphotyrosine"), "Y")
    rows = lines.withColumn("kind", kind).where(F.col("line").rlike(r"^FT\s+MOD_RES") & F.col("kind").isNotNull())
    return rows.select("acc", F.regexp_extract("line", r"MOD_RES\s+(\d+)", 1).cast("int").alias("resno"), "kind").where("resno IS NOT NULL").distinct()


def gene_to_accession(proteins: DataFrame, genes: DataFrame, organism: str = "Homo sapiens") -> DataFrame:
    """First reviewed entry of each gene in an organism; the first secondary accession as fallback.

    ``proteins(uniprot_id, gene, organism, entry_type, secondary)``, ``genes(gene)``.
    """
    rows = proteins.where(F.col("organism") == organism).withColumn("gene", F.upper("gene")).join(genes.select(F.upper("gene").alias("gene")).distinct(), "gene", "left_semi")
    order = W.partitionBy("gene").orderBy(F.when(F.lower("entry_type").contains("unreviewed"), 1).otherwise(0), "uniprot_id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("gene", F.upper(F.coalesce("uniprot_id", F.get("secondary", F.lit(0)))).alias("uniprot_id"))


def protein_records(raw: DataFrame) -> DataFrame:
    """Flat records of UniProt JSON rows."""
    return raw.select(
        F.upper("primaryAccession").alias("uniprot_id"), F.get("genes", F.lit(0))["geneName"]["value"].alias("gene"),
        F.col("proteinDescription.recommendedName.fullName.value").alias("name"), F.col("sequence.value").alias("sequence"),
    )


def ingest_text(table: DataFrame, *columns: str) -> DataFrame:
    """Empty text and ``unlabeled`` become NULL in the given columns."""
    return table.withColumns({c: normalized_text(F.col(c)) for c in columns})


def annotation_import(table: DataFrame) -> DataFrame:
    """Annotations with their derived id; missing text as an empty string."""
    out = table.withColumn("PhosphositeID", F.concat_ws("_", "UniProtID", F.col("ResidueNumber").cast("string")))
    return out.fillna("", [f.name for f in out.schema if f.dataType.simpleString() == "string"])


def cast_columns(table: DataFrame, types: dict[str, str]) -> DataFrame:
    return table.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in table.columns])


def require_columns(table: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in table.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return table


def write_edges_csv(edges: DataFrame, path: str) -> None:
    require_columns(edges, "id1", "id2", "similarity").write.option("header", True).option("quoteAll", True).csv(path)


SHEET_ROWS = 1_048_575  # that a spreadsheet holds below its header


def write_table(table: DataFrame, path: str, kind: str = "parquet") -> int:
    """Write Parquet, ORC, JSON or CSV, or ``sheet``: CSV in one file for a spreadsheet, refused beyond its rows. Returns the rows."""
    n = table.count()
    if kind == "sheet":
        if n > SHEET_ROWS:
            raise ValueError(f"{n} rows do not fit into a spreadsheet of {SHEET_ROWS}")
        table.coalesce(1).write.option("header", True).csv(path)
    elif kind == "csv":
        table.write.option("header", True).option("quoteAll", True).csv(path)
    else:
        table.write.format(kind).save(path)
    return n


def rebuild_edges(spark: SparkSession, path: str, name: str) -> int:
    """Replace the edge table ``name`` by a CSV file's rows, with inferred types."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return replace_table(sequence_edges(require_columns(rows, *rows.columns[:3])), name)


def write_bucketed(table: DataFrame, path: str, bucket: str = "bucket") -> None:
    """Partitioned output of which a later run replaces only the buckets that it makes."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def unfinished(work: DataFrame, done: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Work whose bucket the sink does not hold yet."""
    return work.join(done.select(bucket).distinct(), bucket, "left_anti")


def replace_table(table: DataFrame, name: str) -> int:
    """Write a new version beside a table, refuse an empty one, then swap; the old one stays as backup."""
    spark = table.sparkSession
    table.write.mode("overwrite").saveAsTable(f"{name}_new")
    n = spark.table(f"{name}_new").count()
    if not n:
        spark.sql(f"DROP TABLE {name}_new")
        raise ValueError(f"{name}: the new version has no rows")
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {name}_backup")
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_backup")
    spark.sql(f"ALTER TABLE {name}_new RENAME TO {name}")
    return n


def verify_load(table: DataFrame, values: list[str], sample: int = 3, seed: int = 7) -> tuple[int, int, DataFrame]:
    """Columns, rows, and the best of some value columns for a few random rows."""
    best = F.greatest(*[F.col(f"`{v}`") for v in values]) if len(values) > 1 else F.col(f"`{values[0]}`")
    name = F.coalesce(*[F.when(F.col(f"`{v}`") == best, F.lit(v)) for v in values])
    return len(table.columns), table.count(), table.orderBy(F.rand(seed)).limit(sample).withColumns({"best_value": best, "best_column": name})


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_rows(table: DataFrame, n: int = 5) -> DataFrame:
    return table.limit(n)
