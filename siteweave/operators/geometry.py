"""Structure geometry over atom tables: neighbour joins and what is computed from them.

``atoms(structure_id, chain, resno, resname, aa, atom, element, x, y, z, bfactor)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.functions.motif import AMINO, accessibility
from siteweave.operators import tiles as T
from siteweave.plans.storage import stored

RESIDUE = ["structure_id", "chain", "resno"]
# Residue properties.
PROPERTIES = {"hydrophobic": "AVLIMFWP", "polar": "STYCNQGH", "positive": "KRH", "negative": "DE", "small": "AGSTCDNPV", "medium": "EQHILM", "large": "FWYKR", "aromatic": "FWYH"}
HYDROXYL = {"S": "OG", "T": "OG1", "Y": "OH"}
RADII = {"C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}


def squared(a: str = "", b: str = "n_") -> Column:
    return sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "xyz"), F.lit(0.0))


def neighbours(centres: DataFrame, atoms: DataFrame, radius: float, same_chain: bool = True) -> DataFrame:
    """Pairs of centres and atoms within ``radius``, by grid cells of that size.

    Every centre looks into its 27 cells: an equi-join, never a product of a structure
    with itself. Atom columns get the prefix ``n_``.
    """
    keys = ["structure_id", "chain"] if same_chain else ["structure_id"]
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    left = centres.withColumn("_s", F.explode(steps))
    left = left.withColumns({f"_{c}": cell(c) + F.col(f"_s.{k}") for c, k in zip("xyz", "ijk", strict=True)}).drop("_s")
    right = atoms.select(*keys, *[F.col(c).alias(f"n_{c}") for c in atoms.columns if c not in keys], *[cell(c).alias(f"_{c}") for c in "xyz"])
    return left.join(right, [*keys, "_x", "_y", "_z"]).drop("_x", "_y", "_z").withColumn("d2", squared()).where(F.col("d2") <= radius * radius)


def residue_plddt(atoms: DataFrame, without_hydrogen: bool = False) -> DataFrame:
    rows = atoms.where("element <> 'H'") if without_hydrogen else atoms
    return rows.groupBy(*RESIDUE).agg(F.avg("bfactor").alias("plddt"))


def centres_of(atoms: DataFrame) -> DataFrame:
    """The CA of every residue, else its first atom by name."""
    order = W.partitionBy(*RESIDUE).orderBy((F.col("atom") != "CA").cast("int"), "atom")
    return atoms.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def neighbour_counts(atoms: DataFrame, radius: float = 10.0, most: int = 30) -> DataFrame:
    """Residues within ``radius`` of each residue's centre, itself left out, and accessibility."""
    counts = T.counted(centres_of(atoms), atoms, radius, {}).withColumnRenamed("_n", "n_neighbours")
    out = atoms.select(*RESIDUE).distinct().join(counts, RESIDUE, "left").fillna(0, ["n_neighbours"])
    return out.withColumn("surface_accessibility", accessibility(F.col("n_neighbours"), most))


def nearest_residues(atoms: DataFrame, n: int = 10, radius: float = 10.0) -> DataFrame:
    """The n nearest residues of each residue, by least atom distance to its centre."""
    centres = centres_of(atoms).select(*RESIDUE, *"xyz")

    def step(state, c, p):
        """For each centre in turn its nearest residues so far: place of the centre, distance, number, letter."""
        p, starts = T.residues(p, "aa")
        first = np.arange(len(p["x"])) if starts is None else starts
        numbers, letters = p["resno"][first], np.array([*p["aa_of"], None], object)[p["aa"][first]]
        state = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, object)) if state is None else state
        bound = np.full(len(c["x"]), np.inf)  # the n-th best, where there are so many
        full = np.flatnonzero(np.bincount(state[0], minlength=len(bound)) >= n)
        bound[full] = state[1][np.flatnonzero(np.diff(state[0], append=-1))[np.searchsorted(np.unique(state[0]), full)]]
        found = [state]
        for some, d2 in T.parts(c, p):
            far, other = ~(d2 <= radius * radius), T.apart(c, p, some)
            d2[far if other is None else far | ~other] = np.inf
            d = np.sqrt(d2 if starts is None else np.minimum.reduceat(d2, starts, axis=1))
            limit = bound[some] if d.shape[1] <= n else np.minimum(bound[some], np.partition(d, n - 1, axis=1)[:, n - 1])
            row, at = np.nonzero((d <= limit[:, None]) & (d < np.inf))
            found.append((row + some.start, d[row, at], numbers[at], letters[at]))
        place, d, number, letter = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort([number, d, place])
        rank = np.arange(len(order)) - np.searchsorted(place[order], place[order])
        return tuple(x[order[rank < n]] for x in (place, d, number, letter))

    def emit(c, state):
        place, d, number, letter = state
        return {"resno": c["resno"][place], "n_resno": number, "n_aa": pa.array(letter, pa.string()), "distance": d}

    points = atoms.select(*RESIDUE, *"xyz", F.col("aa").cast("string").alias("aa"))
    met = T.meet(centres, points, radius, step, emit, "resno long, n_resno long, n_aa string, distance double").drop("n_chain")
    least = T.like(met, centres, "n_resno")
    return least.withColumn("rank", F.row_number().over(W.partitionBy(*RESIDUE).orderBy("distance", "n_resno"))).where(F.col("rank") <= n)


def contact_groups(atoms: DataFrame, radius: float = 5.0) -> DataFrame:
    """Residues in contact by property group."""
    return T.counted(centres_of(atoms), atoms, radius, {f"{k}_count": F.lit(v).contains(F.col("aa")) for k, v in PROPERTIES.items()}, ("aa",)).drop("_n")


def pocket(atoms: DataFrame, radius: float = 10.0) -> DataFrame:
    """Property counts, net charge and ratios of the residues around each residue."""
    out = contact_groups(atoms, radius)
    total = F.greatest(F.lit(1), F.col("hydrophobic_count") + F.col("polar_count"))
    charged = F.col("positive_count") + F.col("negative_count")
    return out.withColumns({"net_charge": F.col("positive_count") - F.col("negative_count"), "hydrophobic_ratio": F.col("hydrophobic_count") / total, "charged_ratio": charged / total})


def hydroxyls(atoms: DataFrame) -> DataFrame:
    return atoms.where(reduce(lambda a, b: a | b, [(F.col("aa") == aa) & (F.col("atom") == name) for aa, name in HYDROXYL.items()]))


def hydroxyl_exposure(atoms: DataFrame, radius: float = 4.0) -> DataFrame:
    """1 / (1 + n/10) for n atoms of other residues around the hydroxyl oxygen; contacts with backbone atoms."""
    own = hydroxyls(atoms)
    near = T.counted(own, atoms, radius, {"backbone_contacts": F.col("atom").isin("N", "CA", "C", "O")}, None).withColumnRenamed("_n", "n")
    out = own.select(*RESIDUE).join(near, RESIDUE, "left").fillna(0, ["n", "backbone_contacts"])
    return out.select(*RESIDUE, (1.0 / (1.0 + F.col("n") / 10.0)).alias("hydroxyl_exposure"), "backbone_contacts")


def hydrogen_bonds(atoms: DataFrame, radius: float = 3.5) -> DataFrame:
    """N and O atoms of other residues within reach of the hydroxyl oxygen."""
    own = hydroxyls(atoms)
    near = T.counted(own, atoms.where(F.col("element").isin("N", "O")), radius, {}, None).withColumnRenamed("_n", "hydrogen_bonds")
    return own.select(*RESIDUE).join(near, RESIDUE, "left").fillna(0, ["hydrogen_bonds"])


def nearest_of_kinds(centres: DataFrame, others: DataFrame, keys: list[str], first: float = 8.0) -> DataFrame:
    """``id, kind, d``: distance of each centre to the nearest other point of every kind among those of its keys.

    ``centres(*keys, id, x, y, z)``, ``others(*keys, id, kind, x, y, z)``. Points lie in grid
    cells as wide as the radius, and a centre looks into its 27 cells for the kinds it still
    misses; what it finds within the radius is the nearest. The radius doubles until nothing
    is missed, so a centre meets few points more than it must, however many there are. A
    kind that no other point of the keys has gives no row.
    """
    sizes = others.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))
    own = others.groupBy(*keys, "id", "kind").agg(F.count(F.lit(1)).alias("own"))
    todo = centres.join(sizes, keys).join(own, [*keys, "id", "kind"], "left").where("n > coalesce(own, 0)").drop("n", "own")
    todo, points = stored(todo, "nearest-todo"), stored(others, "nearest-points")
    radius, parts = first, []
    steps = F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip((i, j, k), "ijk", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    while True:
        cell = lambda c, r=radius: F.floor(F.col(c) / r)
        look = todo.withColumn("_s", F.explode(steps))
        look = look.withColumns({f"_{c}": cell(c) + F.col(f"_s.{k}") for c, k in zip("xyz", "ijk", strict=True)}).drop("_s")
        there = points.select(*keys, "kind", F.col("id").alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in "xyz"], *[cell(c).alias(f"_{c}") for c in "xyz"])
        met = look.join(there, [*keys, "kind", "_x", "_y", "_z"]).where("id <> n_id").groupBy(*keys, "id", "kind").agg(F.min(squared()).alias("d2"))
        met = stored(met.where(F.col("d2") <= radius * radius), "nearest-met")
        parts.append(met)
        todo = stored(todo.join(met, [*keys, "id", "kind"], "left_anti"), "nearest-todo")
        if todo.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, parts).withColumn("d", F.sqrt("d2")).drop("d2")


def nearest_by_type(atoms: DataFrame) -> DataFrame:
    """CA distance to the nearest other residue of each letter and property in its chain."""
    kinds = {k: F.col("aa") == k for k in AMINO} | {k: F.lit(v).contains(F.col("aa")) for k, v in PROPERTIES.items()}
    n, ca = len(kinds), atoms.where("atom = 'CA'").select(*RESIDUE, *"xyz", T.bits(kinds).alias("bits"))

    def step(state, c, p):
        """The least squared distance of each centre to each kind, infinite without any."""
        order = np.argsort(p["bits"], kind="stable")
        p = {k: v[order] if isinstance(v, np.ndarray) else v for k, v in p.items()}
        groups, starts = np.unique(p["bits"], return_index=True)
        of = T.flags(groups, n) > 0
        state = np.full((n, len(c["x"])), np.inf) if state is None else state
        for some, d2 in T.parts(c, p):
            other = T.apart(c, p, some)
            if other is not None:
                d2[~other] = np.inf
            least = np.fmin.reduceat(d2, starts, axis=1)
            for k in np.flatnonzero(of.any(axis=0)):
                state[k, some] = np.fmin(state[k, some], least[:, of[:, k]].min(axis=1))
        return state

    def emit(c, state):
        return {"resno": c["resno"]} | {f"c{k}": state[k] for k in range(n)}

    met = T.meet(ca.drop("bits"), ca, None, step, emit, ", ".join(["resno long", *[f"c{k} double" for k in range(n)]]))
    d = lambda k: F.min(F.when(F.col(f"c{k}") < float("inf"), F.sqrt(f"c{k}")))
    wide = T.like(met.groupBy(*RESIDUE).agg(*[d(k).alias(f"nearest_{name}") for k, name in enumerate(kinds)]), ca)
    several = ca.join(ca.groupBy("structure_id", "chain").agg(F.countDistinct("resno").alias("_n")).where("_n > 1"), ["structure_id", "chain"]).select(*RESIDUE).distinct()  # a residue alone has no row
    return several.join(wide, RESIDUE, "left")


def counts_by_type(atoms: DataFrame, radius: float = 10.0) -> DataFrame:
    kinds = {f"count_{a}": F.col("aa") == a for a in AMINO} | {f"count_{k}": F.lit(v).contains(F.col("aa")) for k, v in PROPERTIES.items()}
    return T.counted(centres_of(atoms), atoms, radius, kinds, ("aa",)).drop("_n")


def secondary_distances(atoms: DataFrame, structure: DataFrame, kinds: tuple[str, ...] = ("helix", "strand", "turn", "coil")) -> DataFrame:
    """Distance in sequence and in space to the nearest residue of each kind.

    ``structure(structure_id, chain, resno, ss_type)``. In sequence the residue itself
    counts and the look goes along its chain both ways; in space it does not.
    """
    ca = atoms.where("atom = 'CA'").join(structure, RESIDUE, "left")
    along = W.partitionBy("structure_id", "chain").orderBy("resno")
    back, ahead = along.rowsBetween(W.unboundedPreceding, 0), along.rowsBetween(0, W.unboundedFollowing)
    seq = ca
    for k in kinds:
        at = F.when(F.col("ss_type") == k, F.col("resno"))
        seq = seq.withColumn(f"seq_{k}", F.least(F.col("resno") - F.last(at, True).over(back), F.first(at, True).over(ahead) - F.col("resno")))
    points = stored(ca.select("structure_id", F.struct("chain", "resno").alias("id"), F.col("ss_type").alias("kind"), "x", "y", "z"), "secondary-points")
    found = nearest_of_kinds(points.drop("kind"), points.where(F.col("kind").isin(*kinds)), ["structure_id"])
    space = found.groupBy("structure_id", "id.chain", "id.resno").agg(*[F.min(F.when(F.col("kind") == k, F.col("d"))).alias(f"spatial_{k}") for k in kinds])
    return seq.select(*RESIDUE, *[f"seq_{k}" for k in kinds]).join(space, RESIDUE, "left")


def half_sphere(atoms: DataFrame, radius: float = 13.0) -> DataFrame:
    """Atoms above and below the plane through CA across CA-CB; a glycine's CB is put opposite to N and C."""
    place = lambda name: F.max(F.when(F.col("atom") == name, F.struct("x", "y", "z"))).alias(name)
    frame = atoms.groupBy(*RESIDUE).agg(*map(place, ("CA", "CB", "N", "C"))).where("CA IS NOT NULL")
    pseudo = lambda c: 2 * F.col(f"CA.{c}") - (F.col(f"N.{c}") + F.col(f"C.{c}")) / 2
    for c in "xyz":
        frame = frame.withColumns({c: F.col(f"CA.{c}"), f"v{c}": F.coalesce(F.col(f"CB.{c}"), pseudo(c)) - F.col(f"CA.{c}")})
    frame = frame.drop("CA", "CB", "N", "C")

    def step(state, c, p):
        state = np.zeros((3, len(c["x"])), np.int64) if state is None else state
        for some, near in T.reached(c, p, None, radius):
            side = sum((p[k][None, :] - c[k][some, None]) * c[f"v{k}"][some, None] for k in "xyz")
            state[0, some] += near.sum(axis=1)
            state[1, some] += (near & (side > 0)).sum(axis=1)
            state[2, some] += (near & (side <= 0)).sum(axis=1)
        return state

    def emit(c, state):
        some = np.flatnonzero(state[0])
        return {"resno": c["resno"][some], "hse_up": state[1, some], "hse_down": state[2, some]}

    met = T.meet(frame, atoms.select(*RESIDUE, *"xyz"), radius, step, emit, "resno long, hse_up long, hse_down long")
    out = T.like(met.groupBy(*RESIDUE).agg(F.sum("hse_up").alias("hse_up"), F.sum("hse_down").alias("hse_down")), frame)
    return out.withColumn("hse_ratio", F.when(F.col("hse_down") > 0, F.col("hse_up") / F.col("hse_down")))


def b_factor_stats(atoms: DataFrame, radius: float = 10.0) -> DataFrame:
    own = residue_plddt(atoms)
    centres = centres_of(atoms).select(*RESIDUE, *"xyz")
    points = atoms.select(*RESIDUE, *"xyz").join(own, RESIDUE).withColumn("known", F.col("plddt").isNotNull().cast("long"))

    def step(state, c, p):
        p, starts = T.residues(p)
        first = slice(None) if starts is None else starts
        known, value = p["known"][first] == 1, p["plddt"][first]
        state = np.zeros((2, len(c["x"]))) if state is None else state
        for some, near in T.reached(c, p, starts, radius):
            near &= known
            state[0, some] += near.sum(axis=1)
            state[1, some] += near @ value if np.isfinite(value).all() else np.where(near, value, 0.0).sum(axis=1)
        return state

    def emit(c, state):
        some = np.flatnonzero(state[0])
        return {"resno": c["resno"][some], "n": state[0, some].astype(np.int64), "total": state[1, some]}

    met = T.meet(centres, points, radius, step, emit, "resno long, n long, total double")
    around = T.like(met.groupBy(*RESIDUE).agg((F.sum("total") / F.sum("n")).alias("neighbour_mean")), centres)
    return own.join(around, RESIDUE, "left").withColumn("ratio", F.when(F.col("neighbour_mean") > 0, F.col("plddt") / F.col("neighbour_mean")))


def _sphere(n: int) -> list[tuple[float, float, float]]:
    k = np.arange(n)
    z, phi = 1 - (2 * k + 1) / n, k * np.pi * (3 - np.sqrt(5))
    r = np.sqrt(1 - z * z)
    return [tuple(map(float, p)) for p in np.column_stack([r * np.cos(phi), r * np.sin(phi), z])]


def accessible_area(atoms: DataFrame, points: int = 100, probe: float = 1.4) -> DataFrame:
    """Solvent-accessible area by points on each atom's sphere that no other atom covers."""
    spark = atoms.sparkSession
    sphere = F.broadcast(spark.createDataFrame([(k, *p) for k, p in enumerate(_sphere(points))], "point int, ux double, uy double, uz double"))
    radius = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RADII.items() for x in kv]), F.col("element")), F.lit(1.7)) + probe
    sized = atoms.select(*RESIDUE, "atom", "x", "y", "z", radius.alias("r"))
    dots = sized.crossJoin(sphere).select(*RESIDUE, "atom", "r", "point", *[(F.col(c) + F.col(f"u{c}") * F.col("r")).alias(c) for c in "xyz"])
    most = probe + max(RADII.values())
    covered = neighbours(dots, sized.withColumnRenamed("chain", "own_chain"), most, same_chain=False).where("NOT (chain = n_own_chain AND resno = n_resno AND atom = n_atom) AND d2 < n_r * n_r").select(*RESIDUE, "atom", "point").distinct()
    free = dots.join(covered, [*RESIDUE, "atom", "point"], "left_anti")
    area = 4 * np.pi * F.col("r") ** 2 / points
    return atoms.select(*RESIDUE).distinct().join(free.groupBy(*RESIDUE).agg(F.sum(area).alias("sasa")), RESIDUE, "left").fillna(0.0, ["sasa"])


def cavity_volume(atoms: DataFrame, radius: float = 6.0, step: float = 1.5, clearance: float = 2.0) -> DataFrame:
    """Free volume around each centre: lattice points in a sphere that no atom is near."""
    grid = np.arange(-radius, radius + step / 2, step)
    lattice = [(k, *map(float, p)) for k, p in enumerate((x, y, z) for x in grid for y in grid for z in grid if x * x + y * y + z * z <= radius * radius)]
    points = F.broadcast(atoms.sparkSession.createDataFrame(lattice, "point int, ux double, uy double, uz double"))
    dots = centres_of(atoms).select(*RESIDUE, "x", "y", "z").crossJoin(points).select(*RESIDUE, "point", *[(F.col(c) + F.col(f"u{c}")).alias(c) for c in "xyz"])
    covered = neighbours(dots, atoms.withColumnRenamed("chain", "own_chain"), clearance, same_chain=False).select(*RESIDUE, "point").distinct()
    free = dots.join(covered, [*RESIDUE, "point"], "left_anti").groupBy(*RESIDUE).agg((F.count(F.lit(1)) * step**3).alias("cavity_volume"))
    return atoms.select(*RESIDUE).distinct().join(free, RESIDUE, "left").fillna(0.0, ["cavity_volume"])


def motif_plddt(residues: DataFrame, w: int = 7, default: float | None = None) -> DataFrame:
    """Mean confidence of residues within ``w`` places in order; zeros do not count."""
    window = W.partitionBy("structure_id", "chain").orderBy("resno").rowsBetween(-w, w)
    mean = F.avg(F.when(F.col("plddt") > 0, F.col("plddt"))).over(window)
    return residues.withColumn("motif_plddt", F.coalesce(mean, F.lit(default)) if default is not None else mean)


def residue_motifs(residues: DataFrame, w: int = 7) -> DataFrame:
    """Letters around every residue in order, X beyond the ends."""
    window = W.partitionBy("structure_id", "chain").orderBy("resno")
    around = [F.coalesce((F.lead("aa", k) if k > 0 else F.lag("aa", -k)).over(window), F.lit("X")) if k else F.col("aa") for k in range(-w, w + 1)]
    return residues.withColumn("motif", F.concat(*around))


def residue_features(atoms: DataFrame) -> DataFrame:
    """One row a residue: confidence, motif, neighbours, exposure, pocket, half-sphere."""
    residues = atoms.select(*RESIDUE, "aa").distinct().join(residue_plddt(atoms), RESIDUE)
    parts = [neighbour_counts(atoms), hydroxyl_exposure(atoms), hydrogen_bonds(atoms), pocket(atoms), half_sphere(atoms)]
    return reduce(lambda a, b: a.join(b, RESIDUE, "left"), parts, residue_motifs(motif_plddt(residues)))


def site_features(atoms: DataFrame, sites: DataFrame) -> DataFrame:
    """Feature rows of requested ``sites(structure_id, chain, resno, motif)``; residues without structure keep NULLs."""
    residues = motif_plddt(residue_plddt(atoms, True)).join(neighbour_counts(atoms, most=50), RESIDUE, "left")
    return sites.join(residues, RESIDUE, "left")


def distances(atoms: DataFrame) -> DataFrame:
    """All CA distances within a structure (i < j)."""
    return _pairs(atoms, None)


def contacts(atoms: DataFrame, radius: float = 8.0) -> DataFrame:
    """Pairs of CA atoms within ``radius``, each once."""
    return _pairs(atoms, radius)


def _pairs(atoms: DataFrame, radius: float | None) -> DataFrame:
    """Pairs of CA atoms of a structure, of which the first comes before the second by chain and number."""
    ca = atoms.where("atom = 'CA'").select(*RESIDUE, *"xyz")

    def step(state, c, p):
        found = []
        for some, d2 in T.parts(c, p):
            near = np.ones(d2.shape, bool) if radius is None else d2 <= radius * radius
            if c["chain"] == p["chain"]:
                near &= c["resno"][some, None] < p["resno"][None, :]
            row, at = np.nonzero(near)
            found.append((c["resno"][some][row], p["resno"][at], np.sqrt(d2[row, at])))
        return found

    def emit(c, state):
        return {name: np.concatenate(x) for name, x in zip(("resno", "n_resno", "distance"), zip(*state, strict=True), strict=True)}

    met = T.meet(ca, ca, radius, step, emit, "resno long, n_resno long, distance double", same_chain=False, once=True)
    return T.like(met, ca, "n_resno").select("structure_id", "chain", "resno", "n_chain", "n_resno", "distance")


def domains(atoms: DataFrame, radius: float = 8.0) -> DataFrame:
    """Residues by connected component of their structure's contact graph, the largest component first."""
    from siteweave.operators.graph import components

    name = lambda chain, resno: F.concat_ws("\x1f", "structure_id", chain, F.col(resno).cast("string"))
    near = contacts(atoms, radius)
    labels = components(near.select(name("chain", "resno").alias("a"), name("n_chain", "n_resno").alias("b"), F.lit(1.0).alias("confidence")))
    residues = atoms.where("atom = 'CA'").select(*RESIDUE).distinct().withColumn("node", name("chain", "resno"))
    placed = residues.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    sizes = placed.groupBy("structure_id", "component").agg(F.count(F.lit(1)).alias("n_residues"))
    order = W.partitionBy("structure_id").orderBy(F.desc("n_residues"), "component")
    return placed.join(sizes.withColumn("domain", F.row_number().over(order)), ["structure_id", "component"]).drop("component")


def pca(atoms: DataFrame) -> DataFrame:
    """Eigenvalues and explained shares of each structure's CA coordinates, greatest first."""
    names = [a + b for k, a in enumerate("xyz") for b in "xyz"[k:]]
    moments = atoms.where("atom = 'CA'").groupBy("structure_id").agg(*[F.covar_samp(n[0], n[1]).alias(n) for n in names])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.fillna(0.0).itertuples(index=False):
                m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
                values, vectors = np.linalg.eigh(m)
                total = values.sum() or 1.0
                rows += [(r.structure_id, k, float(values[2 - k]), float(values[2 - k] / total), [float(v) for v in vectors[:, 2 - k]]) for k in range(3)]
            yield pd.DataFrame(rows, columns=["structure_id", "component", "eigenvalue", "explained", "axis"])

    return moments.mapInPandas(solve, f"structure_id {dict(atoms.dtypes)['structure_id']}, component int, eigenvalue double, explained double, axis array<double>")


def pca_projection(atoms: DataFrame) -> DataFrame:
    """Each CA on the principal axes of its structure: ``structure_id, chain, resno, pc1, pc2, pc3``, centred.

    The axes, three a structure, are joined back to the coordinates. An axis points to
    where its largest part (the first of equal ones) is positive.
    """
    ca = atoms.where("atom = 'CA'").select(*RESIDUE, "x", "y", "z")
    size = lambda i: F.abs(F.get("axis", F.lit(i)))
    lead = F.when((size(0) >= size(1)) & (size(0) >= size(2)), F.get("axis", F.lit(0))).when(size(1) >= size(2), F.get("axis", F.lit(1))).otherwise(F.get("axis", F.lit(2)))
    signed = pca(atoms).select("structure_id", "component", F.transform("axis", lambda v: v * F.signum(lead)).alias("axis"))
    axes = signed.groupBy("structure_id").agg(*[F.max(F.when(F.col("component") == k, F.col("axis"))).alias(f"axis{k}") for k in range(3)])
    means = ca.groupBy("structure_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    on = lambda k: sum(((F.col(c) - F.col(f"m{c}")) * F.get(f"axis{k}", F.lit(i)) for i, c in enumerate("xyz")), F.lit(0.0))
    return ca.join(means, "structure_id").join(axes, "structure_id").select(*RESIDUE, *[on(k).alias(f"pc{k + 1}") for k in range(3)])


def rotations(pairs: DataFrame) -> DataFrame:
    """The best rotation of b onto a for each ``pair_id, ax..az, bx..bz``: ``n, rmsd, tm_score, rotation`` (rows of the matrix in turn).

    Only the 3x3 moments of each pair are moved; the rotation's trace gives the RMSD.
    """
    sums = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"a{i}", f"b{j}").alias(f"c{i}{j}") for i in "xyz" for j in "xyz"], sum((F.var_pop(f"{s}{i}") for s in "ab" for i in "xyz"), F.lit(0.0)).alias("spread"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c = np.array([[getattr(r, f"c{i}{j}") for j in "xyz"] for i in "xyz"])
                u, s, v = np.linalg.svd(c)
                sign = np.sign(np.linalg.det(u) * np.linalg.det(v)) or 1.0
                rotation = u @ np.diag([1.0, 1.0, sign]) @ v  # of b's coordinates onto a's
                rmsd = float(np.sqrt(max(0.0, r.spread - 2 * (s[0] + s[1] + sign * s[2]))))
                d0 = max(0.5, 1.24 * max(0.0, r.n - 15) ** (1 / 3) - 1.8)
                rows.append((r.pair_id, int(r.n), rmsd, 1 / (1 + (rmsd / d0) ** 2), rotation.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["pair_id", "n", "rmsd", "tm_score", "rotation"])

    return sums.mapInPandas(solve, f"pair_id {dict(pairs.dtypes)['pair_id']}, n long, rmsd double, tm_score double, rotation array<double>")


def superposition(pairs: DataFrame) -> DataFrame:
    """RMSD and a simple TM score after the best rotation of ``pair_id, ax..az, bx..bz`` rows."""
    return rotations(pairs).drop("rotation")


def residue_deviations(pairs: DataFrame, residue: str = "resno") -> DataFrame:
    """``pair_id, resno, deviation``: how far each residue of b lies from its partner after the best rotation.

    The rotation and both centres, a row a pair, are joined back to the coordinates.
    """
    means = pairs.groupBy("pair_id").agg(*[F.avg(f"{s}{c}").alias(f"m{s}{c}") for s in "ab" for c in "xyz"])
    placed = pairs.join(means, "pair_id").join(rotations(pairs).select("pair_id", "rotation"), "pair_id")
    b = [F.col(f"b{c}") - F.col(f"mb{c}") for c in "xyz"]
    turned = [sum((F.get("rotation", F.lit(3 * i + j)) * b[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    off = sum(((F.col(f"a{c}") - F.col(f"ma{c}") - turned[i]) ** 2 for i, c in enumerate("xyz")), F.lit(0.0))
    return placed.select("pair_id", residue, F.sqrt(off).alias("deviation"))


def library_summary(features: DataFrame, group: str) -> DataFrame:
    """Counts and shares of residues by a column, with means and medians of their features."""
    out = features.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("plddt").alias("mean_plddt"), F.median("plddt").alias("median_plddt"), F.avg("hse_ratio").alias("mean_hse_ratio"), F.median("hse_ratio").alias("median_hse_ratio"))
    total = features.agg(F.count(F.lit(1)).alias("_total"))
    return out.crossJoin(F.broadcast(total)).withColumn("percent", F.col("n") * 100.0 / F.col("_total")).drop("_total")
