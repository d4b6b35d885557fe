"""Points near each other within a structure, tile by tile, without a row for every pair.

A chain is cut by residue numbers into tiles of ``TILE``, each packed into one row. Tiles of
centres meet the tiles of points whose box comes within the radius, and a task works on the
arrays of two tiles at a time. Only what an operator asks of a centre is shuffled again, and
what a task holds at once is bounded by groups of tiles. The work still grows with the
square of what lies within the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.plans.storage import stored

KEYS = ["structure_id", "chain"]
TILE = 512  # residue numbers of a tile
LEFT, RIGHT = 16, 64  # tiles of centres and of points that share a join key
CELLS = 1 << 17  # pairs whose distances are held at once
MOST_TASKS = 2000


def tiled(points: DataFrame) -> DataFrame:
    """Tiles of ``points(structure_id, chain, resno, x, y, z, ...)`` in order of residues, one binary a column and the box around them.

    Texts are packed as places in a list of their own, NULLs of doubles as NaN. Points
    without keys, number or coordinates are near nothing and left out.
    """
    kinds = {c: "text" if t == "string" else "f8" if t in ("double", "float") or c in "xyz" else "i8" for c, t in points.dtypes if c not in KEYS}
    usable = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in (*KEYS, "resno", *"xyz")])
    cast = {c: F.col(c).cast("double" if k == "f8" else "long") for c, k in kinds.items() if k != "text"}
    rows = points.where(usable).withColumns(cast).withColumn("tile", F.floor(F.col("resno") / TILE))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("resno", kind="stable")
        out = {k: [pdf[k].iloc[0]] for k in (*KEYS, "tile")}
        for c, kind in kinds.items():
            if kind == "text":
                codes, of = pd.factorize(pdf[c])
                out |= {c: [codes.astype("i8").tobytes()], f"{c}_of": [list(of)]}
            else:
                out[c] = [pdf[c].to_numpy(kind).tobytes()]
        out |= {f"{side}_{c}": [float(getattr(pdf[c], side)())] for c in "xyz" for side in ("min", "max")}
        return pd.DataFrame(out)

    types = dict(points.dtypes)
    columns = [*[f"{k} {types[k]}" for k in KEYS], "tile long", *[f"{c} binary{f', {c}_of array<string>' if k == 'text' else ''}" for c, k in kinds.items()], *[f"{side}_{c} double" for c in "xyz" for side in ("min", "max")]]
    return rows.groupBy(*KEYS, "tile").applyInPandas(pack, ", ".join(columns))


def _apart() -> Column:
    """The squared distance of two tiles' boxes."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"n_min_{c}") - F.col(f"max_{c}"), F.col(f"min_{c}") - F.col(f"n_max_{c}"))
    return sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0))


def meet(centres: DataFrame, points: DataFrame, radius: float | None, step: Callable, emit: Callable, schema: str, same_chain: bool = True, once: bool = False) -> DataFrame:
    """``*KEYS, n_chain`` and the columns of ``schema``, from every tile of centres and the tiles of points it meets.

    ``step(state, c, p)`` takes the arrays of two tiles (dicts by column) and gives the new
    state of the centres, which begins with None for each tile; ``emit(c, state)`` gives the
    columns. States of one tile of centres may come out in several parts, which the caller
    puts together. With ``once`` no state goes from one tile of points to the next, and of
    two tiles only one meets the other; ``n_chain`` is right only then or with ``same_chain``.
    """
    on = KEYS if same_chain else KEYS[:1]
    rest = [k for k in KEYS if k not in on]
    left, right = stored(tiled(centres), "tile-centres"), stored(tiled(points), "tile-points")
    left = left.withColumn("_g", F.xxhash64(*rest, F.floor(F.col("tile") / LEFT)))
    right = right.withColumn("_h", F.xxhash64(*rest, F.floor(F.col("tile") / RIGHT)))
    right = right.withColumnsRenamed({c: f"n_{c}" for c in right.columns if c not in (*on, "_h")})
    lefts, rights = left.select(*on, "_g").distinct(), right.select(*on, "_h").distinct()
    tasks = max(1, min(MOST_TASKS, lefts.join(rights, on).count()))
    keys = [*on, "_g", "_h"]
    both = left.join(rights, on).repartition(tasks, *keys).hint("merge").join(right.join(lefts, on).repartition(tasks, *keys), keys)
    if radius is not None:
        both = both.where(_apart() <= radius * radius * (1 + 1e-9) + 1e-9)
    if once:
        both = both.where("n_tile >= tile" if same_chain else "chain < n_chain OR (chain = n_chain AND n_tile >= tile)")
    if same_chain:
        both = both.withColumn("n_chain", F.col("chain"))
    names = {"": [c for c in left.columns if c not in (*KEYS, "_g")], "n_": [c[2:] for c in right.columns if c.startswith("n_") and c != "n_chain"]}
    names = {side: [c for c in cs if not c.startswith(("min_", "max_"))] for side, cs in names.items()}
    texts = {side: {c for c in cs if f"{c}_of" in cs} for side, cs in names.items()}
    wanted = [*KEYS, "n_chain", *[f"{side}{c}" for side, cs in names.items() for c in cs]]
    floats = {side: {c for c, t in df.dtypes if t in ("double", "float") or c in "xyz"} for side, df in (("", centres), ("n_", points))}

    def load(batch: pa.RecordBatch, k: int, side: str) -> dict:
        out = {"chain": batch.column(f"{side}chain")[k].as_py()}
        for c in names[side]:
            cell = batch.column(f"{side}{c}")[k]
            if c == "tile" or c.endswith("_of") and c[:-3] in texts[side]:
                out[c] = cell.as_py()
            else:
                out[c] = np.frombuffer(cell.as_buffer(), "f8" if c in floats[side] else "i8")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, c, state = None, None, None, None

        def done():
            columns = emit(c, state)
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([*[pa.repeat(v, n) for v in head], *[pa.array(v) for v in columns.values()]], [*KEYS, "n_chain", *columns])

        for batch in batches:
            for k in range(batch.num_rows):
                here = (*[batch.column(key)[k].as_py() for key in KEYS], batch.column("tile")[k].as_py())
                if here != at:
                    if at is not None and not once:
                        yield done()
                    at, head, c, state = here, [batch.column(key)[k] for key in KEYS] + [batch.column("n_chain")[k]], load(batch, k, ""), None
                state = step(state, c, load(batch, k, "n_"))
                if once:
                    head[2] = batch.column("n_chain")[k]
                    yield done()
                    state = None
        if at is not None and not once:
            yield done()

    types = dict(centres.dtypes)
    return both.select(*wanted).mapInArrow(run, f"structure_id {types['structure_id']}, chain {types['chain']}, n_chain {types['chain']}, {schema}")


def parts(c: dict, p: dict) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of a tile's centres to all points of another, so many centres at a time that they stay few."""
    width = max(1, CELLS // max(1, len(p["x"])))
    for lo in range(0, len(c["x"]), width):
        some = slice(lo, lo + width)
        total = None
        for k in "xyz":
            off = c[k][some, None] - p[k][None, :]
            off *= off
            total = off if total is None else np.add(total, off, out=total)
        yield some, total


def apart(c: dict, p: dict, some: slice) -> np.ndarray | None:
    """Which points are of another residue number than the centre; None where all are."""
    if c["resno"].max() < p["resno"].min() or p["resno"].max() < c["resno"].min():
        return None
    return c["resno"][some, None] != p["resno"][None, :]


def residues(p: dict, *by: str) -> tuple[dict, np.ndarray | None]:
    """The points in order of their residues (and of ``by``), and where each residue begins; None where each has one point."""
    if by:
        order = np.lexsort([*[p[c] for c in reversed(by)], p["resno"]])
        p = {c: v[order] if isinstance(v, np.ndarray) else v for c, v in p.items()}
    new = np.ones(len(p["resno"]), bool)
    if len(new) > 1:
        new[1:] = reduce(np.logical_or, [p[c][1:] != p[c][:-1] for c in ("resno", *by)])
    return p, None if new.all() else np.flatnonzero(new)


def reached(c: dict, p: dict, starts: np.ndarray | None, radius: float) -> Iterator[tuple[slice, np.ndarray]]:
    """For some centres at a time: which residues (or points, without ``starts``) have a point within the radius."""
    for some, d2 in parts(c, p):
        near = d2 <= radius * radius
        other = apart(c, p, some)
        if other is not None:
            near &= other
        yield some, near if starts is None else np.logical_or.reduceat(near, starts, axis=1)


def bits(kinds: dict[str, Column]) -> Column:
    """Which kinds a point is of, as the bits of a whole number."""
    return sum((F.when(cond, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, cond in enumerate(kinds.values())), F.lit(0).cast("long"))


def flags(of: np.ndarray, n: int) -> np.ndarray:
    return (of[:, None] >> np.arange(n) & 1).astype(np.float32)


def counted(centres: DataFrame, points: DataFrame, radius: float, kinds: dict[str, Column], by: tuple[str, ...] | None = ()) -> DataFrame:
    """``*KEYS, resno, _n`` and the count of each kind: the other residues of the chain with a point within ``radius``.

    A residue is a number (and values of ``by``); with None every point counts. Centres without any have no row.
    """
    names = list(kinds)
    points = points.select(*KEYS, "resno", *"xyz", *(by or ()), bits(kinds).alias("bits"))

    def step(state, c, p):
        p, starts = residues(p, *by) if by is not None else (p, None)
        weights = np.column_stack([np.ones(len(p["x"]), np.float32), flags(p["bits"], len(names))])
        weights = weights if starts is None else weights[starts]
        state = np.zeros((len(c["x"]), len(names) + 1), np.int64) if state is None else state
        for some, near in reached(c, p, starts, radius):
            state[some] += (near.astype(np.float32) @ weights).astype(np.int64)  # whole numbers, exact as single floats
        return state

    def emit(c, state):
        some = np.flatnonzero(state[:, 0])
        return {"resno": c["resno"][some]} | {f"c{k}": np.ascontiguousarray(state[some, k]) for k in range(len(names) + 1)}

    met = meet(centres.select(*KEYS, "resno", *"xyz"), points, radius, step, emit, ", ".join(["resno long", *[f"c{k} long" for k in range(len(names) + 1)]]))
    sums = met.groupBy(*KEYS, "resno").agg(*[F.sum(f"c{k}").alias(name) for k, name in enumerate(["_n", *names])])
    return like(sums, centres)


def like(found: DataFrame, centres: DataFrame, *columns: str) -> DataFrame:
    """Residue numbers in the type that they had."""
    kind = dict(centres.dtypes)["resno"]
    return found.withColumns({c: F.col(c).cast(kind) for c in ("resno", *columns)})
