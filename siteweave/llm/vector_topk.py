"""Operator 2: exact top-k inner products over norm-sorted blocks.

Vectors are cut into bands of descending length and the bands into blocks of bounded
size. Every query first meets the longest vectors and so gets a score that its k-th best
can't fall below. A block of queries then meets only the blocks whose greatest length
could still reach it. Inside a pair of blocks, candidates come in runs of descending length.
Coordinates rotated by the singular vectors of all data give partial sums, level by level;
after each level a pair goes on only if its sum so far plus the product of the residual
lengths (Cauchy-Schwarz) reaches the bound. After each run the bound rises to the k-th best
score that the query has met. Scores are exact integers; bounds carry a slack above
rounding error.

Cases: vectors that are null or hold null, NaN or infinite components take no part, nor
do rows without id; shorter vectors count as padded with zeros; ties go to the smaller
id; rows that share an id are queries and candidates each by itself; a query gets all candidates if
there are fewer than k; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteweave.llm.shared import stored

BANDS = 64
BLOCK_ROWS = 4096  # mean candidates of a block
QUERY_ROWS = 1024  # most queries of a block
HEAD_ROWS = 2048  # longest vectors, which set the first bounds
LEVELS = (0.25, 0.5, 0.75)  # shares of the rotated coordinates after which pairs are looked at
RUN_ROWS = 512  # candidates of a run, after which bounds rise
DENSE = 0.05  # share of surviving pairs above which a run's products are all computed
GROUP = 64  # query blocks that a task meets with a candidate block
SAFE = 1 << 53
SCHEMA = "query_id long, query_row long, vec_id long, vec_row long, score long"


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """``vec_id, row, v array<long>, norm2 double``: floor(factor * x) of all usable vectors."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * factor).cast("long"))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), v.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _kind(most: int) -> type:
    """The narrowest whole-number type for sizes up to ``most``: blocks are copied to every block they meet."""
    return next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while no sum can leave their exact range."""
    if a.size == 0 or b.size == 0 or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < SAFE:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of outer products: width squared numbers, whatever the number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            m = _matrix(pdf["v"], width).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(width), width), "j": np.tile(np.arange(width), width), "x": total.ravel()})

    out = np.zeros((width, width))
    for r in vectors.select("v").mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r.i, r.j] = r.x
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score first, ties to the smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def survivors(q: np.ndarray, c: np.ndarray, bound: np.ndarray, levels: tuple[float, ...] = LEVELS) -> np.ndarray:
    """Which pairs of rotated queries and candidates can reach the queries' bounds, looked at level by level."""
    width = q.shape[1]
    alive = np.ones((len(q), len(c)), bool)
    partial = np.zeros((len(q), len(c)))
    rest_q, rest_c = (q**2).sum(axis=1), (c**2).sum(axis=1)
    slack = 1e-9 * np.sqrt(rest_q)[:, None] * np.sqrt(rest_c.max(initial=0.0)) + 1e-6
    done = 0
    for stop in sorted({max(1, int(width * x)) for x in levels}):
        some_q, some_c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(some_q):
            break
        partial[np.ix_(some_q, some_c)] += q[some_q, done:stop] @ c[some_c, done:stop].T
        rest_q, rest_c = rest_q - (q[:, done:stop] ** 2).sum(axis=1), rest_c - (c[:, done:stop] ** 2).sum(axis=1)
        most = partial + np.sqrt(np.maximum(rest_q, 0))[:, None] * np.sqrt(np.maximum(rest_c, 0)) + slack
        alive &= most >= bound[:, None]
        done = stop
    return alive


def top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of every query row."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors), "vectors")
    n, width, least, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    width, kind = max(1, width or 0), _kind(max(-(least or 0), most or 0))
    rotation = np.linalg.eigh(gram(rows, width))[1][:, ::-1] if n else np.eye(width)

    # Bands of descending length; a band that one length fills is cut by id like any other.
    cuts = sorted(set(rows.agg(F.percentile_approx("norm2", [b / BANDS for b in range(1, BANDS)], 10_000)).first()[0] or []), reverse=True)
    band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("norm2"))) if cuts else F.lit(0)
    banded = rows.withColumn("band", band)
    facts = {r.band: (r.n, r.longest) for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("longest")).collect()}  # a row a band
    blocks = [(b, sub, -(-c // BLOCK_ROWS), top) for b, (c, top) in sorted(facts.items()) for sub in range(-(-c // BLOCK_ROWS))]
    merged: list[tuple[int, int, int, int, float]] = []  # small bands next to each other share a block
    held = 0
    for b, sub, subs, top in blocks:
        c = facts[b][0] / subs
        if merged and subs == 1 and merged[-1][2] == 1 and held + c <= BLOCK_ROWS:
            merged.append((b, sub, subs, merged[-1][3], merged[-1][4]))
            held += c
        else:
            merged.append((b, sub, subs, merged[-1][3] + 1 if merged else 0, top))
            held = c
    table = spark.createDataFrame([(b, sub, subs, block) for b, sub, subs, block, _ in merged], "band int, sub int, subs int, block int")
    tops = dict((block, top) for *_, block, top in merged)  # greatest squared length in a block

    head = rows.orderBy(F.desc("norm2"), "vec_id").limit(HEAD_ROWS).select("row", "v").toPandas()  # HEAD_ROWS at most
    head_rows, head_matrix = head["row"].to_numpy(np.int64), _matrix(head["v"], width)
    lengths = np.sqrt(np.array([tops[b] for b in sorted(tops)] or [0.0]))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), QUERY_ROWS):
                part = pdf.iloc[at : at + QUERY_ROWS]
                ids, own, q = part["vec_id"].to_numpy(np.int64), part["row"].to_numpy(np.int64), _matrix(part["v"], width)
                scores = _products(q, head_matrix)
                bound = np.full(len(ids), np.iinfo(np.int64).min)
                for r in range(len(ids)):
                    mine = scores[r][head_rows != own[r]]
                    if len(mine) >= k:
                        bound[r] = np.partition(mine, len(mine) - k)[len(mine) - k]
                size = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                # Blocks come in descending length: a block of queries needs a leading run of them.
                reach = size[:, None] * lengths[None, :] * (1 + 1e-9) + 1e-6 >= bound[:, None].astype(np.float64)
                last = int(np.flatnonzero(reach.any(axis=0)).max()) if reach.any() else -1
                if last >= 0:
                    yield pd.DataFrame({"ids": [ids.tobytes()], "own": [own.tobytes()], "q": [q.astype(kind).tobytes()], "bound": [bound.tobytes()], "last": [last]})

    queries = rows.where(is_query).select("vec_id", "row", "v").mapInPandas(pack, "ids binary, own binary, q binary, bound binary, last int")
    queries = stored(queries, "query-blocks")
    groups = max(1, -(-queries.count() // GROUP))  # so that no task meets all query blocks
    queries = queries.withColumn("grp", F.pmod(F.xxhash64("own"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).drop("last")

    def pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(norm2=pdf["norm2"]).sort_values("norm2", ascending=False, kind="stable")
        columns = {"c_ids": pdf["vec_id"].to_numpy(np.int64), "c_own": pdf["row"].to_numpy(np.int64), "c": _matrix(pdf["v"], width).astype(kind)}
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], **{k: [x.tobytes()] for k, x in columns.items()}})

    placed = banded.join(F.broadcast(table.groupBy("band").agg(F.max("subs").alias("subs"))), "band").withColumn("sub", F.pmod(F.xxhash64("vec_id"), "subs").cast("int"))
    placed = placed.join(F.broadcast(table.select("band", "sub", "block")), ["band", "sub"])  # a row a block
    candidates = placed.select("block", "vec_id", "row", "norm2", "v").groupBy("block").applyInPandas(pack_block, "block int, c_ids binary, c_own binary, c binary")
    candidates = candidates.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, own, q, bound, c_ids, c_own, c in pdf[["ids", "own", "q", "bound", "c_ids", "c_own", "c"]].itertuples(index=False):
                ids, own, bound, c_ids, c_own = (np.frombuffer(x, np.int64) for x in (ids, own, bound, c_ids, c_own))
                q, c = (np.frombuffer(x, kind).reshape(-1, width).astype(np.int64) for x in (q, c))
                found = scored(q, c, own, c_own, c_ids, bound, rotation, k)
                if any(len(at) for at, _ in found):
                    rows = np.repeat(np.arange(len(ids)), [len(at) for at, _ in found])
                    at, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"query_id": ids[rows], "query_row": own[rows], "vec_id": c_ids[at], "vec_row": c_own[at], "score": scores})

    # Query blocks are exploded: their files' size says nothing of the join's, which must not be broadcast.
    met = queries.hint("merge").join(candidates, ["block", "grp"]).select("ids", "own", "q", "bound", "c_ids", "c_own", "c").mapInPandas(score, SCHEMA)
    ranks = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return met.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored(q: np.ndarray, c: np.ndarray, own: np.ndarray, c_own: np.ndarray, c_ids: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and scores of its k best candidates that reach its bound; candidates come longest first."""
    turned_q, turned_c = q @ rotation, c @ rotation
    bound = bound.copy()
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
    for lo in range(0, len(c), RUN_ROWS):
        run = slice(lo, lo + RUN_ROWS)
        alive = survivors(turned_q, turned_c[run], bound)
        scores = _products(q, c[run]) if alive.mean() > DENSE else None
        for r in np.flatnonzero(alive.any(axis=1)):
            mine = np.flatnonzero(alive[r] & (c_own[run] != own[r]))
            values = scores[r, mine] if scores is not None else _products(q[r : r + 1], c[lo + mine])[0]
            keep = values >= bound[r]
            at, values = np.concatenate([found[r][0], lo + mine[keep]]), np.concatenate([found[r][1], values[keep]])
            top = best(c_ids[at], values, k)
            found[r] = at[top], values[top]
            if len(top) == k:
                bound[r] = max(bound[r], values[top][-1])
    return found


def op2_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
